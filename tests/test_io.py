import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.sources import adapters, readers, sinks
from corpusloom.streaming import scoring


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


PAIRED = [
    {"_id": "a", "question": "q1", "answer": "x", "context": [["T", ["s1.", "s2."]], ["U", ["v."]]], "supporting_facts": [["T", 0], ["T", 1]], "level": "hard"},
    {"_id": "b", "question": "q2", "answer": "y", "context": [["T", ["s1.", "s2."]]], "supporting_facts": [["No", 0]], "level": "easy"},
]
PARAGRAPHS = [
    {"id": "2hop__1", "question": "q", "answer": "x", "answerable": True, "paragraphs": [{"idx": 4, "title": "A", "paragraph_text": "a"}, {"idx": 9, "title": "B", "paragraph_text": "b"}], "question_decomposition": [{"paragraph_support_idx": 9}]},
    {"id": "3hop__1", "question": "q", "answer": "x", "answerable": True, "paragraphs": [{"idx": 0, "title": "A", "paragraph_text": "a"}], "question_decomposition": [{"paragraph_support_idx": 0}, {"paragraph_support_idx": None}]},
    {"id": "4hop__1", "question": "q", "answer": "x", "answerable": False, "paragraphs": [], "question_decomposition": []},
]
ARTICLES = {"data": [{"paragraphs": [{"context": "c1", "qas": [{"question": "q1", "is_impossible": False, "answers": [{"text": "x"}]}, {"question": "q2", "is_impossible": True, "answers": []}]}, {"context": "c2", "qas": []}]}]}


def test_question_sets(spark, tmp_path):
    one = write(f"{tmp_path}/hotpot/train.json", json.dumps(PAIRED))
    got = {r["id"]: r for r in readers.questions(spark, one).collect()}
    assert got["a"]["passages"] == ["T\ns1.s2.", "U\nv."] and got["a"]["support"] == [0, 0] and got["b"]["support"] == [] and got["a"]["outputs"] == ["x"]
    assert adapters.flattened(readers.questions(spark, one)).where("id = 'a'").first()["context"] == "T\ns1.s2.\nU\nv."
    two = write(f"{tmp_path}/musique/train.jsonl", "\n".join(map(json.dumps, PARAGRAPHS)))
    got = {r["id"]: r for r in readers.questions(spark, two).collect()}
    assert set(got) == {"2hop__1", "3hop__1"} and got["2hop__1"]["support"] == [1] and got["3hop__1"]["support"] == [0]
    hard = adapters.paragraphs(readers.json_lines(spark, two, schemas.PARAGRAPH_QUESTION), hard_only=True)
    assert [r["id"] for r in hard.collect()] == ["3hop__1"]
    three = write(f"{tmp_path}/squad/dev.json", json.dumps(ARTICLES))
    (row,) = readers.questions(spark, three).collect()
    assert (row["query"], row["passages"], row["more"], row["outputs"]) == ("q1", ["c1"], ["c2"], ["x"])
    with pytest.raises(NotImplementedError):
        readers.questions(spark, f"{tmp_path}/other.json")


def test_json_lines_strict_and_lenient(spark, tmp_path):
    path = write(f"{tmp_path}/x.jsonl", '{"index": 1, "input": "a"}\n\n{"index": 2, "inp\n{"index": 3, "input": "c"}\n')
    schema = "index long, input string"
    with pytest.raises(Exception):
        readers.json_lines(spark, path, schema).collect()
    good, bad = readers.json_lines_lenient(spark, path, schema)
    assert sorted(r["index"] for r in good.collect()) == [1, 3]
    assert [r["line"] for r in bad.collect()] == ['{"index": 2, "inp']
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.txt", schema)
    assert readers.by_extension(spark, write(f"{tmp_path}/y.json", '[{"index": 1}, {"index": 2}]'), schema).count() == 2


def test_step_logs_and_chunks(spark, tmp_path):
    for step in (1, 3):
        write(f"{tmp_path}/log/global_step_{step}.json", json.dumps([{"input": "p", "score": 0.5}, {"input": "p", "score": 1.0}]))
    rows, missing = readers.step_logs(spark, f"{tmp_path}/log", range(1, 4))
    assert sorted((r["step"], r["score"]) for r in rows.collect()) == [(1, 0.5), (1, 1.0), (3, 0.5), (3, 1.0)]
    assert [r["step"] for r in missing.collect()] == [2]
    found = readers.with_file(spark.read.text(f"{tmp_path}/log")).select("file_name")
    expected = spark.createDataFrame([("global_step_1.json",), ("global_step_2.json",)], "file_name string")
    assert [r["file_name"] for r in readers.expected_chunks(found, expected).collect()] == ["global_step_2.json"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, "é"), ("d", 2, None)], "dataset string, length int, text string")
    sinks.json_lines(df, f"{tmp_path}/j", by=("dataset", "length"))
    assert readers.json_lines(spark, f"{tmp_path}/j", "dataset string, length int, text string").count() == 2
    sinks.csv(df, f"{tmp_path}/c")
    assert readers.csv(spark, f"{tmp_path}/c", "dataset string, length int, text string").where("text = 'é'").count() == 1
    sinks.parquet(df, f"{tmp_path}/p/one")
    assert readers.parquet(spark, f"{tmp_path}/p", recursive=True).count() == 2
    assert readers.parquet(spark, f"{tmp_path}/p/one:{tmp_path}/p/one").count() == 4
    sinks.summary(df.agg(F.count("*").alias("n")), f"{tmp_path}/s")
    assert spark.read.schema("n long").json(f"{tmp_path}/s").first()["n"] == 2
    made = []
    for _ in range(2):
        assert sinks.reused(spark, f"{tmp_path}/r", lambda: made.append(1) or df).count() == 2
    assert made == [1]
    assert sinks.output_stem("train-num_sample_1000-max_seq_4096-long", "tag", "cleaned") == "train-num_sample_1000-max_seq_4096-tag-cleaned"
    assert sinks.merged_stem("a-num_sample_1000-b") == "a-num_sample_2500-b"
    with pytest.raises(ValueError):
        sinks.output_stem("x", "t", "s")


def test_ascii_lines(spark, tmp_path):
    texts = ["plain", "é ü 漢", "🙂 a\u0301", 'quote " and \\ back\nline', "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    sinks.json_lines(df, f"{tmp_path}/a", ascii_only=True)
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/a").collect()]
    assert all(x.isascii() for x in lines) and sorted(json.loads(x)["i"] for x in lines) == list(range(6))
    assert {json.loads(x)["i"]: json.loads(x)["text"] for x in lines} == dict(enumerate(texts))
    assert '"\\u00e9 \\u00fc \\u6f22"' in "".join(lines)
    with pytest.raises(ValueError):
        sinks.json_lines(df, f"{tmp_path}/b", by=("i",), ascii_only=True)


def test_shared_folder_of_a_cluster_has_to_be_named():
    from types import SimpleNamespace as Fake

    from corpusloom.sources import storage

    unset = Fake(isDefined=lambda: False)
    context = Fake(_jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: unset)), setCheckpointDir=lambda folder: None, master="spark://there:7077")
    session = Fake(conf=Fake(get=lambda name, default: None), sparkContext=context)
    for master in ("spark://there:7077", "yarn", "local-cluster[2,1,1024]"):
        context.master = master
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            storage.shared_folder(session)
    context.master = "local[8]"
    assert storage.shared_folder(session).startswith("/")


def test_rl_rows(spark):
    one = spark.createDataFrame([("p", (["g"],))], "prompt string, reward_model struct<ground_truth:array<string>>")
    two = spark.createDataFrame([([("user", "p")], (["g"],))], "prompt array<struct<role:string,content:string>>, reward_model struct<ground_truth:array<string>>")
    for df in (one, two):
        row = adapters.normal_rl(df).first()
        assert (row["asked"], row["gold"]) == ("p", ["g"])


def test_golds_are_looked_up_where_they_are(spark):
    struct = "struct<ground_truth:array<string>>"
    cases = [
        ("prompt string, answers array<string>", ("p", ["a"]), ("p", ["a"])),  # no reward model at all
        (f"question string, prompt string, outputs array<string>, reward_model {struct}", ("q", "p", None, (["g"],)), ("q", ["g"])),
        ("input string, gold string", ("i", "g"), ("i", ["g"])),
        ("prompt array<struct<role:string,content:string>>, label long", ([], 3), (None, ["3"])),
        ("prompt string, reward_model struct<style:string>", ("p", ("x",)), ("p", None)),
    ]
    for schema, row, wanted in cases:
        got = adapters.normal_rl(spark.createDataFrame([row], schema)).first()
        assert (got["asked"], got["gold"]) == wanted, schema


def test_streams(spark, tmp_path):
    write(f"{tmp_path}/in/a.json", json.dumps({"id": "1", "pos": 0, "text": "x</think>\\boxed{Paris}", "golds": ["Paris"], "at": "2024-01-01T00:00:00Z"}))
    stream = scoring.scored(scoring.read_rollouts(spark, f"{tmp_path}/in"))
    for n in (1, 2):
        scoring.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == n and spark.read.parquet(f"{tmp_path}/out").first()["f1"] == 1.0
        write(f"{tmp_path}/in/b.json", json.dumps({"id": "2", "pos": 0, "text": "y", "golds": ["Paris"], "at": "2024-01-01T00:00:00Z"})) if n == 1 else None
        if n == 1:
            continue
        assert spark.read.parquet(f"{tmp_path}/out").where("id = '2'").first()["f1"] in (0.0, 1.0)
    events = spark.createDataFrame([(1, "2024-01-01 01:00:00", "c", 1.0), (1, "2024-01-01 01:00:00", "c", 1.0), (2, "2024-01-01 02:00:00", "c", 0.0), (3, "2024-01-09 00:00:00", "c", 0.0)], "event_id int, at string, cls string, score double")
    events.select("event_id", F.to_timestamp("at").alias("ts"), "cls", "score").write.parquet(f"{tmp_path}/events")
    source = spark.readStream.schema("event_id int, ts timestamp, cls string, score double").parquet(f"{tmp_path}/events")
    scoring.run_to_table(scoring.windowed_scores(source), f"{tmp_path}/win", f"{tmp_path}/win_state").awaitTermination(60)
    (first,) = spark.read.parquet(f"{tmp_path}/win").where("n > 1").collect()
    assert (first["avg_score"], first["n"]) == (0.5, 2)


@pytest.mark.parametrize("n", [40, 140, 700])
def test_missing_chunks_look_at_every_document(spark, tmp_path, n):
    from corpusloom.plans.queries import QUERIES

    spark.range(n).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    found = {f"chunk_{i // -(-n // 5)}" for i in range(n)}
    wanted = [f"chunk_{i}" for i in range(7) if f"chunk_{i}" not in found]
    assert sorted(r["file_name"] for r in QUERIES["s12_missing_chunks"](spark, str(tmp_path)).collect()) == wanted
    spark.range(n - n // 5, n).withColumnRenamed("id", "doc_id").union(spark.range(1, n - n // 5 + 1).select((F.col("id") * 0 + n - 1))).write.parquet(f"{tmp_path}/late/documents.parquet")
    late = [r["file_name"] for r in QUERIES["s12_missing_chunks"](spark, f"{tmp_path}/late").collect()]
    assert sorted(late) == [f"chunk_{i}" for i in (0, 1, 2, 3, 5, 6)]


@pytest.fixture
def files(monkeypatch):
    """Bytes of the files that a query had in its folder before it removed it, by the folder they are in."""
    from corpusloom.plans import queries

    found, remove = {}, queries.remove

    def seen(spark, path):
        top = path.removeprefix("file:")
        for folder, _, names in os.walk(top):
            sizes = [os.path.getsize(f"{folder}/{n}") for n in names if n.startswith("part-")]
            found.update({os.path.relpath(folder, top): sizes} if sizes else {})
        remove(spark, path)

    monkeypatch.setattr(queries, "remove", seen)
    return found


def events(spark, folder, n, users):
    """n events of days 1 to 3, by turns of so many users; some without a user."""
    rows = spark.range(n).selectExpr("id AS event_id", "timestamp_seconds(86400 * (id % 3)) AS ts", f"IF(id % 7 = 0, NULL, id % {users}) AS user_id", "IF(id % 2 = 0, 'a', 'b') AS event_type", "CAST(id % 5 AS DOUBLE) AS value", "'{}' AS props")
    rows.coalesce(2).write.parquet(f"{folder}/events.parquet")
    return sorted((i % 3 + 1, "ab"[i % 2], float(i % 5 % 2)) for i in range(n))


def test_step_logs_need_files_by_bytes_not_by_users(spark, tmp_path, files):
    from corpusloom.plans import queries

    rows = events(spark, tmp_path, 3000, 3000)
    found = {(r["step"], r["input"]): (r["n"], r["total"]) for r in queries.s9_step_logs(spark, str(tmp_path)).collect()}
    assert found == {k: (len(s), sum(s)) for k in {r[:2] for r in rows} if (s := [r[2] for r in rows if r[:2] == k])}
    assert {k: len(v) for k, v in files.items()} == {f"log=global_step_{d}.json": 1 for d in (1, 2, 3)}  # one for each 50 users before


@pytest.mark.parametrize("users", [1, 3000])
def test_step_logs_of_many_bytes_have_more_files(spark, tmp_path, files, monkeypatch, users):
    from corpusloom.plans import queries

    monkeypatch.setattr(queries, "ARRAY_BYTES", 4000)
    rows = events(spark, tmp_path, 3000, users)
    assert sorted(map(tuple, queries._step_logs(spark, str(tmp_path), lambda found: found[0]).collect())) == rows
    assert len(files) == 3 and all(len(v) == 7 and max(v) < 6000 for v in files.values())  # 1,000 records of 25 bytes each


def test_missing_steps_list_as_many_files_for_many_users_as_for_one(spark, tmp_path, files):
    from corpusloom.plans import queries

    counts = []
    for users in (1, 3000):
        files.clear()
        events(spark, f"{tmp_path}/{users}", 3000, users)
        assert sorted(r["step"] for r in queries.s9_missing_steps(spark, f"{tmp_path}/{users}").collect()) == list(range(4, 41))
        counts.append({k: len(v) for k, v in files.items()})
    assert counts[0] == counts[1] and len(counts[0]) == 3  # each file's status goes to the driver
