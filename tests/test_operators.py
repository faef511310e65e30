import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analytics, chains, compare, compose, corpus, manifest, rollouts, sampling, sft, summaries


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_ranks_are_those_of_the_sort_order(spark):
    texts = [f"{random.Random(i).random()}é"[: i % 9 + 1] for i in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["doc_id"] for r in corpus.distinct_passages(df).collect()}
    assert got == {t: i for i, t in enumerate(sorted(set(texts)))}


def test_encode_and_back(spark):
    questions = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"])], "qid long, passages array<string>")
    base = corpus.distinct_passages(spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "text string"))
    ids = corpus.encode(questions, base)
    assert {r["qid"]: r["context"] for r in ids.collect()} == {1: [1, 0, 1], 2: [2]}
    assert {r["qid"]: r["passages"] for r in corpus.with_texts(ids, base).collect()} == {1: ["b", "a", "b"], 2: ["c"]}


def test_slices_are_disjoint_and_repeatable(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    order = sampling.shuffled(df, 7, "k")
    a, b = (sampling.disjoint_slice(order, s, 50).collect() for s in (0, 50))
    assert {r["k"] for r in a}.isdisjoint(r["k"] for r in b)
    assert all(r["source_index"] == r["index"] + 50 for r in b)
    assert [r["k"] for r in sorted(a, key=lambda r: r["index"])] != list(range(50))
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(map(tuple, sampling.disjoint_slice(sampling.shuffled(df.repartition(5), 7, "k"), 0, 50).collect())) == sorted(map(tuple, a))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(ValueError):
        sampling.sliced(df, 5, 5, "k")
    for old, new in sampling.LENGTH_RANGES.values():
        assert old[1] - old[0] == 1000 and new[1] - new[0] == 1500
    spans = sorted(x for pair in sampling.LENGTH_RANGES.values() for x in pair)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_chunks(spark):
    assert [tuple(r)[1:] for r in sampling.chunk_ranges(spark, 10, 4).orderBy("node").collect()] == [(0, 3), (3, 6), (6, 9), (9, 10)]


def test_length_mix(spark):
    df = spark.range(10).select(F.col("id").alias("index"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("length"))
    got = sampling.length_mix(df, {1: 0.1, 2: 0.1, 3: 0.8}, 1).collect()
    assert Counter(r["length"] for r in got) == {1: 1, 2: 1, 3: 8} and len({r["index"] for r in got}) == 10
    first = sampling.length_mix(df, {1: 0.2, 2: 0.3, 3: 0.5}, 1, shuffle=False).collect()
    assert sorted((r["length"], r["index"]) for r in first) == [(1, 0), (1, 1), *((2, i) for i in range(3)), *((3, i) for i in range(5))]


def test_decoys_leave_out_the_own_question(spark):
    df = spark.createDataFrame([(i, f"q{i // 2}") for i in range(40)], "qid long, query string")
    got = sampling.sample_others(df, 12, 3).collect()
    assert len(got) == 40
    for r in got:
        assert len(r["distract_questions"]) == 12 and f"q{r['qid'] // 2}" not in r["distract_questions"]
    with pytest.raises(ValueError):
        sampling.sample_others(df, 40, 3)


def own(spark, context, more=()):
    return spark.createDataFrame([(1, list(context), list(more))], "qid long, context array<bigint>, more_context array<bigint>")


def test_decoys_are_never_short(spark):
    rows = [(i, "same" if i < 5 else f"q{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "qid long, query string")
    got = {r["qid"]: r["distract_questions"] for r in sampling.sample_others(df, 5, 1).collect()}
    assert len(got) == 10 and all(len(d) == 5 and dict(rows)[i] not in d for i, d in got.items())
    with pytest.raises(ValueError, match="share one text"):
        sampling.sample_others(df, 6, 1)
    assert sampling.sample_others(df.limit(0), 5, 1).count() == 0


def test_candidates_take_own_then_more_then_others(spark):
    got = compose.candidates(own(spark, [3, 5, 3], [5, 7]), 25, 10, 1).collect()
    tiers = {t: [r["doc_id"] for r in got if r["tier"] == t] for t in (0, 1, 2)}
    assert sorted(tiers[0]) == [3, 5] and tiers[1] == [7] and len(set(tiers[2])) == 10 and not {3, 5, 7} & set(tiers[2])
    small = compose.candidates(own(spark, [0]), 5, 60, 1).collect()
    assert sorted(r["doc_id"] for r in small) == [0, 1, 2, 3, 4]


def test_fit_takes_tens(spark):
    q = own(spark, [0])
    tokens = spark.range(25).select(F.col("id").alias("doc_id"), F.lit(10).alias("n_tokens"))
    all_rows = compose.candidates(q, 25, 24, 1)
    for budget, wanted in ((9, (0, 0, False)), (109, (10, 100, True)), (200, (20, 200, True)), (249, (20, 200, True)), (250, (25, 250, True))):
        got = compose.fit(all_rows, tokens, budget, 0).first()
        assert (got["num_docs"], got["tokens"], got["fits"]) == wanted
    assert compose.fit(all_rows, tokens, 250, 0, most=10).first()["num_docs"] == 10


@pytest.mark.parametrize("n", [10, 60])
def test_core_stands_in_the_middle(spark, n):
    sizes = spark.range(50).select(F.col("id").alias("qid"), F.lit(n).alias("n"), F.lit(10).alias("k"))
    got = compose.centred_slots(sizes, "n", "k", 5).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["qid"], []).append((r["core_rank"], r["slot"]))
    for s in slots.values():
        s.sort()
        places = [x for _, x in s]
        assert len(set(places)) == 10 and places == sorted(places) and 0 <= places[0] and places[-1] < n
    if n == 60:
        every = [r["slot"] for r in got]
        assert sum(15 <= x <= 44 for x in every) > 0.75 * len(every)


def test_place_core_keeps_all(spark):
    rows_ = compose.chosen(compose.candidates(own(spark, [1, 2, 3]), 100, 40, 2), 30)
    got = compose.place_core(rows_, 2).first()["context"]
    assert sorted(got) == sorted(r["doc_id"] for r in rows_.collect())
    assert compose.shuffled_context(rows_, 2).first()["context"] != sorted(got)


def samples(spark):
    text = "One. Two? Three\nFour. Five. Six? Seven. Eight. Nine. Ten. " * 3
    return spark.createDataFrame([(1, "Who?", text, [f"d{i}?" for i in range(9)]), (2, "What?", "Nothing here", [f"e{i}?" for i in range(9)])], "index long, input string, context string, distract_questions array<string>")


def test_chains_lead_to_the_question_and_come_out_again(spark):
    made = chains.chains(samples(spark), 1024, 4)
    pairs = made.select("index", F.explode("pairs").alias("pair"))
    assert pairs.count() == 2 * 4 * 4
    assert {r["index"]: r["reached"] for r in chains.walk(pairs, made.where("chain = 0").select("index", "head")).collect()} == {1: "Who?", 2: "What?"}
    assert {r["reached"] for r in chains.walk(pairs, made.where("chain = 2").select("index", "head")).collect()} == {"d2?", "e2?"}
    placed, rejected = chains.insert(samples(spark), pairs, 9)
    assert [(r["index"], r["stoppers"], r["pairs"]) for r in rejected.collect()] == [(2, 0, 16)]
    out = placed.first()["distractor_context"]
    for (pair,) in pairs.where("index = 1").select("pair").collect():
        assert out.count(pair) == 1
        out = out.replace(f" {pair}.", "", 1) if f" {pair}." in out else out.replace(f"{pair}.", "", 1)
    assert out == samples(spark).where("index = 1").first()["context"]


def test_chain_pairs_and_ids(spark, value):
    assert value(lambda i: chains.chain_pairs(i, F.lit("Q")), ["a", "b", "c"]) == ['{"a": "b"}', '{"b": "c"}', '{"c": "Q"}']
    assert value(lambda i: chains.chain_pairs(i, None), ["a", "b"]) == ['{"a": "b"}']
    assert len(value(lambda k: chains.identifier(1, k), "x")) == 36 and len(value(lambda k: chains.identifier(1, k, form=8), "x")) == 8
    assert len(value(lambda k: chains.identifier(1, k, form="nano"), "x")) == 21
    with pytest.raises(ValueError):
        chains.identifier(1, "k", form=33)
    assert chains.chain_count(16384) == 64 and sampling.decoy_count(16384) == 256


def test_too_few_decoys_stop_the_job(spark):
    with pytest.raises(Exception, match="fewer decoy"):
        chains.chains(samples(spark), 65536, 4).collect()


def test_tree(spark):
    df = spark.createDataFrame([(1, "Q?")], "qid long, input string").withColumn("ids", chains.tree_ids(3, 2, 1, "qid", form=8))
    got = [r["pair"] for r in chains.tree_pairs(df, 1, "qid").orderBy("pos").collect()]
    assert len(got) == 6 + 4 and sum('"Q?"' in p for p in got) == 1


RECORD = "source_index long, input string, context string, answers array<string>, length int, trajectories array<struct<text:string,extracted_answer:string,sub_em:int,em:int,f1:double,is_correct:int>>"


def record(i, *scores):
    return (i, "q?", "ctx", ["Paris"], 4096, [(f"t{k}</think>\\boxed{{Paris}}" if s is not None else "  ", "Paris", int((s or 0) > 0), 0, s or 0.0, int((s or 0) > 0)) for k, s in enumerate(scores)])


def test_best_of_n(spark):
    df = spark.createDataFrame([record(0, 0.0, 0.0), record(1, 0.7, 1.0, 0.8), record(2, 0.0, 1.0, 1.0), record(3, None, 0.5)], RECORD)
    converted = sft.convert(df, "d", "m")
    assert converted.count() == 9 and "ctx" in converted.first()["messages"][0]["content"] and "q?" in converted.first()["messages"][0]["content"]
    assert sft.convert(df, "d", "m", skip_empty=False).count() == 10
    best = {r["source_index"]: r["traj_pos"] for r in sft.best_of(converted).collect()}
    assert best == {1: 1, 2: 1, 3: 1}
    good, bad = sft.fused(df, "d", "m")
    assert good.where("source_index = 1").first()["messages"][1]["content"] == "<think>t1</think>Paris" and bad.count() == 0


def test_rules(spark):
    kind = "messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b")],), (None,), ([],), ([("assistant", "a"), ("user", "b")],), ([("user", ""), ("assistant", None)],)], kind)
    got = [r["e"] for r in df.select(sft.rule_errors(F.col("messages")).alias("e")).collect()]
    assert got[0] == [] and "messages" in got[1][0] and "non-empty" in got[2][0] and "assistant" in got[3][0] and len(got[4]) == 2
    assert sft.conforms(df, kind) == [] and sft.conforms(df, "is_correct int") == ["is_correct"]


def test_merge(spark):
    a = spark.createDataFrame([("d", 1, 1), ("d", 1, 2), ("d", 2, 3)], "dataset string, length int, x int")
    b = spark.createDataFrame([("d", 1, 1), ("e", 1, 5)], "dataset string, length int, x int")
    assert sft.merged(a, b).count() == 5
    got = {(r["dataset"], r["length"]): (r["existing"], r["incremental"], r["merged"]) for r in sft.merge_counts(a, b).collect()}
    assert got == {("d", 1): (2, 1, 3), (None, None): (2, 1, 3)}


def test_integrity_checks(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "row_idx long, input string")
    b = spark.createDataFrame([(0, "x"), (1, "z")], "row_idx long, input string")
    assert [tuple(r) for r in compare.differences(a, b).collect()] == [(1, "y", "z")]
    with pytest.raises(AssertionError):
        compare.differences(a, b.limit(1))
    with pytest.raises(AssertionError):
        compare.zipped(a, b.limit(1).withColumnRenamed("input", "o"))
    with pytest.raises(AssertionError):
        compare.union_counted([a, b], 5)
    assert compare.union_counted([a, b], 4).count() == 4


def test_model_boundary(spark):
    prompts = spark.createDataFrame([(1, "a b c"), (2, "")], "id long, prompt string")
    got = rollouts.generate(prompts, rollouts.fake_model, 3)
    assert got.count() == 6 and got.orderBy("id", "pos").collect() == rollouts.generate(prompts.repartition(3), rollouts.fake_model, 3).orderBy("id", "pos").collect()

    def failing():
        def model(prompt, n):
            raise RuntimeError("down")

        return model

    assert {r["text"] for r in rollouts.generate(prompts, failing, 2, attempts=2, wait=0.0).collect()} == {""}


def test_failed_calls_are_told(spark):
    def start():
        def model(prompt, n):
            if prompt == "bad":
                raise OSError("no line")
            return [prompt] * n

        return model

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")
    got = rollouts.generate(df, start, 2, attempts=2, wait=0.0, errors=True).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "good", None), (1, 1, "good", None), (2, -1, "", "OSError: no line")]
    plain = rollouts.generate(df, start, 2, attempts=1, wait=0.0).collect()
    assert sorted(map(tuple, plain)) == [(1, 0, "good"), (1, 1, "good"), (2, 0, ""), (2, 1, "")]


def test_bands_and_selection(spark):
    first = rollouts.bands(spark.createDataFrame([(i, float(t)) for i, t in enumerate((0, 0, 3, 7, 8))], "id long, total_cem_score double"))
    second = rollouts.bands(spark.createDataFrame([(0, 4.0), (1, 8.0), (3, 2.0)], "id long, total_cem_score double"))
    assert [r["band"] for r in first.orderBy("id").collect()] == ["all_wrong", "all_wrong", "mixed", None, None]
    assert sorted(r["id"] for r in rollouts.selected(first, second).collect()) == [0, 2]


def test_analytics(spark, value):
    assert value(lambda x: analytics.bin_of(x), 16384) == "16k-32k" and value(lambda x: analytics.bin_of(x), 65536) is None
    assert value(lambda x: analytics.bin_of(x, analytics.CHOICE_BINS), 65536) == ">64k"
    assert value(analytics.fixed_reward, 0.5, 100, 50) == pytest.approx(0.548828125)
    assert value(analytics.classify, "Passage 2: x") == "long_qa" and value(analytics.classify, "Passage 2: UUID") == "long_qa_chain" and value(analytics.classify, "x") is None
    log = spark.createDataFrame([(1, "c", "a", 0.5)] * 5 + [(1, "c", "b", 0.5)] * 7 + [(1, "c", "d", 1.0)] * 20 + [(1, "c", "e", 0.0), (1, "c", "e", 1.0)], "step long, cls string, input string, score double")
    inputs = analytics.per_input(log)
    wide = analytics.score_bins(inputs).first()
    assert (wide["bin_2"], wide["bin_4"], wide["bin_1"]) == (1, 1, 1)  # 2.5 and 3.5 go to the even neighbour
    assert analytics.occurrence_bins(inputs).first()["bin_16"] == 1
    assert analytics.step_scores(log).first()["varied_inputs"] == 1


def test_manifest(spark):
    m = None
    for stage, samples_, at in (("generated", 10, "2024-01-01"), ("filtered", 7, "2024-01-02"), ("filtered", 8, "2024-01-03")):
        m = manifest.record(m, "d", 4096, stage, samples_, "f", at, spark)
    expected = spark.createDataFrame([("d", 4096), ("d", 8192)], "dataset string, length int")
    states = {r["length"]: (r["status"], r["current_stage"], r["samples"]) for r in manifest.status(m, expected).collect()}
    assert states == {4096: ("in_progress", "filtered", 8), 8192: ("pending", "-", 0)}
    done = manifest.record(m, "d", 4096, "merged", 8, "f", "2024-01-04", spark)
    assert manifest.roll_up(manifest.status(done, expected)).first()["percent_complete"] == 50.0
    with pytest.raises(ValueError):
        manifest.record(m, "d", 1, "other", 0, "f", "2024-01-01", spark)


def test_summaries(spark):
    ask = "User: " + "word " * 50 + "\n\nQ: Write a summary\n\nAssistant:"
    df = spark.createDataFrame([(ask, ["x " * 30], 0, 5), (ask, ["x"], 7, None), ("User: hi", [], None, None), ("write a summary", ["y"], None, 3)], "question string, answer array<string>, `word count` long, word_count long")
    got = summaries.summary_rows(df, least_in=40, least_out=20)
    assert [r["reject_reason"] for r in got.collect()] == [None, "output_too_short", "no_keyword", "input_too_short"]
    assert [r["words"] for r in got.collect()] == [5, 7, None, 3]
    assert got.first()["messages"][0]["content"].endswith("Q: Write a summary") and not got.first()["messages"][0]["content"].startswith("User")
