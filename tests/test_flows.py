import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import counting
from corpusloom.operators import chains, sft
from corpusloom.plans import flows


@pytest.fixture(scope="module")
def questions(spark):
    rnd = random.Random(4)
    texts = [f"T{i}\n" + " ".join(f"w{rnd.randrange(99)}" for _ in range(20)) + ". And more. Yes?" for i in range(120)]
    rows = [(f"q{i}", f"Who is {i}?", [f"w{i}"], [texts[(5 * i + k) % 120] for k in range(4)], [0, 2, 2]) for i in range(24)]
    return spark.createDataFrame(rows, "id string, query string, outputs array<string>, passages array<string>, support array<int>")


@pytest.mark.parametrize("middle", [False, True])
def test_synthesis(spark, questions, middle):
    samples, misfits = flows.synthesise(questions, 900, 100, num_samples=10, pre_samples=3, core_in_middle=middle)
    got = samples.collect()
    assert len(got) == 10 and misfits.count() == 0
    own = {r["id"]: r["passages"] for r in questions.collect()}
    for r in got:
        assert r["source_index"] == r["index"] + 3 and r["length"] <= 900
        n = r["context"].count("Passage ")
        assert n % 10 == 0 and n >= 10 and all(p in r["context"] for p in own[r["id"]])
        assert r["context"].startswith("Passage 1:\n") and f"\n\nPassage {n}:\n" in r["context"]
    none, bad = flows.synthesise(questions, 120, 100, num_samples=2)
    assert none.count() == 0 and bad.count() == 2
    with pytest.raises(AssertionError):
        flows.synthesise(questions, 900, num_samples=25)


def test_hidden_questions(spark, questions):
    samples, _ = flows.synthesise(questions, 1024, 10, num_samples=4)
    hidden, rejected = flows.hide_questions(samples, questions, 1024)
    assert hidden.count() + rejected.count() == 4
    for r in hidden.collect():
        at = r["chain_head"]
        for _ in range(chains.HOPS):
            at = r["distractor_context"].split(f'{{"{at}": "')[1].split('"}')[0]
        assert at == r["input"]


def test_supporting_only(questions):
    got = flows.relevant_only(questions).where("id = 'q1'").first()
    assert got["context"].count("Passage ") == 3


def oracle(right):
    def start():
        def model(prompt, n):
            word = prompt.split("Who is ")[1].split("?")[0]
            good = right(int(word))
            return [f"<think>x</think>The answer is {'w' + word if k < good else 'zzz'}. \\boxed{{{'w' + word if k < good else 'zzz'}}}" for k in range(n)]

        return model

    return start


def test_difficulty_and_training_rows(spark, questions):
    flat = questions.select("id", "query", "outputs", F.array_join("passages", "\n").alias("context"))
    # the first model's answer runs to the end of its text and so is never covered: all go to the second one
    selected, first, second = flows.difficulty(flat, oracle(lambda i: 0), oracle(lambda i: i % 9), 8)
    assert first.where("band = 'all_wrong'").count() == 24 and second.count() == 24
    assert selected.count() == second.where("not_extreme").count()
    samples = flat.select(F.expr("CAST(substring(id, 2) AS BIGINT)").alias("index"), F.expr("CAST(substring(id, 2) AS BIGINT)").alias("source_index"), F.col("query").alias("input"), "context", F.col("outputs").alias("answers"), F.lit(4096).alias("length"))
    records = flows.trajectories(samples, oracle(lambda i: i % 3), 4)
    assert {r["num_correct"] for r in records.where("index % 3 = 2").collect()} == {2} and records.where("pass_rate = 0.5").count() == 8
    existing = sft.convert(records, "d", "m").limit(2).drop("traj_pos")
    merged, rejected = flows.incremental(existing, samples, oracle(lambda i: i % 3), "d", "m")
    assert merged.count() == 2 + 16 and rejected.count() == 0
    assert merged.where("origin = 'incremental'").first()["messages"][1]["content"].startswith("<think><think>x</think>w")
    asked = flat.select("id", F.col("query").alias("asked"), F.col("outputs").alias("gold"))
    assert flows.not_solved_again(asked, oracle(lambda i: 8 if i % 2 else 3)).count() == 12
    assert flows.longest_model_input([4096, 8192], 512) == 8704
    assert counting.native is not None
