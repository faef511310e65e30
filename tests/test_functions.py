import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import counting, extract, score, text


def plain_norm(s, articles_first):
    s = s.lower()
    drop = lambda x: "".join(c for c in x if c not in string.punctuation)
    art = lambda x: re.sub(r"\b(a|an|the)\b", " ", x)
    s = drop(art(s)) if articles_first else art(drop(s))
    return " ".join(s.split())


def plain_f1(p, g):
    p, g = p.split(), g.split()
    same = sum((Counter(p) & Counter(g)).values())
    return 2 * same / (len(p) + len(g)) if same else 0.0


GOLDEN = [
    (text.normalize_articles_first, ("The answer",), "answer"),
    (text.normalize_articles_first, ("a cat and an owl",), "cat and owl"),
    (text.normalize_articles_first, ("Arthur's Magazine",), "arthurs magazine"),
    (text.normalize_articles_first, ("  foo   bar  ",), "foo bar"),
    (text.normalize_punctuation_first, ("a-b",), "ab"),
    (text.normalize_articles_first, ("a-b",), "b"),
    (text.normalize_punctuation_first, ("the.end",), "theend"),
    (text.normalize_articles_first, ("the.end",), "end"),
    (extract.think_answer, ("<think>x</think>\\boxed{Arthur's Magazine}",), "Arthur's Magazine"),
    (extract.think_answer, ("\\boxed{x}",), None),
    (extract.think_answer, ("a</think>nothing",), None),
    (extract.think_answer, ("a</think>b</think>\\boxed{final}",), "final"),
    (extract.think_answer, ("a</think>**\\boxed{yes}**",), "yes"),
    (extract.think_answer, ("a</think>\\boxed {x}",), "{x}"),
    (extract.clean_trace, ("a</think>\\boxed {x}",), "<think>a</think>{x}"),
    (extract.unbox, ("\\boxed 7",), "7"),
    (extract.unbox, ("\\boxed{7}",), "7"),
    (extract.unbox, ("\\fbox{7}",), "\\fbox{7}"),
    (extract.after_first, ("The answer is A. No, the answer is B. ok",), "A. No, the answer is B. ok"),
    (extract.after_first, ("nothing",), ""),
    (extract.after_last, ("The answer is A. No, the answer is B. ok",), "B"),
    (extract.after_last, ("**The answer is:** 3.5 m",), "3.5 m"),
    (extract.after_last, ("the answer is .",), None),
    (extract.after_last, ("nothing",), None),
    (extract.last_boxed, ("\\boxed{a",), None),
    (extract.last_boxed, ("\\boxed{a} \\boxed{b{c}d} x",), "\\boxed{b{c}d}"),
    (extract.last_boxed_or_framed, ("x \\boxed 7$ y",), "\\boxed 7"),
    (lambda t: extract.unbox_any(extract.last_boxed_or_framed(t)), ("\\fbox{abc}",), "abc"),
    (extract.judged, ("\\boxed{}",), extract.NO_BOX),
    (extract.judged, ("so The Answer is **Paris.**",), "paris"),
    (extract.clean_trace, ("reasoning here</think>\\boxed{Paris}",), "<think>reasoning here</think>Paris"),
    (extract.clean_trace, ("think</think>\\boxed{A {nested} answer}",), "<think>think</think>A {nested} answer"),
    (extract.clean_trace, ("think</think>\n\\boxed{yes}",), "<think>think</think>yes"),
    (extract.clean_trace, ("no tag",), None),
    (extract.unwrap_text, ("\\text{ab}",), "ab"),
    (extract.option_standard, ("Final answer: (c)",), "c"),
    (extract.option_standard, ("Answer: **D**.",), "D"),
    (extract.option_boxed, ("so \\boxed{(b) x}",), "B"),
    (extract.option_original, ("The correct answer is **(D)**",), "D"),
    (extract.without_role_tags, ("User: q\n\nAssistant:",), "q"),
    (extract.without_role_tags, ("q Assistant: r",), "q Assistant: r"),
    (score.covered, ("new york city", ["new york"]), 0.0),
    (score.covered, ("new york", ["new york city"]), 1.0),
    (score.covered, ("", ["x"]), 0.0),
    (score.covered, ("The", ["x"]), 1.0),
    (score.judge_match, ("new york city", ["new york"]), 1),
    (score.judge_match, ("x", []), 0),
    (text.size_label, (4000,), "1K"),
    (text.size_label, (127900,), "128K"),
    (text.size_label, (1000000,), "1M"),
    (text.size_label, (64000,), "60K"),
    (text.as_list, ('["a", "b"]',), ["a", "b"]),
    (text.as_list, ("a",), ["a"]),
    (text.as_list, (None,), []),
    (counting.native, ("ab cd-e.",), 5),
    (counting.native, (None,), 0),
]


def test_golden_vectors(value):
    wrong = [(args, got, wanted) for function, args, wanted in GOLDEN if (got := value(function, *args)) != wanted]
    assert not wrong


@pytest.mark.parametrize(
    ("pred", "golds", "wanted"),
    [("x", ["x"], (1, 1, 1.0)), ("Arthur's Magazine was the first", ["Arthur's Magazine"], (1, 0, None)), ("First for Women", ["Arthur's Magazine"], (0, 0, 0.0)), (None, ["x"], (0, 0, 0.0)), ("x", [], (0, 0, 0.0)), ("yes", ["no", "yes"], (1, 1, 1.0)), ("new york city", ["new york"], (1, 0, 0.8)), ("The", ["Paris"], (1, 0, 0.0))],
)
def test_rewards(value, pred, golds, wanted):
    got = value(score.rewards, pred, golds)
    assert (got["sub_em"], got["em"]) == wanted[:2]
    assert wanted[2] is None or got["f1"] == pytest.approx(wanted[2])


def test_against_plain_python(spark):
    rnd = random.Random(3)
    words = ["the", "a", "an", "a-b", "New", "york", "É", "x.", "aé", "á", " ", "　", "(the)", "the.end", "'", "a"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(8))), " ".join(rnd.choices(words, k=rnd.randrange(5)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "p string, g string")
    r = score.rewards(F.col("p"), F.array("g"))
    columns = ["p", "g", text.normalize_punctuation_first(F.col("p")).alias("pa"), text.normalize_articles_first(F.col("p")).alias("ap"), text.normalize_articles_first(F.col("g")).alias("ag")]
    got = df.select(*columns, r["f1"].alias("f1")).collect()
    staged = score.with_rewards(df.withColumn("golds", F.array("g")), "p").select(*columns, "f1").collect()
    assert got == staged
    for row in got:
        assert row["pa"] == plain_norm(row["p"], False)
        assert row["ap"] == plain_norm(row["p"], True)
        assert row["f1"] == pytest.approx(plain_f1(row["ap"], row["ag"]) if row["p"] else 0.0)


def test_white_space_is_that_of_split():
    from corpusloom.functions.text import SPACES

    wanted = [c for c in range(0x3100) if chr(c).isspace()]
    pattern = re.compile(f"[{SPACES}]")
    assert [c for c in range(0x3100) if pattern.match(chr(c))] == wanted


def test_templates_fill_in_one_pass(value):
    assert value(lambda c, i: text.fill("<{context}|{input}>", context=c, input=i), "a {input} % b", "q") == "<a {input} % b|q>"


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        counting.counter("other")
    with pytest.raises(ValueError):
        extract.option(F.lit("x"), F.lit("y"), "other")


def test_vocabulary_counters(value):
    public = pytest.importorskip("public_tokenizers")
    assert value(counting.counter("byte_pair", public.path("byte_bpe_50k.json")), "hello world") == 2
    assert value(counting.counter("sentence_pieces", public.path("piece_bpe_32k.model")), "hello world") >= 2
    assert value(counting.counter("byte_pair", public.path("byte_bpe_50k.json")), None) == 0
    ranks = counting.counter("ranks", public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    for text in ("hello world", "It's 12 <|endoftext|> \u00e9\n\n x", ""):
        assert value(ranks, text) == value(counting.counter("byte_pair", public.path("byte_bpe_50k.json")), text) or "<|" in text
