"""Each stage of the pipeline against plain Python, over what the stage before it kept."""

import hashlib
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_duplicates import plain_fingerprint, union
from test_mix_tokens_pack import check_packing, water
from test_text_operators import ALPHABETS, brute_spans, tongue

from corpusloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __lang string, __tag int, `__id` string, __again boolean, size int, slot string, bucket double, tag string"


def made_rows():
    rnd = random.Random(12)
    out = []
    for i in range(160):
        lang = rnd.choice(list(ALPHABETS))
        text = tongue(rnd, ALPHABETS[lang], rnd.choice([4, 30, 120]))
        if i % 10 == 3:
            text += f" call +1 (555) 555-01{i % 90 + 10} or me{i}@mail.org now"
        out.append([i * 3 + 1, text, lang if i % 4 else None, rnd.choice(["web", "web", "web", "books", None])])
    out += [[1000 + i, out[7][1], "aa", "web"] for i in range(4)]  # exact copies
    out += [[2000, out[11][1], None, None], [2001, out[11][1], "bb", "books"]]
    out += [[3000, None, "aa", "web"], [3001, "", None, "web"], [3002, "123 !? 4", "bb", "web"], [3003, "漢字仮名交文" * 30, None, "web"], [None, tongue(rnd, ALPHABETS["aa"], 25), None, "web"], [None, None, None, None]]
    out += [list(out[20]), list(out[20])]  # rows that repeat one as it is
    return [(i, t, lang, s, None if t is None else len(t), "x", 5, "y", True, 7, "z", 0.5, "w") for i, t, lang, s in out]


def plain_grams(text, buckets):
    letters = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    runs = [0]
    for c in letters:
        if c or runs[-1]:
            runs.append(c)
    if runs[-1]:
        runs.append(0)
    counts, mask, shift = {}, 0xFFFFFFFF, 32 - (buckets.bit_length() - 1)

    def add(h):
        h = (h ^ (h >> 15)) * 0x9E3779B1 & mask
        counts[h >> shift] = counts.get(h >> shift, 0) + 1

    if any(runs):
        twos = [(a * 0x85EBCA77 ^ b * 0xC2B2AE3D) & mask for a, b in zip(runs, runs[1:])]
        for a in runs:
            if a:
                add(a * 0x9E3779B1 & mask)
        for h in twos:
            add(h)
        for h, c in zip(twos, runs[2:]):
            add((h * 0x27D4EB2F ^ c * 0x165667B1) & mask)
    return counts


def plain_language(text, model):
    """(language, cosine, rejected) by going through all centroids."""
    counts = plain_grams(text or "", model.buckets)
    if not counts:
        return "und", 0.0, True
    v = {b: math.log1p(n) * float(model.idf[b]) for b, n in counts.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    cosine, lang = max((sum(x * float(c[b]) for b, x in v.items()) / length, name) for c, name in zip(model.centroids, model.langs))
    return lang, cosine, cosine < model.floors[min(len(text).bit_length() - 1, len(model.floors) - 1)]


def plain_mix(rows):
    """(doc_id, words) of each take, by the rule: targets, an order by hash, streams that repeat."""
    words = lambda t: (t or "").encode().split()
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    sizes = {s: sum(len(words(r["text"])) for r in group) for s, group in sources.items()}
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    targets = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    takes = []
    for s, group in sources.items():
        left = math.floor(targets[s] + 0.5)
        key = lambda r: hashlib.md5(":".join(["mix", *([] if r["doc_id"] is None else [str(r["doc_id"])]), hashlib.md5((r["text"] or "").encode()).hexdigest()]).encode()).hexdigest()
        for r in sorted(group, key=key) * 2:
            n = min(left, len(words(r["text"])))
            left -= n
            if n:
                takes.append((r["doc_id"], n))
    return takes


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, and what each stage made of the one before, as rows."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(made_rows(), SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1][1], str(folder)).write.parquet(f"{folder}/{name}")
        out.append((name, spark.read.parquet(f"{folder}/{name}")))
    assert all(d.columns == docs.columns for _, d in out[:-1])
    return dict(out) | {"folder": str(folder)}


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", str(r["lang"]))


def test_language_stage(stages):
    model = langid.fit(stages["documents"])
    wanted = []
    for r in stages["documents"].collect():
        lang, _, rejected = plain_language(r["text"], model)
        if not rejected:
            wanted.append(r.asDict() | {"lang": r["lang"] or lang})
    got = [r.asDict() for r in stages["language"].collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key) and 160 <= len(got) < len(made_rows())
    assert {r["doc_id"] for r in stages["documents"].collect()} - {r["doc_id"] for r in got} == {3000, 3001, 3002, 3003}


def test_predictions_against_all_centroids(stages):
    docs = stages["documents"]
    model = langid.fit(docs)
    got = langid.predict(docs.select("doc_id", "text"), model).collect()
    for r in got:
        lang, cosine, rejected = plain_language(r["text"], model)
        assert (r["__lang"], r["__rejected"]) == (lang, rejected) and abs(r["__score"] - min(1, max(0, cosine))) < 1e-4


def test_language_stage_knows_long_beginnings(spark):
    rnd = random.Random(7)
    han = [chr(0x4E00 + i) for i in range(2000)]
    odd = [tongue(rnd, ALPHABETS["aa"], 200)[:600] + " " + tongue(rnd, han, 1000)[:3400] for _ in range(9)]  # odd from 600 to 4,000 characters
    rows = [(i, tongue(rnd, ALPHABETS["aa"], 200), "aa") for i in range(300)] + [(1000 + i, t + " " + tongue(rnd, ALPHABETS["aa"], 200) * 40, "aa") for i, t in enumerate(odd)]
    rows += [(2000 + i, t[:2048], None) for i, t in enumerate(odd)]  # unlabelled; like nothing that was learned but beginnings of that length
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    settings = langid.Settings(fit_rows=5)
    learned = [t for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    model = langid.fit(df, settings)
    parts = [t[:n] for t in learned for n in {*(1 << k for k in range(9, len(t).bit_length())), len(t)}]
    near = [(langid.vectors(langid.ngram_counts(p, model.buckets)[None], model.idf) @ model.centroids.T).max() for p in parts]
    assert len(model.floors) == 10 and abs(model.floors[-1] - 0.7 * np.min(near)) < 1e-4
    assert langid.keep_known(df, settings).count() == len(rows)


def test_near_duplicates_stage(stages):
    rows = [r.asDict() for r in stages["language"].collect()]
    fps = [plain_fingerprint(r["text"] or "") for r in rows]
    roots = union(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(roots[i], []).append(r)
    wanted = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    got = [r.asDict() for r in stages["near_duplicates"].collect()]
    assert sorted(got, key=key) == sorted(wanted, key=key) and len(got) < len(rows)


def test_personal_data_stage(stages):
    before = {key(r)[:2]: r.asDict() for r in stages["near_duplicates"].collect()}
    after = {key(r)[:2]: r.asDict() for r in stages["personal_data"].collect()}
    assert set(before) == set(after)
    for k, r in before.items():
        text, spans = r["text"], sorted(brute_spans(r["text"]), key=lambda s: s[1])
        for kind, start, end in reversed(spans):
            text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
        assert after[k] == r | {"text": text, "n_chars": len(text) if spans else r["n_chars"]}
    assert sum("[PHONE]" in r["text"] and "[EMAIL]" in r["text"] for r in after.values()) == 16


def test_mix_stage(stages):
    rows = [r.asDict() for r in stages["personal_data"].collect()]
    got = [r.asDict() for r in stages["mix"].collect()]
    wanted = plain_mix(rows)
    assert sorted((str(r["doc_id"]), len(r["text"].split())) for r in got) == sorted((str(i), n) for i, n in wanted)
    whole = {r["doc_id"]: r for r in rows}
    for r in got:
        old = whole[r["doc_id"]]
        assert old["text"].startswith(r["text"]) and r["n_chars"] == (old["n_chars"] if r["text"] == old["text"] else len(r["text"]))
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in old.items() if k not in ("text", "n_chars")}


def test_pack_stage_and_run(spark, stages):
    rows = [r.asDict() for r in stages["mix"].collect()]
    got = stages["pack"].collect()
    assert sum(r["length"] for r in got if r["start"] == 0) > 0 and len({(r["doc_id"], r["start"]) for r in got}) <= len(got)
    run = corpus_pipeline.run(spark, stages["folder"]).collect()
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in run if r["start"] == 0) == sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in got if r["start"] == 0)
    assert sum(r["length"] for r in run) == sum(r["length"] for r in got)
    # every row under a number of its own, so that documents taken twice can be told apart
    numbered = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(rows)], "doc_id long, text string")
    assert check_packing([r["text"] for r in rows], dict(corpus_pipeline.STAGES)["pack"](spark, numbered, "").collect()) > 0


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
