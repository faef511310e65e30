import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, packing, tokenizer, tokens

SCHEMA = "doc_id long, text string, source string, lang string, extra int"
CLASH = "doc_id long, text string, source string, size int, slot string, bucket int, start string, row int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1) for i, t, s in rows], SCHEMA)


def many(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.choice([0, 1, 5, 40, 900]))) if rnd.random() > 0.03 else None, rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def water(sizes, weights, total, most):
    """Targets by the rule itself: stop at the cap, share the excess out again."""
    capped, out = set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        weight = sum(weights[s] for s in open_)
        out = {s: most * sizes[s] for s in capped} | {s: rest * weights[s] / weight for s in open_}
        over = {s for s in open_ if out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mix_reaches_its_targets(spark):
    rows = many()
    got = mixing.taken_words(mixing.mix_sources(docs(spark, rows))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    order = sorted(s for s in sizes if s is not None) + [None]
    wanted = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(wanted[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
    again = mixing.taken_words(mixing.mix_sources(docs(spark, rows[::-1]))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_even_and_complete(spark):
    mix = mixing.Mix(block=8)
    pieces = mixing.mix_sources(docs(spark, many()), mix).where("slot IS NOT NULL").collect()
    by_slot = {}
    for p in pieces:
        by_slot.setdefault(p["slot"], []).append(p)
    total = sum(p["n_words"] for p in pieces)
    assert all(len({p["source"] for p in s}) == 1 and sum(p["n_words"] for p in s) <= 8 for s in by_slot.values())
    seen = {}
    words = 0
    for slot in sorted(by_slot):  # at any time every source has about its share
        for p in by_slot[slot]:
            seen[p["source"]] = seen.get(p["source"], 0) + p["n_words"]
            words += p["n_words"]
        if words > total / 10:
            for p in by_slot[slot]:
                assert abs(seen[p["source"]] - words * sum(q["n_words"] for q in pieces if q["source"] == p["source"]) / total) < 12 * 8


def test_shared_ids_spread_over_the_buckets(spark):
    rows = [(None if i % 3 else 5, f"word {i}", "a") for i in range(3000)]
    laid = mixing.lay_out(mixing.counted(docs(spark, rows)))
    assert laid.groupBy("bucket").count().agg(F.max("count")).first()[0] < 12
    wide = {(r["doc_id"], r["start"]) for r in mixing.lay_out(mixing.counted(docs(spark, rows)), digits=4).collect()}
    assert wide == {(r["doc_id"], r["start"]) for r in laid.collect()}  # the number of buckets changes no place
    assert [mixing.bucket_digits(n) for n in (0, 10**6, 10**9, 10**12)] == [3, 3, 4, 7]


def test_points_do_not_repeat_after_a_run():
    assert 0 < mixing.SHIFT < 1 and abs(mixing.SHIFT * 2 % 1 - 0.5) > 1e-3 and abs(mixing.SHIFT - 0.5) > 1e-3


def test_mix_of_odd_tables(spark):
    assert mixing.taken_words(mixing.mix_sources(docs(spark, []))).count() == 0
    rows = [(1, None, None), (1, None, None), (None, "", "a"), (2, " \t", "a"), *[(1, "a b", "x")] * 5, (None, "c d e", "x")]
    got = mixing.taken_words(mixing.mix_sources(docs(spark, rows))).collect()
    assert len(got) == len(rows) and all(r["taken"] == 0 and r["target"] == 0 for r in got if r["size"] == 0)
    assert sum(r["taken"] for r in got) == round(1.5 * 13)
    clash = spark.createDataFrame([(1, "a b c", "x", 1, "y", 2, "z", 3)], CLASH)
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns and sum(len(r["text"].split()) for r in out.collect()) in (4, 5)


def test_mixed_documents_follow_the_mix(spark):
    rows = many(120)
    df = docs(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(mixing.mix_sources(df)).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        whole = rows[r["doc_id"]][1]
        assert whole.startswith(r["text"]) or whole.strip().startswith(r["text"])
    assert got == {i: n for i, n in taken.items() if n}


def brute(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def odd_text(rnd, n):
    parts = ["word", " the", "  ", "\n\n", "'s", "don't", "<|endoftext|>", "<|endof", "12", "345", "é", "中文", "　", "🙂", "!!", "-", "\t", "x" * 40, "́", "\x1c", "\xa0"]
    return "".join(rnd.choice(parts) for _ in range(n))


def test_twin_and_chunks_give_the_library_s_ids():
    encoder, rnd = tokenizer.load("byte_bpe_50k.json"), random.Random(2)
    for n in (0, 1, 3, 30, 400):
        for _ in range(40):
            text = odd_text(rnd, n)
            wanted = brute(text)
            assert encoder.ids(text) == wanted
            for chunk, overlap in ((40, 5), (64, 16), (300, 40)):
                assert sum(tokenizer.encode(encoder, text, chunk, overlap), []) == wanted
    rnd = random.Random(3)
    for parts in (["漢字", "かな", "カナ", "。", "、", "「", "」", "12"], ["word", "<|endoftext|>", "<|endoftext", "|>", ".", "'s", "'", "12", "é", "一", "｡", "́"]):
        for _ in range(30):  # no white space at all
            text = "".join(rnd.choice(parts) for _ in range(400))
            runs = list(tokenizer.encode(encoder, text, 100, 10))
            assert sum(runs, []) == brute(text)
    text = "".join(rnd.choice(["漢字", "かなの", "カナ", "。", "、"]) for _ in range(20000))
    sizes = []
    whole = encoder.ids

    def seen(part):
        sizes.append(len(part))
        return whole(part)

    assert sum(tokenizer.encode(tokenizer.Encoder(seen, encoder.lengths), text, 1000, 50), []) == brute(text) and max(sizes) < 4000  # the chunks stay small
    unbroken = "ab1" * 5000  # no white space: the overlap widens to the whole text
    assert sum(tokenizer.encode(encoder, unbroken, 1000, 50), []) == brute(unbroken)


def test_other_vocabularies():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sum(tokenizer.encode(tokenizer.load("piece_bpe_32k.model"), "Hello world " * 50, 20), []) == model.encode("Hello world " * 50)
    assert len(tokenizer.load("word_bpe_49k.json").ids("Hello")) == 1
    with pytest.raises(ValueError):
        tokenizer.load("x.txt")


def test_token_counts(spark):
    rnd = random.Random(4)
    texts = [None, "", "a", odd_text(rnd, 50), "long text " * 6000, "x" * 700, "word " * 512, "word " * 600]
    df = spark.createDataFrame([(i if i != 2 else None, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1)], "doc_id long, text string, n_tokens int")
    got = tokens.count_tokens(df).collect()
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        r = by[i if i != 2 else None]
        n = len(brute(t or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert tokens.count_tokens(df.limit(0)).count() == 0


def check_packing(rows, got, length=2048):
    ids = {i: np.array(brute(t or "") + [1], "<u4") for i, t in enumerate(rows)}
    sequences, pieces = {}, {}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts, whole in [*((p, None) for p in sequences.values()), *((p, len(ids[d])) for d, p in pieces.items())]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == whole if whole else at <= length
    assert set(pieces) == set(ids)
    filled = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n & (n - 1) == 0 for n in filled)  # full, or a power of two: no padding at all
    return filled.count(length) / len(filled)


def test_packing(spark):
    rnd = random.Random(6)
    rows = [None, "", "word " * 9000, *(odd_text(rnd, rnd.choice([1, 20, 300, 1500])) for _ in range(400))]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(rows)], "doc_id long, text string, length int").repartition(5)
    got = packing.pack(df).collect()
    assert check_packing(rows, got) > 0.9
    assert check_packing(rows, packing.pack(df, open_windows=2, merge_tasks=2).collect()) > 0.8
    assert packing.pack(df.limit(0)).count() == 0
    again = packing.pack(spark.createDataFrame([(1, "a b c")] * 3 + [(None, "a")], "doc_id long, text string")).collect()
    assert sum(r["length"] for r in again) == 3 * 4 + 2


def test_rests_fill_powers_of_two():
    rnd = random.Random(1)
    for _ in range(200):
        pieces = [packing._Piece(i, 0, np.arange(rnd.randrange(1, 300), dtype=np.uint32) + 1000 * i, 0) for i in range(rnd.randrange(0, 7))]
        total = sum(len(p.ids) for p in pieces)
        made = packing.powers_of_two(list(pieces))
        assert [sum(len(p.ids) for p in s) for s in made] == [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        assert np.concatenate([np.zeros(0, np.uint32), *(p.ids for s in made for p in s)]).tolist() == np.concatenate([np.zeros(0, np.uint32), *(p.ids for p in pieces)]).tolist()


def test_packer_places_best_fit_and_emits_the_fullest():
    piece = lambda n: packing._Piece(0, 0, np.zeros(n, np.uint32), n)
    p = packing.Packer(100, 2, 10)
    for n in (60, 70, 28):
        p.add(piece(n))
    assert p.free == [(2, 1), (40, 0)] and not p.done  # 28 went where it left 2
    p.add(piece(50))
    assert [len(x.ids) for x in p.done[0]] == [70, 28]  # a gap of 2 is not worth a cut
    p.add(piece(80))
    assert [len(x.ids) for x in p.done[1]] in ([60, 40], [50, 50])
