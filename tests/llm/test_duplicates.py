import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, minhash, simhash, vectors


def union(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 120)]
    pairs = chain + [(1000, 1000 + i) for i in range(1, 200)] + [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(250)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    wanted = union({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in wanted.items() if n != r}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, (2, 220))
    wanted = union(range(300), zip(a.tolist(), b.tolist()))
    assert components.forest(300, a, b).tolist() == [wanted[i] for i in range(300)]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", " \n", "One", "one two", "One two THREE", "a b c d", "É é x y　z w", *(" ".join(random.Random(i).choices("abcdefgh", k=20 + i)) for i in range(30))]


def test_fingerprints():
    assert [simhash.fingerprint(t) for t in TEXTS] == [plain_fingerprint(t) for t in TEXTS]


def test_hash_is_that_of_spark(spark):
    from xxhash import xxh64_intdigest

    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_bit_planes_find_all_close_pairs(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64)
    for _ in range(300):
        i, j = rng.integers(0, 400, 2)
        fps[i] = fps[j]
        for b in rng.integers(0, 64, rng.integers(0, radius + 2)):
            fps[i] ^= np.uint64(1) << np.uint64(b)
    group = np.sort(rng.integers(0, 5, 400))
    a, b = simhash.close_pairs(fps, group, radius)
    wanted = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == wanted and wanted
    with pytest.raises(ValueError):
        simhash.close_pairs(fps, group, 4)


@pytest.mark.parametrize("n", [10, 1 << 25, 1 << 33])
def test_masks_cover_the_radius(n):
    rnd = random.Random(n)
    for _ in range(500):
        bits = rnd.sample(range(64), 3)
        assert any(not any(m >> b & 1 for b in bits) for m in simhash.masks(n))


def near_rows():
    rnd = random.Random(9)
    out = []
    for g in range(12):
        base = rnd.choices("abcdefghijklmnop", k=400)
        for _ in range(rnd.choice([1, 3, 8])):
            words = list(base)
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(400)] = "zz"
            out.append(" ".join(words))
    return out + TEXTS + TEXTS[:9]


@pytest.mark.parametrize("group_rows", [4096, 4])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, group_rows):
    texts = near_rows()
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: links(*a, **k, group_rows=group_rows))
    df = spark.createDataFrame([(1000 - i, t, "x", 1) for i, t in enumerate(texts)] + [(None, None, "x", 1)], "doc_id long, text string, fp string, tag int")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fps = {1000 - i: plain_fingerprint(t) for i, t in enumerate(texts)}
    wanted = union(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {i: got[i]["component_id"] for i in fps} == wanted
    assert all(got[i]["fingerprint"] == f"{fps[i]:016x}" for i in fps)
    assert got[None]["fingerprint"] == "0" * 16 and got[None]["component_id"] == wanted[1000 - texts.index("")]
    kept = simhash.keep_first(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted.values())) and kept.columns == df.columns


def test_odd_tables_of_texts(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0 and simhash.keep_first(spark.createDataFrame([], schema)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e", 7, "x", True)] * 2 + [(2, None, 8, "y", False)], "doc_id long, text string, __tag int, __id string, __again boolean")
    assert sorted(tuple(r) for r in simhash.keep_first(clash).collect()) == [(1, "a b c d e", 7, "x", True), (2, None, 8, "y", False)] and simhash.keep_first(clash).columns == clash.columns
    same = spark.createDataFrame([(1, "a b c d e")] * 3 + [(1, "quite another text here")] + [(None, "no name for this one")] * 2, schema)
    assert simhash.near_duplicates(same).count() == 6
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_first(same).collect()) == [(0, "no name for this one"), (1, "a b c d e"), (1, "quite another text here")]


def table(spark, v, ids=None):
    return spark.createDataFrame([(i, x, "n") for i, x in zip(ids or range(len(v)), v)], "vec_id long, embedding array<float>, node string")


def exact_cosine(a, b):
    """In exact integers or rationals where floats would leave their range."""
    from fractions import Fraction as Q

    a, b = [Q(x) for x in a], [Q(x) for x in b]
    dot = sum(x * y for x, y in zip(a, b))
    square = Q(dot * dot) / (sum(x * x for x in a) * sum(y * y for y in b))
    return float(square) ** 0.5 * (1 if dot > 0 else -1)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = [c + rng.normal(size=16) * s for c in centres for s in rng.choice([0.0, 0.05, 0.25, 0.5], 25)]
    v += [v[3]] * 20 + [2 * v[4]]
    rng.shuffle(v)
    x = np.array(v, np.float32).astype(float)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 5]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    wanted = union(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    for settings in (vectors.Settings(cell_rows=32), vectors.Settings(cell_rows=32, members=7, visitors=11)):
        got = {r["vec_id"]: r for r in vectors.near_duplicates(table(spark, [*x.tolist(), *odd]), settings).collect()}
        assert len(got) == len(x) + len(odd)
        found = sum(got[i]["n_links"] for i in range(len(x)))
        assert 0.95 * near.sum() <= found <= near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
        assert np.mean([got[i]["component_id"] == wanted[i] for i in range(len(x))]) > 0.98
        assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(x), len(x) + len(odd)))


def test_vectors_of_every_length_and_size(spark):
    """Each length by itself, one component, and values whose squares leave the range of a double: as all pairs in exact numbers say."""
    rng = np.random.default_rng(5)
    v = [[1.0], [2.0], [-3.0], [5e-324], [1e200, 0.0], [1e-200, 0.0], [1.0, 0.0], [1e308, 1e308], [3.0, 3.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [-1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 1e-300], [7.0, 0.0, 0.0, 0.0]]
    v += [(c * 10.0 ** rng.integers(-150, 150)).tolist() for c in np.repeat(rng.normal(size=(30, 5)), 5, axis=0) + rng.normal(size=(150, 5)) * 0.01]
    v += rng.normal(size=(100, 6)).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    near = {(i, j) for i in range(len(v)) for j in range(len(v)) if i != j and len(v[i]) == len(v[j]) and exact_cosine(v[i], v[j]) >= 0.9}
    wanted = union(range(len(v)), near)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(v) and 0.97 * len(near) <= found <= len(near)
    assert all(got[i]["n_links"] == sum(a == i for a, _ in near) and got[i]["component_id"] == wanted[i] for i in range(15))
    assert np.mean([got[i]["component_id"] == wanted[i] for i in got]) > 0.97


def test_one_component_of_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=12) + rng.normal(size=(500, 12)) * 0.02
    got = vectors.near_duplicates(table(spark, v.tolist()), vectors.Settings(members=64, visitors=64)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1 and {r["n_links"] for r in got} == {499}


@pytest.mark.parametrize("dim, codes", [(64, 32), (64, 100), (16, 32)])
def test_recall_at_the_threshold(dim, codes):
    """Of new pairs at just the threshold, among a thousand cells and more, as many are found as the setting says, and 0.9 at least."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(200, dim))
    every = vectors._unit(centres[rng.integers(0, 200, 20000)] * rng.choice([0.0, 0.5], (20000, 1)) + rng.normal(size=(20000, dim)))
    settings = vectors.Settings()
    index = vectors.build(every[:16384], codes * codes * settings.cell_rows, settings)
    assert index.k == codes
    rest = every[16384:18384]
    other = vectors.partners(rest, settings.threshold, rng)
    assert np.allclose((rest * other).sum(axis=1), settings.threshold)
    a, b = index.nearest(rest), index.nearest(other)
    found = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert found.mean() > 0.93
    assert index.visits < codes * codes / 8


def test_odd_tables_of_vectors(spark):
    assert vectors.near_duplicates(table(spark, [])).count() == 0
    assert [r["n_links"] for r in vectors.near_duplicates(table(spark, [None, None])).collect()] == [0, 0]
    one = vectors.near_duplicates(table(spark, [[1.0, 2.0]] * 3, [7, 7, None])).collect()
    assert [r["n_links"] for r in one] == [2, 2, 2] and {r["component_id"] for r in one} == {7} and sum(r["kept"] for r in one) == 2


def shingle_set(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_estimates(spark):
    import hashlib

    rnd = random.Random(8)
    texts = [None, "", "one", "two words", *(" ".join(rnd.choices("abcdefghijklmnop", k=rnd.choice([6, 60, 700]))) for _ in range(150))]
    texts += texts[-5:]
    ids = rnd.sample(range(10**6), len(texts))
    df = spark.createDataFrame([(i, t, 3) for i, t in zip(ids, texts)], "doc_id long, text string, home int").repartition(3)
    order = sorted(zip(ids, [t or "" for t in texts]), reverse=True)
    for per in (4000, 10):
        got = {r["doc_id"]: r for r in minhash.fingerprint_documents(df, rows_per_range=per).collect()}
        assert len(got) == len(texts)
        errors = []
        for k, (i, t) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            n = len(t) // 2
            changed = t[: len(t) - n] + following[:n]
            r = got[i]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            errors += [r["near_edited"] - jaccard(shingle_set(t), shingle_set(changed)), r["near_next"] - jaccard(shingle_set(t), shingle_set(following))]
        assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.25
    prints = {}
    for i, t in order:
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    (one,) = minhash.fingerprint_documents(spark.createDataFrame([(1, "a b")], schema)).collect()
    assert one["near_next"] == 1.0
    rows = minhash.fingerprint_documents(spark.createDataFrame([(None, "x y z")] * 2 + [(5, "a")] * 3 + [(None, None)], schema), rows_per_range=1)
    assert rows.count() == 6


@pytest.mark.parametrize("ids", [[None] * 300, [7] * 300, [None, 7, 9] * 100, [3, 5, 7, 9, None] * 60])
def test_shared_ids_have_several_ranges(spark, ids):
    """A chain through all rows: by descending id, equal ids by hash, nulls last, each text once the text after another."""
    import hashlib

    texts = [f"text number {i} of some" for i in range(len(ids))]
    texts[7] = texts[8] = texts[9]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    ranges = minhash._Ranges(df, 20, 1 << 16)
    assert ranges.split and len(set(ranges.of(*(pa.array(c, pa.int64()) for c in (ids, [random.Random(i).getrandbits(64) - (1 << 63) for i in range(len(ids))]))).tolist())) > 8
    order = df.select("doc_id", "text").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()
    wanted = sorted(hashlib.sha256(minhash.edited(r["text"], order[(k + 1) % len(order)]["text"]).encode()).hexdigest() for k, r in enumerate(order))
    got = minhash.fingerprint_documents(df, rows_per_range=20).collect()
    assert sorted(r["edited_sha256"] for r in got) == wanted
    assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, ids))


def test_densification_borrows_alike():
    a = minhash.signature(np.arange(3, dtype=np.uint64) * np.uint64(7919))
    assert len(a) == minhash.BINS and (a == minhash.signature(np.arange(3, dtype=np.uint64)[::-1] * np.uint64(7919))).all()
    assert minhash.likeness(a, a) == 1.0 and minhash.likeness(None, None) == 1.0 and minhash.likeness(a, None) == 0.0
