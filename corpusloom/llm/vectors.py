"""Near duplicates of embeddings by cosine, found with an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import connected, forest


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    recall: float = 0.97  # share of pairs exactly at the threshold that the search has to reach, from either side
    fit_rows: int = 16384  # vectors the codebooks are fitted and the visits tuned on, about, shared among the lengths; all vectors are indexed
    cell_rows: int = 1024  # vectors a cell holds on average, until there are most_codes codewords
    least_codes: int = 4  # codewords of a half, at least (fewer for less than least_rows vectors)
    most_codes: int = 256
    least_rows: int = 64
    members: int = 4096  # of a cell in one comparison
    visitors: int = 8192


#: Cells of the index of one length are numbered below this.
_CELLS = 1 << 20


class Index:
    """Two codebooks, one for each half of the vectors; a cell is a pair of codewords. ``visits`` is the number of cells a query looks into."""

    def __init__(self, codes: tuple[np.ndarray, np.ndarray], visits: int):
        self.codes, self.visits = codes, visits
        self.k = len(codes[0])

    def costs(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.codes[0].shape[1]
        return tuple(np.maximum(0, (c * c).sum(axis=1) - 2 * (p @ c.T) + (p * p).sum(axis=1, keepdims=True)) for p, c in zip((v[:, :half], v[:, half:]), self.codes))

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """For each row the ``visits`` cells of least cost, nearest first.

        The n-th cell of a multi-sequence traversal pairs an a-th with a b-th nearest codeword where
        a * b <= n, so only those pairs of ranks are looked at.
        """
        n = min(self.visits, self.k * self.k)
        first, second = self.costs(v)
        order = [np.argsort(c, axis=1, kind="stable") for c in (first, second)]
        ranks = [(a, b) for a in range(min(self.k, n)) for b in range(min(self.k, n // (a + 1)))]
        a, b = np.array(ranks).T
        cost = np.take_along_axis(first, order[0], 1)[:, a] + np.take_along_axis(second, order[1], 1)[:, b]
        best = np.argsort(cost, axis=1, kind="stable")[:, :n]
        rows = np.arange(len(v))[:, None]
        return (order[0][rows, a[best]] * self.k + order[1][rows, b[best]]).astype(np.int64)

    def rank_of_home(self, v: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many cells each row of ``v`` looks into until it comes to the own cell of the same row of ``others``."""
        (a, b), (oa, ob) = self.costs(v), self.costs(others)
        rows = np.arange(len(v))
        reached = a[rows, oa.argmin(axis=1)] + b[rows, ob.argmin(axis=1)]
        return np.array([int(np.searchsorted(np.sort(y), r - x).sum()) + 1 for x, y, r in zip(a, b, reached)])


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def partners(v: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """A unit vector at exactly ``cosine`` to each row, in a random direction (the row or its opposite where there is only one dimension)."""
    w = rng.normal(size=v.shape)
    w -= (w * v).sum(axis=1, keepdims=True) * v
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
    return cosine * v + np.sqrt(1 - cosine**2) * w


def unlinked(points: np.ndarray, cosine: float, block: int = 512) -> np.ndarray:
    """Unit vectors in their order, without those that link with one kept before."""
    kept = points[:0]
    for at in range(0, len(points), block):
        new = points[at : at + block]
        new = new[(new @ kept.T < cosine).all(axis=1)]
        near = np.triu(new @ new.T >= cosine, 1)
        good = np.ones(len(new), bool)
        for i in range(len(new)):
            if good[i]:
                good &= ~near[i]
        kept = np.concatenate([kept, new[good]])
    return kept


def build(sample: np.ndarray, n: int, settings: Settings) -> Index:
    """Codebooks from three quarters of the unit vectors, and the number of visits that reaches the target recall on the others.

    Of near duplicates in the sample one is fitted, so that a large group of them does not fall apart
    into cells of its own. A pair is found if either looks into the other's cell, so the visits are the
    rank, from the better side, that covers ``recall`` of the pairs: of made ones, with partners at
    exactly the threshold in random directions for vectors that the codebooks do not know, and of the
    linked ones in the sample.
    """
    half = (sample.shape[1] + 1) // 2
    whole = Index((np.zeros((1, half)), np.zeros((1, sample.shape[1] - half))), 1)
    if n < settings.least_rows or len(sample) < 16:
        return whole
    rng = np.random.default_rng(7)
    sample = sample[rng.permutation(len(sample))]
    cut = 3 * len(sample) // 4
    fit, rest = unlinked(sample[:cut], settings.threshold), sample[cut:][:1024]
    k = int(np.clip(round(np.sqrt(n / settings.cell_rows)), settings.least_codes, min(settings.most_codes, len(fit))))
    if k < 2:
        return whole
    index = Index((_means(fit[:, :half], k, rng), _means(fit[:, half:], k, rng)), 1)
    i, j = np.nonzero(rest @ sample[:8192].T >= settings.threshold)
    some = rng.permutation(np.flatnonzero(i + cut != j))[:2048]
    many = np.concatenate([rest] * (-(-256 // len(rest))))  # of few vectors, more than one partner each
    for a, b in ((many, partners(many, settings.threshold, rng)), (rest[i[some]], sample[j[some]])):
        if len(a):
            rank = np.minimum(index.rank_of_home(a, b), index.rank_of_home(b, a))
            index.visits = max(index.visits, int(np.quantile(rank, settings.recall, method="higher")))
    return index


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def indexes(distinct: DataFrame, settings: Settings) -> tuple[dict[int, Index], dict[int, int]]:
    """An index for each length of the vectors (column v), and how many vectors have it. Only the sample and the counts come to the driver."""
    n = {r["d"]: r["n"] for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    share = {d: min(1.0, max(256.0, settings.fit_rows * m / total) / m) for d, m in n.items() if m >= settings.least_rows}
    points: dict[int, list[np.ndarray]] = {d: [] for d in n}
    if share:
        quota = F.element_at(F.create_map(*[F.lit(x) for d, p in share.items() for x in (d, p)]), F.size("v"))
        drawn = distinct.where(F.pmod(F.xxhash64(F.lit("fit"), "k1"), F.lit(1 << 30)) < F.coalesce(quota, F.lit(0.0)) * (1 << 30))
        for x in drawn.orderBy("k1", "k2").select("v").toArrow()["v"]:
            points[len(x)].append(x.values.to_numpy(zero_copy_only=False))
    return {d: build(_unit(np.stack(points[d])) if points[d] else np.ones((1, d)), m, settings) for d, m in n.items()}, n


def near_duplicates(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link at cosine >= ``threshold`` in double precision; every link given is verified, and the
    search looks into as many cells of the index as reach the target recall for pairs at the threshold.
    Equal vectors are searched once and counted as often as they occur. component_id is the smallest id
    reachable, kept says that it is the row's own. Vectors of each length (a few lengths are expected)
    have an index of their own and link among themselves, those of one component by their sign. Rows
    with vectors that are null, empty, zero or with null or non-finite components link with nothing.
    Repeated ids are rows of their own; a null id names no component. Other columns are ignored; an
    empty table gives an empty result.
    """
    short = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # then half the bytes hold the same values
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("valid", _valid(F.col("v")))
    alone = rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("valid").withColumn("k1", F.xxhash64(F.lit(1), "v")).withColumn("k2", F.xxhash64(F.lit("b"), "v"))
    distinct = rows.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    distinct = cut_lineage(distinct)
    index, n = indexes(distinct, settings)
    if not n:
        return alone
    found = cut_lineage(_compare(distinct.select("node", "v", "copies"), index, n, settings, np.dtype("f4" if short else "f8")))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected(found.where("n IS NULL").select("a", "b"))
    named = distinct.select("k1", "k2", "node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"])
    return linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # or squares of very large or small components leave the range of a double
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_length(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Small batches of vectors (column v) of one length each, with the vectors as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            lengths = pc.list_value_length(piece["v"]).to_numpy(zero_copy_only=False)
            every = np.unique(lengths)
            for d in every:
                part = piece if len(every) == 1 else piece.take(pa.array(np.flatnonzero(lengths == d)))
                yield part, part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _compare(distinct: DataFrame, index: dict[int, Index], n: dict[int, int], settings: Settings, kind: np.dtype) -> DataFrame:
    """(a, b, n): links to join components (n null), and for node a a number of linked vectors (b null).

    Every vector is a member of its own cell and a visitor of the cells it looks into. Cells too large
    for one comparison are cut into parts of members and parts of visitors, each pair of which is a
    group; the few such cells are found by counting first.
    """
    base = {d: i * _CELLS for i, d in enumerate(sorted(index))}

    def cells_of(v: np.ndarray) -> np.ndarray:
        d = v.shape[1]
        return index[d].nearest(_unit(v)) + base[d]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v in _by_length(batches):
            cells = cells_of(v)
            every, visitors = np.unique(cells, return_counts=True)
            members = np.zeros(len(every), np.int64)
            np.add.at(members, np.searchsorted(every, cells[:, 0]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(members), pa.array(visitors.astype(np.int64))], names=["cell", "members", "visitors"])

    total = sum(m * index[d].visits for d, m in n.items())
    large = F.expr(f"members > {max(settings.members, sum(n.values()) // 4096)} OR visitors > {max(settings.visitors, total // 4096)}")  # at most some thousand cells
    tally = distinct.mapInArrow(counted, "cell long, members long, visitors long").groupBy("cell").agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors")).where(large)
    parts = {r["cell"]: (-(-r["members"] // settings.members) or 1, -(-r["visitors"] // settings.visitors)) for r in tally.collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(parts), np.int64)
        for piece, v in _by_length(batches):
            node, copies, cells = piece["node"].to_numpy(), piece["copies"].to_numpy(), cells_of(v)
            out: list[tuple[int, int, int, int, int]] = []  # row, cell, members' part, visitors' part, whether it visits
            lucky = (node * 2654435761 % (1 << 32)).tolist()
            is_hot = np.isin(cells, hot)
            for row, (own, heat) in enumerate(zip(cells.tolist(), is_hot)):
                if not heat.any():
                    out.append((row, own[0], 0, 0, 0))
                    out += [(row, c, 0, 0, 1) for c in own]
                    continue
                m, w = parts.get(own[0], (1, 1))
                out += [(row, own[0], lucky[row] % m, j, 0) for j in range(w)]
                for c in own:
                    m, w = parts.get(c, (1, 1))
                    out += [(row, c, i, lucky[row] % w, 1) for i in range(m)]
            table = np.array(out, np.int64)
            who, raw = table[:, 0], [x.tobytes() for x in v.astype(kind)]
            seen = [x.tobytes() for x in cells]
            visits = table[:, 4] == 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table[:, 1]), pa.array(table[:, 2].astype(np.int32)), pa.array(table[:, 3].astype(np.int32)), pa.array(table[:, 4].astype(np.int32)),
                    pa.array(node[who]), pa.array(copies[who]), pa.array(cells[who, 0]), pa.array([raw[i] for i in who.tolist()], pa.binary()), pa.array([None if x else seen[i] for i, x in zip(who.tolist(), visits)], pa.binary()),
                ],
                names=["cell", "mp", "vp", "visits", "node", "copies", "home", "v", "seen"],
            )

    dealt = distinct.mapInArrow(spread, "cell long, mp int, vp int, visits int, node long, copies long, home long, v binary, seen binary")
    dealt = dealt.repartition("cell", "mp", "vp").sortWithinPartitions("cell", "mp", "vp", "visits")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            keys = np.column_stack([table[c].to_numpy() for c in ("cell", "mp", "vp")])
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist()]
            for a, b in zip(edges, edges[1:]):
                yield from group(table.slice(a, b - a))
            held = table.slice(edges[-1]).combine_chunks().to_batches()
        if held:
            yield from group(pa.Table.from_batches(held))

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        visits = table["visits"].to_numpy() == 1
        m = int((~visits).sum())
        if m == 0 or m == len(visits):
            return
        v = _unit(np.frombuffer(b"".join(table["v"].to_pylist()), kind).reshape(len(visits), -1).astype(float))
        node, copies, home = (table[c].to_numpy() for c in ("node", "copies", "home"))
        homes, member_seen = np.unique(home[m:]), np.frombuffer(b"".join(table["seen"].slice(0, m).to_pylist()), np.int64).reshape(m, -1)
        at = np.searchsorted(homes, member_seen).clip(max=len(homes) - 1)
        known = np.zeros((m, len(homes)), bool)
        rows, columns = np.nonzero(homes[at] == member_seen)
        known[rows, at[rows, columns]] = True
        credit = np.zeros(len(visits))
        left, right = [], []
        for start in range(m, len(visits), 256):  # a dense group has a link for nearly every pair: of each block only a forest is kept
            stop = min(start + 256, len(visits))
            hit = (v[start:stop] @ v[:m].T >= settings.threshold) & (node[start:stop, None] != node[None, :m])
            if hit.any():
                credit[start:stop] = hit @ copies[:m].astype(float)
                back = hit & ~known[:, np.searchsorted(homes, home[start:stop])].T  # members that do not look into the visitor's cell
                credit[:m] += copies[start:stop].astype(float) @ back
                i, j = np.nonzero(hit)
                tree = forest(m + stop - start, i + m, j)
                moved = np.flatnonzero(tree != np.arange(len(tree)))
                left.append(np.where(moved < m, moved, moved - m + start))
                right.append(np.where(tree[moved] < m, tree[moved], tree[moved] - m + start))
        if not left:
            return
        names, local = np.unique(node, return_inverse=True)
        root = forest(len(names), local[np.concatenate(left)], local[np.concatenate(right)])
        moved = np.flatnonzero(root != np.arange(len(names)))
        some = np.flatnonzero(credit)
        a = np.concatenate([names[moved], node[some]])
        b = pa.array(np.concatenate([names[root[moved]], np.zeros(len(some), np.int64)]), mask=np.arange(len(a)) >= len(moved))
        c = pa.array(np.concatenate([np.zeros(len(moved), np.int64), credit[some].round().astype(np.int64)]), mask=np.arange(len(a)) < len(moved))
        yield pa.RecordBatch.from_arrays([pa.array(a), b, c], names=["a", "b", "n"])

    return dealt.mapInArrow(compared, "a long, b long, n long")
