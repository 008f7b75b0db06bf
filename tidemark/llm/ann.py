"""Nearest neighbours by inner product: a hash-prefix forest.

Each tree gives a vector a long hash string, one bit a random hyperplane, and keeps its strings
in a sorted array. A search descends every tree to its longest prefix match and then ascends all
trees at once, one bit at a time, until together they hold enough entries. Rows that enough trees
have met are candidates and are scored exactly. Vectors of unequal norm get one more component so
that all have the norm of the longest, which makes the largest inner product the smallest angle.

How many trees must meet a row depends on the vectors of a block. So for some of a block's queries
the nearest are also found by brute force: the number is the largest with which RECALL of them are
met, and if a single tree does not meet them, the search ascends further, at last to all rows.

Rows are dealt at random into blocks of bounded size, each with a forest of its own, and the
stated queries go to every block. Equal vectors are one entry with their smallest ids, as many as
a result can hold, so a vector that a third of the rows share costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from . import buffers as B, store

TREES = 128
BITS = 24
#: entries of all trees to ascend to, as a multiple of the block's rows
ENTRIES = 6
BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384
#: queries of a block that are also answered by brute force, and the share of their nearest to meet
HELD = 128
RECALL = 0.95


class Forest:
    """A hash-prefix forest over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        norms = np.sqrt((vectors**2).sum(axis=1))
        self.norm = norms.max(initial=0.0)
        rest = np.sqrt(np.maximum(self.norm**2 - norms**2, 0))
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * bits))
        codes = self.codes(np.column_stack([vectors, rest]))
        self.order = np.empty((trees, len(vectors)), np.int32)
        self.sorted = np.empty((trees, len(vectors)), np.int32)
        for t in range(trees):
            self.order[t] = np.argsort(codes[:, t], kind="stable")
            self.sorted[t] = codes[self.order[t], t]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, trees) hash strings as integers, the first bit highest."""
        weight = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        out = np.empty((len(vectors), self.trees), np.int32)
        for i in range(0, len(vectors), 2048):
            signs = (vectors[i : i + 2048] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[i : i + 2048] = signs @ weight
        return out

    def ranges(self, queries: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) in each tree's sorted array of every query's candidates."""
        codes = self.codes(np.column_stack([queries, np.zeros(len(queries))]))
        lo, hi = np.zeros(codes.shape, np.int32), np.zeros(codes.shape, np.int32)
        live = np.arange(len(queries))
        for level in range(self.bits, -1, -1):  # all trees ascend together
            shift = self.bits - level
            for t in range(self.trees):
                own = codes[live, t] >> shift << shift
                lo[live, t] = np.searchsorted(self.sorted[t], own)
                hi[live, t] = np.searchsorted(self.sorted[t], own + np.int32(1 << shift))
            live = live[(hi[live] - lo[live]).sum(axis=1) < enough]
            if not len(live):
                break
        return lo, hi

    def votes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each row the trees in whose range it lies."""
        return np.bincount(np.concatenate([self.order[t, lo[t] : hi[t]] for t in range(self.trees)]), minlength=self.order.shape[1])

    def candidates(self, lo: np.ndarray, hi: np.ndarray, votes: int, least: int) -> np.ndarray:
        """The rows that ``votes`` trees have met, or the ``least`` rows that most trees have met."""
        met = self.votes(lo, hi)
        if (met >= votes).sum() < least:
            votes = int(np.partition(met, -least)[-least]) if least <= len(met) else 0
        return np.flatnonzero(met >= votes)

    def settle(self, data: np.ndarray, queries: np.ndarray, k: int) -> tuple[int, int]:
        """(entries to ascend to, trees that must meet a row) with which ``queries`` meet RECALL of their ``k``
        nearest other vectors."""
        nearest = []
        for q in queries:
            score = data @ q
            top = np.argpartition(-score, min(k, len(score) - 1))[: k + 1]
            top = top[np.argsort(-score[top], kind="stable")]
            nearest.append(top[(data[top] != q).any(axis=1)][:k])
        n = ENTRIES * len(data)
        while True:
            lo, hi = self.ranges(queries, n)
            met = np.sort(np.concatenate([self.votes(lo[i], hi[i])[own] for i, own in enumerate(nearest)]))
            votes = int(met[int((1 - RECALL) * len(met))]) if len(met) else 1
            if votes or n >= self.trees * len(data):
                return n, votes
            n *= 2


def _valid(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rows, their vectors as bytes of doubles) of the vectors that take part; -0.0 is 0.0."""
    column = pc.cast(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    owner = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(owner, ~np.isfinite(values), len(size)) > 0
    ok = ~bad & (np.bincount(owner, values != 0, len(size)) > 0)
    kept = np.ascontiguousarray(values[ok[owner]])
    offsets = np.concatenate([[0], np.cumsum(8 * size[ok])]).astype(np.int64)
    vectors = pa.Array.from_buffers(pa.large_binary(), int(ok.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return np.flatnonzero(ok), vectors.cast(pa.binary())


def _groups(k: int):
    """mapInArrow function: (id, vector) to (vector bytes, id), k + 1 smallest ids each at most.

    Ids are held for a bounded number of distinct vectors at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out():
            pairs = [(v, i) for v, ids in held.items() for i in ids]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.int64())], ["vector", "vec_id"])

        for b in batches:
            B.lean()
            rows, vectors = _valid(b.column(1))
            for i, x in zip(b.column(0).take(pa.array(rows)).to_pylist(), vectors.to_pylist()):
                if i is not None:
                    own = held.setdefault(x, [])
                    own.append(i)
                    if len(own) > 2 * k + 2:
                        own[:] = sorted(set(own))[: k + 1]
            if len(held) > 50_000:
                yield out()
        yield out()

    return run


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (vector bytes, id) of the valid ones."""
    for b in batches:
        rows, vectors = _valid(b.column(1))
        yield pa.RecordBatch.from_arrays([vectors, b.column(0).take(pa.array(rows))], ["vector", "vec_id"])


def _search(k: int):
    """applyInArrow function over one (block, query part): the k + 1 best entries of each query."""

    def run(t: pa.Table) -> pa.Table:
        B.lean()
        vector = t.column("vector").to_pylist()
        ids = t.column("id").to_numpy()
        query = t.column("query").to_numpy(zero_copy_only=False)
        dims = {len(v) for v in vector}
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in dims:  # only vectors of equal length have a product
            has = np.array([len(v) == d for v in vector])
            q, x = np.flatnonzero(has & query), np.flatnonzero(has & ~query)
            if not len(q) or not len(x):
                continue
            data = np.frombuffer(b"".join(vector[i] for i in x), np.float64).reshape(len(x), -1)
            asked = np.frombuffer(b"".join(vector[i] for i in q), np.float64).reshape(len(q), -1)
            forest = Forest(data) if len(x) > 2 * k else None
            if forest:
                held = np.random.default_rng(7).permutation(len(q))[:HELD]
                held = np.argsort(ids[q], kind="stable")[held]
                entries, votes = forest.settle(data, asked[held], k)
                lo, hi = forest.ranges(asked, entries)
            for i in range(len(q)):
                near = forest.candidates(lo[i], hi[i], votes, k + 1) if forest else np.arange(len(x))
                rough = data[near] @ asked[i]
                if len(near) > k + 1:
                    limit = np.partition(rough, len(near) - k - 1)[len(near) - k - 1]
                    near = near[rough >= limit - 1e-9 * (1 + abs(limit))]
                score = (data[near] * asked[i]).sum(axis=1)  # in one order, whatever the candidates
                best = np.lexsort((ids[x[near]], -score))[: k + 1]
                out.append((np.full(len(best), ids[q[i]]), ids[x[near[best]]], score[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "entry", "score"])

    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible
    by ``every``, itself excluded, by largest inner product, then smallest id.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do
    rows without an id. A repeated row (same id and vector) counts once. Vectors are only compared
    with those of their length. An empty table gives an empty one; other columns play no part.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    some = source.mapInArrow(_groups(k), "vector binary, vec_id long").distinct()
    ranked = some.withColumn("place", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    members = ranked.withColumn("entry", F.first("vec_id").over(W.partitionBy("vector").orderBy("vec_id")))
    store.small_batches(spark)
    members = store.materialise(members.select("vector", "vec_id", "entry", "place"), "members")
    entries = members.filter("place = 1")
    blocks = max(1, -(-entries.count() // BLOCK_ROWS))
    asked = store.materialise(source.filter(F.col("vec_id") % every == 0).mapInArrow(_queries, "vector binary, vec_id long").distinct(), "asked")
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    index = entries.select("vector", F.col("entry").alias("id"), F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    ask = asked.select("vector", F.col("vec_id").alias("id"), F.lit(True).alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    ask = ask.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cols = ["vector", "id", "query", "block", "part"]
    found = index.select(cols).unionByName(ask.select(cols)).groupBy("block", "part").applyInArrow(_search(k), "query_id long, entry long, score double")
    best = found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entry"))).filter(F.col("place") <= k + 1).drop("place")
    every_id = best.join(members.select("entry", "vec_id"), "entry").filter("vec_id <> query_id").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every_id.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
