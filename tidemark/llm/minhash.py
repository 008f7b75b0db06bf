"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

Every distinct shingle set has a signature of CHUNKS * WIDTH symbols of 16 bits, cut into CHUNKS
chunks. Two signatures that differ in at most 2 * CHUNKS - 1 symbols have, by the pigeonhole
principle, a chunk with at most one differing symbol; so each chunk is entered once for each
symbol that may be wrong, keyed by its other symbols, and every pair within that distance meets
under some key. Sets that meet are confirmed by their full shingle sets.

No bucket emits its pairs. Each bucket's members are first held against three centres (the
bucket's smallest by three hash orders), and the links found join components. Only a bucket whose
members then still lie in different components is searched again, in blocks of bounded size: all
its members outside its largest component against all members of other components, which finds
every link that could still join two of them. Exact copies of a set are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import buffers as B, store, url_filter
from .components import components
from .url_filter import Bloom, fill

CHUNKS, WIDTH = 10, 5
SYMBOLS = CHUNKS * WIDTH
MAX_DISTANCE = 2 * CHUNKS - 1
#: Pairs that met are confirmed up to this distance, which a pair of similarity 0.8 passes five standard deviations out.
CONFIRM_DISTANCE = 24
BLOCK = 2048
_OWN = "doc_id long, words long, n_shingles long, digest binary, sig binary"
_SETS = "rep long, digest binary, grams binary"


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    x = B.mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * B._ODD)
    return x[:SYMBOLS] | B.U(1), x[SYMBOLS:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SYMBOLS) symbols of 16 bits of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k, (a, b) in enumerate(zip(*_multipliers())):
        out[:, k] = (np.minimum.reduceat(flat * a + b, starts) >> B.U(8)).astype(np.uint16)
    return out


def digest(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(signatures, CHUNKS * WIDTH) keys: each chunk without each of its symbols in turn."""
    out = np.empty((len(sig), CHUNKS * WIDTH), np.uint64)
    wide = sig.astype(np.uint64)
    for c in range(CHUNKS):
        for wrong in range(WIDTH):
            key = np.zeros(len(sig), np.uint64)
            for j in range(WIDTH):
                if j != wrong:
                    key = (key << B.U(16)) | wide[:, c * WIDTH + j]
            place = c * WIDTH + wrong
            out[:, place] = B.mix(key ^ B.mix(np.array([place + 1], np.uint64))[0])
    return out


def _texts(b: pa.RecordBatch, k: int):
    """(row, its sorted distinct shingles), in bounded slices of the batch."""
    data, offs = B.utf8(b.column(1))
    for i, j in B.spans(offs):
        hashes, first = B.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, list(B.shingles(hashes, first, k))


def describe(k: int):
    """mapInArrow function: (doc_id, text, text's hash) to the text's set size, digest and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, dig, sig = [], [], []
            for _, sets in _texts(b, k):
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full) if full else ())
                n += [len(s) for s in sets]
                dig += [digest(s) if len(s) else None for s in sets]
                sig += [next(rows).tobytes() if len(s) else None for s in sets]
            cols = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "words", "n_shingles", "digest", "sig"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(sig)
            ids = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "node"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) to the (a, b) within CONFIRM_DISTANCE."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (2, 3))
            keep = pa.array((x != y).sum(axis=1) <= CONFIRM_DISTANCE)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _sets_of(k: int, ids: Bloom, nodes: Bloom):
    """mapInArrow function: (doc_id, text) to (rep, digest, grams), of the nodes in both filters. No id is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).fill_null(-1).to_numpy()
            some = ids.has(doc.view(np.uint64)) if len(doc) else np.zeros(0, bool)
            b, doc = b.filter(pa.array(some)), doc[some].tolist()
            for i, sets in _texts(b, k):
                at = [r for r, s in enumerate(sets) if len(s)]
                digs = {r: digest(sets[r]) for r in at}
                if at:
                    own = np.array([_node(doc[i + r], digs[r]) for r in at], np.uint64)
                    at = [r for r, ok in zip(at, nodes.has(own)) if ok]
                cols = [pa.array([doc[i + r] for r in at], pa.int64()), pa.array([digs[r] for r in at], pa.binary()), pa.array([sets[r].tobytes() for r in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "digest", "grams"])

    return run


def _node(rep: int, dig: bytes) -> int:
    return (int.from_bytes(dig[:8], "little") + int(rep) * 0x9E3779B97F4A7C15) & (2**64 - 1)


def _node_keys(b: pa.RecordBatch) -> np.ndarray:
    return np.array([_node(r, d) for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.uint64)


def similar(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _confirm(percent: int):
    """(a, b, grams_a, grams_b) to the (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                keep.append(ok and similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return run


def _cross(percent: int):
    """applyInArrow function over one block pair: links between its different components."""

    def run(t: pa.Table) -> pa.Table:
        B.lean()
        rep, comp = t.column("node").to_numpy(), t.column("comp").to_numpy().copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams").combine_chunks()]
        rep, at = np.unique(rep, return_index=True)
        comp, sets = comp[at], [sets[i] for i in at]
        size = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
        flag = np.zeros(len(vocabulary), bool)
        names, n = np.unique(comp, return_counts=True)
        found = []
        for x in np.flatnonzero(comp != names[n.argmax()]):
            own = code[starts[x] : starts[x] + size[x]]
            flag[own] = True
            inter = np.add.reduceat(flag[code], starts, dtype=np.int64)
            flag[own] = False
            for y in np.flatnonzero((comp != comp[x]) & (100 * inter >= percent * (size + size[x] - inter))):
                if comp[y] != comp[x]:
                    found.append((int(rep[x]), int(rep[y])))
                    comp[comp == comp[y]] = comp[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words, n_shingles, comp, component_id) of every row; ``words`` is the text's hash,
    ``comp`` the number of the row's component, null without shingles."""
    store.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("words"))
    own = store.materialise(source.mapInArrow(describe(k), _OWN), "own")
    # a node is a set, whatever rows have it; rep is the id under which its shingles are fetched
    nodes = own.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sig")).alias("r"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "r.doc_id", F.coalesce("r.doc_id", F.lit(-1)).alias("rep"), "r.sig", "digest")
    nodes = store.materialise(nodes, "nodes")

    keys = nodes.select("node", "sig").mapInArrow(_keys, "key long, node long")
    centre = [F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"c{i}") for i in range(3)]
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), *centre).filter("n > 1")
    members = store.materialise(keys.join(buckets, "key"), "members")

    pairs = members.select("node", F.explode(F.array("c0", "c1", "c2")).alias("c")).filter("node <> c")
    pairs = pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    sig = nodes.select("node", "sig")
    pairs = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    pairs = store.materialise(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_near, "a long, b long"), "pairs")

    inside = store.materialise(nodes.join(members.select("node").distinct(), "node", "left_semi").select("rep", "digest", "node"), "inside")
    n = max(inside.count(), 1)
    ids = fill(inside.select(F.col("rep").alias("key")), Bloom(n, 0.01, 1, url_filter.SENT_BYTES))
    own_keys = fill(inside.select("rep", "digest"), Bloom(n, 1e-6, 2, url_filter.SENT_BYTES), _node_keys)
    # the filters spare work only: the join keeps the nodes alone, however many others pass
    sets = source.select("doc_id", "text").mapInArrow(_sets_of(k, ids, own_keys), _SETS).dropDuplicates(["rep", "digest"])
    sets = store.materialise(sets.join(inside, ["rep", "digest"]).select("node", "grams"), "sets")

    wide = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
    links = store.materialise(wide.select("a", "b", "grams_a", "grams_b").mapInArrow(_confirm(percent), "a long, b long"), "links")
    first = store.materialise(components(links), "first")
    store.discard(pairs, inside, links)

    comp = first.toDF("node", "comp")
    placed = store.materialise(members.filter("n > 2").select("key", "node", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    store.discard(members)
    h = F.xxhash64("node")
    shape = placed.groupBy("key", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("y"))
    still = shape.filter("lo <> hi").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")  # one of the buckets with the same members
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    dealt = placed.join(still, "key", "left_semi").withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "node", "comp", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    more = dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_cross(percent), "a long, b long")
    mapped = more.join(first.toDF("a", "ca"), "a", "left").join(first.toDF("b", "cb"), "b", "left")
    second = components(mapped.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    store.discard(placed, sets)

    label = nodes.select("digest", "doc_id", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    label = label.join(second.toDF("comp", "top"), "comp", "left").select("digest", "doc_id", F.coalesce("top", "comp").alias("comp"))
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "comp").select("digest", "comp", "component_id")
    out = own.select("doc_id", "words", "n_shingles", "digest").join(label, "digest", "left")
    return out.select("doc_id", "words", "n_shingles", "digest", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def link_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Rows are linked if 100 * |A and B| >= ``percent`` * |A or B| for their sets of distinct
    ``k``-word shingles. component_id is the smallest doc_id reachable by links. Null and empty
    texts have no shingles and no links. Repeated rows are copies of each other, while two texts
    under one id are linked only if they are similar; a null doc_id never names a component, and the
    component of rows without ids alone is null. An empty table gives an empty one; other columns
    play no part.
    """
    out = _components(docs, k, percent, id_col, text_col)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; all columns are kept.

    It is decided by row: of two texts under one id each stays or goes with its own group. Rows
    without an id come last in their group, of repeated rows that with the smallest hash of all
    columns stays, and rows without shingles all stay.
    """
    columns = docs.columns
    rows = store.materialise(_components(docs, k, percent, id_col, text_col).filter("digest is not null").select("doc_id", "words", "comp"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "words")
    best = rows.groupBy("comp").agg(F.min(place).alias("best")).select("best.doc_id", "best.words")
    texts = rows.groupBy("doc_id", "words").agg(F.count("*").alias("rows"))
    same = [F.col("t.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("t.words") == F.col("b.words")]
    flags = texts.alias("t").join(best.withColumn("is_best", F.lit(True)).alias("b"), same, "left").select("t.doc_id", "t.words", "rows", F.col("is_best").isNotNull().alias("best"))
    flags = store.materialise(flags.filter("not best or rows > 1").select(F.col("doc_id").alias("__id"), F.col("words").alias("__words"), "best"), "flags")
    store.discard(rows)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(id_col).cast("long").alias("__own"), F.xxhash64(text_col).alias("__text"))
    match = [F.col("__own").eqNullSafe(F.col("__id")), F.col("__text") == F.col("__words")]
    single = own.join(flags, match, "left_anti").select("__row")
    repeated = flags.filter("best")
    if not repeated.isEmpty():
        several = own.join(repeated, match).groupBy("__own", "__text").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
        single = single.unionByName(several.select("__row"))
    return single.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])
