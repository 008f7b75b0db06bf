"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Strings are
brought together by anchors: of each string's 32-byte grams the one of the smallest hash, the
leftmost of equals. Equal strings have equal anchors, so all starts of a string meet under one
anchor hash. Consecutive starts with the same anchor are a run, and the bytes their strings cover
its context. Runs are counted by anchor and by the context's hash before any text moves:

- an anchor with one run holds nothing repeated;
- runs whose contexts are all equal are repeated whole;
- where contexts differ, one of each goes to a shard of bounded size. There a suffix array by
  Larsson-Sadakane refinement and Kasai's common prefixes tell which strings repeat;
- an anchor of more contexts than a shard holds is first taken apart. Equal strings have their
  anchor at the same offset, so a run is cut into cells of neighbouring offsets. All strings of a
  cell have a core of bytes in common, and equal strings have equal cores: the parts of one cell
  and core are counted like the runs of an anchor, and what is still too many is cut into smaller
  cells. In a cell of one offset the core is the string, so this ends.

Contexts count as equal if the 64-bit hashes of their anchors and those of their bytes and length
agree, 128 bits in all. A row is told by its id and a 64-bit hash of its text, so only rows of one
id could be taken for each other, and they only by chance of 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from . import buffers as B, store, url_filter
from .url_filter import Bloom, fill

LENGTH = 200
GRAM = 32
SHARD_CONTEXTS = 2_500
MERGE_STRINGS = 25_000  # no longer read: shards have no strings to merge; test_repeats sets it
CELL = 4  # cells of a cell
SEGMENT = 400_000
CHUNK = 250_000
_POSITION = B.U((1 << 24) - 1)


# --- suffix arrays ----------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, rank, next seven symbols or 0) of symbols 1..256 with 0 between strings; each 0 differs from others.

    Suffixes are first sorted by seven symbols. Then groups of equal rank are refined by the rank
    of what follows their sorted part, which doubles it; groups of one are left alone.
    """
    n = len(text)
    wide = np.zeros(n + 7, np.uint64)
    wide[:n] = text
    key = np.zeros(n, np.uint64)
    ends = np.zeros(n, bool)  # whether a 0 is among the seven
    for j in range(7):
        own = wide[j : j + n]
        ends |= own == 0
        key = (key << B.U(9)) | np.where(ends, B.U(0), own)
    sa = np.argsort(key).astype(np.int32)
    tied = np.flatnonzero(ends[sa])  # equal up to their 0: by position, as their 0s differ so
    sa[tied] = sa[tied][np.lexsort((sa[tied], key[sa[tied]]))]
    new = np.ones(n, bool)
    new[1:] = (key[sa][1:] != key[sa][:-1]) | ends[sa][1:] | ends[sa][:-1]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    h = 7
    while True:
        last = np.append(new[1:], True)
        slots = np.flatnonzero(~(new & last))  # of groups of more than one
        if not len(slots):
            return sa, rank, np.where(ends, B.U(0), key)
        own = sa[slots]
        group, follow = rank[own], rank[own + h]
        order = np.argsort(group.astype(np.int64) * n + follow)
        own, group, follow = own[order], group[order], follow[order]
        sa[slots] = own
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[slots] = fresh
        rank[own] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, seven: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each suffix, the symbols it shares with the one before it in the suffix array.

    Kasai's walk: from one position of a string to the next the number falls by one at most. All
    strings take a step together.
    """
    out = np.zeros(len(text), np.int32)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    depth = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")  # strings longer than a step
    starts, h = starts.astype(np.int32), np.zeros(len(starts), np.int32)
    for step in range(int(sizes.max(initial=0))):
        n = int(depth[step])
        i = starts[:n] + step
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        live = np.flatnonzero(r > 0)
        h[:n][r == 0] = 0
        fine = []
        while len(live):  # by seven symbols, then by one
            a, b = i[live] + h[live], j[live] + h[live]
            x = seven[a]
            same = (x == seven[b]) & (x > 0)
            fine.append(live[~same])
            live = live[same]
            h[live] += 7
        live = np.concatenate(fine) if fine else live
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            x = text[a]
            live = live[(x == text[b]) & (x > 0)]
            h[live] += 1
        out[i] = h[:n]
        h[:n] = np.maximum(h[:n] - 1, 0)
    return out


def repeats(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text offsets of the contexts, whether the string at each position repeats, leader).

    A leader is the first in the suffix array of the positions whose strings are equal.
    """
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    for s, c in zip(starts, contexts):
        text[s : s + len(c)] = np.frombuffer(c, np.uint8)
    text += 1
    text[starts + sizes] = 0
    sa, rank, seven = suffix_array(text)
    shared = common_prefixes(text, sa, rank, seven, starts, sizes)
    with_before = shared[sa] >= length
    with_next = np.append(with_before[1:], False)
    repeated, leader = np.zeros(len(text), bool), np.zeros(len(text), bool)
    repeated[sa] = with_before | with_next
    leader[sa] = ~with_before
    return starts, repeated, leader


# --- runs ---------------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offs: np.ndarray, length: int):
    """(text, start, stop, anchor, context) of the runs of some texts; starts are [start, stop)."""
    n = len(data)
    starts_ok = np.zeros(n, bool)
    for a, b in zip(offs[:-1], offs[1:]):
        starts_ok[a : max(a, b - length + 1)] = True
    if n < length or not starts_ok.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    prefix = B.prefix_hash(B.BYTE_VALUES[data])
    at = np.arange(n - GRAM + 1)
    gram = B.range_hash(prefix, at, at + GRAM)
    least = sliding_min((gram & ~_POSITION) | at.astype(np.uint64), length - GRAM + 1)
    anchor = (least & _POSITION).astype(np.int64)
    ok = starts_ok[: len(anchor)]
    text = np.zeros(n + 1, np.int64)
    np.add.at(text, offs[1:-1], 1)
    text = np.cumsum(text[: len(anchor)])
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    stop = np.flatnonzero(last) + 1
    own = text[start]
    context = B.range_hash(prefix, start, stop + length - 1)
    base = offs[own]
    return own, start - base, stop - base, gram[anchor[start]], context


def _find_runs(length: int):
    """mapInArrow function: (doc, row, text) to runs. A very long text is walked in segments."""
    names = ["doc", "row", "start", "stop", "anchor", "context"]

    def one(data, offs, keys, shift=0):
        own, start, stop, anchor, context = runs(data, offs, length)
        cols = [(start + shift).astype(np.int32), (stop + shift).astype(np.int32), anchor.view(np.int64), context.view(np.int64)]
        return pa.RecordBatch.from_arrays([*(pa.array(k[own]) for k in keys), *map(pa.array, cols)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b.column(0).to_numpy(), b.column(1).to_numpy()]
            data, offs = B.utf8(b.column(2))
            for i, j in B.spans(offs, CHUNK):
                lo, hi = offs[i], offs[j]
                own = [k[i:j] for k in keys]
                if hi - lo <= SEGMENT:
                    yield one(data[lo:hi], offs[i : j + 1] - lo, own)
                    continue
                for s in range(0, int(hi - lo), SEGMENT):
                    end = min(int(hi - lo), s + SEGMENT + length - 1)
                    yield one(data[lo + s : lo + end], np.array([0, end - s]), own, s)

    return run


# --- shards -------------------------------------------------------------------------------------


_RUN = ["doc", "row", "start", "stop", "anchor", "context", "n", "of"]
_CONTEXT = "doc long, row long, start int, stop int, anchor long, context long, n long, of long, bytes binary"
_PART = "doc long, row long, start int, stop int, anchor long, piece long, context long, n long, at int, bytes binary"


def _contexts(length: int):
    """mapInArrow function: (text, wanted) to one row a wanted context, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = B.utf8(b.column(0))
            raw = memoryview(np.ascontiguousarray(data))
            wanted = b.column(1)
            flat = wanted.flatten()
            owner = np.repeat(offs[:-1], np.diff(wanted.offsets.to_numpy()))
            cols = [flat.field(n) for n in _RUN]
            start, stop = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
            for i in range(0, len(flat), 4_000):  # contexts are longer than runs, so in slices
                part = slice(i, i + 4_000)
                own = [raw[o + s : o + e + length - 1] for o, s, e in zip(owner[part].tolist(), start[part].tolist(), stop[part].tolist())]
                yield pa.RecordBatch.from_arrays([*(c[part] for c in cols), pa.array(own, pa.binary())], [*_RUN, "bytes"])

    return run


def _widths(length: int) -> list[int]:
    """Offsets of a cell, round by round; the last round has cells of one."""
    out = [1]
    while out[0] * CELL < length - GRAM + 1:
        out.insert(0, out[0] * CELL)
    return out


def _placed(length: int):
    """Function of the batches of ``_contexts``: with the places of their anchors, as parts that no cell has cut yet."""
    names = [c.split()[0] for c in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            raw = b.column("bytes").to_pylist()
            prefix = B.prefix_hash(B.BYTE_VALUES[np.frombuffer(b"".join(raw), np.uint8)])
            base = np.cumsum([0, *map(len, raw[:-1])])
            at = base[:, None] + np.arange(length - GRAM + 1)  # of the first string's grams; its anchor is the first of its hash
            anchor = b.column("anchor").to_numpy().view(np.uint64)
            place = (B.range_hash(prefix, at, at + GRAM) == anchor[:, None]).argmax(axis=1) + b.column("start").to_numpy()
            more = {"piece": pa.array(np.zeros(len(raw), np.int64)), "at": pa.array(place.astype(np.int32))}
            yield pa.RecordBatch.from_arrays([more[c] if c in more else b.column(c) for c in names], names)

    return run


def _cut(length: int, width: int):
    """mapInArrow function: parts cut into cells of ``width`` offsets; a part's piece is the hash of its cell and core."""
    import xxhash

    names = [c.split()[0] for c in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.lean()
        for b in batches:
            out = {c: [] for c in ("owner", "start", "stop", "piece", "context", "bytes")}
            own = (b.column(c).to_pylist() for c in ("start", "stop", "at", "bytes"))
            for k, (start, stop, at, raw) in enumerate(zip(*own)):
                for cell in range((at - stop + 1) // width, (at - start) // width + 1):
                    near, far = cell * width, min(cell * width + width - 1, length - GRAM)
                    first, last = max(start, at - far), min(stop, at - near + 1)
                    part = raw[first - start : last - start + length - 1]
                    core = raw[at - near - start : at - far - start + length]
                    out["owner"].append(k)
                    out["start"].append(first)
                    out["stop"].append(last)
                    out["piece"].append(xxhash.xxh3_64_intdigest(core, cell + 1))
                    out["context"].append(xxhash.xxh3_64_intdigest(part))
                    out["bytes"].append(part)
            owner = pa.array(out.pop("owner"), pa.int64())
            cols = {c: pa.array(np.array(out[c], np.uint64).view(np.int64)) for c in ("piece", "context")}
            cols |= {c: pa.array(out[c], pa.int32()) for c in ("start", "stop")} | {"bytes": pa.array(out["bytes"], pa.binary())}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else b.column(c).take(owner) for c in names], names)

    return run


def _taken_apart(parts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(parts of pieces that fit a shard, with their number ``of`` in the piece; spans found on the way), as
    materialised tables, from contexts of very common anchors in the first round's cells. Each round makes at most ``CELL`` parts of a part."""
    fit, spans = [], []
    group = ["anchor", "piece"]
    for width in _widths(length):
        cut = store.materialise(parts.mapInArrow(_cut(length, width), _PART) if fit else parts, "cut")
        same = cut.groupBy(*group, "context").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("doc", "row", "start", "stop", "at", "bytes")).alias("r"))
        same = store.materialise(same.select(*group, "context", "n", "rows", "r.*"), "same")
        again = same.filter("rows > 1").select(*group, "context", "rows")
        again = store.join_facts(cut.filter("n = 1"), again, [*group, "context"], "rows", cut.count())
        spans.append(store.materialise(again.select("doc", "row", F.col("start").alias("lo"), (F.col("stop") - 1 + length).alias("hi")), "again"))
        pieces = store.materialise(same.groupBy(group).agg(F.count("*").alias("of")).filter("of > 1"), "pieces")
        dealt = store.materialise(store.join_facts(same.drop("rows"), pieces, group, "of", same.count()), "dealt")
        store.discard(cut, same, pieces)
        fit.append(dealt)
        parts = dealt.filter(F.col("of") > SHARD_CONTEXTS)
        if width == 1 or parts.isEmpty():
            break
    return fit, spans


def _shard_of(shards: int) -> Column:
    """The shard of a context of (anchor, piece, of). A piece of a common anchor is a shard of its own, so
    that no two of them meet; the others are dealt over ``shards``."""
    own = F.xxhash64("anchor", "piece")
    return F.when(F.col("of") > SHARD_CONTEXTS // 8, own.bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))).otherwise(F.pmod(own, F.lit(shards)))


_FOUND = "doc long, row long, lo int, hi int"


def _shard(length: int):
    """applyInArrow function over a shard: the stretches of its contexts whose strings repeat."""

    def run(t: pa.Table) -> pa.Table:
        B.lean()
        t = t.combine_chunks()
        first, stop, n = (t.column(c).to_numpy() for c in ("start", "stop", "n"))
        starts, repeated, _ = repeats(t.column("bytes").to_pylist(), length)
        # every start of a string: its context k, its place in the run and in the shard's text
        width = (stop - first).astype(np.int64)
        k = np.repeat(np.arange(len(width)), width)
        within = np.arange(len(k)) - np.repeat(np.cumsum(width) - width, width)
        gone = repeated[starts[k] + within] & (n[k] == 1)  # contexts that occur more often are repeated whole already
        edge = np.ones(len(k), bool)
        edge[1:] = k[1:] != k[:-1]
        head, tail = gone.copy(), gone.copy()
        head[1:] &= edge[1:] | ~gone[:-1]
        tail[:-1] &= edge[1:] | ~gone[1:]
        head, tail = np.flatnonzero(head), np.flatnonzero(tail)
        lo, hi = first[k[head]] + within[head], first[k[tail]] + within[tail] + length
        cols = [t.column("doc").take(k[head]), t.column("row").take(k[head]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
        return pa.table(cols, ["doc", "row", "lo", "hi"])

    return run


# --- texts --------------------------------------------------------------------------------------


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that some spans cover; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.ones(len(starts), bool)
    head[1:] = starts[1:] > reach[:-1]
    last = np.append(head[1:], True) if len(head) else head
    return starts[head], reach[last]


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finished(b: pa.RecordBatch, spans: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """The result's rows for texts and the spans to cut from each, in bounded slices."""
    data, offs = B.utf8(b.column(b.schema.get_field_index("text")))
    doc = b.column(b.schema.get_field_index("doc_id"))
    if spans is not None:
        first = spans.offsets.to_numpy()
        lo, hi = (spans.values.field(c).to_numpy() for c in ("lo", "hi"))
    for i, j in B.spans(offs):
        own, size = data[offs[i] : offs[j]], np.diff(offs[i : j + 1])
        starts = ends = n_spans = np.zeros(0, np.int64)
        if spans is not None:
            part = slice(first[i], first[j])
            text = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
            base = (offs[i:j] - offs[i])[text] + text  # one place between texts keeps their spans apart
            starts, ends = union(base + lo[part], base + hi[part])
            text = np.searchsorted(offs[i : j + 1] - offs[i] + np.arange(j - i + 1), starts, side="right") - 1
            n_spans, starts, ends = text, starts - text, ends - text
        stay = np.ones(len(own), bool)
        if len(starts):
            edge = np.zeros(len(own) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
            stay = np.cumsum(edge[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(stay)])[offs[i : j + 1] - offs[i]]
        kept = own[stay].tobytes()
        digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(left[:-1].tolist(), left[1:].tolist())]
        whole = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(kept)])
        counts = np.bincount(n_spans, minlength=j - i)
        cols = [doc[i:j], pa.array(size), pa.array(size - np.diff(left)), pa.array(counts.astype(np.int64)), pa.array(digests, pa.string()), whole.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, text, spans) to the result's rows, with the bytes that stay."""
    for b in batches:
        if b.num_rows:
            yield from _finished(b, b.column(2))


def _row_keys(b: pa.RecordBatch) -> np.ndarray:
    return B.mix(b.column(0).to_numpy().view(np.uint64) * B._ODD) ^ b.column(1).to_numpy().view(np.uint64)


def _inside(bloom: Bloom):
    """mapInArrow function: the rows (doc, row, ...) in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            B.lean()
            if b.num_rows:
                yield b.filter(pa.array(bloom.has(_row_keys(b))))

    return run


def _untouched(bloom: Bloom):
    """mapInArrow function: the result's rows for the texts that aren't in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                b = b.filter(pa.array(~bloom.has(_row_keys(b))))
                yield from _finished(b, None)

    return run


def _filter_of(rows: DataFrame) -> Bloom:
    """A filter of the keys of ``rows``, which are distinct. It spares shuffles of texts that nothing
    is known of; its size is bounded, so with very many rows it takes in more of the others."""
    return fill(rows.select("doc", "row"), Bloom(max(rows.count(), 1), 0.01, 5, url_filter.SENT_BYTES), _row_keys)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` holds the
    bytes that stay.

    Texts are UTF-8 bytes, null is empty; strings never cross texts. A repeated row is a text of
    its own, so both lose all strings of ``length``. Texts shorter than ``length`` lose nothing.
    An empty table gives an empty one; other columns play no part. The runs and spans of one text
    are one array, which is of the order of the text.
    """
    store.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # rows of equal id and text share a key: they have equal results
    source = source.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("row"), "doc_id", "text")
    key = ["doc", "row"]
    every = store.materialise(source.select(*key, "text").mapInArrow(_find_runs(length), "doc long, row long, start int, stop int, anchor long, context long"), "runs")
    total = every.count()
    common = every.groupBy("anchor").agg(F.count("*").alias("of"), F.min("context").alias("lo"), F.max("context").alias("hi")).filter("of > 1")
    common = store.materialise(common.select("anchor", "of", (F.col("lo") == F.col("hi")).alias("same")), "common")
    shared = store.materialise(store.join_facts(every, common, ["anchor"], "of", total).drop("of"), "shared")
    store.discard(every, common)

    mixed = shared.filter(~F.col("same"))
    kinds = mixed.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct(*key, "start", "stop")).alias("r"))
    kinds = store.materialise(kinds.select("anchor", "context", "n", "r.*"), "kinds")
    n_kinds = kinds.count()
    per_anchor = store.materialise(kinds.groupBy("anchor").agg(F.count("*").alias("of")), "per-anchor")
    dealt = store.join_facts(kinds, per_anchor, ["anchor"], "of", n_kinds)
    texts = source.select(*key, "text")

    def contexts(rows: DataFrame, then=lambda batches: batches, schema: str = _CONTEXT) -> DataFrame:
        wanted = store.materialise(rows.groupBy(key).agg(F.collect_list(F.struct(*_RUN)).alias("wanted")), "wanted")
        held.append(wanted)
        some = texts.mapInArrow(_inside(_filter_of(wanted)), "doc long, row long, text string")
        some = some.dropDuplicates(key).join(wanted, key).select("text", "wanted")
        read = _contexts(length)
        return some.mapInArrow(lambda batches: then(read(batches)), schema)  # in one worker a task

    held, apart, crossed = [per_anchor], [], []
    if not per_anchor.filter(F.col("of") > SHARD_CONTEXTS).isEmpty():
        place, cut = _placed(length), _cut(length, _widths(length)[0])
        apart, crossed = _taken_apart(contexts(dealt.filter(F.col("of") > SHARD_CONTEXTS), lambda batches: cut(place(batches)), _PART), length)
    sharded = ["doc", "row", "start", "stop", "anchor", "piece", "n", "of", "bytes"]
    ready = contexts(dealt.filter(F.col("of") <= SHARD_CONTEXTS)).withColumn("piece", F.lit(0).cast("long")).select(sharded)
    for i, table in enumerate(apart):  # the last round's all fit
        ready = ready.unionByName((table if i == len(apart) - 1 else table.filter(F.col("of") <= SHARD_CONTEXTS)).select(sharded))
    shards = max(1, -(-2 * (n_kinds + sum(table.count() for table in apart)) // SHARD_CONTEXTS))
    found = store.materialise(ready.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInArrow(_shard(length), _FOUND), "found")
    store.discard(*held, *apart)

    again = kinds.filter("n > 1").select("anchor", "context", "n")
    whole = shared.filter("same").select(*key, "start", "stop")
    whole = whole.unionByName(store.join_facts(mixed.drop("same"), again, ["anchor", "context"], "n", total).select(*key, "start", "stop"))
    spans = whole.select(*key, F.col("start").alias("lo"), (F.col("stop") - 1 + length).alias("hi")).distinct()
    for table in (found, *crossed):
        spans = spans.unionByName(table)
    spans = store.materialise(spans.groupBy(key).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    store.discard(shared, kinds, found, *crossed)
    bloom = _filter_of(spans)
    inside = source.mapInArrow(_inside(bloom), source.schema)
    touched = inside.join(spans, key, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans")).mapInArrow(_finish, _OUT)
    return touched.unionByName(source.mapInArrow(_untouched(bloom), _OUT))
