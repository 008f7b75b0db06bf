"""Allow and block rules over urls by a cascade of Bloom filters.

A rule is a host and a path; it fits the host and its subdomains if the url's path begins with the
rule's. Each url has few keys that a rule could have: a suffix of its host with a beginning of its
path as long as some rule's. Over the corpus's complete set of such keys (the universe) the
cascade is exact: level 0 encodes the listed keys, each further level the keys of the other side
that the level before took in wrongly, until none is left. A key is listed if it leaves the
cascade at an odd level. Urls are judged by filters alone, without a join.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import buffers as B, store

MAX_FILTER_BYTES = 64 << 20
#: largest filter that only spares work: past it more keys pass, and the joins behind it take them
SENT_BYTES = 32 << 20
MAX_LEVELS = 64
#: words of a filter that travel as one row
PIECE_WORDS = 4096


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


class Bloom:
    """A Bloom filter over 64-bit hashes; ``seed`` sets levels apart."""

    def __init__(self, n: int, rate: float, seed: int, max_bytes: int | None = None):
        """For ``n`` keys; past ``max_bytes`` the filter stays that large and takes in more wrongly."""
        rate = min(max(rate, 1e-6), 0.5)
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.probes = max(1, round(-math.log2(rate)))
        if max_bytes and self.bits > 8 * max_bytes:
            self.bits = max(64, 8 * max_bytes)
            self.probes = max(1, round(self.bits / n * math.log(2)))
        self.seed = seed
        self.words = np.zeros((self.bits + 63) // 64, np.uint64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        h = B.mix(keys + B.U((0x9E3779B97F4A7C15 * (self.seed + 1)) & (2**64 - 1)))
        step = B.mix(h) | B.U(1)
        return np.stack([(h + step * B.U(i)) % B.U(self.bits) for i in range(self.probes)])

    def add(self, keys: np.ndarray) -> None:
        at = self.places(keys).ravel()
        np.bitwise_or.at(self.words, (at >> B.U(6)).astype(np.int64), B.U(1) << (at & B.U(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return ((self.words[(at >> B.U(6)).astype(np.int64)] >> (at & B.U(63))) & B.U(1)).all(axis=0)


class Cascade:
    """Exact membership over a known universe. ``listed(keys)`` is right for its keys only."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def depth(self, keys: np.ndarray) -> np.ndarray:
        """The first level without the key."""
        out = np.full(len(keys), len(self.levels))
        live = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            hit = level.has(keys[live]) if len(live) else np.zeros(0, bool)
            out[live[~hit]] = i
            live = live[hit]
        return out

    def listed(self, keys: np.ndarray) -> np.ndarray:
        return self.depth(keys) % 2 == 1


def _first(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy().view(np.uint64)


def fill(keys: DataFrame, bloom: Bloom, key_of=_first) -> Bloom:
    """Set the bits of all rows of ``keys``, whose 64-bit keys ``key_of`` tells from a batch (by default
    its first column). A task fills a filter of its own and gives its pieces of ``PIECE_WORDS`` words that
    have a bit; pieces of one place meet in an OR."""
    own, size, schema = copy.copy(bloom), len(bloom.words), "first long, bits binary"
    own.words = None  # not sent to the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own.words = np.zeros(size, np.uint64)
        for b in batches:
            if b.num_rows:
                own.add(key_of(b))
        for s in range(0, size, PIECE_WORDS):
            piece = own.words[s : s + PIECE_WORDS]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([piece.tobytes()], pa.binary())], ["first", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["bits"]]
        return pa.table([t["first"].slice(0, 1), pa.array([np.bitwise_or.reduce(pieces).tobytes()], pa.binary())], ["first", "bits"])

    got = keys.mapInArrow(run, schema).groupBy("first").applyInArrow(merge, schema).toArrow()  # no more than the filter
    for first, bits in zip(got["first"].to_pylist(), got["bits"].to_pylist()):
        bloom.words[first : first + len(bits) // 8] = np.frombuffer(bits, np.uint64)
    return bloom


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade:
    """Cascade of ``listed`` over ``universe``, both (key long) without repeats.

    The first level is sized for both sides, the rest halve. A level of more than ``max_bytes``
    is refused; deal the keys into more ``segments`` then (see ``judge``).
    """
    r, s = listed.count(), universe.count()
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    levels: list[Bloom] = []
    n, rate = r, min(0.5, math.sqrt(0.5) * max(r, 1) / max(s - r, 1))
    while n and len(levels) < MAX_LEVELS:
        level = Bloom(n, rate, len(levels))
        if level.words.nbytes > max_bytes:
            raise ValueError(f"a filter of {level.words.nbytes} bytes passes the bound of {max_bytes}; raise segments")
        fill(inside, level)
        levels.append(level)
        wrong = store.materialise(outside.mapInArrow(passing(level), "key long"), "wrong")
        inside, outside, rate = wrong, inside, 0.5
        n = wrong.count()
    if n:
        raise ValueError("the cascade does not end: a listed key and another share a hash")
    return Cascade(levels)


def passing(level: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[level.has(keys.view(np.uint64))])], ["key"])

    return run


def candidates(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """The keys of a url, the longest first: host suffixes of ``most`` labels at most, which is as many as any
    rule has, with beginnings of the path."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(n - most + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in sorted(set(lengths), reverse=True)]), lambda x: x.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    return F.when(F.length(host) == 0, F.array().cast("array<string>")).otherwise(pairs)


def key_of(rule: Column) -> Column:
    return F.xxhash64(rule)


def _first_listed(block: list[Cascade], allow: list[Cascade]):
    """mapInArrow function: keys of each url to the place of the first listed key and its side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("keys"))
            offs = column.offsets.to_numpy().astype(np.int64)
            keys = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            seg = (keys >> B.U(48)) % B.U(len(block))
            side = np.zeros(len(keys), np.int8)
            for s in range(len(block)):
                here = np.flatnonzero(seg == s)
                side[here[block[s].listed(keys[here])]] = 2
                side[here[allow[s].listed(keys[here])]] = 1
            hits = np.flatnonzero(side)
            first = np.searchsorted(hits, offs[:-1])
            at = np.where(first < len(hits), hits[np.minimum(first, max(len(hits) - 1, 0))] if len(hits) else 0, offs[1:])
            ok = (first < len(hits)) & (at < offs[1:])
            place = np.where(ok, at - offs[:-1] + 1, 0)
            verdict = np.where(ok, side[np.minimum(at, max(len(side) - 1, 0))] if len(side) else 0, 0)
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place.astype(np.int32)), pa.array(verdict.astype(np.int32))], [*names, "place", "side"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", segments: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url.

    ``rules`` are (verdict, host, path). Of the rules that fit, the one with the longest host
    wins, then the one with the longest path; of an allow and a block rule alike, the allow rule.
    A url that no rule fits is in no list, and the cascade's answer for it is allow. Null ids and
    repeated rows are kept; an empty table gives an empty table; other columns play no part. The
    keys are dealt into ``segments`` with a cascade each, by default as many as keep every filter
    within half of ``MAX_FILTER_BYTES``.
    """
    spark = pages.sparkSession
    store.small_batches(spark)
    host, path = url_parts(F.col(url_col))
    lengths = sorted({len(p) for _, _, p in rules})
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    most = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    urls = urls.withColumn("names", candidates(F.col("host"), F.col("path"), lengths, most))
    urls = urls.withColumn("keys", F.transform("names", key_of))
    universe = urls.select(F.explode("keys").alias("key")).distinct()
    named = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, name string").select("verdict", key_of(F.col("name")).alias("key"))
    universe = store.materialise(universe.unionByName(named.select("key")).distinct(), "universe")
    if segments is None:  # the first level is the largest: a key takes 1.44 bits for each halving of its rate
        bits = 1.45 * len(rules) * max(1.0, math.log2(2 * max(universe.count(), 1) / max(len(rules), 1)))
        segments = max(1, math.ceil(bits / (4 * MAX_FILTER_BYTES)))
    sides: dict[str, list[Cascade]] = {"block": [], "allow": []}
    segment = F.pmod(F.shiftrightunsigned("key", 48), F.lit(segments))
    for verdict, out in sides.items():
        listed = named.filter(F.col("verdict") == verdict).select("key").distinct()
        for s in range(segments):
            out.append(build_cascade(universe.filter(segment == s), listed.filter(segment == s)))
    fields = "page_id long, host string, path string, names array<string>, keys array<long>, place int, side int"
    found = urls.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(_first_listed(sides["block"], sides["allow"]), fields)
    rule = F.when(F.col("place") > 0, F.element_at("names", F.greatest("place", F.lit(1))))
    return found.select("page_id", "host", "path", rule.alias("rule"), F.when(F.col("side") == 2, "block").otherwise("allow").alias("verdict"))
