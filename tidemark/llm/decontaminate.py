"""Benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over consecutive words that ignores some positions, so that a
substituted word under an ignored position doesn't hide an overlap. The hashes of all masked
windows of the benchmark items are joined with those of the training texts; each hit gives a
diagonal, on which the item is laid over the text and the overlap around the hit is verified word
by word, substitutions allowed.

The benchmark's hashes go to every worker in blocks of about ``block_words`` words (an item is
never split, so the longest item is the other bound); a larger benchmark takes as many passes as
it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import buffers as B, store

MASKS = ("1101011001", "111001011", "1111011")
MIN_WORDS = 13
#: items of fewer words can't be told from common phrases and are not looked for
LEAST_ITEM = 5
#: seed hits that are spread out at once
HITS = 500_000
TOLERANCE = 0.8
#: a stretch matches well enough if these, summed over its words, are not negative
_SHARE = Fraction(TOLERANCE).limit_denominator(100)
_EQUAL, _CHANGED = _SHARE.denominator - _SHARE.numerator, -_SHARE.numerator
BLOCK_WORDS = 1_000_000
_HITS = "doc_id long, item_id long, n_matched int, n_overlap int, item_words int, doc_start long"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word hashes, first) in slices; words are runs of letters and digits, lower-cased."""
    data, offs = B.utf8(pc.utf8_lower(column.cast(pa.large_string())))
    data = np.where(_WORD[data], data, 32).astype(np.uint8)
    for i, j in B.spans(offs):
        yield (i, *B.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window at each position that has one (neighbouring texts included)."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = out * B.BASE + hashes[j : j + n]
    return B.mix(out)


class Items:
    """The seeds of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int = LEAST_ITEM):
        self.ids, self.words = [], []
        for i, hashes, first in text_words(pa.array(texts, pa.string())):
            for r, (a, b) in enumerate(zip(first[:-1], first[1:])):
                if b - a >= max(least, 1):
                    self.ids.append(ids[i + r])
                    self.words.append(hashes[a:b])
        #: an item too short for a mask is looked for whole
        short = {len(w) for w in self.words if len(w) < max(map(len, MASKS))}
        self.seeds = []
        for mask in (*MASKS, *("1" * n for n in sorted(short))):
            own = [(m, np.full(len(m), i), np.arange(len(m))) for i, w in enumerate(self.words) if len(w) == len(mask) or (mask in MASKS and len(w) >= len(mask)) for m in [masked(w, mask)]]
            if own:
                key, item, at = (np.concatenate(x) for x in zip(*own))
                order = np.argsort(key, kind="stable")
                self.seeds.append((mask, key[order], item[order], at[order]))

    def hits(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """(item, position of the item's first word in ``words``) of all seeds' hits, distinct within a slice
        of about ``HITS`` of them."""
        for mask, key, item, at in self.seeds:
            own = masked(words, mask)
            lo = np.searchsorted(key, own)
            pos = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == own)
            times = np.searchsorted(key, own[pos], side="right") - lo[pos]
            cuts = np.flatnonzero(np.diff(np.cumsum(times) // HITS)) + 1
            for p, n in zip(np.split(pos, cuts), np.split(times, cuts)):
                k = np.repeat(lo[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.unique(np.stack([item[k], np.repeat(p, n) - at[k]], axis=1), axis=0)

    def overlap(self, text: np.ndarray, item: int, start: int) -> tuple[int, int, int]:
        """(matched, length, position in the text) of the best overlap on one diagonal.

        Of the stretches of which at least ``TOLERANCE`` match, the one with most matches, then the
        shortest, then the first. A stretch may run over a cluster of substitutions that the
        words on both sides make up for.
        """
        own = self.words[item]
        a, b = max(0, -start), min(len(own), len(text) - start)
        same = own[a:b] == text[start + a : start + b]
        count = np.concatenate([[0], np.cumsum(same)])
        score = np.concatenate([[0], np.cumsum(np.where(same, _EQUAL, _CHANGED))])
        # for each end the earliest start whose prefix isn't larger: the stretch's sum is 0 at least
        first = np.searchsorted(-np.minimum.accumulate(score), -score[1:])
        matched = count[1:] - count[first]
        m = int(matched.max(initial=0))
        if not m:
            return 0, 0, start + a
        ends = np.flatnonzero(same & (matched == m))
        at = np.flatnonzero(same)[count[first[ends]]]  # a substitution at its start only lengthens it
        k = int(np.argmin(ends - at))
        return m, int(ends[k] + 1 - at[k]), start + a + int(at[k])


def _find(items, min_words: int):
    """mapInArrow function: (doc_id, text) to the verified overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for b in batches:
            rows = []
            docs = b.column(0).to_pylist()
            for i, hashes, first in text_words(b.column(1)):
                best: dict[tuple[int, int], tuple] = {}
                seen: set[tuple[int, int]] = set()
                for item, at in (tuple(x) for part in block.hits(hashes) for x in part.tolist()):
                    if (item, at) in seen:
                        continue
                    seen.add((item, at))
                    # the diagonal may begin before its text does, so its text is that of its seed
                    lo, hi = np.searchsorted(first, [max(at, 0), at + len(block.words[item]) - 1], side="right") - 1
                    for r in range(int(lo), min(int(hi), len(first) - 2) + 1):
                        text = hashes[first[r] : first[r + 1]]
                        start = at - int(first[r])
                        if not len(text) or start >= len(text) or start + len(block.words[item]) <= 0:
                            continue
                        m, n, where = block.overlap(text, item, start)
                        if m >= min(min_words, len(block.words[item])):
                            best[r, item] = max(best.get((r, item), (0, 0, 0)), (m, -n, -where))
                for (r, item), (m, n, where) in sorted(best.items()):
                    rows.append((docs[i + r], block.ids[item], m, -n, len(block.words[item]), -where))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            cols = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "n_matched", "n_overlap", "item_words", "doc_start"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, least_item: int = LEAST_ITEM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_matched, n_overlap, item_words, doc_start), one row for each text and
    item that overlap in at least ``min_words`` equal words (all words of a shorter item), on a
    stretch of which at least four fifths are equal. Items of fewer than ``least_item`` words, which
    any text may hold by chance, overlap with nothing.

    Null and empty texts and items overlap with nothing. Of several overlaps of a pair that with
    most equal words is given, then the shortest, then the first. Repeated rows of ``docs`` each
    give their rows; repeated items too. Empty tables give no rows; other columns play no part.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.size(F.filter(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), lambda w: w != ""))
    total = bench.agg(F.sum(words)).first()[0] or 0
    n = -(-total // block_words) or 1
    out = None
    for i in range(n):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()  # at most about ``block_words`` words
        items = spark.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], least_item))
        got = source.mapInArrow(_find(items, min_words), _HITS)
        out = got if out is None else out.unionByName(got)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", least_item: int = 1, **more) -> DataFrame:
    """``docs`` without the rows whose id overlaps with a benchmark item; all columns are kept.

    Unlike in ``find_leaks`` short items are looked for too, unless ``least_item`` says otherwise: what
    is trained on should rather lose a text than hold an item.
    Rows of one id go together: where one of them holds an item, none can be trusted. Rows without
    an id count as of one id, so give ids first.
    """
    bad = find_leaks(docs, benchmark, least_item=least_item, id_col=id_col, **more).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__leak"]), "left_anti")
