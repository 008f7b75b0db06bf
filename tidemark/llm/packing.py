"""Best-fit packing by minimum bin slack.

A document's tokens are cut into pieces no longer than a sequence. Only a piece's length matters
for packing, so the plan is made from the histogram of lengths, which has at most ``capacity``
entries however large the corpus is. Minimum bin slack fills one bin at a time: a bitset
subset-sum over the available lengths finds the fullest feasible combination that holds the
longest piece left, and that combination is removed; while its pieces last, the same combination
is the answer for the next bin, so it is applied as often as they last at once. Pieces then take
their places by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import store

END_ID = 2
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, seq long"
_PLAN = "p_length int, lo long, hi long, mult long, first_sequence long, first_offset int"


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of at most ``capacity`` that holds the longest length.

    Bit s of a bitset tells whether some combination sums to s. Copies of a length are offered in
    chunks of 1, 2, 4, ... so that any number up to the count can be taken. Of equally full ones,
    that with fewer short pieces is taken.
    """
    lengths = sorted(counts, reverse=True)
    longest = lengths[0]
    full, reach, steps = (1 << (capacity + 1)) - 1, 1 << longest, []
    for length in lengths:
        copies = min(counts[length] - (length == longest), capacity // length)
        chunk = 1
        while copies > 0:
            take = min(chunk, copies)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            copies -= take
            chunk *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    out = {longest: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(length -> copies in a bin, number of such bins)] that uses every piece once."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan = []
    while left:
        combo = fullest(left, capacity)
        times = min(left[k] // m for k, m in combo.items())
        plan.append((combo, times))
        for k, m in combo.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return plan


def plan_rows(plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """For each length, which ranks go to which bins, and where in them."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for combo, times in plan:
        offset = 0
        for length, m in sorted(combo.items(), reverse=True):
            lo = used.get(length, 0)
            rows.append((length, lo, lo + m * times, m, sequence, offset))
            used[length] = lo + m * times
            offset += m * length
        sequence += times
    return rows


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n, capacity)]


def cut_pieces(tokenizer_path: str, capacity: int, end_id: int):
    """mapInArrow function: (doc_id, text) to pieces, numbered by length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .pieces import encoder

        encode, part = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), encode(texts)):
                ids = np.concatenate([ids, end]).astype("<u4")
                raw = ids.tobytes()
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), part, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            cols = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null texts are empty: their only token is ``end_id``. Repeated rows are packed as often as
    they occur; an empty table gives no pieces; other columns play no part.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = store.materialise(source.mapInArrow(cut_pieces(tokenizer_path, capacity, end_id), _PIECES), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    rows = plan_rows(minimum_bin_slack(counts, capacity))  # a few rows a length
    plan = F.broadcast(spark.createDataFrame(rows, _PLAN))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = by_task.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length"))).withColumn("rank", F.col("base") + F.col("seq"))
    k = F.col("rank") - F.col("lo")
    return ranked.join(plan, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("mult"))).alias("sequence_id"),
        (F.col("first_offset") + (k % F.col("mult")) * F.col("length")).alias("offset"),
    )
