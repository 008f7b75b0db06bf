"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is computed in
linear time as (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2. Words are hashed to buckets and weighted
to unit length; statistics of the text (shares of character kinds, word and line repetition,
lengths) and the declared length are cut at quantiles of the training rows, one feature a bin.

It is fitted on the driver, on at most ``MAX_ROWS`` labelled rows (those of the smallest hashes of
their id) and ``MAX_WORDS`` of their words in all; every row is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import buffers as B, store

BUCKETS = 1 << 15
FACTORS = 8
BINS = 12
MAX_ROWS = 12_000
MAX_WORDS = 8_000_000
THRESHOLD = 0.7

#: Kinds of bytes whose shares are statistics.
KINDS = ["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "\n", ".", ",;:", "!?", "|", "*", "%&#$@^~", "<>{}[]()\\/=_+", "'\"`-"]
_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate(KINDS):
    _KIND[list(_chars.encode())] = _k
STATS = len(KINDS) + 9
FEATURES = BUCKETS + STATS * (BINS + 2)


def describe(column: pa.Array, declared: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(row, distinct word buckets of each text, statistics) in bounded slices of a batch."""
    data, offs = B.utf8(column)
    declared = declared.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    for i, j in B.spans(offs):
        own, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n, size = j - i, np.diff(o)
        row = np.repeat(np.arange(n), size)
        stats = np.zeros((n, STATS))
        shares = np.bincount(row * len(KINDS) + _KIND[own], minlength=n * len(KINDS)).reshape(n, -1)
        stats[:, : len(KINDS)] = shares / np.maximum(size, 1)[:, None]
        hashes, first = B.words(own, o)
        count = np.diff(first)
        buckets = [np.unique(hashes[a:b] & B.U(BUCKETS - 1)).astype(np.int64) for a, b in zip(first[:-1], first[1:])]
        breaks = np.flatnonzero(own == 10)
        start = np.unique(np.concatenate([o[:-1], breaks + 1]))
        start = start[start < o[-1]]
        end = np.append(start[1:], o[-1])
        lines = B.range_hash(B.prefix_hash(B.BYTE_VALUES[own]), start, end) if len(start) else np.zeros(0, np.uint64)
        where = np.searchsorted(start, o)
        repeated = [1 - len(np.unique(lines[a:b])) / max(b - a, 1) for a, b in zip(where[:-1], where[1:])]
        k = len(KINDS)
        stats[:, k] = np.log1p(size)
        stats[:, k + 1] = np.log1p(count)
        stats[:, k + 2] = size / np.maximum(count, 1)
        stats[:, k + 3] = [len(b) for b in buckets] / np.maximum(count, 1)
        stats[:, k + 4] = np.log1p(np.diff(where))
        stats[:, k + 5] = np.where(size > 0, repeated, 0)
        stats[:, k + 6] = size / np.maximum(np.diff(where), 1)
        again = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(hashes[1:] == hashes[:-1], out=again[2:] if len(hashes) else again[:0])
        stats[:, k + 8] = (again[np.maximum(first[1:], 1) if len(hashes) else first[1:]] - again[np.minimum(first[:-1] + 1, len(hashes))]) / np.maximum(count, 1)
        stats[:, k + 7] = np.log1p(np.maximum(declared[i:j], 0))
        yield i, buckets, stats


@dataclass
class Machine:
    """A fitted factorisation machine and the cuts of its statistics."""

    cuts: np.ndarray  # (STATS, BINS)
    bias: float
    weight: np.ndarray  # (FEATURES,)
    factor: np.ndarray  # (FEATURES, FACTORS)
    slope: float = 1.0  # of the logits, fitted on rows that the machine has not learnt
    shift: float = 0.0
    learned: bool = False  # whether it has seen rows of both labels

    def rows(self, buckets: list[np.ndarray], stats: np.ndarray):
        """(index, value, starts) of the sparse rows."""
        bins = np.empty(stats.shape, np.int64)
        for s in range(STATS):
            bins[:, s] = np.where(np.isnan(stats[:, s]), BINS + 1, np.searchsorted(self.cuts[s], stats[:, s]))
        extra = BUCKETS + np.arange(STATS) * (BINS + 2) + bins
        index = np.concatenate([x for b, e in zip(buckets, extra) for x in (e, b)])
        value = np.concatenate([x for b in buckets for x in (np.full(STATS, STATS**-0.5), np.full(len(b), max(len(b), 1) ** -0.5))])
        return index, value, np.concatenate([[0], np.cumsum([STATS + len(b) for b in buckets])[:-1]])

    def logits(self, index, value, starts):
        vx = self.factor[index] * value[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        square = np.add.reduceat(vx * vx, starts, axis=0)
        linear = np.add.reduceat(self.weight[index] * value, starts)
        return self.bias + linear + 0.5 * (total**2 - square).sum(axis=1), vx, total

    def score(self, buckets: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        z, _, _ = self.logits(*self.rows(buckets, stats))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -35, 35)))


def fit(buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Logistic loss, AdaGrad over small batches, ``steps`` of them whatever the number of rows;
    without rows of both labels, their share."""
    cuts = np.zeros((STATS, BINS))
    for s in range(STATS):
        known = stats[~np.isnan(stats[:, s]), s]
        if len(known):
            cuts[s] = np.quantile(known, np.linspace(0, 1, BINS + 1)[1:])
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(cuts, float(np.log(share / (1 - share))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    if len(np.unique(labels)) < 2:
        return m
    m.learned = True
    gw, gv, gb = np.full(FEATURES, 1e-2), np.full(FEATURES, 1e-2), 1e-2
    order = np.concatenate([rng.permutation(len(labels)) for _ in range(-(-steps * batch // len(labels)))])
    for own in order[: steps * batch].reshape(steps, batch):
        index, value, starts = m.rows([buckets[i] for i in own], stats[own])
        z, vx, total = m.logits(index, value, starts)
        error = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[own]
        row = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(index))))
        dw = error[row] * value
        dv = dw[:, None] * (total[row] - vx)
        used, back = np.unique(index, return_inverse=True)
        sw = np.bincount(back, dw) / len(own) + decay * m.weight[used]
        sv = np.stack([np.bincount(back, dv[:, f]) for f in range(FACTORS)], axis=1) / len(own) + decay * m.factor[used]
        gw[used] += sw**2
        gv[used] += (sv**2).mean(axis=1)
        m.weight[used] -= rate * sw / np.sqrt(gw[used])
        m.factor[used] -= 0.3 * rate * sv / np.sqrt(gv[used])[:, None]
        gb += error.mean() ** 2
        m.bias -= rate * error.mean() / np.sqrt(gb)
    return m


def calibrate(z: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through the logits of rows not learnt, by Newton's method.

    Labels are drawn in by their smoothed shares (Platt), so rows that are told apart without a
    fault still give a finite slope; slopes below a tenth are a tenth, so the order never turns.
    """
    good = labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    scale = max(z.std(), 1e-9)
    x = np.column_stack([(z - z.mean()) / scale, np.ones(len(z))])
    w = np.array([1.0, np.log((good + 1) / (len(labels) - good + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - target) + 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    a = max(w[0] / scale, 0.1)
    return float(a), float(w[1] - a * z.mean())


def fit_calibrated(buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, share: int = 4) -> Machine:
    """A machine fitted to all rows but each ``share``-th of either label, on which it is calibrated.

    With fewer than eight rows of a label there is no slice to spare, and it stays as fitted.
    """
    place = np.empty(len(labels), np.int64)
    for value in (0, 1):
        own = np.flatnonzero(labels == value)
        place[own] = np.arange(len(own))
    if min((labels == 0).sum(), (labels == 1).sum()) < 8:
        return fit(buckets, stats, labels)
    spare = place % share == share - 1
    m = fit([b for b, s in zip(buckets, spare) if not s], stats[~spare], labels[~spare])
    own = np.flatnonzero(spare)
    z = np.concatenate([m.logits(*m.rows([buckets[i] for i in part], stats[part]))[0] for part in np.array_split(own, -(-len(own) // 256))])
    m.slope, m.shift = calibrate(z, labels[spare])
    return m


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text, declared) to (doc_id, label, buckets, stats)."""
    for b in batches:
        buckets, stats = [], []
        for _, w, s in describe(b.column(2), b.column(3)):
            buckets += [x.astype(np.int32).tobytes() for x in w]
            stats += [x.tobytes() for x in s]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(buckets, pa.binary()), pa.array(stats, pa.binary())], ["doc_id", "label", "buckets", "stats"])


def _columns(docs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> list:
    declared = F.col(length_col).cast("double") if length_col and length_col in docs.columns else F.lit(None).cast("double")
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), declared.alias("declared")]


def held_out(doc_id):
    """Whether a row's labels are never learnt."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> Machine:
    """Fit on at most ``max_rows`` labelled rows that aren't held out; null labels don't count.

    Of an id with several labels the largest counts, of rows of one id the one with the smallest
    statistics. Rows are taken in the order of their ids' hashes, as long as they have
    ``max_words`` distinct words between them.
    """
    store.small_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(*_columns(docs, id_col, text_col, length_col)).join(F.broadcast(known), "doc_id")  # at most ``max_rows``
    got = rows.select("doc_id", "label", "text", "declared").mapInArrow(_features, "doc_id long, label double, buckets binary, stats binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("label", "stats", "buckets")).alias("r")).select("doc_id", "r.*")  # of repeated ids one row
    size = F.sum(F.octet_length("buckets") / 4).over(_first_rows())
    got = got.withColumn("so_far", size).filter(F.col("so_far") <= max_words).drop("so_far").toArrow().sort_by([("doc_id", "ascending"), ("stats", "ascending")])
    buckets = [np.frombuffer(x, np.int32).astype(np.int64) for x in got.column("buckets").to_pylist()]
    stats = np.array([np.frombuffer(x) for x in got.column("stats").to_pylist()]).reshape(-1, STATS)
    return fit_calibrated(buckets, stats, got.column("label").to_numpy())


def _first_rows():
    from pyspark.sql import Window as W

    return W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)  # over ``max_rows`` rows


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, or the ``keep`` columns, score, predicted.

    Null texts are empty; empty texts are scored by their statistics. Repeated rows get equal
    scores. An empty table gives an empty one. A row without an id is not held out. No column but
    the text and the declared length is an input of a score.
    """
    store.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = held.value
        for b in batches:
            rest = [b.column(0)] if keep is None else b.column(0).flatten()
            text = b.column(1) if keep is None else rest[keep.index(text_col)]
            out = [m.score(w, s) for _, w, s in describe(text, b.column(b.num_columns - 1))]
            p = np.concatenate(out) if out else np.zeros(0)
            names = ["doc_id"] if keep is None else [f"c{i}" for i in range(len(rest))]
            cols = rest
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    cols = _columns(docs, id_col, text_col, length_col)
    if keep is None:
        out = docs.select(cols).mapInArrow(run, "doc_id long, score double, predicted int")
        return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
    types = [(f"c{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])  # the text travels once
    schema = ", ".join(f"{c} {t}" for c, t in types) + ", score double, predicted int"
    got = docs.select(whole.alias("row"), cols[2]).mapInArrow(run, schema)
    return got.toDF(*keep, "score", "predicted")


def keep_good(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, **more) -> DataFrame:
    """``docs`` without the rows the machine rejects; all columns are kept. A machine that has not seen
    both labels rejects nothing."""
    if not machine.learned:
        return docs
    return score(docs, machine, threshold, keep=docs.columns, **more).filter("predicted = 1").select(*[f"`{c}`" for c in docs.columns])
