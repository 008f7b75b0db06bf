"""The dated, signed graph: snapshots as of a day, their series, roll-ups and node statistics.

An event counts in a snapshot only if it is dated strictly before the day: news has a date but no
hour, so that of the day itself may not have been known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def decay(age_days: Column, half_life: float | None) -> Column:
    """0.5 ** (age / half-life), or 1 without a half-life."""
    return F.pow(F.lit(0.5), age_days / F.lit(float(half_life))) if half_life else F.lit(1.0)


def in_window(asof: Column, window_days: int | None) -> Column:
    ok = F.col("dt") < asof
    return ok & (F.col("dt") >= F.date_sub(asof, window_days)) if window_days else ok


def matching(events: DataFrame, classes: Sequence[str] | None = None, kinds: Sequence[str] | None = None, min_strength: float | None = None) -> DataFrame:
    """The events of these classes, between nodes of these kinds, at least so strong."""
    if classes:
        events = events.filter(F.col("rel_class").isin(list(classes)))
    if kinds:
        events = events.filter(F.col("src_kind").isin(list(kinds)) & F.col("dst_kind").isin(list(kinds)))
    return events.filter(F.col("strength") >= min_strength) if min_strength is not None else events


def aggregate(events: DataFrame, keys: Sequence[str], asof: Column, half_life: float | None, directed: bool) -> DataFrame:
    """One row for each of ``keys`` and edge, with the measures of an edge."""
    if not directed:
        events = events.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    w = F.col("sign") * F.col("strength")
    return events.groupBy(*keys, "src", "dst").agg(
        F.count("*").alias("n_events"), F.count_distinct("doc_id").alias("n_docs"),
        F.count_if(F.col("sign") > 0).alias("n_pos"), F.count_if(F.col("sign") < 0).alias("n_neg"),
        F.sum(w).alias("w_sum"), F.avg(w).alias("w_mean"), F.sum(w * decay(F.datediff(asof, "dt"), half_life)).alias("w_decay"),
        F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
    )


def snapshot(events: DataFrame, asof: str, window_days: int | None = 90, half_life: float | None = None, directed: bool = True, by_class: bool = False, min_events: int = 1, **filters) -> DataFrame:
    """The edges known as of a day, aggregated from the events of the window before it."""
    day = F.lit(asof).cast("date")
    own = matching(events.filter(in_window(day, window_days)), **filters)
    out = aggregate(own, ["rel_class"] if by_class else [], day, half_life, directed)
    return out.filter(F.col("n_events") >= min_events) if min_events > 1 else out


def snapshots(events: DataFrame, start: str, end: str, step: str = "7 days", window_days: int = 90, half_life: float | None = None, directed: bool = True, step_days: int = 7, **filters) -> DataFrame:
    """Snapshots at start, start + step, ... up to end, in one job.

    Each event is copied to the days of the grid that can see it, at most window / step of them,
    so the range join becomes an equality.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    offset = F.greatest(F.ceil((F.datediff("dt", first) + 1) / F.lit(step_days)), F.lit(0)).cast("int")
    begin = F.date_add(first, offset * step_days)
    stop = F.least(last, F.date_add("dt", window_days))
    days = F.when(begin <= stop, F.sequence(begin, stop, F.expr(f"INTERVAL {step_days} DAYS")))
    seen = matching(events, **filters).withColumn("asof", F.explode(days))
    return aggregate(seen, ["asof"], F.col("asof"), half_life, directed)


def period_edges(events: DataFrame, period: str) -> DataFrame:
    """Edges by calendar week or month and class."""
    w = F.col("sign") * F.col("strength")
    return events.groupBy(F.to_date(F.date_trunc(period, "dt")).alias("period"), "src", "dst", "rel_class").agg(
        F.count("*").alias("n_events"), F.count_distinct("doc_id").alias("n_docs"), F.count_if(F.col("sign") > 0).alias("n_pos"),
        F.count_if(F.col("sign") < 0).alias("n_neg"), F.sum(w).alias("w_sum"), F.avg(w).alias("w_mean"), F.avg("strength").alias("mean_strength"),
    )


def both_directions(events: DataFrame) -> DataFrame:
    """(node, other) of every end of every event, with the event's columns."""
    rest = [c for c in events.columns if c not in ("src", "dst")]
    a = events.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
    return a.unionByName(events.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def node_stats(events: DataFrame) -> DataFrame:
    """(node, n_events, degree): ends of events and distinct neighbours."""
    return both_directions(events).groupBy("node").agg(F.count("*").alias("n_events"), F.count_distinct("other").alias("degree"))


def random_signs(edges: DataFrame, weight: str, seed: int) -> DataFrame:
    """(i, j, w): every link's absolute weight with a random sign, loops and links of weight 0 left out.

    The sign is a bit of a hash of the seed and the link's ends, so it is the same both ways and
    however the links are dealt.
    """
    i, j = F.least("src", "dst"), F.greatest("src", "dst")
    sign = F.xxhash64(F.lit(seed), i, j).bitwiseAND(F.lit(1)) * 2 - 1
    return edges.filter((F.col("src") != F.col("dst")) & ~F.col(weight).eqNullSafe(0.0)).select(i.alias("i"), j.alias("j"), (F.abs(weight) * sign).alias("w"))


def to_adjacency(edges: DataFrame, weight: str = "w_sum") -> dict[str, dict[str, float]]:
    """A snapshot as {src: {dst: weight}} in the driver; for graphs that fit one machine."""
    out: dict[str, dict[str, float]] = {}
    for r in edges.select("src", "dst", weight).toLocalIterator():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out
