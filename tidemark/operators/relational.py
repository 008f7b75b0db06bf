"""Relational building blocks: one row of many, top k, as-of joins, calendars, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import materialise


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; ``rank`` keeps their number in a column."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def total_order(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its rows' numbers from 1 in a total order, without one task holding them all.

    Rows are dealt by range and sorted within their partitions; each partition then starts after
    the counts of those before it. Rows that the order can't tell apart are numbered as they come.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = materialise(dealt.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.spark_partition_id().alias("_part"), at.alias("_at")), "ordered")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(sizes), "_part").select("_row.*", (F.col("_before") + F.col("_at") + 1).alias(name))


def with_ntile(df: DataFrame, order: Sequence[str], n: int, name: str) -> DataFrame:
    """``df`` cut into n parts of nearly equal size in a total order, the larger ones first."""
    ranked = total_order(df, order, "_place")
    total = ranked.count()
    small, more = divmod(total, n)
    place = F.col("_place") - 1
    late = F.lit(more) + F.floor((place - more * (small + 1)) / max(small, 1))
    part = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(late) + 1
    return ranked.withColumn(name, part.cast("int")).drop("_place")


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is NOT IN ``other``, as SQL has it: none if ``other`` has a null key;
    a null key of ``df`` stays only if ``other`` is empty."""
    facts = other.agg(F.count("*").alias("_n"), F.count_if(F.col(key).isNull()).alias("_nulls"))  # one row
    left = df.join(other.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(facts))
    return left.filter((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).drop("_n", "_nulls")


def asof_join(left: DataFrame, right: DataFrame, on: str | None, left_time: str, right_time: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` before (or, not strict, up to) its time.

    Both sides are merged by time within the key, and the last values of the right side are
    carried on, so the work is one sort.
    """
    key = [F.col(on).alias("_key")] if on else [F.lit(0).alias("_key")]
    payload = F.struct(*[F.col(v) for v in values]).alias("_row")
    a = left.select(*key, F.col(left_time).alias("_time"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_row"), F.lit(1 - strict).alias("_side"))
    b = right.select(*key, F.col(right_time).alias("_time"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), payload, F.lit(0 if not strict else 1).alias("_side"))
    if strict:  # a left row sorts before right rows of its own time
        a = a.withColumn("_side", F.lit(0))
    else:
        a = a.withColumn("_side", F.lit(1))
    w = W.partitionBy("_key").orderBy("_time", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_row", F.last("_row", ignorenulls=True).over(w)).filter("_left IS NOT NULL")
    return both.select("_left.*", *[F.col(f"_row.{v}").alias(v) for v in values])


def next_day(left: DataFrame, calendar: DataFrame, day: str, out: str) -> DataFrame:
    """``left`` with the first calendar day strictly after ``day``; rows without one are dropped."""
    a = left.select(F.col(day).alias("_time"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(None).cast("date").alias("_cal"), F.lit(1).alias("_side"))
    b = calendar.select(F.col("date").alias("_time"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.col("date").alias("_cal"), F.lit(0).alias("_side"))
    w = W.orderBy(F.col("_time").desc(), F.col("_side").desc()).rowsBetween(W.unboundedPreceding, 0)
    days = a.select("_time").distinct().withColumns({"_cal": F.lit(None).cast("date"), "_side": F.lit(1)}).unionByName(b.select("_time", "_cal", "_side"))
    after = days.withColumn("_next", F.last("_cal", ignorenulls=True).over(w)).filter("_side = 1 AND _next IS NOT NULL").select("_time", "_next")
    return left.join(F.broadcast(after), F.col(day) == F.col("_time")).withColumn(out, F.col("_next")).drop("_time", "_next")  # one row a day at most


def first_of_period(calendar: DataFrame, period: str, date: str = "date") -> DataFrame:
    """The first date of each week, month, quarter or year."""
    return calendar.groupBy(F.to_date(F.date_trunc(period, date)).alias("period")).agg(F.min(date).alias("first_date"))


def weighted_mode(df: DataFrame, key: str, value: str, weight: str, seen: str) -> DataFrame:
    """(key, value): the value of most weight; ties go to the one first seen, then the smallest."""
    total = df.groupBy(key, value).agg(F.sum(weight).alias("_w"), F.min(seen).alias("_s"))
    return first_by(total, [key], [F.col("_w").desc(), F.col("_s"), F.col(value)]).select(key, value)


def longest_run(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """(key, longest): the most consecutive rows for which ``flag`` holds."""
    w = W.partitionBy(key).orderBy(order)
    marked = df.withColumn("_on", flag.cast("int"))
    runs = marked.withColumn("_g", F.row_number().over(w) - F.sum("_on").over(w)).filter("_on = 1").groupBy(key, "_g").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def jaccard(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jaccard index of two sets of distinct rows, as one row."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.agg((F.sum(F.col("_a") * F.col("_b")) / F.count("*")).alias("jaccard"))


def balanced(df: DataFrame, key: str, weight: str, n: int, most: int = 1_000_000) -> DataFrame:
    """(unit, worker): units dealt by ``greedy_bins`` on the driver, which takes ``most`` of them at most and
    refuses more. The greedy order is one sequence, so it isn't distributed."""
    if df.count() > most:
        raise ValueError(f"more than {most} units; deal them by hash, or group them first")
    bins = greedy_bins([tuple(r) for r in df.select(key, weight).collect()], n)
    return df.sparkSession.createDataFrame(list(bins.items()), "unit string, worker int")


def greedy_bins(items: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Longest processing time: each item, largest first, to the least loaded of n bins."""
    import heapq

    heap = [(0, b) for b in range(n)]
    out = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, b = heapq.heappop(heap)
        out[key] = b
        heapq.heappush(heap, (load + size, b))
    return out
