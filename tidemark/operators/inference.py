"""Tests and regressions as relations: Newey-West, Holm, Benjamini-Hochberg, CMH, Fama-MacBeth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F


def newey_west(series: DataFrame, key: str, order: str, value: str, lags: int) -> DataFrame:
    """(key, n, mean, lrv, t): the mean and its t with Bartlett weights up to ``lags``."""
    w = W.partitionBy(key)
    x = series.withColumn("_d", F.col(value) - F.avg(value).over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)))
    terms = [F.col("_d") * F.col("_d")] + [2 * (1 - h / (lags + 1)) * F.col("_d") * F.coalesce(F.lag("_d", h).over(w.orderBy("_i")), F.lit(0.0)) for h in range(1, lags + 1)]
    out = x.withColumn("_t", sum(terms[1:], terms[0])).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.sum("_t") / F.count("*")).alias("lrv"))
    return out.withColumn("t", F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))


def holm(tests: DataFrame, p: str = "p", order: str = "name") -> DataFrame:
    """``tests`` with holm: p-values adjusted step down; a family is one sorted group."""
    up = W.orderBy(F.col(p), F.col(order))
    m = F.count("*").over(W.partitionBy())
    k = F.row_number().over(up)
    return tests.withColumn("_a", F.least(F.lit(1.0), (m - k + 1) * F.col(p))).withColumn("holm", F.max("_a").over(up.rowsBetween(W.unboundedPreceding, 0))).drop("_a")


def benjamini_hochberg(tests: DataFrame, p: str = "p", order: str = "name") -> DataFrame:
    """``tests`` with bh: p-values adjusted step up."""
    up, down = W.orderBy(F.col(p), F.col(order)), W.orderBy(F.col(p).desc(), F.col(order).desc())
    m = F.count("*").over(W.partitionBy())
    return tests.withColumn("_a", F.least(F.lit(1.0), F.col(p) * m / F.row_number().over(up))).withColumn("bh", F.min("_a").over(down.rowsBetween(W.unboundedPreceding, 0))).drop("_a")


def cochran_mantel_haenszel(rows: DataFrame, stratum: str, a: str, b: str) -> DataFrame:
    """(statistic, odds_ratio) of two 0/1 columns over strata, without continuity correction."""
    s = rows.groupBy(stratum).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(a) * F.col(b)).cast("double").alias("k"), F.sum(a).cast("double").alias("ra"), F.sum(b).cast("double").alias("cb"),
    ).filter("n > 1")
    e = F.col("ra") * F.col("cb") / F.col("n")
    v = F.col("ra") * F.col("cb") * (F.col("n") - F.col("ra")) * (F.col("n") - F.col("cb")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    num = F.sum(F.col("k") * (F.col("n") - F.col("ra") - F.col("cb") + F.col("k")) / F.col("n"))
    den = F.sum((F.col("ra") - F.col("k")) * (F.col("cb") - F.col("k")) / F.col("n"))
    return s.agg((F.pow(F.sum(F.col("k") - e), F.lit(2.0)) / F.sum(v)).alias("statistic"), F.try_divide(num, den).alias("odds_ratio"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(agreement, kappa) of two annotators' 0/1 columns."""
    s = rows.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return s.select("agreement", F.try_divide(F.col("agreement") - chance, 1 - chance).alias("kappa"))


def fama_macbeth(panel: DataFrame, date: str, y: str, x: str) -> DataFrame:
    """(n_dates, mean, t): the mean of the dates' slopes of y on the date's standardised x."""
    w = W.partitionBy(date)
    z = panel.withColumn("_z", F.when(F.stddev_pop(x).over(w) > 0, (F.col(x) - F.avg(x).over(w)) / F.stddev_pop(x).over(w)).otherwise(0.0))
    slopes = z.groupBy(date).agg(F.regr_slope(y, "_z").alias("slope")).filter("slope IS NOT NULL")
    out = slopes.agg(F.count("*").alias("n_dates"), F.avg("slope").alias("mean"), F.stddev_samp("slope").alias("sd"))
    return out.select("n_dates", "mean", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n_dates")).alias("t"))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))
