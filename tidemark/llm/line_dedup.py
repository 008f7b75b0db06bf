"""Line removal by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if more than ``max_ratio`` of the host's pages contain it and at
least ``min_pages`` do. Its share counts each page once, however often the page repeats the line.
A page can hold few lines that so many pages share: the boilerplate lines of a host number at most
the mean lines of a page over ``max_ratio``, so they fit an array a host. That array meets the
host's pages under a salted key, so that a host with a third of all pages is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_RATIO = 0.02
MIN_PAGES = 5
SALTS = 64


def line_key(line: Column) -> Column:
    """128 bits of a line; trailing and leading blanks count."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys) from (host, lines): the keys of each host's boilerplate lines."""
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    distinct = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), line_key))
    lines = pages.select("host", F.explode(distinct).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    common = lines.join(totals, "host").filter(F.col("n") / F.col("total") > max_ratio)
    return common.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with each text's boilerplate lines removed, and n_lines, n_dropped.

    The other lines keep their order and bytes, joined by one LF. Lines of blanks alone are kept
    and never counted. A null text stays null, with no lines; a null host is a host of its own.
    Repeated rows are pages of their own. All input columns are kept; a column named ``n_lines``
    or ``n_dropped`` is replaced.
    """
    keep = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    host = F.coalesce(F.concat(F.lit("h"), F.col(f"row.`{host_col}`").cast("string")), F.lit("n"))
    text = F.col(f"row.`{text_col}`")
    pages = own.select("row", host.alias("host"), F.split(text, "\n", -1).alias("lines"))
    common = boilerplate(pages.select("host", "lines"), max_ratio, min_pages)
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pages.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, ["host", "salt"], "left").select("row", "lines", "keys")
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("keys"), line_key(x))))
    out = joined.withColumn("kept", kept)
    cols = [F.when(F.col("keys").isNull(), text).otherwise(F.array_join("kept", "\n")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in keep if c not in ("n_lines", "n_dropped")]
    n = F.coalesce(F.size("lines"), F.lit(0))
    n = F.when(F.col("lines").isNull(), 0).otherwise(n)
    return out.select(*cols, n.cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
