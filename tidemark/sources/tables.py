"""Tables of a dataset folder, and the views that give them the shapes the operators work on.

Each view has the DataFrame that builds it and the SQL that defines it, side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def graph_events(spark: SparkSession, folder: str) -> DataFrame:
    """Dated, signed relations: supplier to brand, by part type."""
    part = load(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    sign = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return load(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "p_brand").alias("dst"),
        F.to_date("l_shipdate").alias("dt"), F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("rel_class"),
        (F.col("l_discount") * 10).alias("strength"), sign.alias("sign"), F.lit("supplier").alias("src_kind"), F.lit("brand").alias("dst_kind"),
    )


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, symbol, dt) without repeats: orders and their suppliers."""
    return load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("dt")).distinct()


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, date, close, adj_close, volume): brands by day, at their mean price a unit."""
    part = load(spark, folder, "part").select("p_partkey", "p_brand")
    joined = load(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    # whole cents and units, so that the order of the rows can't tell
    close = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.sum(F.col("l_quantity").cast("long")) / 100
    out = joined.groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(close.alias("close"), F.sum("l_quantity").alias("volume"))
    return out.select("ticker", "date", "close", F.col("close").alias("adj_close"), "volume")


def raw_news(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as rows of a raw news file: url, symbol, published_at are derived."""
    d = load(spark, folder, "documents")
    url = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("http://www."), "source", F.lit(".example/"), (F.col("doc_id") % 500).cast("string")))
    return d.select("doc_id", F.col("text").alias("body"), "source", "lang", url.alias("url"), F.concat(F.lit("T"), (F.col("doc_id") % 13).cast("string")).alias("symbol"),
                    F.date_add(F.lit("2019-12-20").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("published"))


def names(spark: SparkSession, folder: str) -> DataFrame:
    """Raw agent names: those of suppliers and parts in several spellings."""
    s = load(spark, folder, "supplier").select(F.concat(F.lit("The "), F.regexp_replace("s_name", "#0*", " "), F.lit(" Holdings Inc.")).alias("raw"))
    p = load(spark, folder, "part").select(F.concat("p_name", F.lit(" (NYSE: "), F.upper(F.substring("p_name", 1, 3)), F.lit(")")).alias("raw")).distinct()
    c = load(spark, folder, "customer").select(F.concat(F.regexp_replace("c_name", "#0*", "'s "), F.lit(" & Co")).alias("raw"))
    return s.union(p).union(c)


VIEWS = {
    "ge": """SELECT 'S' || l_suppkey AS src, 'P' || p_brand AS dst, CAST(l_shipdate AS DATE) AS dt, l_orderkey AS doc_id, p_type AS rel_class,
               l_discount * 10 AS strength, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS sign,
               'supplier' AS src_kind, 'brand' AS dst_kind FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "men": "SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS dt FROM lineitem",
    "px": """SELECT ticker, date, close, close AS adj_close, volume FROM (
               SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100 AS close, sum(l_quantity) AS volume
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "news": """SELECT doc_id, text AS body, source, lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'http://www.' || source || '.example/' || (doc_id % 500) END AS url,
               'T' || (doc_id % 13) AS symbol, CAST(DATE '2019-12-20' + CAST(doc_id % 40 AS INT) AS DATE) AS published FROM documents""",
    "nam": """SELECT 'The ' || regexp_replace(s_name, '#0*', ' ') || ' Holdings Inc.' AS raw FROM supplier
               UNION ALL SELECT DISTINCT p_name || ' (NYSE: ' || upper(substr(p_name, 1, 3)) || ')' FROM part
               UNION ALL SELECT regexp_replace(c_name, '#0*', '''s ') || ' & Co' FROM customer""",
}


def sql(views: str, select: str, **ctes: str) -> str:
    """A statement over the named views and further common table expressions."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in views.split()] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def numbered_as_long(df: DataFrame) -> DataFrame:
    """Row numbers as long, which SQL's are."""
    names = [c for c, t in df.dtypes if t == "int" and c in ("k", "rank", "event_id", "cal_i", "n_cal")]
    return df.withColumns({c: F.col(c).cast("long") for c in names}) if names else df


class Catalog:
    """Named queries with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, statement: str | None = None):
        def register(f):
            self.queries[f.__name__] = lambda spark, folder: numbered_as_long(f(spark, folder))
            if statement:
                self.sql[f.__name__] = statement
            return f

        return register
