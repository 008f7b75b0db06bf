"""From raw news rows to documents, mentions, units and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T
from .relational import first_by


def staged(raw: DataFrame) -> DataFrame:
    """Raw rows typed: doc_id from url or body, year; rows without a date are dropped."""
    out = raw.withColumns({"doc_key": T.identity(F.col("url"), F.col("body")), "year": F.year("published")})
    return out.filter("published IS NOT NULL")


def documents(raw: DataFrame, min_chars: int = 200) -> DataFrame:
    """One row a document: its earliest, then lowest symbol, then lowest row.

    n_symbols counts the symbols of the document within the representative's year.
    """
    rows = staged(raw)
    symbols = rows.groupBy("doc_key", "year").agg(F.count_distinct("symbol").alias("n_symbols"))
    best = first_by(rows, ["doc_key"], [F.col("published").asc_nulls_last(), F.col("symbol").asc_nulls_last(), F.col("doc_id")])
    out = best.join(symbols, ["doc_key", "year"])
    return out.select("doc_key", "published", "year", "url", "symbol", "n_symbols", F.length("body").alias("body_chars"), (F.length("body") < min_chars).alias("is_stub"))


def document_mentions(raw: DataFrame) -> DataFrame:
    """Distinct (doc_key, symbol, published, year)."""
    return staged(raw).select("doc_key", "symbol", "published", "year").distinct()


def units(raw: DataFrame, min_chars: int = 200, fraction: float | None = None) -> DataFrame:
    """Distinct texts: near-duplicates collapse onto the longest body; all_symbols keeps repeats."""
    rows = staged(raw).filter(F.length("body") >= min_chars).withColumn("unit", T.near_key(F.col("body")))
    if fraction is not None:
        rows = rows.filter(T.sampled(F.col("unit"), fraction))
    n = rows.groupBy("unit").agg(F.count("*").alias("n_source_docs"), F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("all_symbols"))
    best = first_by(rows, ["unit"], [F.length("body").desc(), F.col("published"), F.col("doc_id")])
    return best.join(n, "unit").select("unit", F.col("doc_id").alias("repr_doc_id"), "published", "n_source_docs", "all_symbols")


def checks(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(check, ok, detail) over documents and mentions."""
    d = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_key").alias("ids"), F.count_if(F.col("published").isNull()).alias("undated"), F.count_if(F.col("is_stub")).alias("stubs"))
    orphans = mentions.join(docs, "doc_key", "left_anti").agg(F.count("*").alias("orphans"))
    row = d.crossJoin(orphans)
    item = lambda name, ok, detail: F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("long").alias("detail"))
    each = F.array(
        item("rows", F.col("n") > 0, F.col("n")), item("unique_ids", F.col("n") == F.col("ids"), F.col("n") - F.col("ids")), item("dated", F.col("undated") == 0, F.col("undated")),
        item("few_stubs", F.col("stubs") <= F.col("n") * 0.5, F.col("stubs")), item("no_orphans", F.col("orphans") == 0, F.col("orphans")),
    )
    return row.select(F.explode(each).alias("c")).select("c.*")


def relation_tuples(runs: DataFrame, body: str = "props", key: str = "event_id") -> DataFrame:
    """(key, k): fields of JSON bodies; rows that don't parse give nothing."""
    return runs.select(key, F.from_json(body, "k double").alias("j")).filter("j.k IS NOT NULL").select(key, "j.k")


def latest_answers(runs: DataFrame, key: str, ok: str, at: str, tie: str) -> DataFrame:
    """One run a key: a successful one before others, then the latest."""
    return first_by(runs, [key], [F.col(ok).desc(), F.col(at).desc(), F.col(tie)])


def cooccurrence_shares(mentions: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, k, share, t_share, rank): how often b stands with a, of a's and of b's documents."""
    own = mentions.select("doc_id", F.col(key).alias("a")).distinct()
    other = mentions.select("doc_id", F.col(item).alias("b")).distinct()
    na, nb = own.groupBy("a").agg(F.count("*").alias("na")), other.groupBy("b").agg(F.count("*").alias("nb"))
    k = own.join(other, "doc_id").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("k"))
    out = k.join(na, "a").join(nb, "b").select("a", "b", "k", (F.col("k") / F.col("na")).alias("share"), (F.col("k") / F.col("nb")).alias("t_share"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("k"), "b")))


def fuzzy_join(left: DataFrame, right: DataFrame, score: float = 0.9, k: int = 3) -> DataFrame:
    """(a, b, score): of names with the same first word, the k most alike above ``score``."""
    a = left.select(F.col("name").alias("a")).distinct().withColumn("block", F.split_part("a", F.lit(" "), F.lit(1)))
    b = right.select(F.col("name").alias("b")).distinct().withColumn("block", F.split_part("b", F.lit(" "), F.lit(1)))
    both = a.join(b, "block").withColumn("score", T.jaro_winkler_column(F.col("a"), F.col("b"))).filter(F.col("score") >= score)
    w = W.partitionBy("a").orderBy(F.desc("score"), "b")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("a", "b", "score")
