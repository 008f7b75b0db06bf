"""Names to agents: alias closure, candidates in order of evidence, the event build, pairings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .relational import top_k

MAX_ALIASES = 100_000


def closed(aliases: dict[str, str]) -> dict[str, str]:
    """Each alias with the name its chain ends at; a chain that runs in a circle ends at the circle's smallest name."""
    end: dict[str, str] = {}
    for start in aliases:
        path, name = [], start
        while name in aliases and name not in end and name not in path:
            path.append(name)
            name = aliases[name]
        last = end.get(name, min(path[path.index(name) :]) if name in path else name)
        end |= dict.fromkeys(path, last)
    return end


def resolve(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced through ``aliases`` (from, to), chains closed.

    The aliases are a hand-kept list: more than ``MAX_ALIASES`` are refused.
    """
    rows = aliases.select("from", "to").limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    found = closed({r["from"]: r["to"] for r in sorted(rows, key=tuple, reverse=True)})
    table = df.sparkSession.createDataFrame(list(found.items()), "__from string, __to string")
    return df.join(F.broadcast(table), F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def candidates(tables: Sequence[tuple[DataFrame, str]], key: str, most: int = 8) -> DataFrame:
    """(key, candidates): of tables (key, ticker, weight) in order of their evidence, each ticker once by its
    strongest evidence, ``most`` a key, as a list of (rank, ticker, evidence)."""
    out = None
    for k, (df, evidence) in enumerate(tables):
        own = df.select(key, "ticker", F.col("weight").cast("double").alias("weight"), F.lit(k).alias("k"), F.lit(evidence).alias("evidence"))
        out = own if out is None else out.unionByName(own)
    best = top_k(out, [key, "ticker"], [F.col("k"), F.col("weight").desc()], 1)
    ranked = top_k(best, [key], [F.col("k"), F.col("weight").desc(), F.col("ticker")], most, "rank")
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "evidence"))).alias("candidates"))


def build_events(tuples: DataFrame, names: DataFrame, nodes: DataFrame, classes: DataFrame, noise: Column) -> DataFrame:
    """Events of tuples (a, b, rt, ...): both names to keys (names: name, key), keys to nodes (nodes: key, node),
    words to classes (classes: rt, rel_class).

    Left joins that neither drop nor repeat a row: every side is unique by its key. A tuple whose ends were
    merged into one node is noise of its own kind, unless it was noise before.
    """
    out = tuples.withColumn("noise", noise)
    for side, node in (("a", "src"), ("b", "dst")):
        own = names.select(F.col("name").alias(side), F.col("key").alias(f"{side}_key"))
        out = out.join(own, side, "left").join(nodes.select(F.col("key").alias(f"{side}_key"), F.col("node").alias(node)), f"{side}_key", "left")
        out = out.withColumn(node, F.coalesce(node, f"{side}_key"))
    out = out.join(classes, "rt", "left").withColumn("rel_class", F.coalesce("rel_class", F.lit("other")))
    return out.withColumn("noise", F.when(F.col("noise").isNull() & (F.col("src") == F.col("dst")), "merged").otherwise(F.col("noise")))


def paired(a: DataFrame, b: DataFrame, unit: str, ends: tuple[str, str], order: str) -> DataFrame:
    """``a`` with the first row of ``b`` (by ``order``) of the same unit and the same two ends, whichever comes first."""
    key = lambda: F.array_sort(F.array(*[F.col(e) for e in ends]))
    right = b.groupBy(unit, key().alias("_ends")).agg(F.min_by(F.struct(*b.columns), order).alias("match"))
    return a.withColumn("_ends", key()).join(right, [unit, "_ends"], "left").drop("_ends")


def content_hash(df: DataFrame, column: str) -> DataFrame:
    """One row: sha256 over the sorted distinct values' own digests, and their number. A list of references
    in any order has one hash."""
    digests = df.select(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256).alias("d")).distinct()
    return digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("hash"), F.count("*").alias("n"))  # a reference list
