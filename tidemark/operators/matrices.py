"""Graph matrices as long tables (i, j, value): pairs, exposures, projections, co-occurrence.

An exposure cell is (node, agent, value): what a node of the universe has to do with an agent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.scratch import materialise
from .graph import both_directions, decay


def direct_pairs(events: DataFrame, asof: str, half_life: float) -> DataFrame:
    """(i, j, rel_class, w, w_abs, n): decayed strength between two nodes, either way."""
    w = F.col("sign") * F.col("strength") * decay(F.datediff(F.lit(asof).cast("date"), "dt"), half_life)
    own = events.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), "rel_class", w.alias("w")).filter("i <> j")
    return own.groupBy("i", "j", "rel_class").agg(F.sum("w").alias("w"), F.sum(F.abs("w")).alias("w_abs"), F.count("*").alias("n"))


def exposure(events: DataFrame, asof: str, half_life: float, prefix: str) -> DataFrame:
    """(node, agent, w, w_abs, n) of events with exactly one end that begins with ``prefix``."""
    ends = both_directions(events).filter(F.col("node").startswith(prefix) & ~F.col("other").startswith(prefix))
    w = F.col("sign") * F.col("strength") * decay(F.datediff(F.lit(asof).cast("date"), "dt"), half_life)
    return ends.withColumn("w", w).groupBy("node", F.col("other").alias("agent")).agg(F.sum("w").alias("w"), F.sum(F.abs("w")).alias("w_abs"), F.count("*").alias("n"))


def weighted(cells: DataFrame, norm: str, value: str = "w") -> DataFrame:
    """(node, agent, x): exposure cells under a norm.

    raw: as they are; idf: times ln(N / nodes of the agent); degree: over the root of the agent's
    absolute sum; pmi: positive pointwise mutual information of absolute cells, with the cell's
    sign; z: centred and scaled within the agent.
    """
    cells = cells.select("node", "agent", F.col(value).alias("x"))
    agent, node = W.partitionBy("agent"), W.partitionBy("node")
    if norm == "raw":
        return cells
    if norm == "idf":
        total = F.broadcast(cells.agg(F.count_distinct("node").alias("total")))  # one row
        return cells.withColumn("df", F.count("*").over(agent)).crossJoin(total).select("node", "agent", (F.col("x") * F.ln(F.col("total") / F.col("df"))).alias("x"))
    if norm == "degree":
        return cells.withColumn("s", F.sum(F.abs("x")).over(agent)).filter("s > 0").select("node", "agent", (F.col("x") / F.sqrt("s")).alias("x"))
    if norm == "pmi":
        total = F.broadcast(cells.agg(F.sum(F.abs("x")).alias("total")))  # one row
        both = cells.filter("x <> 0").withColumns({"r": F.sum(F.abs("x")).over(node), "c": F.sum(F.abs("x")).over(agent)}).crossJoin(total)
        pmi = F.ln(F.abs("x") * F.col("total") / (F.col("r") * F.col("c")))
        return both.select("node", "agent", (F.signum("x") * F.greatest(pmi, F.lit(0.0))).alias("x"))
    if norm == "z":
        both = cells.withColumns({"m": F.avg("x").over(agent), "s": F.stddev_pop("x").over(agent)})
        return both.select("node", "agent", F.when(F.col("s") > 1e-12, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0).alias("x"))
    raise ValueError(f"no norm {norm}")


def projection(cells: DataFrame) -> DataFrame:
    """(i, j, cosine) of every two nodes i < j that share an agent."""
    unit = cells.withColumn("s", F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("node")))).filter("s > 0")
    unit = unit.select("node", "agent", (F.col("x") / F.col("s")).alias("x"))
    a, b = unit.toDF("i", "agent", "a"), unit.toDF("j", "agent", "b")
    return a.join(b, "agent").filter("i < j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("cosine"))


def cooccurrence(members: DataFrame, doc: str, item: str, largest: int | None = None) -> DataFrame:
    """(i, j, n): documents that hold both items. Documents of ``largest`` items or more (lists of
    everything) are left out if asked."""
    own = members.select(F.col(doc).alias("doc"), F.col(item).alias("item")).distinct()
    if largest:
        own = own.withColumn("k", F.count("*").over(W.partitionBy("doc"))).filter(F.col("k") < largest).drop("k")
    a, b = own.toDF("doc", "i"), own.toDF("doc", "j")
    return a.join(b, "doc").filter("i < j").groupBy("i", "j").agg(F.count("*").alias("n"))


def count_cosine(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """(i, j, cosine): n over the root of the items' own counts; ``totals`` is (item, total)."""
    return pairs.join(totals.toDF("i", "ti"), "i").join(totals.toDF("j", "tj"), "j").select("i", "j", (F.col("n") / F.sqrt(F.col("ti") * F.col("tj"))).alias("cosine"))


def signed_log(c):
    return F.signum(c) * F.log1p(F.abs(c))


#: Edges up to which the rounds of ``pagerank`` run in one task; a round of a larger graph is a job.
LOCAL_EDGES = 1_000_000


def _ranks(damping: float, rounds: int, tolerance: float):
    """applyInPandas function over all edges (src, dst, p)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst", "p"])
        code, nodes = pd.factorize(pd.concat([pdf["src"], pdf["dst"]]), sort=True)
        src, dst, p, n = code[: len(pdf)], code[len(pdf) :], pdf["p"].to_numpy(), len(nodes)
        sink = np.bincount(src, minlength=n) == 0
        rank = np.full(n, 1.0 / n)
        for _ in range(rounds):
            new = (1 - damping) / n + damping * (np.bincount(dst, p * rank[src], n) + rank[sink].sum() / n)
            change, rank = np.abs(new - rank).max(), new
            if change < tolerance:
                break
        return pd.DataFrame({"node": nodes, "rank": rank})

    return run


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 1000, tolerance: float = 1e-12) -> DataFrame:
    """(node, rank) over edges (src, dst, w), iterated until no rank changes by ``tolerance`` or
    for ``rounds``. On more than LOCAL_EDGES edges each round's ranks are written."""
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    share = materialise(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "share")
    if share.count() <= LOCAL_EDGES:
        return share.groupBy(F.lit(0).alias("g")).applyInPandas(_ranks(damping, rounds, tolerance), f"node {share.schema['src'].dataType.simpleString()}, rank double")
    nodes = materialise(share.select("src").union(share.select("dst")).distinct().toDF("node"), "nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    sinks = nodes.join(share.select(F.col("src").alias("node")), "node", "left_anti")
    for _ in range(rounds):
        flow = share.join(rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("f"))
        lost = F.broadcast(rank.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")))  # one row
        after = ((1 - damping) / n + damping * (F.coalesce("f", F.lit(0.0)) + F.col("lost") / n)).alias("after")
        step = rank.join(flow, rank["node"] == flow["dst"], "left").crossJoin(lost).select("node", after, F.col("rank").alias("before"))
        step = materialise(step, "rank")
        rank = step.select("node", F.col("after").alias("rank"))
        if step.agg(F.max(F.abs(F.col("after") - F.col("before")))).first()[0] < tolerance:
            break
    return rank


def _power(rounds: int, tolerance: float):
    """applyInPandas function over all links (i, j, w) of an undirected graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j", "w"])
        code, nodes = pd.factorize(pd.concat([pdf["i"], pdf["j"]]), sort=True)
        half, n = len(pdf), len(nodes)
        apart = code[:half] != code[half:]
        a, b = np.concatenate([code[:half], code[half:][apart]]), np.concatenate([code[half:], code[:half][apart]])
        w = np.concatenate([pdf["w"].to_numpy(), pdf["w"].to_numpy()[apart]])
        v = np.full(n, n**-0.5)
        for _ in range(rounds):
            new = np.bincount(a, w * v[b], n)
            size = np.linalg.norm(new)
            if size == 0:
                break
            change, v = np.abs(new / size - v).max(), new / size
            if change < tolerance:
                break
        return pd.DataFrame({"node": nodes, "centrality": np.abs(v)})

    return run


def eigenvector_centrality(links: DataFrame, rounds: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """(node, centrality) over undirected links (i, j, w >= 0), each given once: the main eigenvector, of
    length 1, by power iteration until no value changes by ``tolerance`` or for ``rounds``.

    On a bipartite graph the iteration swings between two vectors, and the last one is given. With more
    than LOCAL_EDGES links a round is a job and its values are written.
    """
    own = materialise(links.groupBy("i", "j").agg(F.sum("w").alias("w")), "links")
    if own.count() <= LOCAL_EDGES:
        return own.groupBy(F.lit(0).alias("g")).applyInPandas(_power(rounds, tolerance), f"node {own.schema['i'].dataType.simpleString()}, centrality double")
    ways = own.toDF("a", "b", "w").union(own.filter("i <> j").select("j", "i", "w"))
    nodes = materialise(ways.select(F.col("a").alias("node")).distinct(), "nodes")
    v = nodes.withColumn("v", F.lit(nodes.count() ** -0.5))
    for _ in range(rounds):
        new = ways.join(v.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("u"))
        size = F.broadcast(new.agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("size")))  # one row
        step = materialise(new.crossJoin(size).join(v, "node").select("node", F.try_divide("u", "size").alias("v"), F.col("v").alias("before")), "centrality")
        change = step.agg(F.max(F.abs(F.col("v") - F.col("before")))).first()[0]
        if change is None:  # all weights are 0
            break
        v = step.select("node", "v")
        if change < tolerance:
            break
    return v.select("node", F.abs("v").alias("centrality"))
