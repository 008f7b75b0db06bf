"""Queries over the dated graph and its matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, matrices as M, relational as R
from ..sources.tables import Catalog, graph_events, mentions, sql

catalog = Catalog()
ASOF = "1999-06-30"
_EDGE = """count(*) AS n_events, count(DISTINCT doc_id) AS n_docs, count(*) FILTER (WHERE sign > 0) AS n_pos, count(*) FILTER (WHERE sign < 0) AS n_neg,
 round(sum(sign * strength), 6) AS w_sum, round(avg(sign * strength), 6) AS w_mean, round(sum(sign * strength * {d}), 6) AS w_decay, min(dt) AS first_dt, max(dt) AS last_dt"""
_DECAY = f"pow(0.5, (DATE '{ASOF}' - dt) / 30.0)"
_WIN = f"dt < DATE '{ASOF}' AND dt >= DATE '{ASOF}' - 90"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


_W = ("w_sum", "w_mean", "w_decay")


@catalog.add(sql("ge", f"SELECT src, dst, {_EDGE.format(d=_DECAY)} FROM ge WHERE {_WIN} GROUP BY 1, 2"))
def graph_snapshot_directed(spark, d):
    return _rounded(G.snapshot(graph_events(spark, d), ASOF, 90, 30), *_W)


@catalog.add(sql("ge", f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, {_EDGE.format(d='1')} FROM ge WHERE {_WIN} GROUP BY 1, 2"))
def graph_snapshot_undirected(spark, d):
    return _rounded(G.snapshot(graph_events(spark, d), ASOF, 90, directed=False), *_W)


@catalog.add(sql("ge", f"SELECT rel_class, src, dst, {_EDGE.format(d=_DECAY)} FROM ge WHERE {_WIN} GROUP BY ALL"))
def graph_snapshot_by_class(spark, d):
    return _rounded(G.snapshot(graph_events(spark, d), ASOF, 90, 30, by_class=True), *_W)


@catalog.add(sql("ge", f"SELECT src, dst, {_EDGE.format(d='1')} FROM ge WHERE dt < DATE '{ASOF}' AND rel_class IN ('ECONOMY', 'PROMO') AND strength >= 0.3 AND src_kind IN ('supplier', 'brand') AND dst_kind IN ('supplier', 'brand') GROUP BY 1, 2 HAVING count(*) >= 2"))
def graph_snapshot_filters(spark, d):
    return _rounded(G.snapshot(graph_events(spark, d), ASOF, None, min_events=2, classes=["ECONOMY", "PROMO"], kinds=["supplier", "brand"], min_strength=0.3), *_W)


@catalog.add(sql("ge", f"SELECT * FROM (SELECT src, dst, {_EDGE.format(d=_DECAY)} FROM ge WHERE {_WIN} GROUP BY 1, 2) ORDER BY abs(w_decay) DESC, src, dst LIMIT 50"))
def graph_snapshot_decay_topn(spark, d):
    return graph_snapshot_directed(spark, d).orderBy(F.abs("w_decay").desc(), "src", "dst").limit(50)


@catalog.add(sql("ge", "SELECT g.asof, src, dst, " + _EDGE.format(d="pow(0.5, (g.asof - dt) / 45.0)") + " FROM ge JOIN g ON ge.dt < g.asof AND ge.dt >= g.asof - 90 GROUP BY 1, 2, 3", g="SELECT CAST(unnest(generate_series(DATE '1998-01-05', DATE '1998-03-30', INTERVAL 7 DAY)) AS DATE) AS asof"))
def graph_snapshot_series(spark, d):
    return _rounded(G.snapshots(graph_events(spark, d), "1998-01-05", "1998-03-30", half_life=45), *_W)


_PERIOD = """SELECT CAST(date_trunc('{p}', dt) AS DATE) AS period, src, dst, rel_class, count(*) AS n_events, count(DISTINCT doc_id) AS n_docs,
 count(*) FILTER (WHERE sign > 0) AS n_pos, count(*) FILTER (WHERE sign < 0) AS n_neg, round(sum(sign * strength), 6) AS w_sum, round(avg(sign * strength), 6) AS w_mean, round(avg(strength), 6) AS mean_strength FROM ge GROUP BY ALL"""


@catalog.add(sql("ge", _PERIOD.format(p="week")))
def period_edges_week(spark, d):
    return _rounded(G.period_edges(graph_events(spark, d), "week"), "w_sum", "w_mean", "mean_strength")


@catalog.add(sql("ge", _PERIOD.format(p="month")))
def period_edges_month(spark, d):
    return _rounded(G.period_edges(graph_events(spark, d), "month"), "w_sum", "w_mean", "mean_strength")


@catalog.add(sql("ge", "SELECT dt, src, dst, count(*) AS n, round(avg(strength), 6) AS mean_strength, round(sum(CASE WHEN sign > 0 THEN strength ELSE -strength END), 6) AS signed_strength FROM ge GROUP BY 1, 2, 3"))
def signed_daily_edges(spark, d):
    s = F.when(F.col("sign") > 0, F.col("strength")).otherwise(-F.col("strength"))
    return _rounded(graph_events(spark, d).groupBy("dt", "src", "dst").agg(F.count("*").alias("n"), F.avg("strength").alias("mean_strength"), F.sum(s).alias("signed_strength")), "mean_strength", "signed_strength")


@catalog.add(sql("ge", "SELECT node, count(*) AS n_events, count(DISTINCT other) AS degree FROM (SELECT src AS node, dst AS other FROM ge UNION ALL SELECT dst, src FROM ge) GROUP BY 1"))
def union_both_directions(spark, d):
    return G.node_stats(graph_events(spark, d))


@catalog.add(sql("ge", "SELECT year(dt) AS y, count(DISTINCT (src, dst)) AS n_pairs, count(DISTINCT src) AS n_src FROM ge GROUP BY 1"))
def distinct_pairs(spark, d):
    return graph_events(spark, d).groupBy(F.year("dt").cast("long").alias("y")).agg(F.count_distinct(F.struct("src", "dst")).alias("n_pairs"), F.count_distinct("src").alias("n_src"))


@catalog.add(sql("ge", "SELECT coalesce(a.y, b.y + 1) AS y, round(count(*) FILTER (WHERE a.y IS NOT NULL AND b.y IS NOT NULL) / count(*), 6) AS jaccard FROM e a FULL JOIN e b ON a.src = b.src AND a.dst = b.dst AND a.y = b.y + 1 GROUP BY 1", e="SELECT DISTINCT year(dt) AS y, src, dst FROM ge"))
def jaccard_by_period(spark, d):
    e = graph_events(spark, d).select(F.year("dt").cast("long").alias("y"), "src", "dst").distinct()
    both = e.withColumn("a", F.lit(1)).join(e.select((F.col("y") + 1).alias("y"), "src", "dst", F.lit(1).alias("b")), ["y", "src", "dst"], "full")
    return both.groupBy("y").agg(F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*"), 6).alias("jaccard"))


@catalog.add(sql("ge", "SELECT y, degree, count(*) AS n FROM (SELECT y, node, count(*) AS degree FROM (SELECT y, i AS node FROM u UNION ALL SELECT y, j FROM u) GROUP BY 1, 2) GROUP BY 1, 2", u="SELECT DISTINCT year(dt) AS y, least(src, dst) AS i, greatest(src, dst) AS j FROM ge"))
def degree_distribution(spark, d):
    u = graph_events(spark, d).select(F.year("dt").cast("long").alias("y"), F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    nodes = u.select("y", F.col("i").alias("node")).unionByName(u.select("y", F.col("j").alias("node")))
    return nodes.groupBy("y", "node").agg(F.count("*").alias("degree")).groupBy("y", "degree").agg(F.count("*").alias("n"))


_PAIR = f"SELECT least(src, dst) AS i, greatest(src, dst) AS j, rel_class, sign * strength * pow(0.5, (DATE '{ASOF}' - dt) / 90.0) AS w FROM ge WHERE dt < DATE '{ASOF}'"


@catalog.add(sql("ge", "SELECT i, j, rel_class, round(sum(w), 6) AS w, round(sum(abs(w)), 6) AS w_abs, count(*) AS n FROM p GROUP BY 1, 2, 3", p=_PAIR))
def pair_direct_groups(spark, d):
    return _rounded(M.direct_pairs(graph_events(spark, d).filter(F.col("dt") < F.lit(ASOF)), ASOF, 90), "w", "w_abs")


_CELL = f"SELECT dst AS node, src AS agent, sum(w) AS w, sum(abs(w)) AS w_abs, count(*) AS n FROM (SELECT dst, src, sign * strength * pow(0.5, (DATE '{ASOF}' - dt) / 90.0) AS w FROM ge WHERE dt < DATE '{ASOF}') GROUP BY 1, 2"


def _cells(spark, d):
    return M.exposure(graph_events(spark, d).filter(F.col("dt") < F.lit(ASOF)), ASOF, 90, "P")


@catalog.add(sql("ge", "SELECT node, agent, round(w, 6) AS w, round(w_abs, 6) AS w_abs, n FROM c", c=_CELL))
def exposure_cells(spark, d):
    return _rounded(_cells(spark, d), "w", "w_abs")


_NORMS = {
    "idf": "SELECT node, agent, w * ln((SELECT count(DISTINCT node) FROM c) / count(*) OVER (PARTITION BY agent)) AS x FROM c",
    "degree": "SELECT node, agent, w / sqrt(s) AS x FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY agent) AS s FROM c) WHERE s > 0",
    "pmi": "SELECT node, agent, sign(w) * greatest(ln(abs(w) * (SELECT sum(abs(w)) FROM c) / (r * k)), 0) AS x FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY node) AS r, sum(abs(w)) OVER (PARTITION BY agent) AS k FROM c WHERE w <> 0)",
    "z": "SELECT node, agent, CASE WHEN s > 1e-12 THEN (w - m) / s ELSE 0 END AS x FROM (SELECT *, avg(w) OVER (PARTITION BY agent) AS m, stddev_pop(w) OVER (PARTITION BY agent) AS s FROM c)",
}


def _norm_query(norm):
    def query(spark, d):
        return M.weighted(_cells(spark, d), norm).select("node", "agent", F.round(F.col("x") + 0.0, 5).alias("x"))

    query.__name__ = f"exposure_{norm}"
    catalog.add(sql("ge", "SELECT node, agent, round(x + 0.0, 5) AS x FROM n", c=_CELL, n=_NORMS[norm]))(query)


for _n in _NORMS:
    _norm_query(_n)


@catalog.add(sql("ge", "SELECT a.node AS i, b.node AS j, round(sum(a.x * b.x), 6) AS cosine FROM u a JOIN u b ON a.agent = b.agent AND a.node < b.node GROUP BY 1, 2", c=_CELL, u="SELECT node, agent, w / s AS x FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY node)) AS s FROM c) WHERE s > 0"))
def projection_cosine(spark, d):
    return _rounded(M.projection(M.weighted(_cells(spark, d), "raw")), "cosine")


@catalog.add(sql("men", "SELECT a.symbol AS i, b.symbol AS j, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.symbol < b.symbol GROUP BY 1, 2", m="SELECT DISTINCT doc_id, symbol FROM men"))
def cooccurrence(spark, d):
    return M.cooccurrence(mentions(spark, d), "doc_id", "symbol")


@catalog.add(sql("men", "SELECT a.symbol AS i, b.symbol AS j, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.symbol < b.symbol GROUP BY 1, 2", m="SELECT doc_id, symbol FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM (SELECT DISTINCT doc_id, symbol FROM men)) WHERE k < 5"))
def wrap_exclusion(spark, d):
    return M.cooccurrence(mentions(spark, d), "doc_id", "symbol", largest=5)


@catalog.add(sql("men", "SELECT i, j, round(n / sqrt(a.t * b.t), 6) AS cosine FROM p JOIN t a ON i = a.symbol JOIN t b ON j = b.symbol", m="SELECT DISTINCT doc_id, symbol FROM men", t="SELECT symbol, count(*) AS t FROM m GROUP BY 1", p="SELECT a.symbol AS i, b.symbol AS j, count(*) AS n FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.symbol < b.symbol GROUP BY 1, 2"))
def count_cosine(spark, d):
    own = mentions(spark, d).select("doc_id", "symbol").distinct()
    return _rounded(M.count_cosine(M.cooccurrence(own, "doc_id", "symbol"), own.groupBy("symbol").agg(F.count("*").alias("total"))), "cosine")


@catalog.add(sql("ge", "SELECT node, count(DISTINCT doc_id) AS n_docs FROM (SELECT src AS node, doc_id FROM ge UNION ALL SELECT dst, doc_id FROM ge) GROUP BY 1"))
def node_mentions(spark, d):
    return G.both_directions(graph_events(spark, d)).groupBy("node").agg(F.count_distinct("doc_id").alias("n_docs"))


@catalog.add("SELECT least(a.label, b.label) AS i, greatest(a.label, b.label) AS j, round(avg(list_cosine_similarity(a.embedding, b.embedding)), 5) AS cosine, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id GROUP BY 1, 2")
def embedding_cosine(spark, d):
    """Mean cosine of all pairs by labels: a product of sums of unit vectors, so no pairs are made."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    e = e.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("norm > 0")
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    sums = e.select("label", "norm", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.sum(F.col("x") / F.col("norm")).alias("s"))
    a, b = sums.toDF("i", "at", "si"), sums.toDF("j", "at", "sj")
    dot = a.join(b, "at").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("si") * F.col("sj")).alias("dot"))  # a row a pair of labels
    both = dot.join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j")
    same = F.col("i") == F.col("j")
    pairs = F.when(same, F.col("ni") * (F.col("ni") - 1) / 2).otherwise(F.col("ni") * F.col("nj")).cast("long")
    total = F.when(same, (F.col("dot") - F.col("ni")) / 2).otherwise(F.col("dot"))
    return both.select("i", "j", F.round(total / pairs, 5).alias("cosine"), pairs.alias("n")).filter("n > 0")


@catalog.add()
def pagerank(spark, d):
    edges = G.snapshot(graph_events(spark, d), ASOF, 365).select("src", "dst", F.col("n_events").cast("double").alias("w"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return M.pagerank(both)


@catalog.add(sql("ge", f"SELECT p.rel_class, round(sum(sign(x) * ln(1 + abs(x))), 6) AS signed_log FROM (SELECT i, j, rel_class, sum(w) AS x FROM p GROUP BY 1, 2, 3) p GROUP BY 1", p=_PAIR))
def signed_log_by_class(spark, d):
    p = M.direct_pairs(graph_events(spark, d).filter(F.col("dt") < F.lit(ASOF)), ASOF, 90)
    return p.groupBy("rel_class").agg(F.round(F.sum(M.signed_log(F.col("w"))), 6).alias("signed_log"))


@catalog.add(sql("ge", "SELECT src, p.rel_class FROM (SELECT src, rel_class, row_number() OVER (PARTITION BY src ORDER BY w DESC, seen, rel_class) AS k FROM t) p WHERE k = 1", t="SELECT src, rel_class, round(sum(strength), 6) AS w, min(dt) AS seen FROM ge GROUP BY 1, 2"))
def mode_weighted(spark, d):
    t = graph_events(spark, d).groupBy("src", "rel_class").agg(F.round(F.sum("strength"), 6).alias("w"), F.min("dt").alias("seen"))
    return R.weighted_mode(t, "src", "rel_class", "w", "seen")
