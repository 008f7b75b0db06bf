"""Queries for joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import relational as R
from ..sources.tables import Catalog, graph_events, load, mentions, sql

catalog = Catalog()


@catalog.add("SELECT l_orderkey, l_suppkey, o_custkey, o_orderstatus, round(l_extendedprice, 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < DATE '1996-01-01'")
def articles_join(spark, d):
    li = load(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("date"))
    return li.join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_suppkey", "o_custkey", "o_orderstatus", F.round("l_extendedprice", 2).alias("price"))


@catalog.add(sql("men", "SELECT symbol, dt, count(*) AS n_articles, count(DISTINCT doc_id) AS n_documents FROM men GROUP BY 1, 2"))
def daily_symbol_counts(spark, d):
    return mentions(spark, d).groupBy("symbol", "dt").agg(F.count("*").alias("n_articles"), F.count_distinct("doc_id").alias("n_documents"))


@catalog.add(sql("men", "SELECT symbol, count(*) AS n_mentions, min(dt) AS first_seen, max(dt) AS last_seen, count(DISTINCT dt) AS active_days FROM men GROUP BY 1"))
def coverage(spark, d):
    return mentions(spark, d).groupBy("symbol").agg(F.count("*").alias("n_mentions"), F.min("dt").alias("first_seen"), F.max("dt").alias("last_seen"), F.count_distinct("dt").alias("active_days"))


@catalog.add("SELECT o_orderkey AS doc_id, coalesce(s, '') AS symbols FROM orders LEFT JOIN (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def doc_symbols_sorted(spark, d):
    s = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("s"))
    return load(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("doc_id"), F.coalesce("s", F.lit("")).alias("symbols"))


@catalog.add("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_anti_join(spark, d):
    return load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@catalog.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join_dedup(spark, d):
    r = load(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return load(spark, d, "orders").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@catalog.add("SELECT DISTINCT l_suppkey FROM lineitem WHERE year(l_shipdate) = 1996 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE year(l_shipdate) = 1995)")
def not_in_seen(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    return R.not_in(li.filter("y = 1996"), li.filter("y = 1995"), "l_orderkey").select("l_suppkey").distinct()


@catalog.add("SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, n, n_symbols FROM lineitem JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS n_symbols FROM lineitem GROUP BY 1) USING (l_orderkey)")
def count_distinct_over(spark, d):
    li = load(spark, d, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_symbols"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate").join(per, "l_orderkey")


_DEDUP = "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {o}) AS k FROM lineitem) WHERE k = 1"


@catalog.add(_DEDUP.format(o="l_shipdate NULLS LAST, l_suppkey, l_partkey"))
def dedup_row_number(spark, d):
    return R.first_by(load(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_shipdate").asc_nulls_last(), F.col("l_suppkey"), F.col("l_partkey")]).select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")


@catalog.add(_DEDUP.format(o="(l_linestatus = 'O') DESC, l_shipdate DESC, l_suppkey, l_partkey"))
def dedup_prefer_ok(spark, d):
    order = [(F.col("l_linestatus") == "O").desc(), F.col("l_shipdate").desc(), F.col("l_suppkey"), F.col("l_partkey")]
    return R.first_by(load(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")


@catalog.add("SELECT l_suppkey, l_orderkey, l_partkey, l_shipdate, k FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_shipdate) AS k FROM lineitem) WHERE k <= 3")
def top_k_per_group(spark, d):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_shipdate")]
    return R.top_k(load(spark, d, "lineitem"), ["l_suppkey"], order, 3, "k").select("l_suppkey", "l_orderkey", "l_partkey", "l_shipdate", "k")


@catalog.add("SELECT q, o_orderkey, k FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS k FROM (SELECT *, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS q FROM orders)) WHERE k <= 20")
def ntile_strata(spark, d):
    o = R.with_ntile(load(spark, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 4, "q")
    return R.top_k(o, ["q"], [F.md5(F.col("o_orderkey").cast("string"))], 20, "k").select("q", "o_orderkey", "k")


@catalog.add("SELECT rel_class AS cls, doc_id, k FROM (SELECT p_type AS rel_class, l_orderkey AS doc_id, row_number() OVER (PARTITION BY p_type ORDER BY md5('s:' || l_orderkey), l_orderkey) AS k FROM (SELECT DISTINCT p_type, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE k <= 10")
def stratified_sample(spark, d):
    own = graph_events(spark, d).select("rel_class", "doc_id").distinct()
    order = [F.md5(F.concat(F.lit("s:"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    return R.top_k(own, ["rel_class"], order, 10, "k").select(F.col("rel_class").alias("cls"), "doc_id", "k")


@catalog.add(sql("ge", "SELECT event_id, src, dst, dt, doc_id, rel_class FROM (SELECT *, row_number() OVER (ORDER BY dt, src, dst, rel_class, doc_id, strength, sign) AS event_id FROM ge)"))
def event_id_total_order(spark, d):
    order = ["dt", "src", "dst", "rel_class", "doc_id", "strength", "sign"]
    return R.total_order(graph_events(spark, d).select(order), order, "event_id").select("event_id", "src", "dst", "dt", "doc_id", "rel_class")


@catalog.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1, 2")
def share_of_total(spark, d):
    n = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@catalog.add("SELECT y, round(avg(1 - coalesce(common, 0) / n), 6) AS turnover FROM (SELECT b.y, count(*) AS n, count(a.s) AS common FROM t b LEFT JOIN t a ON a.s = b.s AND a.y = b.y - 1 WHERE b.y > (SELECT min(y) FROM t) GROUP BY 1) GROUP BY 1".join(["WITH t AS (SELECT y, s FROM (SELECT year(l_shipdate) AS y, l_suppkey AS s, row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY count(*) DESC, l_suppkey) AS k FROM lineitem GROUP BY 1, 2) WHERE k <= 20) ", ""]))
def set_turnover(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("y"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"))
    t = R.top_k(n, ["y"], [F.desc("n"), F.col("s")], 20).select("y", "s")
    first = F.broadcast(t.agg(F.min("y").alias("first")))  # one row
    before = t.select((F.col("y") + 1).alias("y"), "s", F.lit(1).alias("was"))
    return t.crossJoin(first).filter("y > first").join(before, ["y", "s"], "left").groupBy("y").agg(F.round(1 - F.count("was") / F.count("*"), 6).alias("turnover"))


@catalog.add("SELECT p_brand, array_to_string(list(p_type ORDER BY n DESC, p_type)[1:3], ',') AS types FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def ordered_list_slice(spark, d):
    n = load(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p_type")))
    return n.groupBy("p_brand").agg(F.array_join(F.transform(F.slice(ordered, 1, 3), lambda x: x["p_type"]), ",").alias("types"))


@catalog.add("SELECT CAST(date_trunc('{p}', d) AS DATE) AS period, min(d) AS first_date FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1".format(p="month"))
def first_session_of_period(spark, d):
    days = load(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return R.first_of_period(days, "month")


@catalog.add("SELECT user_id, longest FROM (SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - sum(CAST(value > 20 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) WHERE value > 20 GROUP BY 1, 2) GROUP BY 1)")
def underwater_run(spark, d):
    return R.longest_run(load(spark, d, "events"), "user_id", "event_id", F.col("value") > 20)


@catalog.add("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def ffill_bfill(spark, d):
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    w = W.partitionBy("user_id").orderBy("event_id")
    return load(spark, d, "events").select("user_id", "event_id", F.last(v, ignorenulls=True).over(w).alias("last_purchase"), F.first(v, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("next_purchase"))


_CHANGES = "SELECT o_custkey, CAST(o_orderdate AS DATE) AS od, max(o_orderkey) AS v FROM orders GROUP BY 1, 2"


def _asof(spark, d, strict):
    right = load(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("od")).agg(F.max("o_orderkey").alias("v"))
    left = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return R.asof_join(left, right, "o_custkey", "day", "od", ["v"], strict)


_ASOF = "SELECT o.o_orderkey, o.o_custkey, CAST(o.o_orderdate AS DATE) AS day, c.v FROM orders o ASOF LEFT JOIN c ON o.o_custkey = c.o_custkey AND CAST(o.o_orderdate AS DATE) {op} c.od"


@catalog.add(sql("", _ASOF.format(op=">"), c=_CHANGES))
def asof_join_strict(spark, d):
    right = load(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("od")).agg(F.max("o_orderkey").alias("v"))
    left = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return R.asof_join(left.withColumn("_c", F.col("o_custkey")), right, "o_custkey", "day", "od", ["v"], True).drop("_c")


@catalog.add(sql("", _ASOF.format(op=">="), c=_CHANGES))
def asof_join_inclusive(spark, d):
    return _asof(spark, d, False)


@catalog.add("SELECT e.event_id, c.day AS session FROM (SELECT *, CAST(ts AS DATE) AS d FROM events) e ASOF JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE dayofweek(ts) NOT IN (0, 6)) c ON e.d < c.day")
def next_session_join(spark, d):
    e = load(spark, d, "events").select("event_id", F.to_date("ts").alias("d"))
    cal = e.select(F.col("d").alias("date")).distinct().filter(~F.dayofweek("date").isin(1, 7))
    return R.next_day(e, cal, "d", "session").select("event_id", "session")


_RANGES = [(0, 10, "small"), (11, 25, "medium"), (20, 40, "large")]


@catalog.add("SELECT p_partkey, CASE WHEN p_size IS NULL THEN NULL WHEN p_size BETWEEN 0 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 25 THEN 'medium' WHEN p_size BETWEEN 20 AND 40 THEN 'large' ELSE 'Other' END AS sector FROM part")
def range_lookup_sector(spark, d):
    ranges = spark.createDataFrame([(i, *r) for i, r in enumerate(_RANGES)], "k int, lo int, hi int, name string")
    p = load(spark, d, "part").select("p_partkey", "p_size")
    hit = p.join(F.broadcast(ranges), F.col("p_size").between(F.col("lo"), F.col("hi")), "left")  # a constant table
    best = hit.groupBy("p_partkey", "p_size").agg(F.min_by("name", "k").alias("name"))
    return best.select("p_partkey", F.when(F.col("p_size").isNotNull(), F.coalesce("name", F.lit("Other"))).alias("sector"))


@catalog.add("SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_nationkey >= 0")
def same_sector_pairs(spark, d):
    s = load(spark, d, "supplier").filter("s_nationkey >= 0").select("s_nationkey", "s_suppkey")
    return s.toDF("n", "i").join(s.toDF("n", "j"), "n").filter("i < j").select("i", "j")


@catalog.add("SELECT s_nationkey, n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_join(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_nationkey", "n_name", "r_name").agg(F.count("*").alias("n"))


@catalog.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_tuples_explode(spark, d):
    from ..operators.corpus import relation_tuples

    return relation_tuples(load(spark, d, "events"))


@catalog.add("SELECT * FROM (SELECT p_brand, p_type, p_partkey FROM part) PIVOT (count(p_partkey) FOR p_type IN ('ECONOMY' AS economy, 'PROMO' AS promo) GROUP BY p_brand)")
def pivot_counts(spark, d):
    p = load(spark, d, "part").groupBy("p_brand").pivot("p_type", ["ECONOMY", "PROMO"]).agg(F.count("p_partkey"))
    return p.select("p_brand", F.coalesce("ECONOMY", F.lit(0)).alias("economy"), F.coalesce("PROMO", F.lit(0)).alias("promo"))


@catalog.add("(SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) UNION (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 49)")
def set_operations(spark, d):
    li = load(spark, d, "lineitem").filter("l_quantity > 49")
    a, r, n = (li.filter(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("k")) for f in "ARN")
    return a.subtract(r).union(a.intersect(n)).distinct()


@catalog.add("SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, arg_max(p, d) AS last_price FROM (SELECT l_shipdate, CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def resample_month_last(spark, d):
    p = load(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.max("l_extendedprice").alias("p"))
    return p.groupBy(F.to_date(F.date_trunc("month", "d")).alias("month")).agg(F.max_by("p", "d").alias("last_price"))
