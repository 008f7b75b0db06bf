"""Queries over raw news, relations and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C, inference as I, relational as R
from ..sources.tables import Catalog, graph_events, load, mentions, names, raw_news, sql

catalog = Catalog()

_KEY = "md5(CASE WHEN nullif(trim(url), '') IS NOT NULL THEN 'u:' || trim(url) ELSE 'c:' || md5(trim(regexp_replace(body, '\\s+', ' ', 'g'))) END)"
_STG = f"SELECT *, {_KEY} AS doc_key, year(published) AS year FROM news"
_DOCS = """SELECT doc_key, published, year, url, symbol, n_symbols, length(body) AS body_chars, length(body) < 200 AS is_stub FROM (
 SELECT s.*, n.n_symbols, row_number() OVER (PARTITION BY s.doc_key ORDER BY published NULLS LAST, symbol NULLS LAST, doc_id) AS k
 FROM stg s JOIN (SELECT doc_key, year, count(DISTINCT symbol) AS n_symbols FROM stg GROUP BY 1, 2) n ON s.doc_key = n.doc_key AND s.year = n.year) WHERE k = 1"""


@catalog.add(sql("news", "SELECT doc_key, published, CAST(year AS INT) AS year, url, symbol, n_symbols, CAST(body_chars AS INT) AS body_chars, is_stub FROM docs", stg=_STG, docs=_DOCS))
def curate_documents(spark, d):
    return C.documents(raw_news(spark, d))


@catalog.add(sql("news", "SELECT DISTINCT doc_key, symbol, published, CAST(year AS INT) AS year FROM stg", stg=_STG))
def curate_mentions(spark, d):
    return C.document_mentions(raw_news(spark, d))


_UNIT = "md5(trim(regexp_replace(regexp_replace(lower(body), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')))"


@catalog.add(sql("news", "SELECT unit, doc_id AS repr_doc_id, published, n_source_docs, all_symbols FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY length(body) DESC, published, doc_id) AS k, count(*) OVER (PARTITION BY unit) AS n_source_docs, array_to_string(list_sort(list(symbol) OVER (PARTITION BY unit)), ',') AS all_symbols FROM u) WHERE k = 1", u=f"SELECT *, {_UNIT} AS unit FROM news WHERE length(body) >= 200"))
def units_near_dedup(spark, d):
    return C.units(raw_news(spark, d))


@catalog.add("SELECT page_id, domain FROM (SELECT page_id, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:]+)', 1) AS domain FROM pages) WHERE coalesce(domain, '') NOT IN ('m.therou.example.com', 'therin.example.net')")
def units_domain_filter(spark, d):
    p = load(spark, d, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))
    return p.filter(~F.coalesce("domain", F.lit("")).isin("m.therou.example.com", "therin.example.net"))


_MD5 = "CAST('0x' || substr(md5({c}), 1, 8) AS BIGINT)"


@catalog.add(f"SELECT doc_id FROM documents WHERE {_MD5.format(c="'sample:' || CAST(doc_id AS VARCHAR)")} < {int(0.3 * 2**32)}")
def hash_sample_nested(spark, d):
    return load(spark, d, "documents").filter(T.sampled(F.col("doc_id").cast("string"), 0.3)).select("doc_id")


@catalog.add(f"SELECT doc_id, CAST({_MD5.format(c='CAST(doc_id AS VARCHAR)')} % 4 AS INT) AS part FROM documents")
def hash_partition(spark, d):
    return load(spark, d, "documents").select("doc_id", T.partition_of(F.col("doc_id").cast("string"), 4).alias("part"))


@catalog.add(f"SELECT part, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars, round(100.0 * sum(c) / sum(sum(c)) OVER (), 4) AS share FROM (SELECT CAST({_MD5.format(c='CAST(doc_id AS VARCHAR)')} % 4 AS INT) AS part, length(text) AS c FROM documents) GROUP BY 1")
def partition_load(spark, d):
    from pyspark.sql import Window as W

    p = load(spark, d, "documents").select(T.partition_of(F.col("doc_id").cast("string"), 4).alias("part"), F.length("text").alias("c"))
    out = p.groupBy("part").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))
    return out.withColumn("share", F.round(F.col("chars") * 100.0 / F.sum("chars").over(W.partitionBy()), 4))


@catalog.add(sql("news", """SELECT unnest(['rows', 'unique_ids', 'dated', 'few_stubs', 'no_orphans']) AS "check", unnest([n > 0, n = ids, undated = 0, stubs <= n * 0.5, orphans = 0]) AS ok, unnest([n, n - ids, undated, stubs, orphans]) AS detail
 FROM (SELECT count(*) AS n, count(DISTINCT doc_key) AS ids, count(*) FILTER (WHERE published IS NULL) AS undated, count(*) FILTER (WHERE is_stub) AS stubs FROM docs), (SELECT count(*) AS orphans FROM (SELECT DISTINCT doc_key, symbol, published, year FROM stg) m ANTI JOIN docs USING (doc_key))""", stg=_STG, docs=_DOCS))
def quality_checks(spark, d):
    raw = raw_news(spark, d)
    return C.checks(C.documents(raw), C.document_mentions(raw))


#: Agents and relations: a supplier or customer, made a company, a person, a fund or a source by its number,
#: and an order's comment number turned into one of these words.
_VERBS = ["affects", "appoints", "hires", "outperforms", "includes", "raises price target on", "acquires", "cuts rates", "pays dividend to", "partners with", "supplies", "competes with", "imposes tariffs on", "sues", "lends to", "boosts", "criticizes", "launches", "manages", "sits near"]
_FORMS = ["{} Inc", "The {} Corp.", "John Smith", "Reuters", "{} revenues", "investors", "ProShares {}", "{} Holdings", "Wall Street", "the {} inc"]


def _form(number, name):
    return F.element_at(F.array(*[F.concat(*[p for part in f.split("{}") for p in (name, F.lit(part))][1:]) for f in _FORMS]), (number % len(_FORMS) + 1).cast("int"))


def _form_sql(number, name):
    return "[" + ", ".join(f"replace('{f}', '{{}}', {name})" for f in _FORMS) + f"][CAST({number} % {len(_FORMS)} + 1 AS INT)]"


def _relations(spark, d):
    """(a, b, rt, n): who does what to whom, from order lines; n lines say so."""
    li = load(spark, d, "lineitem")
    a = _form(F.col("l_suppkey"), F.concat(F.lit("Firm "), (F.col("l_suppkey") % 7).cast("string")))
    b = _form(F.col("l_partkey"), F.concat(F.lit("Firm "), (F.col("l_partkey") % 7).cast("string")))
    rt = F.element_at(F.array(*map(F.lit, _VERBS)), (F.col("l_orderkey") % len(_VERBS) + 1).cast("int"))
    return li.groupBy(a.alias("a"), b.alias("b"), rt.alias("rt")).agg(F.count("*").alias("n"))


_RELATIONS = f"""SELECT {_form_sql('l_suppkey', "'Firm ' || (l_suppkey % 7)")} AS a, {_form_sql('l_partkey', "'Firm ' || (l_partkey % 7)")} AS b,
 [{", ".join("'" + v + "'" for v in _VERBS)}][CAST(l_orderkey % {len(_VERBS)} + 1 AS INT)] AS rt, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"""


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _noise_sql():
    bare = lambda x: f"regexp_replace(lower(trim({x})), '^the ', '')"
    has = lambda x, rx: f"regexp_matches({x}, {_q(rx)})"
    metric = lambda x: f"({has(f'trim({x})', T.METRIC)} AND NOT {has(x, T.COMPANY)})"
    words = ", ".join(map(_q, T.GENERIC))
    return f"""CASE WHEN {bare('a')} = {bare('b')} THEN 'self_loop' WHEN {has('a', T.SOURCE)} OR {has('b', T.SOURCE)} THEN 'source'
 WHEN {metric('a')} OR {metric('b')} THEN 'metric' WHEN {bare('a')} IN ({words}) OR {bare('b')} IN ({words}) THEN 'generic'
 WHEN {has('trim(rt)', T.ORG_ALWAYS)} THEN 'orgchart' WHEN {has('trim(rt)', T.ORG_HIRES)} AND {has('trim(b)', T.PERSON)} AND NOT {has('b', T.NOT_PERSON)} THEN 'orgchart'
 WHEN {has('trim(rt)', T.COMPARE)} THEN 'comparison' WHEN {has('trim(rt)', T.MEMBER)} THEN 'membership'
 WHEN {has('trim(rt)', T.FUND_VERBS)} AND ({has('a', T.FUND)} OR {has('b', T.FUND)}) THEN 'membership' END"""


@catalog.add(f"SELECT a, b, rt, n, {_noise_sql()} AS noise FROM ({_RELATIONS})")
def noise_flags(spark, d):
    return _relations(spark, d).withColumn("noise", T.noise(F.col("a"), F.col("b"), F.col("rt")))


@catalog.add(f"SELECT a, b, rt, n FROM (SELECT *, {_noise_sql()} AS noise FROM ({_RELATIONS})) WHERE noise IS NULL OR noise NOT IN ('self_loop', 'source', 'metric', 'generic')")
def noise_filtered(spark, d):
    flagged = noise_flags(spark, d)
    return flagged.filter(F.col("noise").isNull() | ~F.col("noise").isin("self_loop", "source", "metric", "generic")).drop("noise")


@catalog.add("SELECT rel_class, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_pairs FROM (SELECT n, CASE " + " ".join(f"WHEN regexp_matches(lower(rt), {_q(rx)}) THEN '{c}'" for c, rx in T.REL_CLASSES) + f" ELSE 'other' END AS rel_class FROM ({_RELATIONS})) GROUP BY 1")
def rel_class(spark, d):
    told = _relations(spark, d)
    classes = told.select("rt").distinct().withColumn("rel_class", T.rel_class(F.col("rt")))  # distinct words only
    return told.join(classes, "rt").groupBy("rel_class").agg(F.sum("n").alias("n"), F.count("*").alias("n_pairs"))


_NAME = """regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(lower(raw), '\\(.*?\\)', ' ', 'g'), '[''’`]s\\b', '', 'g'), '&', ' and '), '.', ''), '[^a-z0-9]+', ' ', 'g')), '^(the )+(.)', '\\2'), '^the$', ''), '(.)( (%s))+$', '\\1')""" % "|".join(T.SUFFIXES)


@catalog.add(sql("nam", f"SELECT raw, {_NAME} AS key FROM nam"))
def name_norm(spark, d):
    return names(spark, d).select("raw", T.name_key(F.col("raw")).alias("key"))


@catalog.add(sql("nam", f"SELECT DISTINCT replace(upper({_NAME}), ' ', '_') AS slug FROM nam"))
def name_slug(spark, d):
    return names(spark, d).select(T.slug(F.col("raw")).alias("slug")).distinct()


@catalog.add(sql("nam", "SELECT raw, t AS ticker FROM (SELECT raw, regexp_extract(raw, '\\(\\s*(?:NYSE\\s*:\\s*)?([A-Z]{1,5}(?:[.\\-][A-Z])?)\\s*\\)', 1) AS t FROM nam) WHERE t IN ('SMA', 'RED', 'BLU', 'HOT')"))
def explicit_ticker(spark, d):
    hits = F.filter(T.explicit_tickers(F.col("raw")), lambda t: t.isin("SMA", "RED", "BLU", "HOT"))
    return names(spark, d).select("raw", F.get(hits, F.lit(0)).alias("ticker")).filter("ticker IS NOT NULL")


@catalog.add(sql("nam", f"SELECT DISTINCT a.key FROM k a JOIN (SELECT DISTINCT lower(trim(regexp_replace(s_name, '#0*', ' '))) AS key FROM supplier) b ON a.key = b.key", k=f"SELECT {_NAME} AS key FROM nam"))
def exact_name_join(spark, d):
    k = name_norm(spark, d).select("key").distinct()
    s = load(spark, d, "supplier").select(F.lower(F.trim(F.regexp_replace("s_name", "#0*", " "))).alias("key")).distinct()
    return k.join(s, "key", "left_semi")


@catalog.add("SELECT a, b, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rk FROM (SELECT a.n AS a, b.n AS b, jaro_winkler_similarity(a.n, b.n) AS score FROM l a JOIN r b ON split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1)) WHERE score >= 0.85) WHERE rk <= 3".join(["WITH l AS (SELECT DISTINCT p_name AS n FROM part), r AS (SELECT DISTINCT p_name || ' x' AS n FROM part) ", ""]))
def fuzzy_jaro_block(spark, d):
    p = load(spark, d, "part").select(F.col("p_name").alias("name"))
    return C.fuzzy_join(p, p.select(F.concat("name", F.lit(" x")).alias("name")), 0.85).withColumn("score", F.round("score", 5))


_CO = """SELECT a, b, k, round(k / na, 6) AS share, round(k / nb, 6) AS t_share, row_number() OVER (PARTITION BY a ORDER BY k DESC, b) AS rank FROM (
 SELECT o.symbol AS a, t.symbol AS b, count(*) AS k FROM m o JOIN m t ON o.doc_id = t.doc_id AND o.symbol <> t.symbol GROUP BY 1, 2) JOIN (SELECT symbol AS a, count(*) AS na FROM m GROUP BY 1) USING (a) JOIN (SELECT symbol AS b, count(*) AS nb FROM m GROUP BY 1) USING (b)"""
_M = "SELECT DISTINCT doc_id, symbol FROM men"


@catalog.add(sql("men", "SELECT * FROM co WHERE rank <= 5", m=_M, co=_CO))
def cooc_shares(spark, d):
    m = mentions(spark, d).select("doc_id", "symbol", F.col("symbol").alias("other"))
    return C.cooccurrence_shares(m, "symbol", "other").filter("rank <= 5").withColumns({c: F.round(c, 6) for c in ("share", "t_share")})


@catalog.add(sql("men", "SELECT b, arg_max(a, (k, -a)) AS alias FROM co WHERE k >= 3 GROUP BY 1", m=_M, co=_CO))
def alias_arg_max(spark, d):
    m = mentions(spark, d).select("doc_id", "symbol", F.col("symbol").alias("other"))
    return C.cooccurrence_shares(m, "symbol", "other").filter("k >= 3").groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("alias"))


@catalog.add("SELECT event_id, CASE WHEN TRY_CAST(x AS DOUBLE) IS NULL THEN NULL ELSE greatest(0, least(1, TRY_CAST(x AS DOUBLE))) END AS strength FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE CAST(value / 20 - 0.2 AS VARCHAR) END AS x FROM events)")
def clamp_strength(spark, d):
    x = F.when(F.col("event_id") % 5 == 0, "bad").otherwise((F.col("value") / 20 - 0.2).cast("string"))
    return load(spark, d, "events").select("event_id", T.clamp01(x).alias("strength"))


@catalog.add("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN strpos(reverse(h), ' ') > 0 AND 300 - strpos(reverse(h), ' ') > 270 THEN substr(h, 1, 300 - strpos(reverse(h), ' ')) ELSE h END AS prompt, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents)")
def prompt_truncate(spark, d):
    return load(spark, d, "documents").select("doc_id", T.cut_at_blank(F.col("text"), 300).alias("prompt"), T.token_estimate(F.col("text")).alias("tokens"))


@catalog.add("SELECT lang, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'the ')) AS literal, count(*) FILTER (WHERE list_bool_or(list_transform(['with', 'pour', 'para', 'sich'], lambda w: contains(lower(text), w)))) AS any_token FROM documents GROUP BY 1")
def text_presence(spark, d):
    t = F.lower("text")
    some = F.exists(F.array(*[F.lit(w) for w in ("with", "pour", "para", "sich")]), lambda w: F.contains(t, w))
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.contains(t, F.lit("the "))).alias("literal"), F.count_if(some).alias("any_token"))


@catalog.add("SELECT round(agreement, 6) AS agreement, round((agreement - c) / (1 - c), 6) AS kappa FROM (SELECT avg(CAST(quality = toxic AS INT)) AS agreement, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS c FROM labels)")
def cohen_kappa(spark, d):
    return I.kappa(load(spark, d, "labels"), "quality", "toxic").select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@catalog.add("SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_crosstab(spark, d):
    return load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@catalog.add()
def lpt_balance(spark, d):
    return R.balanced(load(spark, d, "supplier").select("s_name", F.round(F.abs("s_acctbal")).cast("long").alias("w")), "s_name", "w", 4)


@catalog.add(sql("ge", "SELECT node, n_events, degree FROM (SELECT node, count(*) AS n_events, count(DISTINCT other) AS degree FROM (SELECT src AS node, dst AS other FROM ge WHERE sign < 0 UNION ALL SELECT dst, src FROM ge WHERE sign < 0) GROUP BY 1)"))
def negative_node_stats(spark, d):
    from ..operators.graph import node_stats

    return node_stats(graph_events(spark, d).filter("sign < 0"))
