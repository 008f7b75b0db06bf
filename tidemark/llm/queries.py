"""The queries of this subpackage: opN_<name>(spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, html_text, line_dedup, minhash, packing, quality, suffix, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_hash_prefix_forest(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


OP3_SQL = """
WITH own AS (SELECT doc_id, text, coalesce('h' || source, 'n') AS host, row_number() OVER () AS r,
                    string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS total FROM own GROUP BY host),
lines AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM own),
common AS (SELECT l.host, l.line FROM lines l JOIN totals t ON l.host = t.host WHERE trim(l.line) <> ''
           GROUP BY l.host, l.line, t.total HAVING count(*) >= 5 AND count(*) / t.total > 0.02),
boiler AS (SELECT host, list(line) AS dropped FROM common GROUP BY host),
kept AS (SELECT o.doc_id, o.text, o.lines, b.dropped,
                list_filter(o.lines, lambda x: NOT list_contains(coalesce(b.dropped, []), x)) AS keep
         FROM own o LEFT JOIN boiler b ON o.host = b.host)
SELECT doc_id, CASE WHEN dropped IS NULL OR text IS NULL THEN text ELSE coalesce(array_to_string(keep, chr(10)), '') END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(keep), 0) AS BIGINT) AS n_dropped
FROM kept
"""


def op4_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_suffix_array_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


OP7_SQL = r"""
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT hp.page_id, hp.host, hp.path, r.h || r.p AS rule, r.verdict,
               row_number() OVER (PARTITION BY hp.page_id ORDER BY length(r.h) DESC NULLS LAST, length(r.p) DESC NULLS LAST) AS k
        FROM hp LEFT JOIN rules r ON (hp.host = r.h OR ends_with(hp.host, '.' || r.h)) AND starts_with(hp.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_near_duplicates(spark, sf_dir):
    return minhash.link_groups(table(spark, sf_dir, "documents"), k=4)


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_hash_prefix_forest, op2_best_fit_packing, op3_line_dedup, op4_decontamination, op5_html_extraction, op6_suffix_array_dedup, op7_url_filter, op8_quality, op9_near_duplicates, op10_token_counts)}
SQL = {"op3_line_dedup": OP3_SQL, "op7_url_filter": OP7_SQL}
