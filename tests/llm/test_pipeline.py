"""The pipeline's stages keep their contract, and its rows equal a brute-force packing of what it keeps."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_operators import EDGE, brute_groups, check_packing


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = [name for name, _ in cp.STAGES]
    assert len(labels) == 5
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, folder)
        assert out.columns == cp.COLUMNS
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "near_duplicates":
            groups = brute_groups(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if c == i}
        docs = spark.createDataFrame([tuple(r) for r in out.collect()], out.schema)
    check_packing(cp.STAGES[-1][1](spark, docs, folder).collect(), [(r.doc_id, r.text) for r in docs.collect()], 1024)


@pytest.mark.parametrize("rows", [EDGE, []])
def test_stages_on_edge_rows(spark, tmp_path, rows):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    more = {c: F.lit(c) for c in ("row", "words", "key", "host", "score", "predicted", "n_lines", "digest", "item_id")}
    spark.createDataFrame(own, schema).withColumns(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, None), (None, 0, 1), (9, None, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, ""), (2, "one two three four five six")] if rows else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame([tuple(r) for r in out.collect()], out.schema)
        assert docs.columns == cp.COLUMNS
    kept = sorted(((r.doc_id or 0, r.text) for r in docs.collect()), key=repr)
    assert kept == sorted({(i or 0, t) for i, t in rows if i != 5}, key=repr)  # one of each copy; rows without words all stay
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_other_queries_do_not_need_it():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert 'coverage' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
