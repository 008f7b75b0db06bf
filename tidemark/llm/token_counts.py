"""Token counts through a digest cache.

The count of a text depends on nothing but its bytes and the tokenizer, so a cache maps
(tokenizer version digest, content digest) to the count. Texts are joined to the cache by digest,
only distinct misses are encoded, and their counts are appended to the cache as a new batch. A
batch is read only once its ``_SUCCESS`` mark exists, so a lost job leaves nothing half-read.

Normalised content: null is the empty text; nothing else is altered, as any change of a text may
change its count. Repeated rows each get a row. An empty table gives an empty table. Other
columns of the input play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import buffers as B, store

CACHE_KEY = "tidemark.tokenCache"
_SCHEMA = "digest binary, n_tokens long"


def version_digest(tokenizer_path: str) -> str:
    """Digest of the tokenizer's file; another file never shares counts."""
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    from .pieces import encoder

    return lambda texts: list(encoder(path).encode(texts, ids=False))


def encode_counts(path: str):
    """mapInArrow function: (digest, text), equal digests next to each other, to (digest, n_tokens) once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.lean()
        count, last = _counter(path), None
        for b in batches:
            digests = [last, *b.column(0).to_pylist()]
            b = b.filter(pa.array([x != y for x, y in zip(digests, digests[1:])], pa.bool_()))
            last = digests[-1]
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark, root: str, version: str) -> DataFrame | None:
    """All complete batches of one tokenizer version, or None."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{version}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    done = [str(s.getPath()) for s in fs.listStatus(fs_path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema(_SCHEMA).parquet(*done) if done else None


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    ``cache`` is a folder that executors share; by default the session's ``tidemark.tokenCache``,
    or a new one for this call. ``over_limit`` is n_tokens > ``limit``.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    cache = cache or spark.conf.get(CACHE_KEY, None) or f"{store.shared_dir(spark)}/tidemark/token-cache-{uuid.uuid4().hex}"
    version = version_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = own.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    known = read_cache(spark, cache, version)
    texts = store.materialise(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "digests")
    misses = texts.select("digest", "doc_id")
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    # a null or repeated id can't stand for a text alone, so the digest is part of the key
    todo = own.withColumn("same", F.coalesce("doc_id", F.lit(-1))).join(
        misses.select(F.col("digest").alias("d"), F.coalesce("doc_id", F.lit(-1)).alias("s")), (F.col("same") == F.col("s")) & (F.col("digest") == F.col("d")), "left_semi").sortWithinPartitions("same", "digest")
    batch = f"{cache}/{version}/batch-{uuid.uuid4().hex}"
    todo.select("digest", "text").mapInArrow(encode_counts(tokenizer_path), _SCHEMA).write.parquet(batch)
    counts = read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    total = texts.agg(F.sum("rows")).first()[0] or 0
    counted = store.materialise(texts.join(counts, "digest").select("digest", "rows", "n_tokens"), "counted")
    found = store.join_facts(keyed, counted, ["digest"], "rows", total)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
