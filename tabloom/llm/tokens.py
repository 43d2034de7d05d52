"""Token counts through a cache keyed by digests of content and tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ship, text_or_empty
from tabloom.llm.encoding import Counter, loaded, tokenizer_version
from tabloom.llm.textbatch import slices

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def _stored(spark, cache_dir: str, version: str) -> DataFrame:
    """The cache's counts for a tokenizer, one per digest even if two runs appended the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        table = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    else:
        table = spark.createDataFrame([], CACHE_SCHEMA)
    return table.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(tokenizer_path: str, version: str):
    """Batches of (digest, text) to batches of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(Counter, tokenizer_path)
        for batch in batches:
            digests, texts = batch.column(0), batch.column(1)
            for start, stop in slices(texts):
                counts = counter.counts(texts.slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [digests.slice(start, stop - start), pa.array([version] * len(counts)), pa.array(counts, pa.int64())],
                    names=["digest", "version", "n_tokens"])

    return run


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_dir: str, text_column: str = "text") -> str:
    """Encode the distinct texts that the cache lacks and append their counts; returns the version.

    Texts are reduced to one per digest before they are shuffled, so copies cost nothing more.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_version(tokenizer_path)
    distinct = docs.select(content_digest(text_column), text_or_empty(text_column).alias("_text")).groupBy("digest").agg(F.first("_text").alias("_text"))
    misses = distinct.join(_stored(spark, cache_dir, version), "digest", "left_anti")
    misses.mapInArrow(encode_counts(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_dir)
    return version


def content_digest(text_column: str):
    """SHA-256 of the normalised text. Byte-level counts depend on every byte, so all that is
    normalised is a null, which counts as empty."""
    return F.unhex(F.sha2(text_or_empty(text_column).cast("binary"), 256)).alias("digest")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_dir: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Counts are those of the tokenizer file for the whole text, without added special tokens;
    special strings inside a text are handled as the file says. Null and empty texts have no
    tokens, repeated rows are returned as often as they occur, null ids are kept, an empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    version = fill_cache(docs, tokenizer_path, cache_dir, text_column)
    rows = docs.select(F.col(id_column), F.octet_length(text_or_empty(text_column)).cast("long").alias("n_bytes"), content_digest(text_column))
    return (
        rows.join(_stored(spark, cache_dir, version), "digest")
        .select(F.col(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
