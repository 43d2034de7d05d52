"""A training corpus from raw documents: five stages, each written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import written
from tabloom.llm.decontaminate import without_contaminated
from tabloom.llm.neardup import without_near_duplicates
from tabloom.llm.packing import pack
from tabloom.llm.quality import fit_quality, quality_column
from tabloom.llm.substrings import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality classifier."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_column(docs, model).getField("kept"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id."""
    return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand earlier; n_chars follows the text.

    A document that loses no word keeps its text as it is; one that loses all has an empty text.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, carry=carry)
    kept = found.select("doc_id", F.col("kept_text").alias("text"), *[F.col("carried").getField(c).alias(c) for c in carry], F.col("n_removed").alias("_removed"))
    if "n_chars" in carry:
        kind = dict(docs.dtypes)["n_chars"]
        kept = kept.withColumn("n_chars", F.when(F.col("_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each result is written, so plans stay short and a lost
    executor costs a stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
