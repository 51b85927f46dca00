"""From raw documents to packed sequences: language, near-copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns rows with the columns of
``documents``; the last one returns the packed pieces. Nulls, empty texts, repeated rows and empty tables pass through
as the operators define; rows that share a doc_id stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import decontaminate, langid, packing, simhash, suffix
from wardlens.llm.queries import TOKENIZER, tokenizer_path
from wardlens.llm.shared import stored
from wardlens.session import prepare


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with no language in most of their words, go."""
    return langid.accepted(docs, langid.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 0.8 of their five-word shingles the one with the smallest id stays; rows without an id stay."""
    groups = simhash.similar_copies(docs)
    gone = groups.filter(F.col("id") != F.col("component")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte in a 200-byte string that occurs more than once; ``n_chars`` follows."""
    kept = suffix.kept_texts(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.filter((F.col("n_hit") > 0) & F.col("doc_id").isNotNull()).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in a sequence."""
    return packing.digest(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

#: Language and packing have no counterpart in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again as the next one's input."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
