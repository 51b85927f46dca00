"""CSV extracts, split datasets, term lists, vector tables, result tables and fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.sources import tables

SPLITS = ("train", "val", "test")

# Tables of the raw dataset, by file name.
CSV_SCHEMAS = {
    "ADMISSIONS": tables.ADMISSIONS,
    "DIAGNOSES_ICD": tables.DIAGNOSES,
    "D_ICD_DIAGNOSES": tables.CODE_DICTIONARY,
    "NOTEEVENTS": tables.NOTES,
}

COHORT_NOTES = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("hadm_id", T.LongType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("clean_text", T.StringType()),
])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file or folder, plain or gzip, with quoted fields that hold line breaks and doubled quotes.

    Columns are matched by name whatever their order and letter case; columns the schema lacks are not kept.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    # the header alone fixes the order in which the file holds its columns
    header = spark.read.options(**{**options, "inferSchema": False}).csv(path).columns
    wanted = {field.name.lower(): field for field in schema}
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = spark.read.options(**options).schema(as_text).csv(path)
    by_lower = {name.lower(): name for name in header}
    return raw.select(*[
        F.col(f"`{by_lower[low]}`").cast(field.dataType).alias(field.name) for low, field in wanted.items()
    ])


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV that ``read_csv_table`` reads back."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def read_cohort_csv(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """The two cohort extracts as one labelled table."""
    from wardlens.operators.relations import union_cohorts, with_label

    return union_cohorts(
        with_label(read_csv_table(spark, positive, COHORT_NOTES), 1),
        with_label(read_csv_table(spark, negative, COHORT_NOTES), 0),
    )


def write_cohort_csv(positive: DataFrame, negative: DataFrame, path: str) -> tuple[str, str]:
    """The two cohort extracts as gzip CSV folders, written in one pass; returns their paths.

    In one plan the notes that both cohorts join are shuffled once and not once for each.
    """
    from wardlens.operators.relations import union_cohorts, with_label

    both = union_cohorts(with_label(positive, 1), with_label(negative, 0))
    options = {"header": True, "quote": '"', "escape": '"', "compression": "gzip"}
    paths = tuple(f"{path}/label={label}" for label in (1, 0))
    for extract in paths:
        # a cohort without notes is a header
        both.drop("label").limit(0).write.mode("overwrite").options(**options).csv(extract)
    both.write.mode("append").options(**options).partitionBy("label").csv(path)
    return paths


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One Parquet dataset, a folder per split, so that reading one split prunes the others."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_splits(spark: SparkSession, path: str, columns: tuple[str, ...] = ("text", "label")) -> DataFrame:
    return spark.read.parquet(path).select(*columns, "split")


def write_splits_csv(df: DataFrame, path: str, split: str = "split") -> None:
    """A CSV folder per split."""
    for name in SPLITS:
        write_csv(df.filter(F.col(split) == name).drop(split), f"{path}/{name}")


def read_splits_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    parts = [
        read_csv_table(spark, f"{path}/{name}", schema).withColumn("split", F.lit(name)) for name in SPLITS
    ]
    return reduce(DataFrame.unionByName, parts)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """The term dictionary with its feature names."""
    return terms.select(F.col(term).alias("term"), F.concat(F.lit("HP_"), F.col(term)).alias("feature"))


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A table of word vectors: token, vec."""
    return spark.read.parquet(path).select("token", F.col("vec").cast("array<float>").alias("vec"))


def load_doc_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Precomputed document vectors: doc_id, vec."""
    return spark.read.parquet(path).select("doc_id", F.col("vec").cast("array<double>").alias("vec"))


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)
