"""One document per subject, and the train/validation/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import hash_bucket, words

def patient_documents(
    notes: DataFrame,
    sep: str = "",
    label_mode: str | None = "max",
    key: str = "subject_id",
    order: Sequence[str] = ("hadm_id", "row_id"),
    text: str = "clean_text",
) -> DataFrame:
    """Texts of each key joined in order, with its label: (key, first_<order[0]>, n_notes, text, label).

    ``label_mode='max'`` gives the highest label, ``'distinct'`` a row per distinct label, None no label. Notes
    without a key belong to no document. A key is one document whatever its size; the job fails where a text
    exceeds what a cell can hold. Where no whole text is needed, work on the note rows instead.
    """
    first = order[0]
    entries = F.array_sort(F.collect_list(F.struct(*order, text)))
    label = {"max": [F.max("label").alias("label")], "distinct": [F.collect_set("label").alias("label")], None: []}[label_mode]
    result = notes.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(first).alias(f"first_{first}"),
        F.count(F.lit(1)).alias("n_notes"),
        F.array_join(F.transform(entries, lambda e: e[text]), sep).alias("text"),
        *label,
    )
    if label_mode == "distinct":
        result = result.withColumn("label", F.explode("label"))
    return result


def max_label(notes: DataFrame, key: str = "subject_id") -> DataFrame:
    """The highest label of each key."""
    return notes.groupBy(key).agg(F.max("label").alias("label"))


def split_name(key: Column | str, fractions: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42) -> Column:
    """train, val or test by the key's hash: the same under any partitioning, and no pass over the data."""
    bucket = hash_bucket(key, seed)
    train = round(fractions[0] * 1000)
    val = round((fractions[0] + fractions[1]) * 1000)
    return F.when(bucket < train, "train").when(bucket < val, "val").otherwise("test")


def split_dataset(
    df: DataFrame, key: str, fractions: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 42
) -> DataFrame:
    return df.withColumn("split", split_name(key, fractions, seed))


def fit_rows(df: DataFrame, fit_splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """The rows vocabularies and topics are fitted on."""
    return df.filter(F.col("split").isin(list(fit_splits)))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def max_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """The longest text, in whitespace tokens."""
    return df.agg(F.max(F.size(words(text))).alias("max_tokens"))
