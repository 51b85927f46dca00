"""The tables behind the exploration plots."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators.relations import label_name
from wardlens.operators.text import word_count


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label_name(F.col(label)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, word_count(F.col(text)).alias("word_count"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(bin, low, n): bins of equal width from the least value up.

    Rows fold to counts per value first, so what the least value is joined to is small.
    """
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    least = df.agg(F.min(column)).scalar()
    binned = per_value.withColumn("low_edge", least).withColumn(
        "bin", F.floor((F.col(column) - F.col("low_edge")) / width).cast("int")
    )
    return binned.groupBy("bin").agg(
        F.min(F.col("low_edge") + F.col("bin") * width).alias("low"), F.sum("n").alias("n")
    )


def word_count_histogram(df: DataFrame, key: str, text: str, width: float) -> DataFrame:
    return histogram(word_counts(df, key, text), "word_count", width)


def drop_iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows within ``k`` interquartile ranges of the quartiles, bounds included.

    Quartiles are interpolated, from the counts of the distinct values.
    """
    per_value = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_copies"))
    quartiles = F.percentile(column, F.lit([0.25, 0.75]), F.col("n_copies"))
    bounds = per_value.agg(quartiles.alias("q")).select(
        F.struct(
            (F.col("q")[0] - k * (F.col("q")[1] - F.col("q")[0])).alias("lo"),
            (F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("hi"),
        )
    ).scalar()
    return (
        df.withColumn("bounds", bounds)
        .filter((F.col(column) >= F.col("bounds.lo")) & (F.col(column) <= F.col("bounds.hi")))
        .drop("bounds")
    )


def heatmap(triples: DataFrame, key: str, width: int, rows: int = 64, columns: int = 64) -> DataFrame:
    """A feature matrix as a picture of at most ``rows`` x ``columns`` cells: (doc_bin, feature_bin, total, n).

    ``triples`` has (key, idx, value) with an integer key; ``width`` is the number of features.
    """
    return triples.groupBy(
        F.pmod(F.col(key), F.lit(rows)).cast("int").alias("doc_bin"),
        F.floor(F.col("idx") * columns / width).cast("int").alias("feature_bin"),
    ).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def compare_blocks(
    blocks: Mapping[str, DataFrame], key: str, width: int, rows: int = 64, columns: int = 64
) -> DataFrame:
    """The pictures of several feature blocks of the same width, by block name."""
    parts = [
        heatmap(triples, key, width, rows, columns).withColumn("block", F.lit(name)) for name, triples in blocks.items()
    ]
    return reduce(DataFrame.unionByName, parts)
