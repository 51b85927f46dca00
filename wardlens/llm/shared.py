"""Helpers of the training-data operators: scratch tables, text batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, else below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read and go on from it: the cut survives a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded_sample(df: DataFrame, key: str, limit: int, seed: str) -> DataFrame:
    """At most ``limit`` rows, the same ones on every run: those with the smallest hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(limit)


def labelled_ids(labels: DataFrame, label: str, *, folds: int, fold: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the labelled documents outside the held-out fold.

    Rows without a label do not count; of several labels of a document the largest does.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).dropna()
    return ids.filter(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.max("label").alias("label"))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, *, folds: int, fold: int, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of the labelled documents outside the held-out fold, or of at most ``limit`` of them.

    With a limit the ids are chosen from the narrow label table by hash, so that the texts are only scanned.
    """
    ids = labelled_ids(labels, label, folds=folds, fold=fold, id_col=id_col)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if limit is None:
        return texts.join(ids, "id")
    chosen = bounded_sample(ids, "id", limit, label)
    return texts.join(F.broadcast(chosen), "id")


def text_slices(texts: list[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` characters, so that work arrays stay small."""
    start = total = 0
    for at, text in enumerate(texts):
        size = len(text) if text else 0
        if at > start and total + size > limit:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large and small stars: (node, root), root the smallest id.

    Only nodes with an edge to another node are returned. Every step is an aggregate with map-side combine
    and a join in which one side is unique per node, so a hub is split like any other skewed key; edges are
    written after each round and nothing about them reaches the driver but a count and a checksum.
    """
    u, v = F.col("u"), F.col("v")
    pairs = edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
    star = stored(pairs.filter(u != v).distinct(), "edges")
    before = None
    while (now := _signature(star)) != before:
        before = now
        if not now[0]:
            break
        both = star.unionByName(star.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(u, F.col("m")).alias("m"))
        large = both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u, F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter(u != v).distinct()
        )
        star = stored(small, "edges")
    return star.select(u.alias("node"), v.alias("root"))
