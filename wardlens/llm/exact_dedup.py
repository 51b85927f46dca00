"""Exact deduplication by a stateful stream.

Documents flow through a streaming aggregate whose state lives in RocksDB on disk and never expires. Under the digest of the
normalised text it keeps the stable identifier of the row that stays, the locator of its content (file and row) and the
number of rows met. Rows are folded before the shuffle, so a text held by a third of all rows is one row per task, and a
batch reads a bounded number of bytes. The stream commits its state to the shared folder: a lost executor costs the batch at
work, and a later run over more files goes on where the last one ended.

Rows that hit a digest are compared by their full bytes. A digest of different texts is resolved by the texts themselves.

Nulls: a null text is empty; a null id is smaller than any other. Of rows that share the largest id, the one with the largest
locator stays. Empty tables give no rows. Columns beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.shared import ascii_lower, scratch, stored

#: Bytes of files in one batch of the stream.
BATCH = 64 << 30
#: Bits of the filter that keeps texts met once from the shuffle; full, it only lets more of them through.
FILTER_BITS = 1 << 27
#: State on disk, with a bound on the memory of all stores of an executor.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores would otherwise reserve far more disk than they fill
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normal(text: Column) -> Column:
    """The form in which texts are compared: A-Z in lower case; null is empty."""
    return F.coalesce(ascii_lower(text), F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _rows(table: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, place, text, digest); the place is the file and the row in it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = table.select(F.col(id_col).alias("id"), place.alias("place"), normal(F.col(text_col)).alias("text"))
    return rows.withColumn("digest", digest(F.col("text")))


def ingest(
    spark: SparkSession, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *, batch: int = BATCH,
    digest: Callable[[Column], Column] = sha256,
) -> None:
    """Take all Parquet files at ``path`` (a file or a folder) that the state in ``folder`` has not seen into that state."""
    schema = spark.read.parquet(path).schema
    # as a pattern, so that a single file is a source as well
    path = path.rstrip("/")
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch)).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = _rows(source, id_col, text_col, digest)
    state = rows.groupBy("digest").agg(F.max(F.struct("id", "place")).alias("kept"), F.count(F.lit(1)).alias("n"))
    with _conf(spark, _STATE_CONF):
        stream = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
    stream.awaitTermination()


def retained(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, keep_id, place, n): the state as a table."""
    state = spark.read.format("statestore").load(folder)
    kept, n = (F.col("value")[name] for name in state.schema["value"].dataType.names)
    return state.select("key.digest", kept["id"].alias("keep_id"), kept["place"].alias("keep_place"), n.alias("n"))


def _may_repeat(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose digest is in ``groups``, and a few others: bits of hashed digests, FILTER_BITS / 8 bytes at most, are
    broadcast, so that texts met once are not shuffled."""
    at = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    bits = groups.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    placed = rows.withColumn("at", at).withColumn("bucket", F.bitmap_bucket_number("at")).withColumn("bit", F.bitmap_bit_position("at"))
    byte = F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))
    is_set = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    return placed.join(F.broadcast(bits), "bucket").filter(is_set).select(*rows.columns)


def deduplicate(
    spark: SparkSession, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of the rows at ``path`` by the state in ``folder``, which has met them."""
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    # only digests met more than once matter to other rows
    groups = stored(retained(spark, folder).filter("n > 1"), "groups")
    unequal = stored(
        _may_repeat(rows, groups).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .filter("low != high").select("digest"),
        "unequal",
    )
    if unequal.isEmpty():
        found = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text").join(groups, "digest", "left")
    else:
        apart = rows.join(unequal, "digest").groupBy("digest", "text").agg(F.max(F.struct("id", "place")).alias("k"), F.count(F.lit(1)).alias("n"))
        apart = stored(apart.select("digest", "text", "k.id", "k.place", "n").toDF("digest", "text", "keep_id", "keep_place", "n"), "apart")
        one = groups.join(unequal, "digest", "left_anti").withColumn("text", F.lit(None).cast("string")).unionByName(apart)
        r, g = rows.alias("r"), one.alias("g")
        same = (F.col("r.digest") == F.col("g.digest")) & (F.col("g.text").isNull() | (F.col("r.text") == F.col("g.text")))
        found = r.join(g, same, "left").select("r.*", "keep_id", "keep_place", "n").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    alone = F.col("n").isNull()
    return found.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("place") == F.col("keep_place"))).alias("kept"),
        "text_sha256",
    )


def digest(spark: SparkSession, path: str) -> DataFrame:
    """The columns of the query, with a state of its own below the shared folder."""
    folder = scratch(spark, "dedup-state")
    ingest(spark, path, folder)
    return deduplicate(spark, path, folder).withColumnRenamed("id", "doc_id")


SQL = """
with rows as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents
)
select
    doc_id,
    max(doc_id) over same as keep_id,
    count(*) over same as group_size,
    doc_id = max(doc_id) over same as kept,
    sha256(t) as text_sha256
from rows
window same as (partition by t)
"""
