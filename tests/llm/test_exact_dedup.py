"""Stateful deduplication against a dictionary of texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wardlens.llm import exact_dedup as D
from wardlens.llm.queries import QUERIES


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            out[i, keep, len(ids), stays, sha] += 1
            stays = False
    return out


def found(df, id_col="doc_id"):
    return Counter(tuple(r) for r in df.select(id_col, "keep_id", "group_size", "kept", "text_sha256").collect())


ROWS = [
    (1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (None, "same"), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000),
    (9, "x" * 300_000), (None, None), (10, "alone"), (None, "lost"), (None, "LOST"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dedup") / "documents.parquet")
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as id", "'q' as place", "2 as digest", "3 as n")
    df.repartition(4).write.parquet(path)
    return path


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op12_stateful_dedup"](spark, sf_dir)) == plain(rows)


def test_nulls_ties_repeated_rows_and_other_columns(spark, folder):
    assert found(D.digest(spark, folder)) == plain(ROWS)


@pytest.mark.parametrize("bits", [0, 1])
def test_texts_of_one_digest_are_told_apart(spark, folder, tmp_path, bits):
    def weak(text):
        return F.substring(D.sha256(text), 1, bits)

    D.ingest(spark, folder, str(tmp_path), digest=weak)
    assert found(D.deduplicate(spark, folder, str(tmp_path), digest=weak), "id") == plain(ROWS)


def test_state_goes_on_over_batches_and_runs(spark, tmp_path):
    path, state = str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    first, second = [(k, f"T{k % 7}") for k in range(40)], [(k, f"t{k % 9}") for k in range(40, 90)]
    spark.createDataFrame(first, "doc_id long, text string").repartition(5).write.parquet(path)
    D.ingest(spark, path, state, batch=1)
    spark.createDataFrame(second, "doc_id long, text string").repartition(3).write.mode("append").parquet(path)
    D.ingest(spark, path, state, batch=1)
    assert found(D.deduplicate(spark, path, state), "id") == plain(first + second)
    table = {bytes(r.digest): (r.keep_id, r.n) for r in D.retained(spark, state).collect()}
    assert table[hashlib.sha256(b"t8").digest()] == (89, 6)
    # the locator leads to the content
    for r in D.retained(spark, state).limit(3).collect():
        at = spark.read.parquet(path).where((F.col("_metadata.file_path") == r.keep_place.file) & (F.col("_metadata.row_index") == r.keep_place.row)).first()
        assert hashlib.sha256(lower(at.text).encode()).digest() == bytes(r.digest) and at.doc_id == r.keep_id
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert not found(D.digest(spark, path))


def test_single_file(spark, tmp_path):
    path = tmp_path / "d"
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(str(path))
    file = next(str(f) for f in path.iterdir() if f.name.endswith(".parquet"))
    assert found(D.digest(spark, file)) == plain(ROWS)
