import math
from collections import Counter

from pyspark.sql import functions as F

from wardlens.operators import dataset as D

NOTES = "subject_id long, hadm_id long, row_id long, clean_text string, label int"


def test_documents_join_in_order_with_the_highest_label(spark):
    rows = [(1, 2, 5, "c", 0), (1, 1, 9, "b", 1), (1, 1, 3, "a", 0), (2, 7, 1, "z", 0)]
    df = spark.createDataFrame(rows, NOTES)
    found = {r["subject_id"]: (r["text"], r["label"], r["n_notes"]) for r in D.patient_documents(df).collect()}
    assert found == {1: ("abc", 1, 3), 2: ("z", 0, 1)}


def test_two_labels_make_two_rows(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", 0), (1, 1, 2, "b", 1)], NOTES)
    rows = D.patient_documents(df, sep=",", label_mode="distinct").collect()
    assert sorted((r["text"], r["label"]) for r in rows) == [("a,b", 0), ("a,b", 1)]


def test_a_subject_of_any_size_is_one_document(spark):
    rows = [(1, i // 7, 7 * i, f"<{i}>", int(i == 3)) for i in range(5000)]
    rows += [(2, 1, 5000, "x", 0), (2, 2, 5001, "y", 1), (None, 1, 1, "no subject", 1)]
    found = {r["subject_id"]: (r["n_notes"], r["text"], r["label"]) for r in D.patient_documents(spark.createDataFrame(rows, NOTES)).collect()}
    assert found == {1: (5000, "".join(f"<{i}>" for i in range(5000)), 1), 2: (2, "xy", 1)}


def test_split_is_stable_and_has_the_wanted_shares(spark):
    df = spark.range(20_000).select(F.col("id").alias("subject_id"))
    first = D.split_dataset(df, "subject_id")
    sizes = {r["split"]: r["n_rows"] for r in D.split_sizes(first).collect()}
    for name, share in {"train": 0.6, "val": 0.2, "test": 0.2}.items():
        assert abs(sizes[name] - 20_000 * share) < 3 * math.sqrt(20_000 * share * (1 - share))
    second = D.split_dataset(df.repartition(7), "subject_id")
    assert first.exceptAll(second).count() == 0
    assert Counter(r["split"] for r in D.fit_rows(first).select("split").collect()).keys() == {"train", "val"}


def test_longest_text_counts_whitespace_tokens(spark):
    df = spark.createDataFrame([("a b  c",), ("",)], "text string")
    assert D.max_tokens(df).first()[0] == 3
