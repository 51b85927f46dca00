import csv
import gzip
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.sources import files, tables


def test_gzip_csv_with_line_breaks_quotes_and_other_columns(spark, tmp_path):
    path = tmp_path / "NOTEEVENTS.csv.gz"
    text = 'line one\nline "two", with comma\n'
    with gzip.open(path, "wt", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(["ROW_ID", "HADM_ID", "SUBJECT_ID", "CHARTDATE", "EXTRA", "CATEGORY", "ISERROR", "TEXT"])
        writer.writerow([1, 10, "", "2101-01-05", "x", "Discharge summary", "", text])
        writer.writerow([2, 11, 3, "2101-01-06", "x", "Nursing", 1, "short"])
    df = files.read_csv_table(spark, str(path), tables.NOTES)
    rows = {r["row_id"]: r for r in df.collect()}
    assert df.schema == tables.NOTES
    assert rows[1]["text"] == text and rows[1]["subject_id"] is None and rows[1]["iserror"] is None
    assert rows[2]["hadm_id"] == 11 and rows[2]["iserror"] == 1


def test_clinical_tables_from_parquet(spark, tmp_path):
    for name, schema in (
        ("admissions", tables.ADMISSIONS), ("diagnoses_icd", tables.DIAGNOSES),
        ("d_icd_diagnoses", tables.CODE_DICTIONARY), ("noteevents", tables.NOTES),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    loaded = tables.load_clinical_tables(spark, str(tmp_path))
    assert loaded.notes.columns == tables.NOTES.names and loaded.diagnoses.count() == 0


def test_splits_through_parquet_and_csv(spark, tmp_path):
    rows = [('a "quoted"\ntext', 1, "train"), ("b", 0, "val"), ("c", 0, "test")]
    df = spark.createDataFrame(rows, "text string, label int, split string")
    files.write_splits(df, f"{tmp_path}/p")
    assert sorted(map(tuple, files.read_splits(spark, f"{tmp_path}/p").collect())) == sorted(rows)
    one = files.read_splits(spark, f"{tmp_path}/p").filter(F.col("split") == "val")
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().toString()
    files.write_splits_csv(df, f"{tmp_path}/c")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
    assert sorted(map(tuple, files.read_splits_csv(spark, f"{tmp_path}/c", schema).collect())) == sorted(rows)


def test_vectors_and_terms(spark, tmp_path):
    files.write_parquet(spark.createDataFrame([("a", [1.0, 2.0])], "token string, vec array<float>"), f"{tmp_path}/w")
    assert files.load_word_vectors(spark, f"{tmp_path}/w").first()["vec"] == [1.0, 2.0]
    terms = files.load_terms(spark.createDataFrame([("heart",)], "term string"))
    assert tuple(terms.first()) == ("heart", "HP_heart")


def test_cohort_extracts_are_written_in_one_pass(spark, tmp_path):
    texts = ['a "quoted" word, a comma', "two\nlines", "", None, "plain " * 500]
    notes = spark.createDataFrame([(i, i + 10, i + 100, texts[i % 5]) for i in range(40)], "subject_id long, hadm_id long, row_id long, clean_text string")
    reads = spark.sparkContext.accumulator(0)

    def met(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    # what both cohorts join moves once
    moved = notes.mapInArrow(met, notes.schema)
    sides = [spark.createDataFrame([(i,) for i in range(40) if (i % 3 == 0) == side], "subject_id long") for side in (True, False)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        positive, negative = (moved.join(side, "subject_id").select(notes.columns) for side in sides)
        paths = files.write_cohort_csv(positive, negative, str(tmp_path / "cohort"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert reads.value == 40
    assert all(f.endswith(".csv.gz") for p in paths for f in os.listdir(p) if f.startswith("part-"))
    found = sorted(files.read_cohort_csv(spark, *paths).collect())
    plain = str(tmp_path / "plain")
    files.write_csv(notes, plain)
    expected = files.read_csv_table(spark, plain, files.COHORT_NOTES).withColumn("label", (F.col("subject_id") % 3 == 0).cast("int"))
    assert found == sorted(expected.collect()) and len(found) == 40
    paths = files.write_cohort_csv(notes.limit(0), negative, str(tmp_path / "one"))
    assert {r["label"] for r in files.read_cohort_csv(spark, *paths).collect()} == {0}
    assert files.read_cohort_csv(spark, *files.write_cohort_csv(notes.limit(0), notes.limit(0), str(tmp_path / "none"))).count() == 0
