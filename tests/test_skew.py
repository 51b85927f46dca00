"""Hot keys: a third of the rows in one group is split, folded or cut, and the result stays whole."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlens.functions import scalars as S
from wardlens.operators import features as V
from wardlens.operators import relations as R
from wardlens.plans import cohorts as C
from wardlens.sources.tables import DIAGNOSES, NOTES, Tables


@pytest.fixture
def no_broadcast(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot_tables(spark):
    """Subject 1 holds a third of all diagnoses and notes, admission 1 a third of all notes."""
    ids = spark.range(0, 60_000, numPartitions=12)
    hot = F.col("id") % 3 == 0
    subject = F.when(hot, 1).otherwise(F.col("id") % 5000 + 2)
    dx = ids.select(
        subject.alias("subject_id"), F.when(hot, F.col("id") % 4000 + 1).otherwise(F.col("id") % 5000 + 100_000).alias("hadm_id"),
        (F.col("id") % 9).cast("int").alias("seq_num"),
        F.when(F.col("id") % 7 == 0, "4280").otherwise("001").alias("icd9_code"),
    )
    notes = ids.select(
        F.col("id").alias("row_id"), subject.alias("subject_id"),
        F.when(hot, 1).otherwise(F.col("id") % 5000 + 100_000).alias("hadm_id"),
        F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 20).cast("int")).alias("chartdate"),
        F.lit("Discharge summary").alias("category"), F.lit(None).cast("int").alias("iserror"),
        F.concat(F.lit("note "), F.col("id").cast("string")).alias("text"),
    )
    admissions = dx.select("subject_id", "hadm_id").distinct().withColumn("admittime", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    dictionary = spark.createDataFrame([("4280",), ("001",)], "icd9_code string")
    return Tables(
        admissions, dx.select(*DIAGNOSES.names), dictionary, notes.select(*NOTES.names)
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_admission_is_split_between_tasks(spark, hot_tables, no_broadcast):
    noted = R.coded_notes(hot_tables.notes, hot_tables.diagnoses, F.col("icd9_code").startswith("428"))
    plan = final_plan(noted.select("row_id"))
    assert "skew=true" in plan and "BroadcastHashJoin" not in plan


def test_hot_subject_is_split_between_tasks(spark, hot_tables, no_broadcast):
    subjects = C.negative_subjects(hot_tables, "999")
    plan = final_plan(R.restrict_subjects(hot_tables.diagnoses, subjects))
    assert "skew=true" in plan and "BroadcastHashJoin" not in plan


def test_notes_of_a_hot_admission_are_split_between_tasks(spark, hot_tables, no_broadcast):
    flags = R.admission_flags(hot_tables.diagnoses, "428", ["seq_num"])
    plan = final_plan(R.attach_notes(flags, hot_tables.notes).select("row_id"))
    assert "skew=true" in plan


def test_cohort_results_with_and_without_splitting_agree(spark, hot_tables, no_broadcast):
    split = sorted(map(tuple, C.record_days(hot_tables, "428").collect()))
    summary = C.cohort_progression_summary(hot_tables, "428").collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert sorted(map(tuple, C.record_days(hot_tables, "428").collect())) == split
        assert C.cohort_progression_summary(hot_tables, "428").collect() == summary
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_word_that_fills_the_corpus_is_counted_before_the_shuffle(spark):
    docs = spark.range(0, 300, numPartitions=6).repartition(6).select(
        (F.col("id") * 1).alias("doc_id"), F.concat(F.repeat(F.lit("hot "), 200), F.lit("cold"), F.col("id").cast("string")).alias("text")
    )
    counts = V.token_counts(docs, "doc_id", S.vector_tokens("text"))
    rows = {r["token"]: r["cf"] for r in V.top_vocab(counts, 3).collect()}
    assert rows["hot"] == 60_000
    # read from the bottom up: counted within the task, then exchanged
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(doc_id")
