import hashlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlens.operators import relations as R
from wardlens.plans import cohorts as C
from wardlens.sources.tables import NOTES, Tables

DX = "subject_id long, hadm_id long, seq_num int, icd9_code string"


def flags(df, **kw):
    return {r["hadm_id"]: r["detected_flag"] for r in R.admission_flags(df, "428", ["seq_num"], **kw).collect()}


@pytest.fixture
def dx(spark):
    return spark.createDataFrame(
        [
            (1, 10, 1, "4280"), (1, 10, 2, "001"),        # match stands first only
            (1, 11, 1, "001"), (1, 11, 2, "4281"),        # match stands second
            (2, 12, 1, "4280"), (2, 12, 2, "4289"),       # first and second
            (2, 13, 1, None), (2, 13, 2, "4280"),         # NULL does not count as a position
            (3, 14, 1, None),                             # only NULL
            (3, 15, 1, "001"),
        ],
        DX,
    )


def test_flag_misses_a_match_in_first_position(dx):
    assert flags(dx) == {10: 0, 11: 1, 12: 1, 13: 0, 14: 0, 15: 0}


def test_flag_at_any_position(dx):
    assert flags(dx, mode="any") == {10: 1, 11: 1, 12: 1, 13: 1, 14: 0, 15: 0}


def test_flag_equals_like_on_the_list(dx):
    found = R.admission_flags(dx, "428", ["seq_num"], with_list=True)
    for row in found.collect():
        assert row["detected_flag"] == int(",428" in (row["icd9_code_list"] or ""))


def test_all_null_codes_are_neither_positive_nor_negative(dx):
    found = {r["hadm_id"]: r["has_code"] for r in R.has_code(dx, "hadm_id", "428").collect()}
    assert found[14] is None and found[15] is False and found[13] is True


def test_an_admission_of_any_size_is_one_list(spark):
    n = 100_001
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("subject_id"), F.lit(10).cast("long").alias("hadm_id"),
        (F.lit(n - 1) - F.col("id")).cast("int").alias("seq_num"), F.concat(F.lit("c"), F.col("id")).alias("icd9_code"),
    )
    df = rows.unionByName(spark.createDataFrame([(2, 20, 1, "4280"), (2, 20, 2, "x"), (1, 10, n, "4281"), (1, 10, 3, None)], DX))
    whole = ",".join([f"c{i}" for i in reversed(range(n))] + ["4281"])
    lists = {r["hadm_id"]: (r["first_seq"], r["icd9_code_list"]) for r in R.code_lists(df, ["seq_num"]).collect()}
    assert lists == {10: (0, whole), 20: (1, "4280,x")}
    found = {r["hadm_id"]: r for r in R.admission_flags(df, "428", ["seq_num"], with_list=True).collect()}
    assert (found[10]["detected_flag"], found[10]["icd9_code_list"], found[10]["n_codes"]) == (1, whole, n + 1)
    assert (found[20]["detected_flag"], found[20]["icd9_code_list"]) == (0, "4280,x")


@pytest.fixture
def tables(spark, dx):
    notes = spark.createDataFrame(
        [
            (1, 1, 10, date(2020, 1, 1), "Discharge summary", None, "A [**x**] b, c [**y**] d"),
            (2, 1, 10, date(2020, 1, 2), "Nursing", None, "n"),
            (3, None, 11, date(2020, 1, 1), "Discharge summary", None, "no subject"),
            (4, 2, 12, date(2020, 1, 1), "Discharge summary", 1, "error"),
            (5, 3, 15, date(2020, 1, 1), "Discharge summary", None, "E\nF"),
        ],
        NOTES,
    )
    admissions = dx.select("subject_id", "hadm_id").distinct().withColumn("admittime", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    dictionary = spark.createDataFrame([("4280",), ("4281",), ("4289",), ("001",)], "icd9_code string")
    return Tables(admissions, dx, dictionary, notes)


def test_positive_subjects_need_a_valid_note_with_a_subject(tables):
    assert [r[0] for r in C.positive_subjects(tables, "428").collect()] == [1]


def test_negative_subjects(tables):
    assert [r[0] for r in C.negative_subjects(tables, "428").collect()] == [3]


def test_positive_notes_keep_admissions_before_detection(tables):
    rows = C.positive_notes(tables, "428").collect()
    assert [(r["hadm_id"], r["clean_text"], r["icd9_code_list"]) for r in rows] == [(10, "a  d", "4280,001")]


def test_one_admission_can_count_for_both_groups(tables):
    days = {r["subject_id"]: r for r in C.record_days(tables, "428").collect()}
    assert days[1]["is_positive"] and days[1]["is_negative"] and days[1]["positive_days"] == 2
    assert not days[3]["is_positive"] and days[3]["negative_days"] == 1


def test_negative_notes_carry_code_list_and_hash(tables):
    row = C.negative_notes(tables, "428").first()
    assert row["hashing"] == hashlib.md5(b"3").hexdigest() and row["icd9_code_list"] == "001"


def test_join_grouped_tells_keys_apart(spark):
    left = spark.createDataFrame([("x|", "y"), ("x", "|y")], "a string, b string")
    grouped = spark.createDataFrame([("x", "|y", 1)], "a string, b string, n int")
    assert [tuple(r) for r in R.join_grouped(left, grouped, ["a", "b"]).collect()] == [("x", "|y", 1)]
