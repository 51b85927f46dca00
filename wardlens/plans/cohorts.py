"""The cohort programs: exploration counts, record windows, progression summary, positive and negative notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.scalars import stable_hash, starts_with_code, strip_commas, strip_redactions
from wardlens.operators import relations as R
from wardlens.sources.tables import Tables

NOTE_CATEGORY = "Discharge summary"
PERCENTS = (10, 25, 50, 75, 90, 100)
NEGATIVE_LIMIT = 4000


# --- exploration -------------------------------------------------------------------------------------------

def admission_counts(t: Tables) -> DataFrame:
    return R.distinct_counts(t.admissions, {"subjects": "subject_id", "admissions": "hadm_id"})


def diagnosis_counts(t: Tables) -> DataFrame:
    return t.diagnoses.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("subject_id").alias("subjects"),
        F.count_distinct("hadm_id").alias("admissions"),
    )


def admissions_per_subject(t: Tables) -> DataFrame:
    return R.distinct_per_key(t.admissions, "subject_id", "hadm_id", "distinct_admissions")


def codes_per_subject(t: Tables) -> DataFrame:
    return R.distinct_per_key(t.diagnoses, "subject_id", "icd9_code", "distinct_codes")


def prefix_prevalence(t: Tables, prefix: str) -> DataFrame:
    """Diagnoses, subjects and admissions with the prefix, and the totals.

    Admissions are folded to one row first: an admission belongs to one subject, so its count and its two
    flags are all the distinct counts need, and the Expand over four distinct columns is avoided.
    """
    hit = F.coalesce(starts_with_code("icd9_code", prefix), F.lit(False))
    per_admission = t.diagnoses.groupBy("subject_id", "hadm_id").agg(F.count_if(hit).alias("hits"))
    per_subject = per_admission.groupBy("subject_id").agg(F.sum("hits").alias("hits"))
    subjects = per_subject.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("prefix_diagnoses"),
        F.count_if((F.col("hits") > 0) & F.col("subject_id").isNotNull()).alias("prefix_subjects"),
        F.count("subject_id").alias("total_subjects"),
    )
    per_hadm = per_admission.groupBy("hadm_id").agg(F.sum("hits").alias("hits"))
    admissions = per_hadm.agg(
        F.count_if((F.col("hits") > 0) & F.col("hadm_id").isNotNull()).alias("prefix_admissions"),
        F.count("hadm_id").alias("total_admissions"),
    )
    pair = admissions.select(F.struct("prefix_admissions", "total_admissions")).scalar()
    return subjects.withColumn("pair", pair).select(
        "prefix_diagnoses",
        "prefix_subjects",
        F.col("pair.prefix_admissions").alias("prefix_admissions"),
        "total_subjects",
        F.col("pair.total_admissions").alias("total_admissions"),
    )


# --- days of record ----------------------------------------------------------------------------------------

def record_days(t: Tables, prefix: str) -> DataFrame:
    """Per subject the number of distinct note dates in admissions with and without a prefix code.

    ``positive_days`` counts dates of admissions with a code that has the prefix, ``negative_days`` dates of
    admissions with a code that has not; an admission can be both. One pass over the diagnoses and one over
    the notes serve both groups.
    """
    hit = starts_with_code("icd9_code", prefix)
    kinds = t.diagnoses.groupBy("hadm_id").agg(
        F.bool_or(hit).alias("has_prefix"), F.bool_or(~hit).alias("has_other")
    )
    # distinct dates first: an admission then has as many rows as days, however many notes it holds
    kept = (
        R.valid_notes(t.notes)
        .filter(F.col("subject_id").isNotNull())
        .select("subject_id", "hadm_id", "chartdate")
        .distinct()
    )
    per_date = (
        kept.join(kinds, "hadm_id")
        .groupBy("subject_id", "chartdate")
        .agg(F.bool_or("has_prefix").alias("has_prefix"), F.bool_or("has_other").alias("has_other"))
    )
    dated = F.col("chartdate").isNotNull()
    return per_date.groupBy("subject_id").agg(
        F.bool_or("has_prefix").alias("is_positive"),
        F.bool_or("has_other").alias("is_negative"),
        F.count_if(F.col("has_prefix") & dated).alias("positive_days"),
        F.count_if(F.col("has_other") & dated).alias("negative_days"),
    )


def _days_of(days: DataFrame, kind: str) -> DataFrame:
    return days.filter(F.col(f"is_{kind}")).select("subject_id", F.col(f"{kind}_days").alias("num_days"))


def window_summary(t: Tables, prefix: str) -> DataFrame:
    days = record_days(t, prefix)
    return R.stack_summaries([
        R.summary_stats(_days_of(days, "positive"), "Positive", "num_days"),
        R.summary_stats(_days_of(days, "negative"), "Negative", "num_days"),
    ])


def window_percentiles(t: Tables, prefix: str, percents: Sequence[int] = PERCENTS) -> DataFrame:
    days = record_days(t, prefix)
    return R.stack_summaries([
        R.percentile_row(_days_of(days, "positive"), "Positive", "num_days", percents),
        R.percentile_row(_days_of(days, "negative"), "Negative", "num_days", percents),
    ])


# --- cohorts -----------------------------------------------------------------------------------------------

def positive_subjects(t: Tables, prefix: str) -> DataFrame:
    """Subjects with a valid note in an admission that has a code with the prefix."""
    noted = R.coded_notes(t.notes, t.diagnoses, starts_with_code("icd9_code", prefix))
    return noted.select("subject_id").distinct()


def negative_subjects(t: Tables, prefix: str) -> DataFrame:
    """Subjects none of whose note-bearing admissions has a code with the prefix."""
    noted = (
        R.valid_notes(t.notes)
        .filter(F.col("subject_id").isNotNull())
        .select("subject_id", "hadm_id")
        .distinct()
        .join(R.has_code(t.diagnoses, "hadm_id", prefix), "hadm_id")
    )
    return noted.groupBy("subject_id").agg(F.bool_or("has_code").alias("has_code")).filter(~F.col("has_code")).select("subject_id")


def cohort_admissions(
    t: Tables, subjects: DataFrame, prefix: str, mode: str = "reference", with_list: bool = False
) -> DataFrame:
    """Admissions of the subjects with their known codes: flag, number of codes and, on request, the list.

    Diagnoses are folded to one row per admission before they meet the admissions table.
    """
    codes = R.restrict_subjects(R.known_codes(t.diagnoses, t.dictionary), subjects)
    flags = R.admission_flags(codes, prefix, t.code_order, mode, with_list)
    return t.admissions.join(flags, ["subject_id", "hadm_id"])


def admission_flags_sample(t: Tables, prefix: str, n: int = 10, mode: str = "reference") -> DataFrame:
    """The admissions of a few positive subjects with code list and flag."""
    subjects = R.sample_subjects(positive_subjects(t, prefix), n)
    return cohort_admissions(t, subjects, prefix, mode, with_list=True).orderBy("subject_id", "admittime", "hadm_id")


def progression_per_subject(t: Tables, prefix: str, mode: str = "reference") -> DataFrame:
    """Per positive subject with notes: admissions, flagged admissions, and notes by flag.

    Notes are counted per admission before the join, so the two per-subject aggregates become one.
    """
    admissions = cohort_admissions(t, positive_subjects(t, prefix), prefix, mode)
    noted = t.notes.groupBy("subject_id", "hadm_id").agg(F.count(F.lit(1)).alias("n_notes"))
    flag = F.col("detected_flag")
    return (
        admissions.join(noted, ["subject_id", "hadm_id"], "left")
        .groupBy("subject_id")
        .agg(
            F.count(F.lit(1)).alias("total_admit"),
            F.sum(flag).alias("flagged_admit"),
            F.count("n_notes").alias("noted_admit"),
            R.sum_where(F.coalesce("n_notes", F.lit(0)), flag == 0).alias("notes_unflagged"),
            R.sum_where(F.coalesce("n_notes", F.lit(0)), flag == 1).alias("notes_flagged"),
        )
        .filter(F.col("noted_admit") > 0)
        .drop("noted_admit")
    )


def cohort_progression_summary(t: Tables, prefix: str, mode: str = "reference") -> DataFrame:
    """Three rows: subjects with some unflagged admission, with all admissions flagged, and all subjects.

    One conditional aggregate over the per-subject table, unpivoted, instead of three passes over it.
    """
    per_subject = progression_per_subject(t, prefix, mode)
    total, flagged = F.col("total_admit"), F.col("flagged_admit")
    rows = [
        ("0_not_detected_in_early_admission", total > flagged),
        ("1_detected_since_first_admission", total == flagged),
        ("2_total", F.lit(True)),
    ]
    measures = {
        "avg_admit_unflagged": total - flagged,
        "avg_total_admit": total,
        "avg_notes_unflagged": F.col("notes_unflagged"),
        "avg_notes_flagged": F.col("notes_flagged"),
    }
    wide = per_subject.agg(*[
        F.struct(
            F.lit(name).alias("category"),
            F.count_if(condition).alias("cnt"),
            *[F.avg(F.when(condition, value)).alias(m) for m, value in measures.items()],
        ).alias(f"row{i}")
        for i, (name, condition) in enumerate(rows)
    ])
    stacked = F.array(*[F.col(f"row{i}") for i in range(len(rows))])
    return wide.select(F.inline(stacked)).orderBy("category")


def clean_note(text: str = "text") -> F.Column:
    """Lower case, redaction marks off, commas off."""
    return strip_commas(strip_redactions(F.lower(F.col(text))))


def _notes_of(admissions: DataFrame, t: Tables, category: str) -> DataFrame:
    notes = R.filter_category(t.notes, category).select("subject_id", "hadm_id", "row_id", "category", "text")
    return R.attach_notes(admissions, notes).withColumn("clean_text", clean_note())


def positive_notes(
    t: Tables, prefix: str, category: str = NOTE_CATEGORY, mode: str = "reference", with_list: bool = True
) -> DataFrame:
    """Cleaned notes of positive subjects' admissions before detection."""
    admissions = cohort_admissions(t, positive_subjects(t, prefix), prefix, mode, with_list)
    return _notes_of(admissions.filter(F.col("detected_flag") == 0), t, category)


def negative_notes(
    t: Tables,
    prefix: str,
    category: str = NOTE_CATEGORY,
    mode: str = "reference",
    limit: int | None = NEGATIVE_LIMIT,
    with_list: bool = True,
) -> DataFrame:
    """Cleaned notes of negative subjects with the subject's hash; ``limit`` admissions in its order, None for all."""
    kept = cohort_admissions(t, negative_subjects(t, prefix), prefix, mode, with_list).filter(F.col("detected_flag") == 0)
    if limit is not None:
        kept = R.hash_sample(kept, "subject_id", ["hadm_id"], limit)
    return _notes_of(kept.withColumn("hashing", stable_hash("subject_id")), t, category)


def cohort_notes(t: Tables, prefix: str, limit: int | None = None) -> DataFrame:
    """Positive and negative notes with their label; all negative admissions unless a limit is given."""
    columns = ["subject_id", "hadm_id", "row_id", "clean_text", "label"]
    return R.union_cohorts(
        R.with_label(positive_notes(t, prefix, with_list=False), 1).select(*columns),
        R.with_label(negative_notes(t, prefix, limit=limit, with_list=False), 0).select(*columns),
    )
