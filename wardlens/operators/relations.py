"""Filters, joins, set operations, limits and aggregates over the relational tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalars import stable_hash, starts_with_code
from wardlens.session import materialize

# --- filters and projections -------------------------------------------------------------------------------

def valid_notes(notes: DataFrame) -> DataFrame:
    """Notes not marked as errors."""
    return notes.filter(F.col("iserror").isNull())


def filter_category(notes: DataFrame, category: str) -> DataFrame:
    return notes.filter(F.col("category") == category)


def with_label(df: DataFrame, label: int) -> DataFrame:
    return df.withColumn("label", F.lit(label))


def label_name(label: Column) -> Column:
    return F.when(label == 1, "positive").when(label == 0, "negative")


# --- joins -------------------------------------------------------------------------------------------------

def coded_notes(notes: DataFrame, diagnoses: DataFrame, condition: Column) -> DataFrame:
    """Valid notes of admissions with a matching code.

    The inner join of the reference multiplies notes by codes, and only distinct values of the note are used
    after it, so a semi join on the admission keeps the same subjects and dates without the fan-out. The
    subject comes from the note and must not be NULL. Repeated admissions on the right are harmless to a semi
    join, and left undistinguished they keep the join open to the runtime's splitting of a hot admission.
    """
    kept = valid_notes(notes).filter(F.col("subject_id").isNotNull())
    return kept.join(diagnoses.filter(condition).select("hadm_id"), "hadm_id", "left_semi")


def known_codes(diagnoses: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Diagnoses whose code is in the dictionary. Catalyst broadcasts the dictionary while it is small."""
    return diagnoses.join(dictionary, "icd9_code", "left_semi")


def join_grouped(left: DataFrame, grouped: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a relation grouped by the same keys, leaving hot keys of ``left`` open to splitting.

    A grouped relation is already partitioned by its keys, so the plain join adds no exchange on its side,
    and the runtime splits a hot key only where both sides have one. Joining on the keys written as text asks
    for that exchange; one narrow row per key moves.
    """
    parts = [F.col(k).cast("string") for k in keys]
    # each part with its length in front, so that no two key tuples read alike
    key = F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit("|"), p)])
    left = left.withColumn("join_key", key)
    grouped = grouped.withColumn("join_key", key).drop(*keys)
    if how == "left_semi":
        grouped = grouped.select("join_key")
    return left.join(grouped, "join_key", how).drop("join_key")


def restrict_subjects(df: DataFrame, subjects: DataFrame) -> DataFrame:
    return join_grouped(df, subjects.select("subject_id"), ["subject_id"], "left_semi")


def attach_notes(flags: DataFrame, notes: DataFrame) -> DataFrame:
    """Admissions with their notes."""
    return join_grouped(notes, flags, ["subject_id", "hadm_id"])


def join_labels(texts: DataFrame, labels: DataFrame, key: str = "subject_id") -> DataFrame:
    """Texts with their label where there is one."""
    return texts.join(labels, key, "left")


def merge_labels(texts: DataFrame, labels: DataFrame, key: str = "subject_id") -> DataFrame:
    """Texts with every distinct label of their key: two labels make two rows."""
    return texts.join(labels.select(key, "label").distinct(), key)


# --- codes per admission -----------------------------------------------------------------------------------

def admission_flags(
    diagnoses: DataFrame,
    prefix: str,
    order: Sequence[str],
    mode: str = "reference",
    with_list: bool = False,
) -> DataFrame:
    """One row per (subject_id, hadm_id): n_codes, detected flag and, on request, the ordered code list.

    ``mode='reference'``: the flag is 1 when a code with the prefix stands at the second position or later of
    the ordered list (a comma goes before it). ``mode='any'``: at any position. Neither needs the list: the
    number of matches and the first code decide, so the state per admission is a few values and admissions of
    any size aggregate on the map side.

    The list is one cell whatever the admission's size; the job fails where it exceeds what a cell can hold.
    """
    keys = ["subject_id", "hadm_id"]
    code = F.col("icd9_code")
    match = F.coalesce(starts_with_code(code, prefix), F.lit(False))
    first = F.min(F.when(code.isNotNull(), F.struct(*order, "icd9_code")))["icd9_code"]
    counts = [
        F.count(code).alias("n_codes"),
        F.count_if(match).alias("n_match"),
        first.alias("first_code"),
    ]
    if with_list:
        counts.append(_ordered_list(order).alias("icd9_code_list"))
    grouped = diagnoses.groupBy(*keys).agg(*counts)

    matches = F.col("n_match")
    if mode == "reference":
        matches = matches - F.when(F.col("first_code").startswith(prefix), 1).otherwise(0)
    elif mode != "any":
        raise ValueError(f"unknown mode {mode!r}")
    flagged = grouped.withColumn("detected_flag", F.when(matches > 0, 1).otherwise(0))
    return flagged.drop("n_match", "first_code")


def _ordered_list(order: Sequence[str]) -> Column:
    entries = F.collect_list(F.when(F.col("icd9_code").isNotNull(), F.struct(*order, "icd9_code")))
    text = F.array_join(F.transform(F.array_sort(entries), lambda e: e["icd9_code"]), ",")
    return F.when(F.count("icd9_code") > 0, text)


def code_lists(diagnoses: DataFrame, order: Sequence[str]) -> DataFrame:
    """The ordered code list of each admission: (subject_id, hadm_id, first_seq, icd9_code_list)."""
    coded = diagnoses.filter(F.col("icd9_code").isNotNull())
    return coded.groupBy("subject_id", "hadm_id").agg(
        F.min(order[0]).alias("first_seq"), _ordered_list(order).alias("icd9_code_list")
    )


def has_code(diagnoses: DataFrame, key: str, prefix: str) -> DataFrame:
    """Per key whether any code has the prefix; NULL when all its codes are NULL."""
    return diagnoses.groupBy(key).agg(F.bool_or(starts_with_code("icd9_code", prefix)).alias("has_code"))


# --- aggregates --------------------------------------------------------------------------------------------

def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_counts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Distinct counts of several columns in one row: output name -> column."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(name) for name, c in columns.items()])


def distinct_per_key(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Distinct values of a column per key, most first."""
    counted = df.groupBy(key).agg(F.count_distinct(F.col(column)).alias(name))
    return counted.orderBy(F.desc(name), F.asc(key))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def distinct_where(column: str, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, F.col(column)))


def sum_where(value: Column | int, condition: Column) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.sum(F.when(condition, value).otherwise(0))


def summary_stats(df: DataFrame, label: str, column: str) -> DataFrame:
    """One labelled row: rows, average, least and greatest value."""
    x = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("patients"),
        F.avg(x).alias(f"avg_{column}"),
        F.min(x).alias(f"min_{column}"),
        F.max(x).alias(f"max_{column}"),
    ).select(F.lit(label).alias("label"), "*")


def percentile_row(df: DataFrame, label: str, column: str, percents: Sequence[int], accuracy: int = 10_000) -> DataFrame:
    """One labelled row of percentiles p10, p25 ...; the sketch has a fixed size whatever the row count."""
    marks = F.percentile_approx(column, [p / 100 for p in percents], accuracy)
    found = df.agg(marks.alias("q"))
    return found.select(F.lit(label).alias("label"), *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(percents)])


def percentile_linear(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """Interpolated percentiles, from the counts of each distinct value so that copies of a value weigh nothing."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_copies"))
    return counted.agg(F.percentile(column, F.lit(list(fractions)), F.col("n_copies")).alias("q")).select(
        *[F.col("q")[i].alias(f"p{round(f * 100)}") for i, f in enumerate(fractions)]
    )


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def stack_summaries(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def union_cohorts(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.unionByName(negative)


# --- samples and top lists ---------------------------------------------------------------------------------

def sample_subjects(subjects: DataFrame, n: int = 10) -> DataFrame:
    """``n`` subjects, the same ones on every run."""
    return subjects.select("subject_id").orderBy(stable_hash("subject_id"), "subject_id").limit(n)


def hash_sample(df: DataFrame, key: str, ties: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in the order of the key's hash."""
    return df.orderBy(stable_hash(key), key, *ties).limit(n)


def top_rows(df: DataFrame, score: str, name: str, n: int) -> DataFrame:
    """The ``n`` highest scores, ties by name."""
    return df.orderBy(F.desc(score), F.asc(name)).limit(n)


def numbered(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in the order, from 0: places within range partitions plus the rows before.

    The ranges are written, as their bounds come from a sample and may differ in a second run. No task sees all rows;
    only a count per partition is summed in one. Rows that are equal in the order are placed in any way.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = materialize(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    placed = ranges.withColumn("_place", place).join(F.broadcast(before), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_place") - 1).cast("bigint")).drop("_part", "_place", "_before")
