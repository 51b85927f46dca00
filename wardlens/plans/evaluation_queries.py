"""Evaluation and exploration queries, and the files a dataset travels in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions import scalars as S
from wardlens.operators import dataset as D
from wardlens.operators import eda as G
from wardlens.operators import evaluate as E
from wardlens.operators import features as V
from wardlens.plans import cohorts as C
from wardlens.plans import corpus as K
from wardlens.plans.cohort_queries import COHORT_NOTES_SQL, PREFIX
from wardlens.plans.feature_queries import FUZZY_SQL, hits_sql, r6
from wardlens.plans.registry import query, with_ctes, with_views
from wardlens.plans.text_queries import BUCKET_SQL, PATIENT_SQL, SPLIT_SQL, cohort
from wardlens.session import scratch_path
from wardlens.sources import files
from wardlens.sources.tables import NOTES, load_tables, read_table

# --- evaluation --------------------------------------------------------------------------------------------

PREDICTIONS_SQL = f"""
predictions as (
  select doc_id, quality as label, 1 - toxic as prediction, {BUCKET_SQL.format('doc_id')} / 1000.0::double as score from labels)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "labels").select(
        "doc_id",
        F.col("quality").alias("label"),
        (1 - F.col("toxic")).alias("prediction"),
        (S.hash_bucket("doc_id", 42) / 1000.0).alias("score"),
    )


CELLS_SQL = """
cells as (
  select count(*) filter (label = 0 and prediction = 0) as tn, count(*) filter (label = 0 and prediction = 1) as fp,
         count(*) filter (label = 1 and prediction = 0) as fn, count(*) filter (label = 1 and prediction = 1) as tp
  from predictions)"""


@query(
    "hardened_scores", "E1",
    with_ctes(PREDICTIONS_SQL) + """
select doc_id, round(score, 6) as score, case when score > 0.5 then 1 else 0 end as hard from predictions""",
)
def hardened_scores(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).select("doc_id", r6("score").alias("score"), E.harden(F.col("score")).alias("hard"))


@query(
    "confusion_matrix", "E2",
    with_ctes(PREDICTIONS_SQL, CELLS_SQL) + """
select 0 as label, 0 as prediction, tn as n from cells union all select 0, 1, fp from cells
union all select 1, 0, fn from cells union all select 1, 1, tp from cells""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(predictions(spark, sf))


@query(
    "accuracy", "E3",
    with_ctes(PREDICTIONS_SQL) + """
select round(avg(case when label = prediction then 1.0::double else 0 end), 6) as accuracy from predictions""",
)
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return E.accuracy(predictions(spark, sf)).select(r6("accuracy").alias("accuracy"))


@query("f1_score", "E4", with_ctes(PREDICTIONS_SQL, CELLS_SQL) + "select round(2 * tp / (2 * tp + fp + fn), 6) as f1 from cells")
def f1_score(spark: SparkSession, sf: str) -> DataFrame:
    return E.f1(predictions(spark, sf)).select(r6("f1").alias("f1"))


@query(
    "classification_report", "E5",
    with_ctes(
        PREDICTIONS_SQL,
        """
classes as (
  select c.label as y,
         count(*) filter (p.label = c.label and p.prediction = c.label) as hit,
         count(*) filter (p.prediction = c.label) as said, count(*) filter (p.label = c.label) as support
  from predictions p cross join (select unnest([0, 1]) as label) c group by 1)""",
        """
rated as (
  select y, coalesce(hit / nullif(said, 0), 0) as p, coalesce(hit / nullif(support, 0), 0) as r,
         coalesce(2 * hit / nullif(said + support, 0), 0) as f, support, hit from classes)""",
    ) + """
select class, round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6) as f1, support from (
select case y when 0 then 'negative' else 'positive' end as class, p as "precision", r as recall, f as f1, support from rated
union all
select 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), cast(sum(support) as bigint) from rated
union all
select 'macro avg', avg(p), avg(r), avg(f), cast(sum(support) as bigint) from rated
union all
select 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support),
       cast(sum(support) as bigint) from rated)""",
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    report = E.classification_report(predictions(spark, sf))
    return report.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "auc_of_hard_labels", "E6",
    with_ctes(PREDICTIONS_SQL, CELLS_SQL) + "select round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as auc from cells",
)
def auc_of_hard_labels(spark: SparkSession, sf: str) -> DataFrame:
    return E.auc(predictions(spark, sf), "hard").select(r6("auc").alias("auc"))


@query(
    "auc_with_swapped_arguments", "E7",
    with_ctes(PREDICTIONS_SQL, CELLS_SQL) + "select round((tp / (tp + fp) + tn / (tn + fn)) / 2, 6) as auc from cells",
)
def auc_with_swapped_arguments(spark: SparkSession, sf: str) -> DataFrame:
    return E.auc(predictions(spark, sf), "swapped").select(r6("auc").alias("auc"))


@query(
    "auc_of_scores", "E6",
    with_ctes(PREDICTIONS_SQL) + """
select round((sum(case when label = 1 then r else 0 end) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n)), 6) as auc
from (
  select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as r,
         count(*) filter (label = 1) over () as p, count(*) filter (label = 0) over () as n
  from predictions)""",
)
def auc_of_scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.auc(predictions(spark, sf), "score").select(r6("auc").alias("auc"))


# --- exploration -------------------------------------------------------------------------------------------

@query(
    "label_distribution", "G1 P9",
    """
select case quality when 1 then 'positive' when 0 then 'negative' end as label, count(*) as n from labels group by 1""",
)
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return G.label_distribution(read_table(spark, sf, "labels"), "quality")


@query(
    "patient_label_distribution", "G1 D1",
    with_views(*COHORT_NOTES_SQL, PATIENT_SQL) + """
select case label when 1 then 'positive' when 0 then 'negative' end as label, count(*) as n from patient_documents group by 1""",
)
def patient_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return G.label_distribution(D.max_label(cohort(spark, sf)))


WORDS_SQL = f"word_counts as (select doc_id, len(regexp_extract_all(text, {K.quoted(K.lexicon.TOKEN)})) as word_count from documents)"
BIN_WIDTH = 50


def histogram_sql(source: str) -> str:
    return f"""
select cast(floor((word_count - least_count) / {BIN_WIDTH}.0) as integer) as bin,
       cast(min(least_count + floor((word_count - least_count) / {BIN_WIDTH}.0) * {BIN_WIDTH}) as bigint) as low, count(*) as n
from {source}, (select min(word_count) as least_count from {source}) group by 1"""


@query("word_count_histogram", "G2 T10", with_ctes(WORDS_SQL) + histogram_sql("word_counts"))
def word_count_histogram(spark: SparkSession, sf: str) -> DataFrame:
    found = G.word_count_histogram(K.documents(spark, sf), "doc_id", "text", BIN_WIDTH)
    return found.withColumn("low", F.col("low").cast("bigint"))


INLIERS_SQL = """
inliers as (
  select w.doc_id, w.word_count
  from word_counts w, (select quantile_cont(word_count, 0.25) as q1, quantile_cont(word_count, 0.75) as q3 from word_counts)
  where w.word_count between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))"""


@query("documents_of_usual_length", "G3 A18", with_ctes(WORDS_SQL, INLIERS_SQL) + "select * from inliers")
def documents_of_usual_length(spark: SparkSession, sf: str) -> DataFrame:
    kept = G.drop_iqr_outliers(G.word_counts(K.documents(spark, sf), "doc_id", "text"), "word_count")
    return kept.withColumn("word_count", F.col("word_count").cast("bigint"))


@query("usual_length_histogram", "G3 G2", with_ctes(WORDS_SQL, INLIERS_SQL) + histogram_sql("inliers"))
def usual_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    kept = G.drop_iqr_outliers(G.word_counts(K.documents(spark, sf), "doc_id", "text"), "word_count")
    return G.histogram(kept, "word_count", BIN_WIDTH).withColumn("low", F.col("low").cast("bigint"))


def picture_sql(source: str, width: int) -> str:
    return f"""
select cast(doc_id % 64 as integer) as doc_bin, cast(floor(idx * 64 / {width}) as integer) as feature_bin,
       round(cast(sum(value) as double), 6) as total, count(*) as n from {source} group by 1, 2"""


def _indexed(hits: DataFrame, terms: list[str]) -> DataFrame:
    index = F.create_map(*[F.lit(x) for i, t in enumerate(terms) for x in (t, i)])
    return hits.select("doc_id", index[F.col("term")].alias("idx"), F.col("value").cast("double").alias("value"))


def index_sql(terms: list[str]) -> str:
    return "case term " + " ".join(f"when {K.quoted(t)} then {i}" for i, t in enumerate(terms)) + " end as idx"


@query(
    "term_heatmap", "G4",
    with_ctes(f"hits as (select doc_id, {index_sql(K.TERMS)}, value from ({hits_sql(K.TERMS)}) where value > 0)")
    + picture_sql("hits", len(K.TERMS)),
)
def term_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    hits = _indexed(V.hotspot_counts(K.documents(spark, sf), "doc_id", "text", K.TERMS), K.TERMS)
    return G.heatmap(hits, "doc_id", len(K.TERMS)).withColumn("total", r6("total"))


@query(
    "exact_and_fuzzy_heatmaps", "G5 V6 V7",
    with_ctes(
        *FUZZY_SQL,
        f"exact_hits as (select doc_id, {index_sql(K.FUZZY_TERMS)}, value from ({hits_sql(K.FUZZY_TERMS)}) where value > 0)",
        f"""
fuzzy_hits as (
  select doc_id, {index_sql(K.FUZZY_TERMS)}, value from (
    select c.doc_id, s.term, count(*) as value
    from chunked c join scored s on c.n_words = s.n_words and c.chunk = s.chunk where s.ratio >= 95 group by 1, 2))""",
    ) + f"""
select 'exact' as block, * from ({picture_sql('exact_hits', len(K.FUZZY_TERMS))})
union all
select 'fuzzy' as block, * from ({picture_sql('fuzzy_hits', len(K.FUZZY_TERMS))})""",
)
def exact_and_fuzzy_heatmaps(spark: SparkSession, sf: str) -> DataFrame:
    docs = K.documents(spark, sf)
    blocks = {
        "exact": _indexed(V.hotspot_counts(docs, "doc_id", "text", K.FUZZY_TERMS), K.FUZZY_TERMS),
        "fuzzy": _indexed(V.hotspot_fuzzy(docs, "doc_id", "text", K.FUZZY_TERMS), K.FUZZY_TERMS),
    }
    return G.compare_blocks(blocks, "doc_id", len(K.FUZZY_TERMS)).withColumn("total", r6("total"))


# --- choice of configuration -------------------------------------------------------------------------------

@query(
    "best_config", "M9",
    """
select source as config, round(n_docs_share, 6) as m1, round(mean_chars_share, 6) as m2, round((n_docs_share + mean_chars_share) / 2, 6) as mean_metric
from (select source, count(*) / (select count(*) from documents) as n_docs_share,
             avg(n_chars) / (select max(n_chars) from documents) as mean_chars_share from documents group by 1)
order by (n_docs_share + mean_chars_share) / 2 desc, source limit 1""",
)
def best_config(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    n, longest = docs.agg(F.count(F.lit(1))).scalar(), docs.agg(F.max("n_chars")).scalar()
    results = docs.groupBy(F.col("source").alias("config")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean_chars")
    ).select("config", (F.col("n") / n).alias("m1"), (F.col("mean_chars") / longest).alias("m2"))
    best = E.best_config(results, ["m1", "m2"])
    return best.select("config", *[r6(c).alias(c) for c in ("m1", "m2", "mean_metric")])


# --- files -------------------------------------------------------------------------------------------------

@query(
    "notes_through_csv", "S2",
    with_views() + """
select row_id, subject_id, hadm_id, cast(chartdate as varchar) as chartdate, category, iserror, text from noteevents""",
)
def notes_through_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Notes written as quoted CSV with line breaks and read back."""
    path = scratch_path(spark, "notes-csv")
    files.write_csv(load_tables(spark, sf).notes, path)
    return files.read_csv_table(spark, path, NOTES).withColumn("chartdate", F.col("chartdate").cast("string"))


@query(
    "cohort_through_csv", "S3 P8 U2",
    with_views(*COHORT_NOTES_SQL) + "select subject_id, hadm_id, row_id, clean_text, label from cohort_notes",
)
def cohort_through_csv(spark: SparkSession, sf: str) -> DataFrame:

    t = load_tables(spark, sf)
    path = scratch_path(spark, "cohort-csv")
    columns = ["subject_id", "hadm_id", "row_id", "clean_text"]
    positive = C.positive_notes(t, PREFIX, with_list=False).select(*columns)
    negative = C.negative_notes(t, PREFIX, limit=None, with_list=False).select(*columns)
    return files.read_cohort_csv(spark, *files.write_cohort_csv(positive, negative, path))


SPLIT_ROWS_SQL = f"""
select d.text, l.quality as label, {SPLIT_SQL.format('d.doc_id')} as split from documents d join labels l on d.doc_id = l.doc_id"""
SPLIT_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])


def _split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.split_dataset(K.labelled_documents(spark, sf), "doc_id")


@query("splits_through_csv", "S4 S5 P10", SPLIT_ROWS_SQL)
def splits_through_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits-csv")
    files.write_splits_csv(_split_rows(spark, sf).select("text", "label", "split"), path)
    return files.read_splits_csv(spark, path, SPLIT_SCHEMA)


@query("splits_through_parquet", "S5 S6 S4", SPLIT_ROWS_SQL)
def splits_through_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits-parquet")
    files.write_splits(_split_rows(spark, sf), path)
    return files.read_splits(spark, path)
