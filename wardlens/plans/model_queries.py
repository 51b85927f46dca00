"""Model queries: trained on the labelled documents, so their results are checked by tests and not by SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions import lexicon
from wardlens.functions import scalars as S
from wardlens.models import adaboost, boosted, head, linear, topics
from wardlens.models import experiment as X
from wardlens.operators import dataset as D
from wardlens.operators import evaluate as E
from wardlens.operators import features as V
from wardlens.operators import text as TX
from wardlens.operators import vectors as W
from wardlens.plans import corpus as K
from wardlens.plans.registry import query
from wardlens.session import keyed, materialize, scratch_path
from wardlens.sources import files

T_ = TypeVar("T_")

# The first configuration of the reference's sweep, which the queries of a single model use.
CONFIG = X.SWEEP[0]

# Written tables and fitted models that several queries of one session read, by the state of the files behind them.
_SHARED: dict[tuple[str, str, str, int], object] = {}


def _state(spark: SparkSession, sf: str) -> int:
    """Changes when a file of the tables that the models read is written anew."""
    state = 0
    for table in ("documents", "labels", "embeddings"):
        files = spark.read.parquet(f"{sf}/{table}.parquet").select(
            F.xxhash64("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string")).alias("h")
        )
        state = hash((state, tuple(sorted(r.h for r in files.distinct().collect()))))
    return state


def shared(spark: SparkSession, sf: str, name: str, build: Callable[[], T_]) -> T_:
    key = (spark.sparkContext.applicationId, sf, name, _state(spark, sf))
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, label, split) of the labelled documents."""

    def build() -> DataFrame:
        docs = K.labelled_documents(spark, sf).withColumn("text", TX.clean_tokens(F.col("text")))
        return materialize(D.split_dataset(docs, "doc_id"), "cleaned")

    return shared(spark, sf, "cleaned", build)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The word vectors as one written table."""
    return shared(
        spark, sf, "vectors", lambda: materialize(W.combine_vectors(*K.word_vectors(spark, sf)), "word-vectors")
    )


def matrix(spark: SparkSession, sf: str) -> X.Matrix:
    return shared(
        spark, sf, "matrix",
        lambda: X.build_matrix(
            cleaned(spark, sf), K.TERMS, CONFIG, vectors(spark, sf), K.VECTOR_WIDTH, topic_model=topic_model(spark, sf)
        ),
    )


def topic_model(spark: SparkSession, sf: str) -> topics.TopicModel:
    """The matrix's topics; whoever needs them alone does not wait for its other blocks."""
    return shared(spark, sf, "topics", lambda: X.fit_topic_model(cleaned(spark, sf), CONFIG))


@query("topic_words", "M1 M2 L6")
def topic_words(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_words(topic_model(spark, sf), 20)


@query("topic_word_table", "M2 L6 S10")
def topic_word_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of every topic, written as a CSV result table and read back."""
    path = scratch_path(spark, "topic-words")
    files.write_csv(topics.topic_words(topic_model(spark, sf)), path)
    schema = T.StructType([
        T.StructField("topic", T.StringType()), T.StructField("keyword", T.StringType()), T.StructField("importance", T.DoubleType()),
    ])
    return files.read_csv_table(spark, path, schema)


@query("topic_features", "V9 M1")
def topic_features(spark: SparkSession, sf: str) -> DataFrame:
    weights = topics.topic_weights(topic_model(spark, sf), cleaned(spark, sf), "doc_id", S.vector_tokens("text"))
    return weights.select("doc_id", F.posexplode("vec").alias("topic", "weight"))


@query("feature_vectors", "V13 V14")
def feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = matrix(spark, sf).rows
    return rows.select("doc_id", "label", "split", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def _boosted(spark: SparkSession, sf: str) -> tuple[boosted.BoostedModel, DataFrame, list[str]]:
    built = matrix(spark, sf)
    rows = built.rows
    train, val = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    fitted = shared(
        spark, sf, "boosted", lambda: boosted.fit_boosted(train, val, CONFIG.eta, CONFIG.patience, CONFIG.rounds, key="doc_id")
    )
    return fitted, rows, built.names


@query("boosted_tree_scores", "M3 E1")
def boosted_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    found, rows, _ = _boosted(spark, sf)
    scored = found.model.transform(rows)
    return scored.select("doc_id", "split", "label", "score", E.harden(F.col("score")).alias("prediction"))


@query("boosted_validation_curve", "M3")
def boosted_validation_curve(spark: SparkSession, sf: str) -> DataFrame:
    found, rows, _ = _boosted(spark, sf)
    return spark.createDataFrame([(i + 1, float(a)) for i, a in enumerate(found.val_auc)], "round int, auc double")


@query("split_count_importance", "M4")
def split_count_importance(spark: SparkSession, sf: str) -> DataFrame:
    found, rows, names = _boosted(spark, sf)
    return boosted.split_count_importance(found.model, rows, names)


@query("top_feature_importance", "G6 L7")
def top_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    found, rows, names = _boosted(spark, sf)
    return boosted.top_features(boosted.split_count_importance(found.model, rows, names), 25)


def _svm(spark: SparkSession, sf: str) -> linear.GridResult:
    """The whole grid of penalties, fitted once for the queries that read it."""

    def build() -> linear.GridResult:
        train = matrix(spark, sf).rows.filter(F.col("split") == "train")
        return linear.fit_svm_grid(train, "doc_id", CONFIG.alphas, max_iter=CONFIG.svm_iterations)

    return shared(spark, sf, "svm", build)


@query("svm_grid", "M5")
def svm_grid(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(_svm(spark, sf).accuracies, "alpha double, accuracy double")


@query("saved_svm_predictions", "S11 M5 E7")
def saved_svm_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The best model of the grid, saved, loaded and applied."""
    path = scratch_path(spark, "svm-model")
    files.save_model(_svm(spark, sf).model, path)
    scored = linear.HingeModel.load(path).transform(matrix(spark, sf).rows)
    return scored.select("doc_id", "split", "label", F.col("prediction").cast("int").alias("prediction"))


@query("adaboost_grid", "M6")
def adaboost_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Depths, leaf sizes, rounds and rates of boosted decision trees over count-based weights, by cross-validation.

    The tokens are words of two characters or more, with their accents.
    """
    docs = cleaned(spark, sf)
    counts = V.token_counts(docs, "doc_id", S.vector_tokens("text", lexicon.WORD_2, accents=False))
    words = counts.select("token").distinct().count()
    weights = V.tfidf_from_counts(counts, V.document_count(docs, "doc_id"), "doc_id")
    rows = W.pack_vectors(weights, docs.select("doc_id", "label", "split"), "doc_id", words)
    kept = materialize(D.fit_rows(rows).select("doc_id", "label", "features"), "adaboost")
    _, table = adaboost.fit_adaboost_grid(
        kept, "doc_id", adaboost.DEPTHS, adaboost.MIN_LEAVES, adaboost.ROUNDS, adaboost.RATES
    )
    return table


@query("mlp_head_predictions", "M7")
def mlp_head_predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = cleaned(spark, sf)
    averaged = W.average_embedding(keyed(docs, "doc_id"), "doc_id", "text", vectors(spark, sf), K.VECTOR_WIDTH, mode="tokens")
    rows = docs.select("doc_id", "label", "split").join(averaged, "doc_id")
    rows = materialize(rows, "document-vectors")
    train, val = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    scored = head.predict_mlp_head(head.fit_mlp_head(train, "vec", K.VECTOR_WIDTH, "doc_id", validation=val), rows)
    return scored.select("doc_id", "split", "label", "prediction", "score")


@query("document_vectors_through_parquet", "S8 V12")
def document_vectors_through_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """Averaged vectors written once and read back as a feature block."""
    path = scratch_path(spark, "doc-vectors")
    files.write_parquet(W.average_embedding(keyed(cleaned(spark, sf), "doc_id"), "doc_id", "text", vectors(spark, sf), K.VECTOR_WIDTH), path)
    block = W.vector_block(files.load_doc_vectors(spark, path), "doc_id", K.VECTOR_WIDTH, "w2v_")
    return block.triples.withColumn("value", F.round("value", 6))


@query("experiment_metrics", "M10")
def experiment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = X.run_experiment(cleaned(spark, sf), K.TERMS, CONFIG, vectors(spark, sf), K.VECTOR_WIDTH)
    return metric_table(spark, metrics)


def metric_table(spark: SparkSession, metrics: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(name, float(value)) for name, value in metrics.items()], "metric string, value double")


@query("tuning_sweep", "M8 M9")
def tuning_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return X.sweep(cleaned(spark, sf), K.TERMS, X.SWEEP, vectors(spark, sf), K.VECTOR_WIDTH)


@query("tuning_rerun", "M8 M9 M10")
def tuning_rerun(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of another run with the best configuration of the sweep."""
    _, metrics = X.sweep_and_rerun(cleaned(spark, sf), K.TERMS, X.SWEEP, vectors(spark, sf), K.VECTOR_WIDTH)
    return metric_table(spark, metrics)
