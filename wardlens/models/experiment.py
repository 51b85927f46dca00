"""One training run from cleaned documents to metrics, and the sweep over configurations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions import scalars as S
from wardlens.models import boosted, linear, topics
from wardlens.operators import dataset as D
from wardlens.operators import evaluate as E
from wardlens.operators import features as V
from wardlens.operators import vectors as W
from wardlens.session import keyed, materialize

# Configurations of a sweep whose jobs run side by side: a fit is many short jobs that leave cores idle.
RUNS = 4

METRICS = ["boosted_accuracy", "boosted_auc", "boosted_f1", "svm_accuracy", "svm_auc", "svm_f1"]


@dataclass(frozen=True)
class Config:
    """One row of the sweep."""

    max_features: int = 10_000
    topics: int = 5
    eta: float = 0.1
    patience: int = 5
    rounds: int = 100
    topic_passes: int = 10
    topic_batches: int = 10
    alphas: Sequence[float] = field(default=linear.ALPHAS)
    svm_iterations: int = 1000
    fit_splits: tuple[str, ...] = ("train", "val")
    scale: str = "per_split"


# The four configurations of the reference's sweep: one value of each list at a time.
SWEEP = [
    Config(max_features=10_000, topics=5, eta=0.1, patience=5),
    Config(max_features=15_000, topics=10, eta=0.2, patience=10),
    Config(max_features=20_000, topics=15, eta=0.3, patience=15),
    Config(max_features=25_000, topics=20, eta=0.4, patience=20),
]


@dataclass(frozen=True)
class Matrix:
    """Scaled feature vectors with labels and splits as a written table, and the feature names."""

    rows: DataFrame
    names: list[str]
    topic_model: topics.TopicModel


def _word_block(docs: DataFrame, together: DataFrame, config: Config, key: str) -> W.Block:
    """The weighted words of written documents, and the vocabulary that they share with the topics."""
    # what is folded by document reads its pieces side by side, so that tokens are not shuffled
    counts = V.token_counts(together, [key, "split"], S.vector_tokens("text"))
    fitted = (D.fit_rows(df, config.fit_splits) for df in (docs, counts))
    return W.word_block(docs, next(fitted), counts, next(fitted), key, config.max_features)


def _fit_topics(docs: DataFrame, words: Sequence[str], config: Config) -> topics.TopicModel:
    return topics.fit_topics(
        D.fit_rows(docs, config.fit_splits), S.vector_tokens("text"), words, config.topics, config.topic_passes, config.topic_batches
    )


def fit_topic_model(docs: DataFrame, config: Config, key: str = "doc_id") -> topics.TopicModel:
    """The topic model of the matrix of ``docs``, without the blocks that it does not read."""
    docs = materialize(docs.select(key, "text", "label", "split"), "documents")
    return _fit_topics(docs, _word_block(docs, keyed(docs, key), config, key).names, config)


def build_matrix(
    docs: DataFrame, terms: Sequence[str], config: Config, vectors: DataFrame | None = None, d: int = 100, key: str = "doc_id",
    topic_model: topics.TopicModel | None = None,
) -> Matrix:
    """Word weights, term hits, topic weights and averaged word vectors, scaled, as one vector per document.

    ``docs`` has (key, text, label, split) with cleaned text, a document cut in pieces on several rows. ``topic_model`` is
    that of ``fit_topic_model`` on the same documents, where it is there already.
    """
    docs = materialize(docs.select(key, "text", "label", "split"), "documents")
    together = keyed(docs, key)
    blocks = [_word_block(docs, together, config, key), W.term_block(together, key, "text", terms)]

    model = topic_model or _fit_topics(docs, blocks[0].names, config)
    weights = topics.topic_weights(model, docs, key, S.vector_tokens("text"))
    blocks.append(W.vector_block(weights, key, config.topics, "LDA_"))
    if vectors is not None:
        averaged = W.average_embedding(together, key, "text", vectors, d)
        blocks.append(W.vector_block(averaged, key, d, "w2v_"))

    triples, names = W.combine_blocks(blocks, key)
    # read twice below: for the ranges of the features and for the scaled values
    triples = materialize(triples, "triples")
    labels = docs.select(key, "label", "split").dropDuplicates([key])
    scaled = W.min_max(triples, labels, key, config.scale, len(names))
    rows = materialize(W.pack_vectors(scaled, labels, key, len(names)), "matrix")
    return Matrix(rows, names, model)


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], Any]], most: int) -> list[Any]:
    """The results of independent tasks that submit their jobs from at most so many threads."""
    with ThreadPoolExecutor(max(1, min(most, len(tasks)))) as pool:
        return list(pool.map(lambda task: task(), [inheritable_thread_target(spark)(task) for task in tasks]))


def run_experiment(
    docs: DataFrame, terms: Sequence[str], config: Config, vectors: DataFrame | None = None, d: int = 100, key: str = "doc_id"
) -> dict[str, float]:
    """Fit both classifiers on the training split and return their metrics on the test split."""
    matrix = build_matrix(docs, terms, config, vectors, d, key)
    rows = matrix.rows
    train, val, test = (rows.filter(F.col("split") == s) for s in ("train", "val", "test"))

    trees, grid = side_by_side(docs.sparkSession, [
        lambda: boosted.fit_boosted(train, val, config.eta, config.patience, config.rounds, key=key),
        lambda: linear.fit_svm_grid(train, key, config.alphas, max_iter=config.svm_iterations),
    ], 2)
    scored = trees.model.transform(test)
    tree_scores = E.scores(scored.withColumn("hard", E.harden(F.col("score"))), "label", "hard").first()

    svm_scores = E.scores(grid.model.transform(test), "label", "prediction").first()
    return {
        "boosted_accuracy": tree_scores["accuracy"],
        "boosted_auc": tree_scores["auc_hard"],
        "boosted_f1": tree_scores["f1"],
        "svm_accuracy": svm_scores["accuracy"],
        "svm_auc": svm_scores["auc_swapped"],
        "svm_f1": svm_scores["f1"],
    }


def sweep(
    docs: DataFrame, terms: Sequence[str], configs: Sequence[Config] = SWEEP, vectors: DataFrame | None = None, d: int = 100,
    key: str = "doc_id",
) -> DataFrame:
    """One row of metrics per configuration. The documents are cleaned once for all runs, which go side by side."""
    cleaned = materialize(docs.select(key, "text", "label", "split"), "documents")
    rows = []
    runs = [lambda config=config: run_experiment(cleaned, terms, config, vectors, d, key) for config in configs]
    for i, (config, metrics) in enumerate(zip(configs, side_by_side(docs.sparkSession, runs, RUNS), strict=True)):
        rows.append((i, config.max_features, config.topics, config.eta, config.patience, *[float(metrics[m]) for m in METRICS]))
    columns = ", ".join(f"{m} double" for m in METRICS)
    return docs.sparkSession.createDataFrame(
        rows, f"config int, max_features int, topics int, eta double, patience int, {columns}"
    )


def sweep_and_rerun(
    docs: DataFrame, terms: Sequence[str], configs: Sequence[Config] = SWEEP, vectors: DataFrame | None = None, d: int = 100,
    key: str = "doc_id",
) -> tuple[DataFrame, dict[str, float]]:
    """The sweep table, and the metrics of another run with its best configuration."""
    table = sweep(docs, terms, configs, vectors, d, key)
    best = E.best_config(table, METRICS).first()["config"]
    return table, run_experiment(docs, terms, configs[best], vectors, d, key)
