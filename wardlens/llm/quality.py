"""Quality of documents by Bradley-Terry ranking.

Every labelled document is compared with documents of the other label, dealt by the hash of their ids; a linear score is
learned by logistic loss on the difference of their features. Its threshold is a quantile of the scores of all training
documents. Sums of fixed size per task are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import held_out, labelled_ids, stored
from wardlens.operators.relations import numbered

#: Pairs at least, where there are so many; more documents make more pairs.
PAIRS = 40_000
#: Newton steps, and quantiles that are tried as threshold.
STEPS, QUANTILES = 12, np.linspace(0.001, 0.999, 999)
#: Score at the threshold.
CUT = 0.3

_CODES = [10, *range(32, 127)]  # line ends and printable ASCII count one by one
N_FEATURES = len(_CODES) + 14


def features(text: str | None) -> np.ndarray:
    """Shares of bytes, and how words and lines repeat; zeros for a null or empty text."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = len(data)
    k = len(_CODES)
    out[:k] = np.sqrt(counts[_CODES] / n)
    upper, lower, wide = counts[65:91].sum(), counts[97:123].sum(), counts[128:].sum()
    letters = max(1, upper + lower + wide)
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    distinct = set(words)
    repeated = sum(map(str.__eq__, words, words[1:]))
    length = sum(map(len, words))
    out[k:] = (
        np.log1p(n) / 10, np.sqrt(wide / n), upper / letters, (n - letters - counts[32]) / n, counts[48:58].sum() / n, np.log1p(length / m),
        len(distinct) / m, len(distinct) / m**0.8, np.sqrt(repeated / m), np.sqrt(sum(map(str.isupper, words)) / m),
        np.sqrt(1 - sum(map(str.isalpha, words)) / m), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines) / m), float(m < 20),
    )
    return out


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, increasing in the raw score, ``CUT`` at the threshold."""
        z = (self.raw(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x.sum(0), (x * x).sum(0)])


def _standard(n: int, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each feature."""
    if not n:
        return np.zeros(N_FEATURES), np.ones(N_FEATURES)
    mean, square = moments.reshape(2, -1) / n
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3


def _pair_sums(d: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slope and curve of the loss over pairs, given by the difference of good and bad."""
    lost = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
    return np.concatenate([d.T @ lost, ((d * (lost * (1 - lost))[:, None]).T @ d).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], penalty: float) -> np.ndarray:
    weights = np.zeros(N_FEATURES)
    for _ in range(STEPS):
        found = sums(weights)
        slope, curve = found[: len(weights)], found[len(weights) :].reshape(len(weights), -1)
        weights = weights + np.linalg.solve(curve + penalty * np.eye(len(weights)), slope - penalty * weights)
    return weights


def _places(raw: np.ndarray, label: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """Bad and good rows by how many of the tried thresholds they reach, then the sums of scores and of their squares."""
    at = np.searchsorted(tried, raw, side="right")
    counts = [np.bincount(at[(label == 1) == good], minlength=len(tried) + 1) for good in (False, True)]
    return np.concatenate([*counts, [raw.sum(), (raw * raw).sum()]])


def _threshold(tried: np.ndarray, places: np.ndarray) -> tuple[float, float]:
    """The quantile that sets the fewest documents on the wrong side, of each label alike, and half the scores' deviation."""
    bad, good = places[:-2].reshape(2, -1)
    wrong = good.cumsum()[:-1] / good.sum() + 1 - bad.cumsum()[:-1] / bad.sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    mean, square = places[-2:] / places[:-2].sum()
    return float(tried[best[len(best) // 5]]), float(np.sqrt(max(square - mean * mean, 0.0))) / 2 + 1e-9


def _lowered(threshold: float, below: float | None) -> float:
    """Any value down to the next score below sets the same rows apart; a low one, as a wrongly kept document costs less."""
    return threshold if below is None else threshold - 0.8 * (threshold - below)


def _partners(many: int, few: int, pairs: int) -> int:
    """Documents of the rarer label that each of the other label meets."""
    return min(few, max(1, -(-pairs // many)))


def _unlike(mean: np.ndarray, scale: np.ndarray, n_bad: int) -> Ranking:
    """Nothing to compare: every document scores alike, on the side of the only label there is."""
    return Ranking(mean, scale, np.zeros(N_FEATURES), 1.0 if n_bad else -1.0, 1.0)


def fit_ranking(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, penalty: float = 20.0) -> Ranking:
    """Bradley-Terry weights by Newton steps on pairs of a good and a bad document: what ``fit`` does, for arrays."""
    x = x.astype(np.float64).reshape(-1, N_FEATURES)
    mean, scale = _standard(len(x), _moments(x))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label != 1)
    if not len(good) or not len(bad):
        return _unlike(mean, scale, len(bad))
    z = np.clip((x - mean) / scale, -8, 8)
    many, few = (good, bad) if len(good) >= len(bad) else (bad, good)
    k = _partners(len(many), len(few), pairs)
    met = (np.arange(len(many))[:, None] + np.arange(k)) % len(few)
    d = np.repeat(z[many], k, axis=0) - z[few][met.ravel()]
    weights = _newton(lambda w: _pair_sums(d if many is good else -d, w), penalty)
    raw = z @ weights
    tried = np.quantile(raw, QUANTILES, method="higher")
    threshold, spread = _threshold(tried, _places(raw, label, tried))
    return Ranking(mean, scale, weights, _lowered(threshold, max(raw[raw < threshold], default=None)), spread)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, features)."""
    for batch in batches:
        rows = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["id", "features"])


def labelled_features(documents: DataFrame, labels: DataFrame, label: str, *, folds: int, fold: int) -> DataFrame:
    """(id, label, features) of the labelled documents outside the held-out fold.

    Texts are only scanned: what meets the labels are features of fixed size, by the same join whatever the tables' sizes.
    """
    ids = labelled_ids(labels, label, folds=folds, fold=fold).withColumn("label", F.when(F.col("label") == 1, 1).otherwise(0))
    texts = documents.select(F.col("doc_id").alias("id"), "text").filter(F.col("id").isNotNull() & ~held_out(F.col("id"), folds, fold))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_vectors, f"id {kind}, features binary").join(ids.hint("merge"), "id").select("id", "label", "features")


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _summed(frame: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum over all batches of ``width`` numbers; a row per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    total = np.zeros(width)
    for row in sorted(frame.mapInArrow(run, "part int, data binary").collect()):
        total += np.frombuffer(row["data"])
    return total


def _pairs(rows: DataFrame, n: dict[int, int], mean: np.ndarray, scale: np.ndarray, pairs: int) -> DataFrame:
    """Written differences of good and bad: every document meets one of the other label at least."""
    good, bad = (
        numbered(rows.filter(F.col("label") == v).select(F.xxhash64("id").alias("h"), "id", "features"), "h", "id", "features").select("rank", "features")
        for v in (1, 0)
    )
    many, few = (good, bad) if n[1] >= n[0] else (bad, good)
    k = _partners(max(n.values()), min(n.values()), pairs)
    met = many.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("rank", F.pmod(F.col("rank") + F.col("j"), F.lit(min(n.values()))))
    both = met.join(few.withColumnRenamed("features", "other"), "rank").select("features", "other")
    sign = 1 if n[1] >= n[0] else -1

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.clip((_numbers(c) - mean) / scale, -8, 8) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in (sign * (a - b)).astype(np.float32)], pa.binary())], names=["d"])

    return stored(both.mapInArrow(differences, "d binary"), "quality-pairs")


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", *, folds: int = 5, fold: int = 0, pairs: int = PAIRS, penalty: float = 20.0) -> Ranking:
    """Learn from every labelled document outside the held-out fold."""
    rows = stored(labelled_features(documents, labels, label, folds=folds, fold=fold), "quality-rows")
    counted = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = {v: counted.get(v, 0) for v in (0, 1)}
    plain = rows.select("features", "label")
    mean, scale = _standard(sum(n.values()), _summed(plain, lambda b: _moments(_numbers(b.column(0))), 2 * N_FEATURES))
    if not n[0] or not n[1]:
        return _unlike(mean, scale, n[0])
    met = _pairs(rows, n, mean, scale, pairs)
    weights = _newton(lambda w: _summed(met, lambda b: _pair_sums(_numbers(b.column(0)), w), N_FEATURES * (N_FEATURES + 1)), penalty)
    model = Ranking(mean, scale, weights, 0.0, 1.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_numbers(batch.column(0)))), batch.column(1)], names=["raw", "label"])

    raw = stored(plain.mapInArrow(scored, "raw double, label int"), "quality-scores")
    tried = np.array(raw.agg(F.percentile_approx("raw", QUANTILES.tolist(), 100_000)).first()[0])
    places = _summed(raw, lambda b: _places(b.column(0).to_numpy(), b.column(1).to_numpy(), tried), 2 * (len(tried) + 1) + 2)
    threshold, spread = _threshold(tried, places)
    below = raw.filter(F.col("raw") < threshold).agg(F.max("raw")).first()[0]
    return Ranking(mean, scale, weights, _lowered(threshold, below), spread)


def score(documents: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row; a null text scores as an empty one. Other columns are not read."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, f"id {kind}, score double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query."""
    rows = score(documents, fit(documents, labels)).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
