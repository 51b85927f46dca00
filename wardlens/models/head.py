"""A classification head over document vectors: dropout, a ReLU layer, dropout, two classes, by data-parallel mini-batches.

Every epoch is a job: each shard of rows goes through its mini-batches from the same weights, then the shards' weights and
moments are averaged by their rows. Up to SHARD_ROWS rows are one shard, which is plain training.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN_UNITS = 256
# Shares of inputs and of hidden units that a mini-batch leaves out.
DROP_INPUT, DROP_HIDDEN = 0.5, 0.3
# Rows of a shard; beyond MOST_SHARDS of them the shards grow instead, so that what the driver averages stays bounded.
SHARD_ROWS, MOST_SHARDS, BATCH = 16_384, 64, 12
DECAY, MOMENTUM, SQUARES, TINY = 0.01, 0.9, 0.999, 1e-8

Layers = list[np.ndarray]  # weights and offsets of the hidden layer, then of the classes


def start_layers(d: int, hidden: int, seed: int) -> Layers:
    rng = np.random.default_rng(seed)
    even = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(n)
    return [even(d, d, hidden), even(d, hidden), even(hidden, hidden, 2), even(hidden, 2)]


def forward(layers: Layers, x: np.ndarray) -> np.ndarray:
    """The probability of class 1."""
    w1, b1, w2, b2 = layers
    out = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    return 1 / (1 + np.exp(np.clip(out[:, 0] - out[:, 1], -700, 700)))


def gradients(layers: Layers, x: np.ndarray, y: np.ndarray, inputs: np.ndarray, units: np.ndarray) -> tuple[float, Layers]:
    """Mean cross-entropy and its gradients, with what dropout leaves of inputs and hidden units as factors."""
    w1, b1, w2, b2 = layers
    x = x * inputs
    z = x @ w1 + b1
    a = np.maximum(z, 0) * units
    out = a @ w2 + b2
    out -= out.max(axis=1, keepdims=True)
    log_p = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
    each = np.arange(len(y))
    d_out = np.exp(log_p)
    d_out[each, y] -= 1
    d_out /= len(y)
    d_z = (d_out @ w2.T) * units * (z > 0)
    return float(-log_p[each, y].mean()), [x.T @ d_z, d_z.sum(axis=0), a.T @ d_out, d_out.sum(axis=0)]


def _pack(parts: list[Layers]) -> np.ndarray:
    return np.concatenate([a.ravel() for layers in parts for a in layers])


def _unpack(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[Layers]:
    """Layers, first and second moments."""
    parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes * 3])[:-1])
    arrays = [p.reshape(s).copy() for p, s in zip(parts, shapes * 3)]
    return [arrays[k : k + len(shapes)] for k in range(0, len(arrays), len(shapes))]


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.nan_to_num(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d), posinf=0, neginf=0)


def _epoch(sent, shapes: list[tuple[int, ...]], epoch: int, epochs: int, rate: float, seed: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("key", "ascending")])
        layers, first, second = _unpack(sent.value, shapes)
        x, y = _matrix(table.column("vec"), shapes[0][0]), table.column("y").to_numpy().astype(np.int64)
        shard = table.column("shard")[0].as_py()
        rng = np.random.default_rng((seed, epoch, shard))
        dealt = np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH))
        steps = len(dealt) * epochs
        for k, some in enumerate(dealt):
            inputs = (rng.random((len(some), x.shape[1])) >= DROP_INPUT) / (1 - DROP_INPUT)
            units = (rng.random((len(some), shapes[1][0])) >= DROP_HIDDEN) / (1 - DROP_HIDDEN)
            _, slopes = gradients(layers, x[some], y[some], inputs, units)
            t = epoch * len(dealt) + k + 1
            step = rate * (1 - (t - 1) / steps)
            for p, g, m, v in zip(layers, slopes, first, second):
                m += (1 - MOMENTUM) * (g - m)
                v += (1 - SQUARES) * (g * g - v)
                p *= 1 - step * DECAY
                p -= step * (m / (1 - MOMENTUM**t)) / (np.sqrt(v / (1 - SQUARES**t)) + TINY)
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "n": pa.array([len(y)], pa.int64()),
            "data": pa.array([_pack([layers, first, second]).tobytes()], pa.binary()),
        })

    return run


class HeadModel(Model, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted head: adds ``score`` (the probability of class 1) and ``prediction`` (1 above 0.5, else 0)."""

    width = Param(Params._dummy(), "width", "length of a vector", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "all layers in a row", TypeConverters.toListFloat)
    vec = Param(Params._dummy(), "vec", "column of vectors", TypeConverters.toString)

    def __init__(self, layers: Layers | None = None, vec: str = "vec") -> None:
        super().__init__()
        self._setDefault(predictionCol="prediction")
        if layers:
            self._set(width=len(layers[0]), weights=_pack([layers]).tolist(), vec=vec)

    def layers(self) -> Layers:
        d, flat = self.getOrDefault(self.width), np.array(self.getOrDefault(self.weights))
        hidden = (len(flat) - 2) // (d + 3)
        shapes = [(d, hidden), (hidden,), (hidden, 2), (2,)]
        return [p.reshape(s) for p, s in zip(np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers, d = self.layers(), self.getOrDefault(self.width)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            x = np.array([np.zeros(d) if r is None else np.asarray(r, np.float64) for r in v]).reshape(-1, d)
            return pd.Series(forward(layers, np.nan_to_num(x, posinf=0, neginf=0)))

        vec = F.col(self.getOrDefault(self.vec)).cast("array<double>")
        usable = F.when((F.size(vec) == d) & ~F.exists(vec, lambda c: c.isNull()), vec)
        scored = dataset.withColumn("score", score(usable))
        return scored.withColumn(self.getPredictionCol(), F.when(F.col("score") > 0.5, 1).otherwise(0))


def fit_mlp_head(
    df: DataFrame, vec: str, d: int, key: str, hidden: int = HIDDEN_UNITS, epochs: int = 5, rate: float = 1e-3,
    validation: DataFrame | None = None, seed: int = 42,
) -> HeadModel:
    """The head after the epoch with the best accuracy on ``validation`` (the earliest of equal ones), or after the last one.

    Adam with decoupled decay; the step falls in a line to 0. Rows without a vector of ``d`` numbers are left out of the
    fit and scored as zeros; NaN and infinities count as 0, and a label that is null or not above 0 is class 0. The weights
    are d x hidden + hidden x 2 numbers, whatever the rows.
    """
    spark = df.sparkSession
    v = F.col(vec).cast("array<double>")
    rows = df.filter((F.size(v) == d) & ~F.exists(v, lambda c: c.isNull())).select(
        F.when(F.col("label") > 0, 1).otherwise(0).cast("byte").alias("y"), v.alias("vec"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("order"), F.col(key).cast("string").alias("key"),
    )
    n = rows.count()
    if not n:
        raise ValueError("no rows with a vector to learn from")
    shards = max(1, min(MOST_SHARDS, -(-n // SHARD_ROWS)))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(shards)).cast("int")
    packed = rows.withColumn("shard", shard).repartition(shards, "shard").persist()
    layers = start_layers(d, hidden, seed)
    shapes = [a.shape for a in layers]
    zeros = [np.zeros_like(a) for a in layers]
    flat, best = _pack([layers, zeros, zeros]), (-1.0, layers)
    try:
        for epoch in range(epochs):
            sent = spark.sparkContext.broadcast(flat)
            run = _epoch(sent, shapes, epoch, epochs, rate, seed)
            parts = sorted(packed.groupBy("shard").applyInArrow(run, "shard int, n long, data binary").collect())
            sent.destroy()
            flat = sum(r["n"] * np.frombuffer(r["data"]) for r in parts) / sum(r["n"] for r in parts)
            layers = _unpack(flat, shapes)[0]
            if validation is not None:
                right = (F.col("prediction") == F.when(F.col("label") > 0, 1).otherwise(0)).cast("double")
                accuracy = HeadModel(layers, vec).transform(validation).agg(F.avg(right)).first()[0]
                best = max(best, (-1.0 if accuracy is None else accuracy, layers), key=lambda b: b[0])
    finally:
        packed.unpersist()
    return HeadModel(best[1] if best[0] >= 0 else layers, vec)


def predict_mlp_head(model: HeadModel, df: DataFrame) -> DataFrame:
    return model.transform(df)
