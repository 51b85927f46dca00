"""Near-duplicate vectors by dual traversal of cover trees.

On the unit sphere a cosine of at least ``threshold`` is a distance of at most ``sqrt(2 - 2 threshold)``. Vectors are
dealt to cells around pivots; cells become blocks, each with a tree of nested balls whose radii halve from level to
level. Pairs of blocks, then pairs of nodes, are dropped when the distance of their centres exceeds the sum of their
radii by more than that; the pairs of balls that are left are compared vector by vector in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.shared import bounded_sample, components, stored

THRESHOLD = 0.9
#: Vectors per block; two blocks meet in one task.
BLOCK = 8192
#: Pivots at most, taken from the vectors with the smallest hashes; they only decide which vectors share a block.
PIVOTS = 256
#: Distances closer to a bound than this are compared: the root of a rounded cosine near 1 is off by some 2e-8.
SLACK = 1e-6
#: Vectors in a ball that is not divided further, and balls that a ball is divided into at most.
LEAF = 256
CHILDREN = 16


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) -> (id, unit): double precision, as bytes; null for a vector without a direction."""
    for batch in batches:
        out = []
        for value in batch.column(1):
            given = value.as_py()
            x = np.array(given, np.float64) if given and None not in given else np.empty(0)
            # scaled first, so that no square overflows or vanishes
            top = np.abs(x).max() if len(x) else 0.0
            if not 0 < top < math.inf:
                out.append(None)
                continue
            x /= top
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])


def _matrix(units: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(-1, width // 8)


def _distance(cosine):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Ball:
    """A node of the tree: a range of the ordered vectors, a centre and the largest distance from it."""

    __slots__ = ("start", "stop", "centre", "radius", "children")

    def __init__(self, start, stop, centre, radius):
        self.start, self.stop, self.centre, self.radius = start, stop, centre, radius
        self.children: list[Ball] = []


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, Ball]:
    """(order, root) of a tree over unit vectors; a ball covers ``order[start:stop]``.

    Centres of one level keep half the radius above apart from each other; every vector joins the nearest.
    """
    order = np.arange(len(x))
    far = float(_distance(x @ x[0]).max())
    root = Ball(0, len(x), x[0], far)
    waiting = [(root, 2.0)]
    while waiting:
        ball, level = waiting.pop()
        own = order[ball.start : ball.stop]
        if len(own) <= LEAF or ball.radius == 0 or level < 1e-9:
            continue
        inside = x[own]
        level /= 2
        while level / 2 > ball.radius:
            level /= 2
        nearest = _distance(inside @ ball.centre)
        label = np.zeros(len(own), np.int64)
        centres = [ball.centre]
        while len(centres) < CHILDREN and (at := int(nearest.argmax())) >= 0 and nearest[at] > level:
            d = _distance(inside @ inside[at])
            closer = d < nearest
            label[closer], nearest = len(centres), np.minimum(nearest, d)
            centres.append(inside[at])
        by = np.argsort(label, kind="stable")
        order[ball.start : ball.stop] = own[by]
        counts = np.bincount(label, minlength=len(centres))
        at = ball.start
        for k, n in enumerate(counts.tolist()):
            if n:
                child = Ball(at, at + n, centres[k], float(nearest[label == k].max()))
                ball.children.append(child)
                waiting.append((child, level))
                at += n
    return order, root


def dual_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of rows (of ``x`` and ``y``, or of ``x`` alone with each pair once) of cosine ``threshold`` or more.

    Rows (a, b, False): ``a[k]`` is linked with ``b[k]``. Rows (a, b, True): all of ``a`` with all of ``b``, two balls
    whose bounds leave no other way; they are not compared.
    """
    reach = math.sqrt(2 - 2 * threshold)
    own = y is None
    left, a = cover_tree(x)
    right, b = (left, a) if own else cover_tree(y)
    xs = x[left]
    ys = xs if own else y[right]
    xf, yf = xs.astype(np.float32), ys.astype(np.float32)
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        apart = float(_distance(a.centre @ b.centre)) if a is not b else 0.0
        if apart - a.radius - b.radius > reach + SLACK and a is not b:
            continue
        if a is not b and apart + a.radius + b.radius < reach - SLACK:
            yield left[a.start : a.stop], right[b.start : b.stop], True
            continue
        if a.children and (not b.children or a.stop - a.start >= b.stop - b.start):
            if a is b:
                waiting += [(c, d) for k, c in enumerate(a.children) for d in a.children[k:]]
            else:
                waiting += [(c, b) for c in a.children]
            continue
        if b.children:
            waiting += [(a, c) for c in b.children]
            continue
        # single precision finds what may reach the threshold, double precision decides
        i, j = np.nonzero(xf[a.start : a.stop] @ yf[b.start : b.stop].T >= threshold - 1e-4)
        if a is b:
            i, j = i[i < j], j[i < j]
        i, j = i + a.start, j + b.start
        for k in range(0, len(i), 200_000):
            p, q = i[k : k + 200_000], j[k : k + 200_000]
            sure = np.einsum("ij,ij->i", xs[p], ys[q]) >= threshold
            yield left[p[sure]], right[q[sure]], False


def _join_blocks(threshold: float):
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        """Two blocks, or one with itself: per vector the number of others linked, and one link to its local group."""
        side = frame["side"].to_numpy()
        parts = [frame[side == s] for s in (0, 1)]
        size = len(frame["unit"].iloc[0])
        ids = np.concatenate([p["rep"].to_numpy(np.int64) for p in parts])
        held = np.concatenate([p["held"].to_numpy(np.int64) for p in parts])
        x = _matrix(parts[0]["unit"].tolist(), size)
        y = _matrix(parts[1]["unit"].tolist(), size) if len(parts[1]) else None
        shift = len(x) if y is not None else 0
        links = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        if len(x) and (y is not None or not frame["pair"].iloc[0]):
            for a, b, all_of_them in dual_links(x, y, threshold):
                b = b + shift
                if all_of_them:
                    links[a] += held[b].sum()
                    links[b] += held[a].sum()
                    # one chain through both
                    a, b = np.concatenate([np.full(len(b), a[0]), a[1:]]), np.concatenate([b, np.full(len(a) - 1, b[0])])
                else:
                    np.add.at(links, a, held[b])
                    np.add.at(links, b, held[a])
                while len(a):
                    p, q = label[a], label[b]
                    apart = p != q
                    a, b, p, q = a[apart], b[apart], p[apart], q[apart]
                    np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                    while not np.array_equal(label[label], label):
                        label = label[label]
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": ids[some], "n": links[some], "other": ids[label[some]]})

    return join


def _meetings(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """From pairs of cells that may hold links to one row for each block of each pair of blocks."""
    pairs = spark.createDataFrame(plan, "size int, a long, a_blocks int, b long, b_blocks int")
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1)).alias("k"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)).alias("m"))
    pairs = pairs.filter((F.col("a") != F.col("b")) | (F.col("k") <= F.col("m")))
    pair = (F.col("a") != F.col("b")) | (F.col("k") != F.col("m"))
    task = F.struct("size", "a", "k", "b", "m").alias("task")
    first = pairs.select(F.col("a").alias("cell"), "size", F.col("k").alias("block"), task, F.lit(0).alias("side"), pair.alias("pair"))
    second = pairs.filter(pair).select(F.col("b").alias("cell"), "size", F.col("m").alias("block"), task, F.lit(1).alias("side"), F.lit(True).alias("pair"))
    both = first.unionByName(second)
    return F.broadcast(both) if sum(p[2] * p[4] for p in plan) <= 100_000 else both


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component, kept) per row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length. Equal directions are one vector for the trees and counted by their number. Ids are integers;
    a row with a null id links with nothing and has no component. Repeated ids are separate vectors. Pairs of
    blocks that no bound rules out are all compared, so vectors without any clusters cost the square of their number.
    """
    spark = vectors.sparkSession
    rows = stored(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(_unit, "id long, unit binary"),
        "units",
    )
    usable = rows.filter(F.col("unit").isNotNull() & F.col("id").isNotNull())
    # a number per distinct direction, written with it; ids may be repeated
    distinct = usable.groupBy("unit").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("held"))
    classes = stored(distinct.withColumn("size", F.length("unit")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    pivots = bounded_sample(classes.select("unit", "size"), "unit", max(1, min(PIVOTS, n // BLOCK)), "pivots").collect()
    table = [(r["size"], np.frombuffer(r["unit"], np.float64)) for r in pivots]
    pivot_of = {s: (np.array([p for z, p in table if z == s]), [k for k, (z, _) in enumerate(table) if z == s]) for s in {z for z, _ in table}}

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, far = [], []
            for unit in batch.column(0).to_pylist():
                near, names = pivot_of.get(len(unit), (None, None))
                if near is None:  # no pivot of this length: such vectors share a cell without a bound
                    cells.append(-1)
                    far.append(2.0)
                    continue
                cosine = near @ np.frombuffer(unit, np.float64)
                k = int(cosine.argmax())
                cells.append(names[k])
                far.append(float(_distance(cosine[k])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    dealt = stored(classes.select("unit", "rep", "held", "size").mapInArrow(to_cells, "unit binary, rep long, held long, size int, cell long, far double"), "cells")
    # one row per cell and vector length; a large cell is cut into blocks by hash
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    cells = dealt.groupBy("cell", "size").agg(blocks.alias("blocks"), F.max("far").alias("radius")).collect()
    reach = math.sqrt(2 - 2 * threshold)
    plan = []
    for k, a in enumerate(sorted(cells)):
        for b in sorted(cells)[k:]:
            if a["size"] != b["size"]:
                continue
            if a is not b and a["cell"] >= 0 and b["cell"] >= 0:
                apart = float(_distance(table[a["cell"]][1] @ table[b["cell"]][1]))
                if apart - a["radius"] - b["radius"] > reach + SLACK:
                    continue
            plan.append((a["size"], a["cell"], a["blocks"], b["cell"], b["blocks"]))
    if not plan:
        linked = spark.createDataFrame([], "rep long, n long, other long")
    else:
        sizes = spark.createDataFrame([(c["cell"], c["size"], c["blocks"]) for c in cells], "cell long, size int, blocks int")
        placed = dealt.join(F.broadcast(sizes), ["cell", "size"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        met = placed.join(_meetings(spark, plan), ["cell", "size", "block"])
        linked = met.select("task", "side", "pair", "rep", "held", "unit").groupBy("task").applyInPandas(_join_blocks(threshold), "rep long, n long, other long")
    linked = stored(linked, "links")
    roots = components(linked, "rep", "other")
    counts = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    placed = classes.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    placed = stored(placed.select("unit", (F.coalesce("n", F.lit(0)) + F.col("held") - 1).alias("n_links"), "root", "least"), "placed")
    named = placed.join(stored(placed.groupBy("root").agg(F.min("least").alias("component")), "named"), "root").select("unit", "n_links", "component")
    lone = rows.filter(F.col("unit").isNull() | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = usable.join(named, "unit").select("id", "n_links", "component").unionByName(lone)
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def digest(vectors: DataFrame) -> DataFrame:
    """The columns of the query."""
    found = near_vectors(vectors)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
