import threading

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlens.functions import scalars as S
from wardlens.models import adaboost, boosted, head, linear, topics
from wardlens.models import experiment as X
from wardlens.operators import evaluate as E
from wardlens.operators.relations import numbered

WIDTH = 6


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        label = int(i % 3 == 0)
        x = rng.normal(0, 1, WIDTH)
        x[0] += 4 * label - 2
        x[1] = 0.0 if i % 2 else x[1]
        rows.append((i, label, ("train", "val", "test")[i // 100], Vectors.dense(x) if i % 5 else Vectors.sparse(WIDTH, list(range(WIDTH)), x.tolist())))
    return spark.createDataFrame(rows, ["doc_id", "label", "split", "features"]).repartition(3).persist()


def part(df, name):
    return df.filter(F.col("split") == name)


@pytest.fixture(scope="module")
def trees(separable):
    return boosted.fit_boosted(part(separable, "train"), part(separable, "val"), eta=0.3, patience=3, rounds=8, depth=3)


def test_boosted_trees_learn_and_stop(separable, trees, tmp_path):
    test = part(separable, "test")
    scored = trees.model.transform(test).withColumn("hard", E.harden(F.col("score")))
    assert E.scores(scored, "label", "hard").first()["accuracy"] > 0.85
    kept = trees.model.tree_list()
    assert 1 <= trees.best_round <= len(kept) == len(trees.val_auc) <= 8
    assert max(trees.val_auc) == trees.val_auc[trees.best_round - 1]
    assert len(kept) == 8 or len(kept) - trees.best_round == 3
    # the margins of the loop are those of the model
    auc = E.auc_of_scores(trees.model.transform(part(separable, "val")), "label", "margin").first()["auc"]
    assert auc == pytest.approx(trees.val_auc[-1])
    trees.model.write().overwrite().save(str(tmp_path / "trees"))
    again = boosted.BoostedTrees.load(str(tmp_path / "trees")).transform(test)
    margins = lambda df: sorted((r.doc_id, r.margin) for r in df.select("doc_id", "margin").collect())
    assert margins(again) == margins(scored)


def test_margins_are_written_anew(separable, monkeypatch, trees):
    monkeypatch.setattr(boosted, "WRITE_EVERY", 2)
    again = boosted.fit_boosted(part(separable, "train"), part(separable, "val"), eta=0.3, patience=3, rounds=8, depth=3)
    assert again.val_auc == pytest.approx(trees.val_auc)
    assert [t.feature for t in again.model.tree_list()] == [t.feature for t in trees.model.tree_list()]


def test_chunks_are_sorted_once_and_sums_hold_no_zeros(spark, monkeypatch):
    monkeypatch.setattr(boosted, "CHUNK", 16)
    rng = np.random.default_rng(5)
    rows = [(float(i % 2), sorted(rng.choice(40, 3, replace=False).tolist()), rng.integers(0, 4, 3).astype(float).tolist(), i, i % 5 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "y double, indices array<int>, values array<double>, id long, held boolean").coalesce(1)
    cuts = spark.sparkContext.broadcast((np.arange(0, 42 * 3, 3), np.tile([0.0, 1.0, 2.0], 41)))
    chunks = df.mapInArrow(boosted._to_chunks(cuts), boosted._CHUNKS).persist()
    kept = chunks.collect()
    assert all((np.diff(np.frombuffer(c["feature"], np.int32)) >= 0).all() for c in kept) and max(len(c["y"]) for c in kept) == 16 * 8
    assert sum(len(c["y"]) // 8 for c in kept if c["held"]) == 40 and sum(len(c["y"]) // 8 for c in kept) == 200
    starts = np.arange(0, 41 * 4, 4)
    tree = boosted.Tree()
    tree.leaf(0.0)
    plan = boosted._Plan(starts, np.append(np.arange(40) % 4 > 0, False), [], tree, {0: (0.0, 0.0)}, 9)
    sums = chunks.filter("not held").mapInArrow(boosted._histograms(spark.sparkContext.broadcast(plan)), boosted._SUMS).collect()
    found = np.zeros((2, 160))
    for r in sums:
        at, data = np.frombuffer(r["at"], np.int32), np.frombuffer(r["data"]).reshape(2, -1)
        assert data.shape[1] == len(at) and (data != 0).any(axis=0).all()
        found[:, at] += data
    expected = np.zeros((2, 160))
    drawn = boosted._mixed(np.arange(200), 9) < boosted.ROW_SHARE
    for y, indices, values, i, held in rows:
        for f, v in zip(indices, values):
            if not held and drawn[i] and f % 4:
                expected[:, f * 4 + int(v)] += 0.5 - y, 0.25
    assert np.allclose(found, expected)
    chunks.unpersist()


def test_boosting_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(boosted, "CHUNK", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 1, 240) > 0).astype(int)
    rows = [(i, int(y[i]), Vectors.dense(x[i])) for i in range(240)]
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    sizes, grow = [], boosted._grow

    def counted(chunks, *args):
        sizes.append([r["n"] for r in chunks.groupBy(F.spark_partition_id()).agg(F.sum(F.length("y") / 8).alias("n")).collect()])
        return grow(chunks, *args)

    monkeypatch.setattr(boosted, "_grow", counted)
    found = [boosted.fit_boosted(part, part, eta=0.3, patience=9, rounds=3, depth=2, key="doc_id") for part in (df.coalesce(1), df.repartition(3), df.repartition(40))]
    trees = [[(t.feature, t.bin) for t in f.model.tree_list()] for f in found]
    assert trees[1:] == trees[:1] * 2 and all(f.val_auc == pytest.approx(found[0].val_auc) for f in found)
    cores = spark.sparkContext.defaultParallelism
    assert all(len(s) == cores and max(s) <= 2 * 240 / cores for s in sizes)


def test_trees_beyond_the_stop_are_dropped(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, i % 2, Vectors.dense(rng.normal(size=3))) for i in range(80)], ["doc_id", "label", "features"])
    scores = iter([0.6, 0.9, 0.8, 0.7, 0.6, 0.99, 0.99])
    monkeypatch.setattr(boosted.BinaryClassificationEvaluator, "evaluate", lambda self, df: next(scores))
    found = boosted.fit_boosted(df, df, patience=2, rounds=7, depth=1, key="doc_id")
    assert found.val_auc == [0.6, 0.9, 0.8, 0.7] and found.best_round == 2 and len(found.model.tree_list()) == 4
    scores = iter([0.6, 0.9, 0.8, 0.9])
    found = boosted.fit_boosted(df, df, patience=2, rounds=3, depth=1, key="doc_id", keep="best")
    assert found.val_auc == [0.6, 0.9, 0.8] and len(found.model.tree_list()) == 2


@pytest.mark.parametrize("seed", range(4))
def test_best_split_equals_trying_all(seed):
    rng = np.random.default_rng(seed)
    n, width, bins = 60, 5, 4
    x = np.where(rng.random((n, width)) < 0.4, -1, rng.integers(0, bins, (n, width)))  # -1: absent
    g, h = rng.normal(size=n), rng.random(n) + 0.1
    starts = np.arange(0, (width + 1) * bins, bins)
    first, second = np.zeros(width * bins), np.zeros(width * bins)
    for f in range(width):
        for row in np.flatnonzero(x[:, f] >= 0):
            first[starts[f] + x[row, f]] += g[row]
            second[starts[f] + x[row, f]] += h[row]

    def score(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + boosted.LAMBDA)

    best = 0.0
    for f in range(width):
        for at in range(bins):
            for absent_left in (False, True):
                left = (x[:, f] >= 0) & (x[:, f] <= at) | (absent_left & (x[:, f] < 0))
                if min(h[left].sum(), h[~left].sum()) >= boosted.LEAST_WEIGHT:
                    best = max(best, score(left) + score(~left) - score(np.full(n, True)))
    gain, f, at, absent_left, lg, lh = boosted.best_split(first, second, starts, g.sum(), h.sum())
    left = (x[:, f] >= 0) & (x[:, f] <= at) | (absent_left & (x[:, f] < 0))
    assert gain == pytest.approx(best) and lg == pytest.approx(g[left].sum()) and lh == pytest.approx(h[left].sum())


def test_absent_features_follow_the_learned_side(spark):
    rows = []
    for i in range(200):
        kind = i % 4  # absent or low: 1; high: 0
        vector = Vectors.sparse(3, {0: 0.2 + i / 1000, 1: 1.0}) if kind == 0 else Vectors.sparse(3, {1: 1.0}) if kind == 1 else Vectors.sparse(3, {0: 0.8 + i / 1000, 2: 1.0})
        rows.append((i, int(kind < 2), vector))
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    found = boosted.fit_boosted(df, df, eta=0.5, patience=2, rounds=4, depth=2, key="doc_id")
    assert found.val_auc[-1] == 1.0
    scored = found.model.transform(df.withColumn("features", F.col("features"))).collect()
    assert all((r.score > 0.5) == (r.label == 1) for r in scored)


def test_rows_that_cannot_be_boosted(spark):
    df = spark.createDataFrame([(i, 1, Vectors.sparse(3, {})) for i in range(5)], ["doc_id", "label", "features"])
    found = boosted.fit_boosted(df, df.limit(0), patience=1, rounds=5)
    assert len(found.model.tree_list()) == 2 and all(len(t.feature) == 1 for t in found.model.tree_list())
    assert boosted.split_count_importance(found.model, df, ["a", "b", "c"]).count() == 0


def test_importance_counts_every_split(separable, trees):
    names = [f"f{i}" for i in range(WIDTH)]
    rows = boosted.split_count_importance(trees.model, separable, names).collect()
    assert sum(r["importance"] for r in rows) == sum(f >= 0 for t in trees.model.tree_list() for f in t.feature)
    assert rows == sorted(rows, key=lambda r: (-r["importance"], r["keyword"]))
    assert rows[0]["keyword"] in names


def plain_hinge(rows, alpha, epochs, order):
    """Stochastic descent of one model, row by row: weights, intercept and mean loss of the last epoch."""
    w, b, t, first = np.zeros(WIDTH), 0.0, 0, 1 / (alpha ** -0.25 * alpha)
    for _ in range(epochs):
        loss = 0.0
        for y, x in order(rows):
            step = 1 / (alpha * (first + t))
            margin = y * (w @ x + b)
            loss += max(0.0, 1 - margin)
            w *= max(0.0, 1 - step * alpha)
            if margin <= 1:
                w += step * y * x
                b += 0.01 * step * y
            t += 1
    return w, b, loss / len(rows)


def test_svm_grid_equals_plain_descent(separable, spark):
    train = part(separable, "train")
    rows = train.select("doc_id", "label", "features", F.xxhash64(F.lit(42), "doc_id").alias("o")).orderBy("o").collect()
    given = [(1 if r.label else -1, r.features.toArray()) for r in rows]
    # tol below any loss: the last epoch is the given one
    grid = linear.fit_svm_grid(train, "doc_id", (0.001, 0.003), folds=3, max_iter=4, tol=-1e9)
    assert grid.epochs == 4
    w, b, _ = plain_hinge(given, grid.best_alpha, 4, list)
    assert np.allclose(grid.model.getOrDefault("coefficients"), w) and grid.model.getOrDefault("intercept") == pytest.approx(b)
    # folds: every third row by hash within the label
    place = {r.doc_id: k % 3 for k, r in enumerate(sorted(rows, key=lambda r: (r.label, r.o)))}
    for alpha, accuracy in grid.accuracies:
        shares = []
        for fold in range(3):
            kept = [g for g, r in zip(given, rows) if place[r.doc_id] != fold]
            w, b, _ = plain_hinge(kept, alpha, 4, list)
            out = [g for g, r in zip(given, rows) if place[r.doc_id] == fold]
            shares.append(np.mean([(w @ x + b > 0) == (y > 0) for y, x in out]))
        assert accuracy == pytest.approx(np.mean(shares))


def test_svm_grid_stops_learns_and_reloads(separable, tmp_path, monkeypatch):
    from wardlens.sources.files import save_model

    for shard_rows in (linear.SHARD_ROWS, 30):
        monkeypatch.setattr(linear, "SHARD_ROWS", shard_rows)
        grid = linear.fit_svm_grid(part(separable, "train"), "doc_id", linear.ALPHAS, folds=5)
        assert grid.best_alpha in linear.ALPHAS and len(grid.accuracies) == 30 and grid.epochs < 300
        scored = grid.model.transform(part(separable, "test"))
        assert E.scores(scored).first()["accuracy"] > 0.9
    # the same result however the rows lie
    again = linear.fit_svm_grid(part(separable, "train").repartition(5), "doc_id", linear.ALPHAS, folds=5)
    assert np.allclose(again.model.getOrDefault("coefficients"), grid.model.getOrDefault("coefficients"), rtol=0, atol=1e-9)
    assert again.accuracies == grid.accuracies
    save_model(grid.model, str(tmp_path / "svm"))
    loaded = linear.HingeModel.load(str(tmp_path / "svm")).transform(part(separable, "test"))
    key = lambda df: sorted((r["doc_id"], r["margin"], r["prediction"]) for r in df.select("doc_id", "margin", "prediction").collect())
    assert key(scored) == key(loaded)


def test_svm_shards_and_models_are_dealt_evenly(separable, spark, monkeypatch):
    train = separable.filter(F.col("split") != "test")
    cores = spark.sparkContext.defaultParallelism
    averaged, dealt = linear._averaged, []

    def counted(packed, *args):
        if not dealt or dealt[-1][0] is not packed:
            dealt.append((packed, [r["n"] for r in packed.groupBy(F.spark_partition_id()).agg(F.count_distinct("shard").alias("n")).collect()]))
        return averaged(packed, *args)

    monkeypatch.setattr(linear, "_averaged", counted)
    monkeypatch.setattr(linear, "LEAST_MODELS", 1, raising=False)
    monkeypatch.setattr(linear, "SHARD_ROWS", 200 // (2 * cores))
    linear.fit_svm_grid(train, "doc_id", (0.001, 0.01), folds=3, max_iter=2)
    # of the more shards than tasks, none gets two more than another
    assert len(dealt[0][1]) == 2 * cores and max(dealt[0][1]) - min(dealt[0][1]) <= 1
    monkeypatch.setattr(linear, "SHARD_ROWS", 200)
    several = linear.fit_svm_grid(train, "doc_id", (0.001, 0.01), folds=3, max_iter=9)
    monkeypatch.setattr(linear, "LEAST_MODELS", 100)
    alone = linear.fit_svm_grid(train, "doc_id", (0.001, 0.01), folds=3, max_iter=9)
    assert [len(d[1]) for d in dealt[1:]] == [min(cores, 8), 1]
    assert several.accuracies == alone.accuracies and several.epochs == alone.epochs
    assert np.allclose(several.model.getOrDefault("coefficients"), alone.model.getOrDefault("coefficients"))


def test_rows_are_numbered(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "v long, k long").repartition(6)
    rows = numbered(df, F.desc("v")).collect()
    assert all(r["rank"] == 999 - r.v for r in rows) and len(rows) == 1000


def plain_tree(x, y, w, rows, depth, min_leaf, out):
    """Labels by the tree of the greatest falls of impurity, every split tried."""
    def impurity(some):
        a, b = (w[some & (y == c)].sum() for c in (0, 1))
        return 2 * a * b / (a + b) if a + b > 0 else 0.0

    out[rows] = w[rows & (y == 1)].sum() > w[rows & (y == 0)].sum()
    best = (1e-12, None)
    if depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                left = rows & (x[:, f] <= t)
                right = rows & ~left
                if min(left.sum(), right.sum()) >= min_leaf:
                    best = max(best, (impurity(rows) - impurity(left) - impurity(right), (f, t)), key=lambda b: b[0])
    if best[1]:
        left = rows & (x[:, best[1][0]] <= best[1][1])
        for side in (left, rows & ~left):
            plain_tree(x, y, w, side, depth - 1, min_leaf, out)
    return out


def sparse_rows(seed, n=60, width=5):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.5, 0.0, rng.integers(-3, 4, (n, width)) / 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] < 0) ^ (rng.random(n) < 0.2)).astype(np.int8)
    return x, y, rng.random(n)


def as_rows(x):
    kept = [np.flatnonzero(r) for r in x]
    return adaboost._Rows(np.array([len(k) for k in kept]), np.concatenate(kept), np.concatenate([r[k] for r, k in zip(x, kept)]))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("depth,min_leaf", [(1, 1), (2, 5), (4, 2), (10, 1)])
def test_adaboost_trees_equal_trying_all_splits(seed, depth, min_leaf):
    x, y, w = sparse_rows(seed)
    learns = np.arange(len(y)) % 4 != seed % 4
    w = np.where(learns, w, 0) / w[learns].sum()
    rows = as_rows(x)
    tree, labels = adaboost._Grower(rows, y, learns, min_leaf).grow(w, depth)
    plain = plain_tree(x, y, w, learns, depth, min_leaf, np.zeros(len(y), np.int8))
    assert (labels[learns] == plain[learns]).all()
    # the tree applied to any row gives what it gave while it grew
    assert (rows.labels(tree)[learns] == labels[learns]).all()
    for k, row in enumerate(x):
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] if row[tree.feature[at]] <= tree.threshold[at] else tree.right[at]
        assert tree.label[at] == rows.labels(tree)[k]


def plain_boost(x, y, learns, depth, min_leaf, rounds, rate):
    """Margins of the rows after every round, by the plain algorithm; rows left out are not labelled by it."""
    w, margin, out = np.where(learns, 1 / learns.sum(), 0.0), np.zeros(len(y)), []
    for _ in range(rounds):
        labels = plain_tree(x, y, w, learns, depth, min_leaf, np.zeros(len(y), np.int8))
        error = w[learns & (labels != y)].sum()
        if error >= 0.5:
            break
        alpha = rate * np.log((1 - error) / error) if error > 0 else 1.0
        margin = margin + alpha * (2.0 * labels - 1)
        out.append(margin)
        if error <= 0:
            break
        w = w * np.where(labels != y, np.exp(alpha), 1)
        w /= w.sum()
    return out


def test_adaboost_equals_the_plain_algorithm(spark):
    x, y, _ = sparse_rows(11, n=80)
    df = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i]) if i % 2 else Vectors.sparse(5, {int(j): float(x[i][j]) for j in np.flatnonzero(x[i])})) for i in range(80)], ["doc_id", "label", "features"]).repartition(3)
    model = adaboost.fit_adaboost(df, "doc_id", depth=2, min_leaf=4, rounds=7, rate=0.5)
    expected = plain_boost(x, y, np.full(80, True), 2, 4, 7, 0.5)
    for rounds in (1, 3, 7):
        found = {r.doc_id: r.margin for r in adaboost.predict_adaboost(model, df, rounds).collect()}
        assert np.allclose([found[i] for i in range(80)], expected[min(rounds, len(expected)) - 1])


def test_adaboost_grid_counts_held_out_rows(spark):
    x, y, _ = sparse_rows(5, n=90)
    df = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(90)], ["doc_id", "label", "features"]).repartition(4)
    model, table = adaboost.fit_adaboost_grid(df, "doc_id", (1, 3), (3,), (2, 6), (0.1, 1.0), folds=3)
    found = {(r.depth, r.min_leaf, r.rounds, r.rate): r.accuracy for r in table.collect()}
    assert len(found) == 8
    order = df.select("doc_id", "label", F.xxhash64(F.lit(42), "doc_id").alias("o")).orderBy("label", "o").collect()
    fold = np.zeros(90, int)
    for k, r in enumerate(order):
        fold[r.doc_id] = k % 3
    shares = {c: [] for c in found}
    for out in range(3):
        part = df.join(spark.createDataFrame([(i,) for i in range(90) if fold[i] != out], "doc_id long"), "doc_id")
        for depth, min_leaf, rate in {(c[0], c[1], c[3]) for c in found}:
            fitted = adaboost.fit_adaboost(part, "doc_id", depth, min_leaf, 6, rate)
            rows = as_rows(x)
            margin, after = np.zeros(90), []
            for tree, alpha in fitted.member_list()[0]:
                margin = margin + alpha * (2.0 * rows.labels(tree) - 1)
                after.append(((margin > 0) == y)[fold == out].mean())
            for rounds in (2, 6):
                shares[depth, min_leaf, rounds, rate].append(after[min(rounds, len(after)) - 1])
    assert all(found[c] == pytest.approx(np.mean(shares[c])) for c in found)
    best = max(found.values())
    assert len(model.member_list()[0]) <= 6 and best > 0.6


def test_adaboost_learns_in_shards_and_reloads(separable, tmp_path, monkeypatch):
    train, test = part(separable, "train"), part(separable, "test")
    monkeypatch.setattr(adaboost, "SHARD_ROWS", 40)
    model = adaboost.fit_adaboost(train, "doc_id", depth=1, min_leaf=2, rounds=6, rate=0.5)
    assert len(model.member_list()) == 3 and all(1 <= len(m) <= 6 for m in model.member_list())
    scored = adaboost.predict_adaboost(model, test)
    assert E.scores(scored).first()["accuracy"] > 0.9
    again = adaboost.fit_adaboost(train.repartition(5), "doc_id", depth=1, min_leaf=2, rounds=6, rate=0.5)
    assert again.member_list() == model.member_list()
    model.write().overwrite().save(str(tmp_path / "committee"))
    key = lambda df: sorted((r.doc_id, r.margin, r.prediction) for r in df.select("doc_id", "margin", "prediction").collect())
    assert key(adaboost.AdaBoostModel.load(str(tmp_path / "committee")).transform(test)) == key(scored)


def test_adaboost_learns_from_all_rows_together_whatever_their_number(spark):
    n = 17_000
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (n, 2)).astype(float)
    y = ((x[:, 0] + 0.3 * x[:, 1] + rng.normal(0, 1, n)) > 0).astype(np.int8)
    df = spark.createDataFrame([(i, int(y[i]), Vectors.dense(x[i])) for i in range(n)], ["doc_id", "label", "features"]).repartition(4)
    model = adaboost.fit_adaboost(df, "doc_id", depth=2, min_leaf=4, rounds=3, rate=0.5)
    assert len(model.member_list()) == 1
    found = {r.doc_id: r.margin for r in adaboost.predict_adaboost(model, df).collect()}
    assert np.allclose([found[i] for i in range(n)], plain_boost(x, y, np.full(n, True), 2, 4, 3, 0.5)[-1])


@pytest.mark.parametrize("seed,rate", [(1, 0.01), (2, 0.1), (3, 0.5)])
def test_adaboost_rounds_that_remember_equal_rounds_that_do_not(seed, rate, monkeypatch):
    for name, value in (("SMALL", 4), ("FIRST", 1), ("BLOCKS", 8), ("KEPT_TURNS", 2)):
        monkeypatch.setattr(adaboost, name, value)
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((150, 40)) < 0.4, rng.normal(size=(150, 40)).round(1), 0.0)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.7, 150)) > 0.2).astype(np.int8)
    learns, rows = np.arange(150) % 5 != 0, as_rows(x)
    grower, read = adaboost._Grower(rows, y, learns, 3), []
    bounds = adaboost._Layout.bounds
    monkeypatch.setattr(adaboost._Layout, "bounds", lambda *args: read.append(1) or bounds(*args))
    found = list(adaboost._boost(rows, grower, y, 4, 30, rate))
    often = len(read)
    w, expected = np.where(learns, 1 / learns.sum(), 0.0), plain_boost(x, y, learns, 4, 3, 30, rate)
    assert len(found) == len(expected)
    margin = np.zeros(150)
    read.clear()
    for (tree, alpha), plain in zip(found, expected):
        assert grower.grow(w, 4)[0] == tree
        margin = margin + alpha * (2.0 * rows.labels(tree) - 1)
        assert np.allclose(margin[learns], plain[learns])
        missed = learns & (rows.labels(tree) != y)
        w = w * np.where(missed, np.exp(alpha), 1)
        w /= w.sum()
    assert often < len(read)


def test_adaboost_bounds_hold_and_a_task_has_one_fit(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((200, 12)) < 0.5, rng.normal(size=(200, 12)), 0.0)
    y, w = rng.integers(0, 2, 200), rng.random(200)
    grower = adaboost._Grower(as_rows(x), y, np.full(200, True), 2)
    for rows in (np.arange(200), np.arange(0, 200, 3)):
        node = adaboost._Node(rows, grower.all)
        one, zero = w * y, w * (1 - y)
        bounds = grower.all.bounds(rows, 200, zero, one)
        level, sides = grower._level(node), grower.all.side.tolist()
        total = one[rows].sum(), zero[rows].sum()
        for place, gain in zip(level.first, level.gains(zero, one, total[1], total[0])):
            assert gain * adaboost.LEAST_GAIN <= bounds[sides.index(level.side[place])] * sum(total)
    df = spark.range(60).select(F.col("id"), (F.col("id") % 12).cast("int").alias("task"))
    run = lambda table: table.group_by("task").aggregate([("id", "count")]).rename_columns(["task", "n"]).append_column("k", [[len(set(table["task"].to_pylist()))]])
    assert [tuple(r) for r in adaboost._by_task(df, 13, "task", run, "task int, n long, k long").collect()] == [(k, 5, 1) for k in range(12)]


def test_adaboost_of_odd_rows(spark):
    rows = [(1, 1, Vectors.sparse(3, {})), (1, 1, Vectors.sparse(3, {})), (2, None, Vectors.sparse(3, {0: float("nan")})), (None, 1, Vectors.dense([0, 0, 0])), (3, 1, None)]
    schema = spark.createDataFrame([(0, 0, Vectors.sparse(3, {}))], ["doc_id", "label", "features"]).schema
    df = spark.createDataFrame(rows, schema)
    model = adaboost.fit_adaboost(df, "doc_id", rounds=3)
    assert all(t.feature == [-1] and t.label == [1] for t, _ in model.member_list()[0])
    whole = df.filter(F.col("features").isNotNull())
    assert {r.prediction for r in adaboost.predict_adaboost(model, whole).collect()} == {1}
    assert adaboost.predict_adaboost(model, whole.limit(0)).count() == 0
    with pytest.raises(ValueError):
        adaboost.fit_adaboost(df.limit(0), "doc_id")


def test_head_learns_in_shards_and_reloads(separable, tmp_path, monkeypatch):
    rows = separable.withColumn("vec", vector_to_array("features"))
    train, val, test = (part(rows, s) for s in ("train", "val", "test"))
    for shard_rows in (head.SHARD_ROWS, 40):
        monkeypatch.setattr(head, "SHARD_ROWS", shard_rows)
        model = head.fit_mlp_head(train, "vec", WIDTH, "doc_id", hidden=16, epochs=8, rate=0.02, validation=val)
        assert E.scores(head.predict_mlp_head(model, test)).first()["accuracy"] > 0.9
    again = head.fit_mlp_head(train.repartition(5), "vec", WIDTH, "doc_id", hidden=16, epochs=8, rate=0.02, validation=val)
    assert np.allclose(again.getOrDefault("weights"), model.getOrDefault("weights"), rtol=0, atol=1e-9)
    model.write().overwrite().save(str(tmp_path / "head"))
    key = lambda df: sorted((r.doc_id, r.score, r.prediction) for r in df.select("doc_id", "score", "prediction").collect())
    assert key(head.HeadModel.load(str(tmp_path / "head")).transform(test)) == key(model.transform(test))


def test_head_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    layers = head.start_layers(4, 5, 1)
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 2, 7)
    inputs, units = (rng.random((7, 4)) >= 0.5) / 0.5, (rng.random((7, 5)) >= 0.3) / 0.7
    _, slopes = head.gradients(layers, x, y, inputs, units)
    for array, slope in zip(layers, slopes):
        for place in np.ndindex(array.shape):
            kept, losses = array[place], []
            for move in (1e-6, -1e-6):
                array[place] = kept + move
                losses.append(head.gradients(layers, x, y, inputs, units)[0])
            array[place] = kept
            assert slope[place] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-7)
    # without dropout the loss is that of the scores
    loss, _ = head.gradients(layers, x, y, 1.0, 1.0)
    score = head.forward(layers, x)
    assert loss == pytest.approx(-np.log(np.where(y == 1, score, 1 - score)).mean())


def test_head_of_odd_rows(spark):
    schema = "doc_id long, label int, vec array<double>"
    rows = [(1, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, None, [float("nan"), float("inf")]), (None, 0, [0.0, 1.0]), (3, 1, None), (4, 1, [1.0]), (5, 0, [None, 1.0])]
    df = spark.createDataFrame(rows, schema)
    model = head.fit_mlp_head(df, "vec", 2, "doc_id", hidden=4, epochs=2)
    scored = head.predict_mlp_head(model, df).collect()
    assert len(scored) == 7 and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (2, 3, 4, 5)}) == 1
    assert head.predict_mlp_head(model, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        head.fit_mlp_head(df.limit(0), "vec", 2, "doc_id")


def test_topics_are_shares_and_repeat(spark):
    df = spark.createDataFrame([(i, "heart valve heart" if i % 2 else "lung cough lung") for i in range(40)], "doc_id long, text string")
    words = ["cough", "heart", "lung", "valve"]
    tokens = S.vector_tokens("text")
    model = topics.fit_topics(df, tokens, words, 2, passes=3, batches_per_pass=2)
    weights = {r["doc_id"]: r["vec"] for r in topics.topic_weights(model, df, "doc_id", tokens).collect()}
    assert all(sum(w) == pytest.approx(1) for w in weights.values())
    table = topics.topic_words(model).collect()
    assert len(table) == 8 and {r["keyword"] for r in table} == set(words)
    ranks = [(r["topic"], -r["importance"], r["keyword"]) for r in table]
    assert ranks == sorted(ranks)


def test_experiment_and_sweep(spark):
    texts = {1: "heart failure edema lasix", 0: "knee pain fracture cast"}
    rows = [(i, f"{texts[i % 2]} w{i % 7}", i % 2, ("train", "train", "train", "val", "test")[i // 2 % 5]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, split string")
    config = X.Config(max_features=20, topics=2, rounds=3, topic_passes=1, topic_batches=2, alphas=(0.001,), svm_iterations=5)
    table = X.sweep(docs, ["heart", "knee"], [config])
    row = table.first()
    assert row["boosted_accuracy"] == 1.0 and row["svm_accuracy"] == 1.0
    assert E.best_config(table, X.METRICS).first()["config"] == 0


def test_independent_fits_go_side_by_side(spark, monkeypatch):
    # each waits for the other, so that one after the other would never end
    both = threading.Barrier(2, timeout=20)
    fit, grid = boosted.fit_boosted, linear.fit_svm_grid
    monkeypatch.setattr(boosted, "fit_boosted", lambda *a, **k: (both.wait(), fit(*a, **k))[1])
    monkeypatch.setattr(linear, "fit_svm_grid", lambda *a, **k: (both.wait(), grid(*a, **k))[1])
    rows = [(i, f"{('heart edema', 'knee cast')[i % 2]} w{i % 7}", i % 2, ("train", "train", "val", "test")[i // 2 % 4]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, split string")
    config = X.Config(max_features=20, topics=2, rounds=1, topic_passes=1, topic_batches=2, alphas=(0.001,), svm_iterations=2)
    alone = X.run_experiment(docs, ["heart"], config)
    assert set(alone) == set(X.METRICS)
    runs = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(X, "run_experiment", lambda docs, terms, config, *_: (runs.wait(), dict.fromkeys(X.METRICS, float(config.topics)))[1])
    table = X.sweep(docs, ["heart"], [X.Config(topics=3), X.Config(topics=4)])
    assert [(r["config"], r["topics"], r["svm_f1"]) for r in sorted(table.collect())] == [(0, 3, 3.0), (1, 4, 4.0)]


def test_a_document_in_pieces_is_one_row_of_the_matrix(spark):
    whole = [(i, "heart knee lung " * 2 + f"w{i % 3}", i % 2, "train") for i in range(10)]
    cut = [(i, part, label, split) for i, text, label, split in whole for part in (text[:16], text[16:])]
    config = X.Config(max_features=10, topics=2, topic_passes=1, topic_batches=1)
    schema = "doc_id long, text string, label int, split string"
    found = []
    for rows in (whole, cut):
        matrix = X.build_matrix(spark.createDataFrame(rows, schema), ["heart", "knee"], config)
        keep = [i for i, name in enumerate(matrix.names) if not name.startswith("LDA_")]
        values = {r["doc_id"]: [round(r["features"].toArray()[i], 9) for i in keep] for r in matrix.rows.collect()}
        assert matrix.rows.count() == 10
        found.append(values)
    assert found[0] == found[1]


def test_registered_queries_use_the_reference_settings(monkeypatch):
    from wardlens.plans import model_queries as Q

    c = Q.CONFIG
    assert (c.max_features, c.rounds, c.topic_passes, c.svm_iterations, len(c.alphas)) == (10_000, 100, 10, 1000, 30)
    seen = {}

    class Stop(Exception):
        pass

    def stop(name):
        def call(*args, **named):
            seen[name] = args[1:], named
            raise Stop

        return call

    monkeypatch.setattr(Q, "cleaned", lambda spark, sf: "docs")
    monkeypatch.setattr(Q, "vectors", lambda spark, sf: "vectors")
    for name in ("run_experiment", "sweep", "sweep_and_rerun"):
        monkeypatch.setattr(X, name, stop(name))
    for build in (Q.experiment_metrics, Q.tuning_sweep, Q.tuning_rerun):
        with pytest.raises(Stop):
            build(None, "")
    assert seen["run_experiment"][0][1:3] == (X.SWEEP[0], "vectors")
    assert seen["sweep"][0][1:3] == seen["sweep_and_rerun"][0][1:3] == (X.SWEEP, "vectors")


def test_topics_are_fitted_without_the_rest_of_the_matrix(spark, monkeypatch):
    from wardlens.plans import model_queries as Q

    rows = [(i, ["heart valve heart pump", "knee joint bone knee"][i % 2] + f" word{i % 7}", i % 2, ("train", "val", "test")[i % 3]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, split string")
    config = X.Config(max_features=8, topics=2, topic_passes=1, topic_batches=2)
    whole = X.build_matrix(docs, ["heart"], config)
    alone = X.fit_topic_model(docs, config)
    assert alone.counter.vocabulary == whole.topic_model.counter.vocabulary and alone.k == 2
    assert alone.lda.topicsMatrix().toArray().shape == whole.topic_model.lda.topicsMatrix().toArray().shape
    again = X.build_matrix(docs, ["heart"], config, topic_model=alone)
    assert again.topic_model is alone and again.names == whole.names
    # a query of the topics builds no matrix
    monkeypatch.setattr(Q, "_SHARED", {})
    monkeypatch.setattr(Q, "_state", lambda spark, sf: 0)
    monkeypatch.setattr(Q, "cleaned", lambda spark, sf: docs)
    monkeypatch.setattr(Q, "CONFIG", config)
    monkeypatch.setattr(X, "build_matrix", None)
    monkeypatch.setattr(Q, "vectors", None)
    assert Q.topic_features(spark, "").count() == 30 * 2
    assert {r["topic"] for r in Q.topic_words(spark, "").collect()} == {"LDA_0", "LDA_1"}


def test_registered_adaboost_grid_is_whole(spark, monkeypatch):
    from wardlens.plans import model_queries as Q

    docs = spark.createDataFrame([(i, f"heart w{i}", i % 2, "train") for i in range(12)], "doc_id long, text string, label int, split string")
    seen = []
    monkeypatch.setattr(Q, "cleaned", lambda spark, sf: docs)
    monkeypatch.setattr(adaboost, "fit_adaboost_grid", lambda rows, *args, **named: seen.append((rows, args, named)) or (None, None))
    monkeypatch.setattr(Q.CONFIG.__class__, "max_features", 5)
    Q.adaboost_grid(spark, "")
    rows, args, named = seen[0]
    assert args[1:] == ((2, 4, 6, 8, 10), (5, 10), (10, 50, 250, 1000), (0.001, 0.01, 0.1)) and not named
    assert rows.first()["features"].size == 13
