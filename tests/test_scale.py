"""What moves: tokens stay with their document, lookup tables travel, repeats go before a join."""

import random

import pytest
from pyspark.sql import functions as F

from wardlens.functions import scalars as S
from wardlens.operators import text as T
from wardlens.operators import vectors as W
from wardlens.session import keyed


@pytest.fixture
def unsure(spark):
    """The optimizer broadcasts nothing of its own, as for tables whose size it overestimates."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "c"), (3, ""), (4, None)], "doc_id long, text string")


def vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("n", None)]
    return spark.createDataFrame(rows, "token string, vec array<float>")


def test_padded_sequences_move_texts_only(unsure):
    sequence = W.token_vectors(keyed(docs(unsure), "doc_id"), "doc_id", "text", vectors(unsure), 2, 4)
    padded = W.pad_sequences(sequence, "doc_id", 4, 2)
    assert plan(padded).count("Exchange hashpartitioning") == 1
    assert {r["doc_id"]: r["n_tokens"] for r in padded.collect()} == {1: 5, 2: 1}


@pytest.mark.parametrize("mode", ["padded", "tokens"])
def test_average_moves_texts_only(unsure, mode):
    averaged = W.average_embedding(keyed(docs(unsure), "doc_id"), "doc_id", "text", vectors(unsure), 2, mode=mode)
    # the texts for the words, for the documents and for the longest one
    assert plan(averaged).count("Exchange hashpartitioning") <= 3
    assert "hashpartitioning(token" not in plan(averaged)
    n = 3 if mode == "padded" else 5
    found = {r["doc_id"]: r["vec"] for r in averaged.collect()}
    assert found[1] == pytest.approx([2 / n, 4 / n])
    assert found[2] == found[3] == found[4] == [0.0, 0.0]


def test_lookup_falls_back_to_a_join_by_token(unsure):
    positions = T.token_positions(docs(unsure), "doc_id", S.words("text"))
    table = vectors(unsure).select("token", F.col("token").alias("word"))
    small, large = (T.lookup_tokens(positions, "doc_id", table, most=m) for m in (10, 0))
    assert "BroadcastHashJoin" in plan(small) and "BroadcastHashJoin" not in plan(large)
    known = [sorted(r["word"] for r in df.filter("word is not null").collect()) for df in (small, large)]
    assert known == [["a", "a", "b", "b"]] * 2


def test_common_length_is_that_of_the_expression(spark):
    rng = random.Random(3)
    rows = [tuple("".join(rng.choices("abé𝄞", k=rng.randrange(9))) for _ in "ab") for _ in range(60)] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    common = S.common_subsequence_lengths("a", "b")
    for r in df.select(common.alias("x"), S.common_subsequence_length("a", "b").alias("y"), S.ratio_of(common, "a", "b").alias("r"), S.fuzzy_ratio("a", "b").alias("s")).collect():
        assert (r["x"], r["r"]) == (r["y"], r["s"])


def test_brand_similarity_joins_distinct_rows(spark, tmp_path):
    from wardlens.plans.text_queries import brand_similarity

    part = spark.createDataFrame([("ab", 1)] * 30 + [("cd", 2)], "p_type string, p_size int")
    supplier = spark.createDataFrame([("abd", 1)] * 30, "s_name string, s_nationkey int")
    part.write.parquet(f"{tmp_path}/part.parquet")
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    found = brand_similarity(spark, str(tmp_path))
    assert found.collect() == [("ab", "abd", 2, 80)]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert below.count("Aggregate") == 2


def test_a_task_sums_its_shards(spark):
    """What an epoch moves is a set of blocks a task, not one a shard; the sum is the same."""
    import numpy as np
    import pyarrow as pa

    from wardlens.models import linear

    alphas = np.array([0.01, 0.001])
    models = linear._Models(np.zeros((3, 2)), np.zeros(2), np.zeros(2, np.int64), alphas, np.array([-1, -1]))
    sent = type("Sent", (), {"value": models})()

    def batch(*shards):
        n = len(shards)
        return pa.RecordBatch.from_arrays(
            [pa.array(shards), pa.array([1.0, -1.0, 1.0, -1.0][:n]), pa.array([0] * n), pa.array([[0, 2]] * n), pa.array([[0.5, 1.0]] * n)],
            names=["shard", "y", "fold", "indices", "values"],
        )

    run = lambda b: {r["block"]: (r["rows"], np.frombuffer(r["data"])) for out in linear._epoch(sent)([b]) for r in out.to_pylist()}
    both, one = run(batch(0, 0, 7, 7)), run(batch(0, 0))
    assert sorted(both) == [-1, 0] and both[0][0] == 4
    assert np.allclose(both[0][1], 2 * one[0][1])
