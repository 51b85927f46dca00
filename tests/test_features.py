import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import lcs

from wardlens.functions import scalars as S
from wardlens.operators import eda as G
from wardlens.operators import features as V
from wardlens.operators import vectors as W
from wardlens.sources.tables import read_table

DOCS = [(1, "heart failure heart"), (2, "failure of the lung"), (3, "lung lung lung heart")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def counts_of(docs):
    return V.token_counts(docs, "doc_id", S.vector_tokens("text"))


def test_weights_against_a_plain_computation(docs):
    counts = counts_of(docs)
    vocab = V.tfidf_fit(counts, V.document_count(docs, "doc_id"), 10)
    found = {(r["doc_id"], r["token"]): r["value"] for r in V.tfidf_transform(counts, vocab, "doc_id").collect()}
    df = {"heart": 2, "failure": 2, "lung": 2}
    for doc_id, text in DOCS:
        tf = Counter(w for w in text.split() if w in df)
        raw = {t: (1 + math.log(n)) * (math.log(3 / df[t]) + 1) for t, n in tf.items()}
        length = math.sqrt(sum(w * w for w in raw.values()))
        for token, w in raw.items():
            assert found[doc_id, token] == pytest.approx(w / length)
    by_doc = Counter()
    for (doc_id, _), value in found.items():
        by_doc[doc_id] += value * value
    assert all(total == pytest.approx(1) for total in by_doc.values())


def test_vocabulary_ties_go_by_token(docs):
    rows = V.top_vocab(counts_of(docs), 2).collect()
    assert sorted((r["token"], r["idx"], r["cf"]) for r in rows) == [("heart", 0, 3), ("lung", 1, 4)]


def test_weights_do_not_depend_on_partitions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    results = []
    for n in (1, 8):
        part = docs.orderBy(F.rand(n)).repartition(n)
        counts = counts_of(part)
        vocab = V.tfidf_fit(counts, V.document_count(part, "doc_id"), 200)
        rows = V.tfidf_transform(counts, vocab, "doc_id").collect()
        results.append({(r["doc_id"], r["token"]): round(r["value"], 9) for r in rows})
    assert results[0] == results[1]


def test_band_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(i, "all " + ("half " if i < 5 else "") + ("one" if i == 0 else "")) for i in range(10)], "doc_id long, text string")
    frequencies = V.document_frequency(df, "doc_id", S.vector_tokens("text"))
    found = {r["token"] for r in V.df_band_vocab(frequencies, V.document_count(df, "doc_id"), 0.1, 0.7).collect()}
    assert found == {"half", "one"}


def test_terms_match_inside_words_and_as_patterns(spark):
    df = spark.createDataFrame([(1, "heartheart aaa"), (2, "none")], "doc_id long, text string")
    rows = V.hotspot_counts(df, "doc_id", "text", ["heart", "aa", "h.art"]).collect()
    assert {(r["doc_id"], r["term"]): r["value"] for r in rows} == {(1, "heart"): 2, (1, "aa"): 1, (1, "h.art"): 2}
    assert len(V.hotspot_counts(df, "doc_id", "text", ["heart", "aa"], keep_zeros=True).collect()) == 4


def test_fuzzy_hits_against_brute_force(spark):
    texts = {
        1: "congestive heart failure, congestive heart-failure congestve heart failure swelling",
        2: "pulmonary hypertension pulmonary hypertensin! (hypertension) hypertensionn hypertens",
        3: "",
        4: "heart",
    }
    terms = ["congestive heart failure", "hypertension", "pulmonary hypertension", "heart"]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r["doc_id"], r["term"]): r["value"] for r in V.hotspot_fuzzy(df, "doc_id", "text", terms).collect()}
    expected = Counter()
    for doc_id, text in texts.items():
        words = "".join(c for c in text if (c.isascii() and c.isalnum()) or c in "()" or c.isspace()).split()
        for term in terms:
            n = len(term.split())
            for i in range(0, len(words), n):
                chunk = " ".join(words[i:i + n])
                if round(200 * lcs(chunk, term) / (len(chunk) + len(term))) >= 95:
                    expected[doc_id, term] += 1
    assert found == dict(expected) and len(found) >= 4


@pytest.mark.parametrize(
    "text, days",
    [
        ("Admission Date: [**2101-1-5**] Discharge Date:  [**2101-01-08**]", 3),
        ("Admission Date: [**2101-1-8**] Discharge Date:  [**2101-01-05**]", 3),
        ("Admission Date: [**2101-1-5**]", 0),
        ("nothing", 0),
        ("Admission Date: [**1999-01-01**] Discharge Date: [**1999-01-09**]", 0),
        ("Admission Date: [**2101-13-45**] Discharge Date: [**2101-01-09**]", 0),
    ],
)
def test_stay_days(spark, text, days):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(V.stay_days("text")).first()[0] == days


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame([("a", [1.0, -2.0]), ("b", [3.0, 4.0])], "token string, vec array<float>")


def test_primary_vectors_win(spark, vectors):
    fallback = spark.createDataFrame([("b", [9.0, 9.0]), ("c", [5.0, 5.0])], "token string, vec array<float>")
    found = {r["token"]: list(r["vec"]) for r in W.combine_vectors(vectors, fallback).collect()}
    assert found == {"a": [1, -2], "b": [3, 4], "c": [5, 5]}
    tokens = spark.createDataFrame([("b",), ("c",), ("d",)], "token string")
    looked = {r["token"]: r["vec"] for r in W.lookup_vectors(tokens, vectors, fallback).collect()}
    assert looked == {"b": [3, 4], "c": [5, 5], "d": None}


def test_average_over_the_padded_matrix(spark, vectors):
    df = spark.createDataFrame([(1, "a b zz a"), (2, "zz"), (3, "")], "doc_id long, text string")
    padded = {r["doc_id"]: r["vec"] for r in W.average_embedding(df, "doc_id", "text", vectors, 2).collect()}
    assert padded[1] == pytest.approx([5 / 4, 0.0]) and padded[2] == [0, 0] and padded[3] == [0, 0]
    own = {r["doc_id"]: r["vec"] for r in W.average_embedding(df, "doc_id", "text", vectors, 2, mode="tokens").collect()}
    assert own[1] == pytest.approx([5 / 4, 0.0])
    cut = {r["doc_id"]: r["vec"] for r in W.average_embedding(df, "doc_id", "text", vectors, 2, cap=2).collect()}
    assert cut[1] == pytest.approx([2.0, 1.0])


def test_too_long_sequences_are_cut(spark, vectors):
    df = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    sequence = W.token_vectors(df, "doc_id", "text", vectors, 2, max_len=2)
    rows = {r["doc_id"]: [list(v) for v in r["matrix"]] for r in W.pad_sequences(sequence, "doc_id", 2, 2).collect()}
    assert rows == {1: [[1, -2], [3, 4]], 2: [[3, 4], [0, 0]]}


def test_scaling_counts_implicit_zeros_and_flattens_constants(spark):
    triples = spark.createDataFrame(
        [(1, 0, 2.0), (2, 0, 4.0), (1, 1, 7.0), (2, 1, 7.0), (3, 1, 7.0), (1, 2, -1.0), (2, 2, 1.0), (3, 2, 0.0)],
        "doc_id long, idx int, value double",
    )
    docs = spark.createDataFrame([(1, "train"), (2, "train"), (3, "train")], "doc_id long, split string")
    found = {(r["doc_id"], r["idx"]): r["value"] for r in W.min_max(triples, docs, "doc_id", width=3).collect()}
    assert found == {(1, 0): 0.5, (2, 0): 1.0, (1, 1): 0.0, (2, 1): 0.0, (3, 1): 0.0, (1, 2): 0.0, (2, 2): 1.0, (3, 2): 0.5}


def test_each_split_has_its_own_range(spark):
    triples = spark.createDataFrame([(1, 0, 2.0), (2, 0, 4.0), (3, 0, 8.0), (4, 0, 16.0)], "doc_id long, idx int, value double")
    docs = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val"), (4, "val")], "doc_id long, split string")
    own = {r["doc_id"]: r["value"] for r in W.min_max(triples, docs, "doc_id").collect()}
    assert own == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}
    by_train = {r["doc_id"]: r["value"] for r in W.min_max(triples, docs, "doc_id", fit="train").collect()}
    assert by_train == {1: 0.0, 2: 1.0, 3: 3.0, 4: 7.0}


def test_packed_vectors(spark):
    triples = spark.createDataFrame([(1, 2, 5.0), (1, 0, 1.0), (1, 1, 0.0)], "doc_id long, idx int, value double")
    docs = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    found = {r["doc_id"]: r["features"].toArray().tolist() for r in W.pack_vectors(triples, docs, "doc_id", 3).collect()}
    assert found == {1: [1, 0, 5], 2: [0, 0, 0]}


def test_outlier_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 100]], "x int")
    assert sorted(r[0] for r in G.drop_iqr_outliers(df, "x").collect()) == [1, 2, 3, 4, 5]


def test_histogram_bins(spark):
    df = spark.createDataFrame([(v,) for v in [3, 4, 12, 13, 14, 33]], "x int")
    assert {r["bin"]: (r["low"], r["n"]) for r in G.histogram(df, "x", 10).collect()} == {0: (3, 3), 1: (13, 2), 3: (33, 1)}


def test_average_by_arrays_equals_average_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    table = spark.createDataFrame([(w, [float(x) for x in rng.normal(size=4)]) for w in words], "token string, vec array<float>")
    texts = [" ".join(rng.choice([*words, "unknown", "other"], rng.integers(1, 90))) for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)] + [(60, None), (61, ""), (62, "unknown only"), (None, "w1 w2"), (None, "w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    summed = []
    monkeypatch.setattr(W, "SUMMED_TOKENS", 7, raising=False)
    by_arrays = getattr(W, "_text_sums", None)
    monkeypatch.setattr(W, "_text_sums", lambda *args: summed.append(1) or by_arrays(*args), raising=False)
    for mode in ("padded", "tokens"):
        for cap in (4000, 20):
            found = []
            for most in (10**6, 0):
                monkeypatch.setattr(W, "MOST_ARRAY_NUMBERS", most, raising=False)
                rows = W.average_embedding(df, "doc_id", "text", table, 4, cap, mode).collect()
                found.append(sorted((r.doc_id is None, r.doc_id or 0, r.vec) for r in rows))
            assert [x[:2] for x in found[0]] == [x[:2] for x in found[1]] and len(found[0]) == 54
            assert np.allclose([x[2] for x in found[0]], [x[2] for x in found[1]], rtol=0, atol=1e-12)
    assert len(summed) == 4
    # a vector that is not whole, or a word that comes twice, is left to the join
    monkeypatch.setattr(W, "MOST_ARRAY_NUMBERS", 10**6, raising=False)
    for odd in ([("w1", [1.0, None, 1.0, 1.0])], [("w1", [1.0] * 4), ("w1", [2.0] * 4)]):
        W.average_embedding(df, "doc_id", "text", spark.createDataFrame(odd, "token string, vec array<float>"), 4, 20).collect()
    assert len(summed) == 4
