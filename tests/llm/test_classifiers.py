"""Quality, language and toxicity: odd input, exactness of the decoders, accuracy on the held-out fold."""

import itertools
import zlib

import numpy as np
import pytest

from wardlens.llm import langid, quality, toxicity
from wardlens.llm.queries import QUERIES

BIG = "/root/testdata/sf0.01"


def remainder(i, folds):
    return zlib.crc32(str(i).encode()) % folds


ODD = [(1, None, None), (2, "", "en"), (3, "123 ?!", "en"), (3, "123 ?!", "en"), (None, "word", None), (4, "x" * 200_000, "fr"), (5, "a " * 50_000, "en"), (6, "²½ _", "en")]


def odd(spark):
    return spark.createDataFrame([(*r, "l", 0.5) for r in ODD], "doc_id long, text string, lang string, label string, score double")


def labels(spark, column):
    rows = [(1, 1), (2, 0), (3, 1), (3, 0), (5, None), (None, 1), (7, 0)]
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths, k = [1, 4, 2, 5], 3
    e, t, s = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p, pairs = langid.marginals(e, first, t, s)
    expected, expected_pairs, at = np.zeros_like(p), np.zeros((k, k)), 0
    for n in lengths:
        total = 0.0
        own, own_pairs = np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(s[path[0]] + sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                own[i, y] += w
            for a, b in zip(path, path[1:]):
                own_pairs[a, b] += w
        expected[at : at + n] = own / total
        expected_pairs += own_pairs / total
        at += n
    assert np.allclose(p, expected) and np.allclose(pairs, expected_pairs)


def test_code_switched_words_are_labelled_one_by_one():
    a, b = "the house and a garden with trees".split(), "das haus und ein garten mit baum".split()
    rng = np.random.default_rng(1)
    model = langid.fit_field([(lang, list(rng.choice(ws, 30))) for _ in range(20) for lang, ws in (("en", a), ("de", b))])
    first = np.zeros(12, bool)
    first[0] = True
    p, _ = langid.marginals(model.evidence(["the", "house", "and", "trees", "with", "garden", "und", "das", "haus", "mit", "ein", "baum"]), first, model.transition, model.start)
    assert [model.languages[i] for i in p.argmax(1)] == ["en"] * 6 + ["de"] * 6


def test_language_of_odd_input(spark):
    rows = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.digest(odd(spark)).collect()}
    assert {(1, "und", remainder(1, 3) == 1), (2, "und", remainder(2, 3) == 1), (6, "und", remainder(6, 3) == 1)} <= rows
    assert langid.digest(odd(spark)).count() == len(ODD)
    assert langid.digest(odd(spark).limit(0)).count() == 0


def test_language_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = QUERIES["op5_language"](spark, BIG).collect()
    assert len(rows) == len(docs) and all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == docs[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_quality_of_odd_input(spark):
    rows = quality.digest(odd(spark), labels(spark, "quality")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for frame in (labels(spark, "quality").limit(0), labels(spark, "quality").filter("quality = 1")):
        assert quality.digest(odd(spark), frame).count() == len(ODD)
    assert quality.digest(odd(spark).limit(0), labels(spark, "quality")).count() == 0


def test_ranking_orders_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, quality.N_FEATURES)).astype(np.float32)
    label = (x[:, 0] + 0.5 * x[:, 1] > -0.8).astype(int)
    model = quality.fit_ranking(x, label)
    scores = model.score(x)
    assert (scores[label == 1][:, None] > scores[label == 0][None, :]).mean() > 0.97
    assert ((scores >= quality.CUT) == label).mean() > 0.9


def accuracy(spark, name, column):
    truth = {r.doc_id: r[column] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = QUERIES[name](spark, BIG).collect()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return np.mean([p == t for p, t in held])


def test_quality_learns_from_every_labelled_row(spark):
    texts = [(k, ("good words in a line. " if k % 3 else "## 77 !! ") * (1 + k % 5)) for k in range(7000)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in texts], "doc_id long, quality int")
    model = quality.fit(documents, marks)
    learned = marks.filter(~quality.held_out(marks.doc_id, 5, 0)).join(documents, "doc_id").collect()
    x = np.array([quality.features(r["text"]) for r in learned], np.float64)
    assert np.allclose(model.mean, x.mean(0), atol=1e-9)
    scores = model.score(x)
    assert (((scores >= quality.CUT) == [r["quality"] == 1 for r in learned])).all()


def test_quality_moves_no_texts(spark):
    documents = spark.createDataFrame([(k, f"word {k} " * (k % 7)) for k in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(k % 200, k % 2) for k in range(250)], "doc_id long, quality int")
    found = quality.labelled_features(documents, marks, "quality", folds=5, fold=0)
    expected = {k: max(v % 2 for v in range(250) if v % 200 == k) for k in range(200) if remainder(k, 5)}
    texts = dict(documents.collect())
    rows = {r["id"]: (r["label"], r["features"]) for r in found.collect()}
    assert rows == {k: (v, quality.features(texts[k]).tobytes()) for k, v in expected.items()}
    # below the exchange a text has become its features, and the join is the one that large tables need
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    moved = [line for line in plan.splitlines() if "text" in line]
    assert moved and not any("Exchange" in line for line in moved)
    assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")


def test_quality_accuracy(spark):
    assert accuracy(spark, "op4_quality", "quality") > 0.95


def test_toxicity_accuracy(spark):
    assert accuracy(spark, "op8_toxicity", "toxic") > 0.9


@pytest.fixture(scope="module")
def model():
    text = "you are a loser and an idiot . what a pathetic clown . stupid trash . the letter of a book is good " * 30
    s = toxicity.symbols(text)
    counts = np.zeros(toxicity.SYMBOLS**toxicity.ORDER)
    for i in range(len(s) - 3):
        counts[((s[i] * 28 + s[i + 1]) * 28 + s[i + 2]) * 28 + s[i + 3]] += 1
    return toxicity.smoothed(counts)


def test_model_is_a_distribution(model):
    assert np.allclose(np.exp(model).sum(1), 1, atol=1e-4)


@pytest.mark.parametrize("token,word", [
    ("1d10t", "idiot"), ("l0ser", "loser"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("tr@sh", "trash"), ("$tupid", "stupid"), ("id*ot", "idiot"), ("cl0wn!!", "clown"),
    ("pathetic***", "pathetic"), ("(idiot),", "idiot"), ("letter", "letter"),
])
def test_disguises_are_removed(model, token, word):
    assert word in toxicity.Restorer(model).words(token)


def test_spaced_letters(model):
    assert "idiot" in toxicity.Restorer(model).of_text("what an I d i o t you are")


@pytest.mark.parametrize(
    "text",
    [
        "you i d i o t.", 'an "i d i o t"', "an (i d i o t)", "an i  d  i  o  t", "an i\u00a0d\u00a0i\u00a0o\u00a0t!", "an\ni\nd\ni\no\nt",
        "s o   i d i o t", "an iddioott", "'iddioott'!",
    ],
)
def test_words_spaced_or_doubled_at_the_end_of_a_sentence(model, text):
    assert "idiot" in toxicity.Restorer(model).of_text(text)


def test_viterbi_finds_the_best_path(model):
    for token in ("1d10t", "a*b", "sss", "l o s"):
        lattice = toxicity._lattice(token)

        def value(path):
            state, score, out = 0, 0.0, ""
            for letter, cost in path:
                score -= cost
                if letter and not (letter == " " and state % 28 == 0):
                    score += float(model[state][toxicity._symbol(letter)])
                    state = (state % 28**2) * 28 + toxicity._symbol(letter)
                    out += letter
            return score + float(model[state][0]), out.strip()

        best = max(value(p) for p in itertools.product(*lattice))
        assert toxicity.restore(token, model) == best[1]


def test_toxicity_of_odd_input(spark):
    for frame in (labels(spark, "toxic"), labels(spark, "toxic").limit(0)):
        rows = toxicity.digest(odd(spark), frame).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.digest(odd(spark).limit(0), labels(spark, "toxic")).count() == 0
