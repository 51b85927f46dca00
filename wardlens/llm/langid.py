"""Language of documents by a linear-chain conditional random field over their words.

A word's evidence comes from its character n-grams, those at its ends (affixes) apart from those inside, and from the
whole word (lexicon); learned transitions tie neighbours together. Forward-backward gives each word a distribution
over languages, so that code-switched text is labelled word by word; a document takes the language of most of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import held_out, text_slices

#: Documents per language and words per document that are used for learning at most.
PER_LANGUAGE = 400
WORDS_PER_DOCUMENT = 200
#: Hash buckets of the features, and steps of learning.
BUCKETS = 1 << 17
STEPS = 25
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Share of a document's words that its language needs for the document to be accepted.
LEAST_SHARE = 0.4
# characters worked on at a time where whole rows pass through the workers
_SLICE = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature of the words; a word is framed by marks, so that affixes are n-grams too."""
    chars = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    marks = np.flatnonzero(chars == 0)
    owner = np.cumsum(chars == 0) - 1  # a mark belongs to the word behind it
    after = marks[np.minimum(owner + 1, len(marks) - 1)]  # the next mark
    buckets, owners = [], []
    code = np.zeros(len(chars), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(chars) - n + 1
        code = (code[:m] * np.uint64(0x100000001B3)) ^ (chars[n - 1 : n - 1 + m] + np.uint64(1))
        if n in GRAMS:
            start = np.arange(m)
            inside = (start + n - 1 <= after[:m]) & (owner[:m] < len(words))
            if n == 1:
                inside &= chars[:m] != 0
            buckets.append(code[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
            owners.append(owner[:m][inside])
    whole = np.zeros(len(words), np.uint64)
    place = np.arange(len(chars)) - marks[owner]
    letter = chars != 0
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(place.max(initial=0)) + 1, 0x5851F42D4C957F2D, np.uint64))))
    np.add.at(whole, owner[letter], (chars[letter] + np.uint64(1)) * power[place[letter]])
    buckets.append(whole * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99))
    owners.append(np.arange(len(words)))
    mixed = np.concatenate(buckets)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owners)


def marginals(evidence: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over joined chains: (label distribution of each word, sum of pair distributions).

    ``first`` marks the words that begin a chain. The words are cut into segments that advance side by side: the
    product of each segment's steps links their ends, so the result is that of one pass over each whole chain.
    """
    n, k = evidence.shape
    e = np.exp(evidence - evidence.max(1, keepdims=True))
    t, s = np.exp(transition), np.exp(start)
    length = max(1, int(np.sqrt(n)))
    rows = -(-n // length)
    full = np.ones((rows * length, k))
    full[:n] = e
    begins = np.zeros(rows * length, bool)
    begins[:n] = first
    begins[n:] = True  # what fills up the last segment is chains of their own
    full, begins = full.reshape(rows, length, k), begins.reshape(rows, length)
    product = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for i in range(length):
        step = np.where(begins[:, i, None, None], s[None, None, :], t[None]) * full[:, i, None, :]
        product = product @ step
        product /= product.max((1, 2), keepdims=True)
    enter, leave = np.ones((rows, k)), np.ones((rows, k))
    for r in range(1, rows):
        enter[r] = enter[r - 1] @ product[r - 1]
        enter[r] /= enter[r].sum()
    for r in range(rows - 2, -1, -1):
        leave[r] = product[r + 1] @ leave[r + 1]
        leave[r] /= leave[r].sum()
    ahead, behind = np.empty_like(full), np.empty_like(full)
    state = enter
    for i in range(length):
        state = np.where(begins[:, i, None], s[None], state @ t) * full[:, i]
        state = state / state.sum(1, keepdims=True)
        ahead[:, i] = state
    state = leave
    for i in range(length - 1, -1, -1):
        behind[:, i] = state
        state = np.where(begins[:, i, None], 1.0, (full[:, i] * state) @ t.T)
        state = state / state.sum(1, keepdims=True)
    ahead, behind, full = (x.reshape(-1, k)[:n] for x in (ahead, behind, full))
    p = ahead * behind
    p /= p.sum(1, keepdims=True)
    inner = np.flatnonzero(~first[1:]) + 1
    right = full[inner] * behind[inner]
    total = np.einsum("ni,ij,nj->n", ahead[inner - 1], t, right)
    pairs = t * (ahead[inner - 1].T @ (right / total[:, None])) if len(inner) else np.zeros((k, k))
    return p, pairs


@dataclass(frozen=True)
class Field:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    transition: np.ndarray
    start: np.ndarray

    def evidence(self, words: list[str]) -> np.ndarray:
        """Sum of the weights of each word's features."""
        buckets, owners = word_features(words)
        out = np.empty((len(words), len(self.languages)))
        for j in range(out.shape[1]):
            out[:, j] = np.bincount(owners, weights=self.weights[buckets, j], minlength=len(words))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share of the words, by the sum of the words' distributions."""
        found = [(UNKNOWN, 0.0)] * len(texts)
        lists = [words_of(t) if t else [] for t in texts]
        some = [i for i, ws in enumerate(lists) if ws and any(map(str.isalpha, texts[i]))]
        if some and self.languages:
            codes, distinct = pd.factorize(np.array([w for i in some for w in lists[i]], object))
            starts = np.cumsum([0, *(len(lists[i]) for i in some[:-1])])
            first = np.zeros(len(codes), bool)
            first[starts] = True
            p, _ = marginals(self.evidence(list(distinct))[codes], first, self.transition, self.start)
            share = np.add.reduceat(p, starts) / np.array([len(lists[i]) for i in some])[:, None]
            for i, row in zip(some, share, strict=True):
                found[i] = (self.languages[int(row.argmax())], min(1.0, float(row.max())))
        return [x[0] for x in found], [x[1] for x in found]


def fit_field(chains: list[tuple[str, list[str]]], steps: int = STEPS, rate: float = 0.5, penalty: float = 1e-2) -> Field:
    """Maximum likelihood by adaptive gradient steps; every word of a chain has the chain's language."""
    chains = sorted((lang, ws) for lang, ws in chains if ws)
    languages = sorted({lang for lang, _ in chains})
    k = len(languages)
    if not k:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    codes, distinct = pd.factorize(np.array([w for _, ws in chains for w in ws], object))
    lengths = np.array([len(ws) for _, ws in chains])
    starts = np.cumsum([0, *lengths[:-1]])
    first = np.zeros(len(codes), bool)
    first[starts] = True
    name = np.array([languages.index(lang) for lang, _ in chains])
    gold = np.eye(k)[np.repeat(name, lengths)]
    buckets, owners = word_features(list(distinct))
    used, at = np.unique(buckets, return_inverse=True)
    w, t, s = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)
    w2, t2, s2 = np.full_like(w, 1e-2), np.full_like(t, 1e-2), np.full_like(s, 1e-2)
    same = np.diag(np.bincount(name, weights=lengths - 1, minlength=k))
    count = len(codes)

    def spread(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, weights=values[:, j], minlength=size) for j in range(k)], 1)

    for _ in range(steps):
        evidence = spread(w[at], owners, len(distinct))[codes]
        p, pairs = marginals(evidence, first, t, s)
        rest = spread(gold - p, codes, len(distinct))
        slopes = (
            (spread(rest[owners], at, len(used)) - penalty * w) / count * 1e3,
            (same - pairs) / count * 10 - penalty * t,
            (gold[starts] - p[starts]).mean(0) - penalty * s,
        )
        for value, squares, slope in zip((w, t, s), (w2, t2, s2), slopes, strict=True):
            squares += slope**2
            value += rate * slope / np.sqrt(squares)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = w
    return Field(languages, weights, t, s)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, text) -> (lang, words): a run of words that begins at a place taken from the id."""
    for batch in batches:
        langs, runs = [], []
        for i, lang, text in zip(*batch.columns, strict=True):
            ws = words_of(text.as_py() or "")
            at = (i.as_py() or 0) * 7919 % max(1, len(ws) - WORDS_PER_DOCUMENT + 1)
            langs.append(lang.as_py())
            runs.append(ws[at : at + WORDS_PER_DOCUMENT])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.list_(pa.string()))], names=["lang", "words"])


def fit(
    documents: DataFrame, *, folds: int = 3, fold: int = 1, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Field:
    """Learn from about ``per_language`` documents of each language outside the held-out fold, chosen by hash."""
    train = documents.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    train = train.filter(~held_out(F.col("id"), folds, fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit_field([])
    odds = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    # a hash decides, so a language has about its number; never more than twice as many rows in all
    rows = train.filter(draw < F.element_at(odds, F.col("lang"))).limit(2 * per_language * len(counts))
    return fit_field([(r["lang"], list(r["words"])) for r in rows.mapInArrow(_chains, "lang string, words array<string>").collect()])


def predict(documents: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; ``und`` and 0 for a text that is null or has no letter. Other columns are not read."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = [], []
            for a, b in text_slices(texts):
                lang, score = model.predict(texts[a:b])
                langs += lang
                scores += score
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"]
            )

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predicted, f"id {kind}, lang_pred string, score double")


def accepted(documents: DataFrame, model: Field, least: float = LEAST_SHARE, text_col: str = "text") -> DataFrame:
    """Rows of ``documents``, all columns, whose text has a language that makes up at least ``least`` of its words."""
    at = documents.columns.index(text_col)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = []
            for a, b in text_slices(texts, _SLICE):
                keep += [lang != UNKNOWN and score >= least for lang, score in zip(*model.predict(texts[a:b]), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(filtered, documents.schema)


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query."""
    rows = predict(documents, fit(documents)).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
