"""Toxicity of texts after noisy-channel deobfuscation.

A disguised word is seen as the output of a channel that replaces letters by look-alikes, repeats them or puts blanks
or marks between them. The lattice of letters it may stand for is decoded by Viterbi under a character language
model, whose counts come from all documents. A word that the channel cannot have changed has one path, itself. The
restored words are then scored by how much oftener they occur in toxic than in other labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import held_out, labelled_texts, text_slices

#: Labelled documents that are used for learning at most, and word features kept at most.
LABELLED = 20_000
LEXICON = 50_000
#: Letters of context of the language model are ORDER - 1; symbols are a-z, the gap between words and any other letter.
ORDER = 4
SYMBOLS = 28
GAP, OTHER = 0, 27
#: Channel costs in nats: a look-alike, a letter dropped from a repetition, a mark between letters, a gap removed.
REPLACED, DROPPED, MARKED, JOINED = 2.5, 0.7, 1.5, 1.0
#: Restored tokens a task remembers.
REMEMBERED = 300_000

# What a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i",
}
# Marks that may stand between the letters of a word, or hide one letter.
MARKS = frozenset("*.-_~^'`´·•,:;/\\=#%&")
_HIDES = frozenset("*#%&?_")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"

_THREEFOLD = re.compile(r"(.)\1\1")
# what is no part of a word at its ends, besides a look-alike that is repeated three times or more
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—•·¿"
# single characters with blanks of any kind between, marks at the ends left out
_SPACED = re.compile(rf"(?<!\S)[{re.escape(_PUNCTUATION)}]*(\S(?:\s+\S){{2,}})[{re.escape(_PUNCTUATION)}]*(?!\S)")
_DOUBLED = re.compile(r"(.)\1+")
_BEFORE = "".join(c for c in _PUNCTUATION if c not in "@$!|+(<")
_BEHIND = "".join(c for c in _PUNCTUATION if c not in "@$+")


def trimmed(token: str) -> str:
    """A token without the marks at its ends."""
    token = token.lstrip(_BEFORE).rstrip(_BEHIND)
    while token[-1:] in LOOKALIKES and not token[-1].isalnum() and token.endswith(token[-1] * 3):
        token = token.rstrip(token[-1]).rstrip(_BEHIND)
    while token[:1] in LOOKALIKES and not token[0].isalnum() and token.startswith(token[0] * 3):
        token = token.lstrip(token[0]).lstrip(_BEFORE)
    return token


# -- language model -----------------------------------------------------------------------------------------------


def _table() -> np.ndarray:
    table = np.full(256, GAP, np.uint8)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[128:] = OTHER
    return table


_SYMBOL = _table()


def symbols(text: str) -> np.ndarray:
    """Letters of a text as small numbers, gaps made one; a byte beyond ASCII is part of another letter."""
    s = _SYMBOL[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    s = np.concatenate(([GAP] * (ORDER - 1), s, [GAP])).astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[ORDER:] = (s[ORDER:] != GAP) | (s[ORDER - 1 : -1] != GAP)
    return s[keep]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in text_slices(texts):
            # the gaps before each text keep the grams of neighbours apart
            s = np.concatenate([symbols(t) if t else np.empty(0, np.int64) for t in texts[a:b]])
            if len(s) >= ORDER:
                m = len(s) - ORDER + 1
                code = s[:m].copy()
                for n in range(1, ORDER):
                    code *= SYMBOLS
                    code += s[n : m + n]
                total += np.bincount(code, minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def language_model(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of each symbol after each context, from the counts of all documents.

    A task sums its grams before they are exchanged; SYMBOLS ** ORDER counts, whatever the input, reach the driver.
    """
    texts = documents.select(F.col(text_col).alias("text"))
    grams = texts.mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**ORDER)
    for row in grams.collect():
        counts[row["gram"]] = row["n"]
    return smoothed(counts)


def smoothed(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Each order backs off to the next lower one; shape (contexts, SYMBOLS)."""
    low = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in range(1, ORDER + 1):
        c = counts.reshape(SYMBOLS ** (ORDER - n), SYMBOLS ** (n - 1), SYMBOLS).sum(0)
        below = np.tile(low.reshape(-1, SYMBOLS), (SYMBOLS if n > 1 else 1, 1)) if n > 1 else low.reshape(1, SYMBOLS)
        low = (c + weight * below) / (c.sum(1, keepdims=True) + weight)
    return np.log(low).astype(np.float32)


# -- channel ------------------------------------------------------------------------------------------------------


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for ('' for nothing, ' ' for a gap) and the cost."""
    out = []
    last = ""
    for c in token:
        if c == " ":
            options = [("", JOINED), (" ", 0.0)]
        elif c.isalpha() and c not in LOOKALIKES:
            options = [(c, 0.0)]
            if c == last:
                options.append(("", DROPPED))
        else:
            options = [(" ", MARKED if c in MARKS else 2 * REPLACED)]
            options += [(x, REPLACED) for x in LOOKALIKES.get(c, "")]
            if c == last and c in LOOKALIKES:
                options.append(("", DROPPED))
            if c in MARKS:
                options.append(("", MARKED))
            if c in _HIDES:
                options += [(x, REPLACED + 1.0) for x in _LETTERS]
        out.append(options)
        last = c
    return out


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else GAP if c == " " else OTHER


def restore(token: str, model: np.ndarray) -> str:
    """Most likely original of a lower-cased token: Viterbi over the lattice, the state being the context."""
    contexts = SYMBOLS ** (ORDER - 2)
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in _lattice(token):
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            row = model[state]
            for letter, cost in options:
                if not letter or (letter == " " and state % SYMBOLS == GAP):
                    at, value, link = state, score - cost, path
                else:
                    s = _symbol(letter)
                    at, value, link = (state % contexts) * SYMBOLS + s, score - cost + float(row[s]), (letter, path)
                if at not in new or value > new[at][0]:
                    new[at] = (value, link)
        states = new
    best = max(states.items(), key=lambda x: x[1][0] + float(model[x[0]][GAP]))[1][1]
    letters = []
    while best is not None:
        letters.append(best[0])
        best = best[1]
    return "".join(reversed(letters)).strip()


def _disguised(token: str) -> bool:
    """Whether the channel may have changed the token: a look-alike, mark or threefold letter among letters."""
    if token.isalpha():
        if token.isascii():
            return _THREEFOLD.search(token) is not None
        return not LOOKALIKES.keys().isdisjoint(token) or _THREEFOLD.search(token) is not None
    return any(map(str.isalpha, token)) or sum(c in LOOKALIKES for c in token) > 2


class Restorer:
    """Restores the words of texts and remembers them."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, token: str, keep: bool = True) -> tuple[str, ...]:
        """What a lower-cased token stands for: as it is without marks at its ends and, if disguised, restored."""
        found = self.known.get(token)
        if found is None:
            plain = trimmed(token)
            options = {plain} if plain else set()
            if _disguised(plain):
                options.update(restore(plain, self.model).split(" "))
            elif plain.isascii():
                # doubled letters may be a disguise; the lexicon is learned from the same forms
                options.add(_DOUBLED.sub(r"\1", plain))
            found = tuple(sorted(w for w in options if w))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if keep or len(options) > 1:
                self.known[token] = found
        return found

    def of_text(self, text: str) -> set[str]:
        """Distinct restored words."""
        text = text.lower()
        out: set[str] = set()
        for token in set(text.split()):
            out.update(self.words(token))
        for spaced in _SPACED.findall(text):
            out.update(self.spaced(spaced))
        return out

    def spaced(self, run: str) -> tuple[str, ...]:
        """Words of a run of single characters, as a whole and in the parts that its wider gaps set off."""
        gaps = [len(g) for g in re.findall(r"\s+", run)]
        letters = run.split()
        parts, at = {" ".join(letters)}, 0
        if max(gaps) > min(gaps):
            ends = [i for i, g in enumerate(gaps, 1) if g > min(gaps)]
            for end in [*ends, len(letters)]:
                parts.add(" ".join(letters[at:end]))
                at = end
        out: set[str] = set()
        for part in parts:
            if part not in self.known:
                self.known[part] = tuple(w for w in restore(part, self.model).split(" ") if w)
            out.update(self.known[part])
        return tuple(sorted(out))


# -- scoring ------------------------------------------------------------------------------------------------------


def word_keys(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its stems: beginnings of four, five and six letters."""
    digest = xxhash.xxh64_intdigest
    keys = [digest(word.encode("utf-8", "surrogatepass"), 1) >> 1]
    keys += [digest(word[:n].encode("utf-8", "surrogatepass"), n) >> 1 for n in (4, 5, 6) if len(word) >= n]
    return tuple(keys)


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log odds of being in a toxic document, less two standard errors; at least three toxic documents are needed."""
    t, c = toxic + 0.5, clean + 0.5
    odds = np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1)) - 2 * np.sqrt(1 / t + 1 / c)
    return np.where(toxic >= 3, np.maximum(odds, 0.0), 0.0)


@dataclass(frozen=True)
class Scorer:
    lexicon: dict[int, float]
    weights: tuple[float, float, float, float]

    def summary(self, found: list[float]) -> tuple[float, float, float]:
        """The two strongest words and the rest together."""
        found = sorted(found, reverse=True)
        return (found + [0.0])[0], (found + [0.0, 0.0])[1], math.log1p(sum(found[2:]))

    def score(self, x: tuple[float, float, float]) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Weigher:
    """Evidence of the words of texts."""

    def __init__(self, model: np.ndarray, lexicon: dict[int, float]) -> None:
        self.restorer = Restorer(model)
        self.lexicon = lexicon
        self.known: dict[str, tuple[tuple[str, float], ...]] = {}

    def weighed(self, words: tuple[str, ...]) -> tuple[tuple[str, float], ...]:
        """Words of the lexicon with the strongest evidence among their keys."""
        pairs = ((w, max(self.lexicon.get(k, 0.0) for k in word_keys(w))) for w in words)
        return tuple(p for p in pairs if p[1])

    def of_text(self, text: str | None) -> list[float]:
        """Evidence of each distinct word that has any."""
        text = (text or "").lower()
        tokens = set(text.split())
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for token in tokens:
            if token not in known:
                known[token] = self.weighed(self.restorer.words(token, keep=False))
        found: dict[str, float] = {}
        for token in tokens:
            if known[token]:
                found.update(known[token])
        for run in _SPACED.findall(text):
            found.update(self.weighed(self.restorer.spaced(run)))
        return list(found.values())


def _key_counts(model: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, text) -> (key, toxic, all): in how many of the task's documents each key occurs."""
        restorer = Restorer(model)
        toxic: Counter[int] = Counter()
        every: Counter[int] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(every)
            columns = [keys, [toxic[k] for k in keys], [every[k] for k in keys]]
            toxic.clear()
            every.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "toxic", "all"])

        for batch in batches:
            for label, text in zip(*batch.columns, strict=True):
                keys = {k for w in restorer.of_text(text.as_py() or "") for k in word_keys(w)}
                every.update(keys)
                if label.as_py() == 1:
                    toxic.update(keys)
                if len(every) > 500_000:
                    yield flush()
        yield flush()

    return count


def fit_weights(x: np.ndarray, label: np.ndarray, penalty: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps; non-negative evidence, so weights below zero are set to zero."""
    z = np.hstack((np.ones((len(x), 1)), x))
    w = np.zeros(z.shape[1])
    ridge = penalty * np.diag([0.0, *[1.0] * x.shape[1]]) + 1e-6 * np.eye(len(w))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (label - p) - ridge @ w), -2, 2)
        w[1:] = np.maximum(w[1:], 0.0)
    return tuple(float(v) for v in w)


def fit(documents: DataFrame, labels: DataFrame, model: np.ndarray, label: str = "toxic", *, folds: int = 5, fold: int = 0, limit: int = LABELLED) -> Scorer:
    """Learn a lexicon and weights from at most ``limit`` labelled documents.

    While the weights are learned each document is scored without its own contribution to the lexicon.
    """
    chosen = labelled_texts(documents, labels, label, folds=folds, fold=fold, limit=limit).select("label", "text")
    totals = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Scorer({}, (3.0 if n_toxic else -3.0, 0.0, 0.0, 0.0))
    counts = chosen.mapInArrow(_key_counts(model), "key long, toxic long, all long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    # only keys of three toxic documents that are commoner there than elsewhere can count
    counts = counts.filter((F.col("toxic") >= 3) & (F.col("toxic") * n_clean > (F.col("all") - F.col("toxic")) * n_toxic))
    table = counts.orderBy((F.col("toxic") / F.col("all")).desc(), F.col("toxic").desc(), "key").limit(LEXICON).collect()
    keys = [r["key"] for r in table]
    t, c = np.array([r["toxic"] for r in table], float), np.array([r["all"] - r["toxic"] for r in table], float)

    def lexicon(values: np.ndarray) -> dict[int, float]:
        return {k: v for k, v in zip(keys, values.tolist(), strict=True) if v > 0}

    scorer = Scorer(lexicon(evidence(t, c, n_toxic, n_clean)), (0.0,) * 4)
    without = {1: lexicon(evidence(t - 1, c, n_toxic - 1, n_clean)), 0: lexicon(evidence(t, np.maximum(c - 1, 0), n_toxic, n_clean - 1))}
    shared = documents.sparkSession.sparkContext.broadcast((model, scorer, without))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer, without = shared.value
        weigh = {label: Weigher(model, values) for label, values in without.items()}
        for batch in batches:
            rows = [(label.as_py(), *scorer.summary(weigh[int(label.as_py() == 1)].of_text(text.as_py()))) for label, text in zip(*batch.columns, strict=True)]
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=["label", "a", "b", "c"])

    found = sorted(tuple(r) for r in chosen.mapInArrow(summaries, "label int, a double, b double, c double").collect())
    return Scorer(scorer.lexicon, fit_weights(np.array([r[1:] for r in found]), np.array([float(r[0] == 1) for r in found])))


def score(documents: DataFrame, model: np.ndarray, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row; a null text scores as an empty one. Other columns are not read."""
    shared = documents.sparkSession.sparkContext.broadcast((model, scorer))  # the model has a fixed size, the scorer at most LEXICON words

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        weigh = Weigher(model, scorer.lexicon)
        for batch in batches:
            out = [scorer.score(scorer.summary(weigh.of_text(text.as_py()))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, f"id {kind}, score double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query."""
    model = language_model(documents)
    rows = score(documents, model, fit(documents, labels, model)).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
