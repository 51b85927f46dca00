"""Scalar text, date and hash functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions import lexicon

ColumnOrName = Column | str


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def starts_with_code(code: ColumnOrName, prefix: str) -> Column:
    """Code-prefix predicate; reaches the Parquet scan as StringStartsWith."""
    return _col(code).startswith(prefix)


def strip_redactions(text: ColumnOrName, greedy: bool = True) -> Column:
    """Remove ``[**...**]`` marks: from the first opening to the last closing mark of a line, or mark by mark."""
    inner = r"[^\n]*" if greedy else r"[^\n]*?"
    return F.regexp_replace(_col(text), rf"\[\*\*{inner}\*\*\]", "")


def strip_commas(text: ColumnOrName) -> Column:
    return F.translate(_col(text), ",", "")


def stable_hash(value: ColumnOrName) -> Column:
    """A hash that does not change between runs, engines or partitionings."""
    return F.md5(_col(value).cast("string"))


def hash_bucket(value: ColumnOrName, seed: int, buckets: int = 1000) -> Column:
    """Bucket of a key under a seed, 0 .. buckets-1."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), _col(value).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def words(text: ColumnOrName) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.filter(F.split(_col(text), lexicon.SPACES), lambda t: t != "")


def join_words(tokens: ColumnOrName) -> Column:
    return F.array_join(_col(tokens), " ")


def min_length(tokens: ColumnOrName, least: int = 3) -> Column:
    return F.filter(_col(tokens), lambda t: F.length(t) >= least)


def remove_words(tokens: ColumnOrName, unwanted: Sequence[str]) -> Column:
    """Drop listed tokens; order and repeats of the others stay."""
    return F.filter(_col(tokens), lambda t: ~t.isin(list(unwanted)))


def lemma_map(tokens: ColumnOrName, lemmas: dict[str, str]) -> Column:
    """Replace tokens by their lemma from a small dictionary."""
    if not lemmas:
        return _col(tokens)
    table = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair])
    return F.transform(_col(tokens), lambda t: F.coalesce(F.element_at(table, t), t))


def substitute(text: ColumnOrName, table: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order."""
    out = _col(text)
    for pattern, replacement in table:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def delete_characters(text: ColumnOrName, characters: str) -> Column:
    return F.translate(_col(text), characters, "")


def count_matches(text: ColumnOrName, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    return F.regexp_count(_col(text), F.lit(pattern))


def date_after(text: ColumnOrName, header: str) -> Column:
    """The date in the first ``<header>  [**Y-M-D**]``; NULL when absent or not a calendar date."""
    found = F.regexp_extract(
        _col(text), rf"{re.escape(header)}[{lexicon.SPACE_CLASS}]+\[\*\*([0-9]+-[0-9]+-[0-9]+)\*\*\]", 1
    )
    return F.try_to_date(found, "y-M-d")


def absolute_days(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.abs(F.date_diff(_col(a), _col(b)))


def strip_accents(text: ColumnOrName) -> Column:
    source, target, marks = lexicon.accent_table()
    return F.translate(_col(text), source + marks, target)


def is_alphabetic(token: ColumnOrName) -> Column:
    return _col(token).rlike(r"^\p{L}+$")


def contains_any(text: ColumnOrName, terms: Sequence[str]) -> Column:
    """Whether any of the terms occurs as a substring."""
    return _col(text).rlike("|".join(re.escape(t) for t in terms))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, for expressions that mention it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def chunks(tokens: ColumnOrName, size: ColumnOrName | int) -> Column:
    """Consecutive groups of ``size`` tokens joined by a space; the last may be shorter."""
    size = F.lit(size) if isinstance(size, int) else _col(size)

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)), size)
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, size), " "))

    return F.filter(bind(_col(tokens), cut), lambda c: c != "")


def common_subsequence_length(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Length of the longest common subsequence: one row of the table per character of ``a``."""
    a, b = _col(a), _col(b)
    b_length = F.length(b)
    first = F.array_repeat(F.lit(0), b_length + 1)

    def next_row(row: Column, i: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            cell = F.when(
                F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1)), F.element_at(row, j) + 1
            ).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1)))
            return F.array_append(acc, cell)

        return F.aggregate(F.sequence(F.lit(1), b_length), F.array(F.lit(0)), step)

    last = F.aggregate(F.sequence(F.lit(1), F.length(a)), first, next_row)
    return F.when((F.length(a) == 0) | (b_length == 0), F.lit(0)).otherwise(F.element_at(last, -1))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is one integer, a bit per character of ``b``."""
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        same = row & places.get(c, 0)
        row = (row + same | row - same) & full
    return len(b) - row.bit_count()


def common_subsequence_lengths(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The same in Arrow batches, for columns of very many pairs."""

    @F.pandas_udf(T.IntegerType())
    def lengths(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else common_length(x, y) for x, y in zip(a, b)], dtype="Int32")

    return lengths(_col(a), _col(b))


def ratio_of(common: Column, a: ColumnOrName, b: ColumnOrName) -> Column:
    """Similarity 0..100 of strings whose longest common subsequence is known, rounded half to even."""
    total = F.length(_col(a)) + F.length(_col(b))
    return F.when(total == 0, F.lit(100)).otherwise(F.bround(F.lit(200.0) * common / total, 0).cast("int"))


def fuzzy_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Similarity 0..100: twice the common subsequence over the total length, rounded half to even."""
    return ratio_of(common_subsequence_length(a, b), a, b)


def word_tokens(text: ColumnOrName) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(_col(text), F.lit(lexicon.TOKEN), F.lit(0))


def vector_tokens(text: ColumnOrName, pattern: str = lexicon.WORD, lowercase: bool = True, accents: bool = True) -> Column:
    """Tokens of the vectorizers: lower case, accents off, then every match of the token pattern."""
    out = _col(text)
    if lowercase:
        out = F.lower(out)
    if accents:
        out = strip_accents(out)
    return F.regexp_extract_all(out, F.lit(pattern), F.lit(0))


def sentences(text: ColumnOrName) -> Column:
    """Sentences with their closing marks, trimmed of spaces and line breaks; empty ones dropped."""
    found = F.regexp_extract_all(_col(text), F.lit(lexicon.SENTENCE), F.lit(0))
    return F.filter(
        F.transform(found, lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")), lambda s: s != ""
    )
