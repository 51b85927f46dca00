"""Corpus features as long triples (doc, feature, value): weighted words, counts, term hits, stay length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions import lexicon
from wardlens.functions import scalars as S
from wardlens.operators.relations import numbered

# A vocabulary of so many words is numbered in one task and broadcast; a larger one by ranges, and joined.
MOST_FEATURES = 1_000_000

# --- counts and vocabularies -------------------------------------------------------------------------------


def token_counts(
    df: DataFrame,
    keys: str | Sequence[str],
    tokens: Column,
    stop_words: Sequence[str] = lexicon.ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(keys, token, tf). The tokens of a text are counted before they leave its task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    exploded = df.select(*keys, F.explode(tokens).alias("token"))
    if stop_words:
        exploded = exploded.filter(~F.col("token").isin(list(stop_words)))
    return exploded.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))


def document_count(df: DataFrame, key: str) -> Column:
    """The number of documents, as a scalar subquery."""
    return df.agg(F.count_distinct(key)).scalar()


def whole_vocab(counts: DataFrame) -> DataFrame:
    """Every token: (token, idx, cf, df); ``idx`` follows the token order."""
    totals = counts.groupBy("token").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    return numbered(totals, "token", name="idx").select("token", F.col("idx").cast("int").alias("idx"), "cf", "df")


def top_vocab(counts: DataFrame, max_features: int) -> DataFrame:
    """The most frequent tokens, ties by token: (token, idx, cf, df); ``idx`` follows the token order.

    Up to MOST_FEATURES rows are gathered to number them; more are ranked by range.
    """
    totals = counts.groupBy("token").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    if max_features > MOST_FEATURES:
        kept = numbered(totals, F.desc("cf"), F.asc("token")).filter(F.col("rank") < max_features).drop("rank")
        return numbered(kept, "token", name="idx").select("token", F.col("idx").cast("int").alias("idx"), "cf", "df")
    top = totals.orderBy(F.desc("cf"), F.asc("token")).limit(max_features)
    return (
        top.agg(F.array_sort(F.collect_list(F.struct("token", "cf", "df"))).alias("entries"))
        .select(F.posexplode("entries").alias("idx", "e"))
        .select(F.col("e.token").alias("token"), "idx", F.col("e.cf").alias("cf"), F.col("e.df").alias("df"))
    )


def inverse_frequency(n: Column, df: Column, smooth: bool) -> Column:
    """``ln((1+n)/(1+df))+1`` when smooth, ``ln(n/df)+1`` when not."""
    extra = 1 if smooth else 0
    return F.log((n + extra) / (df + extra)) + 1


def tfidf_fit(counts: DataFrame, n_docs: Column, max_features: int, smooth: bool = False) -> DataFrame:
    """Vocabulary with weights: (token, idx, cf, df, idf)."""
    return top_vocab(counts, max_features).withColumn("idf", inverse_frequency(n_docs, F.col("df"), smooth))


def tfidf_transform(counts: DataFrame, vocab: DataFrame, key: str, sublinear: bool = True, bounded: bool = True) -> DataFrame:
    """Weights of the vocabulary words of each document, each document scaled to length 1: (key, token, idx, value).

    A ``bounded`` vocabulary comes from ``top_vocab`` with at most MOST_FEATURES words and is broadcast. The window
    over a document holds at most its different words.
    """
    tf = (F.log("tf") + 1) if sublinear else F.col("tf")
    known = vocab.select("token", "idx", "idf")
    weighted = counts.join(F.broadcast(known) if bounded else known, "token").withColumn("w", tf * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "token", "idx", (F.col("w") / length).alias("value"))


def bow_transform(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """Counts of the vocabulary words: (key, token, idx, value)."""
    joined = counts.join(F.broadcast(vocab.select("token", "idx")), "token")
    return joined.select(key, "token", "idx", F.col("tf").cast("double").alias("value"))


def tfidf_from_counts(counts: DataFrame, n_docs: Column, key: str) -> DataFrame:
    """Plain term frequency with smooth idf over every word, scaled to length 1."""
    vocab = whole_vocab(counts).withColumn("idf", inverse_frequency(n_docs, F.col("df"), True))
    return tfidf_transform(counts, vocab, key, sublinear=False, bounded=False)


def document_frequency(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(token, df): each token once per text, counted on the map side."""
    return (
        df.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def idf_table(frequencies: DataFrame, n_docs: Column, smooth: bool = True) -> DataFrame:
    return frequencies.withColumn("idf", inverse_frequency(n_docs, F.col("df"), smooth))


def df_band_vocab(frequencies: DataFrame, n_docs: Column, lo: float = 0.1, hi: float = 0.7) -> DataFrame:
    """Tokens found in at least ``lo`` and at most ``hi`` of the documents."""
    return frequencies.filter((F.col("df") >= n_docs * lo) & (F.col("df") <= n_docs * hi))


def extension_tokens(df: DataFrame, key: str, text: str, percent: float = 70) -> DataFrame:
    """Alphabetic tokens whose smooth idf is at or below its percentile: the most widespread ones.

    The percentile is taken over the counts of each distinct document frequency, a table far smaller than
    the vocabulary.
    """
    frequencies = document_frequency(df, key, S.vector_tokens(text, lexicon.WORD_2, lowercase=False, accents=False))
    weighted = idf_table(frequencies, document_count(df, key))
    spread = weighted.groupBy("idf").agg(F.count(F.lit(1)).alias("n_tokens"))
    threshold = spread.agg(F.percentile("idf", F.lit(percent / 100), F.col("n_tokens"))).scalar()
    return weighted.filter((F.col("idf") <= threshold) & S.is_alphabetic("token"))


# --- term hits ---------------------------------------------------------------------------------------------

def hotspot_counts(df: DataFrame, key: str, text: str, terms: Sequence[str], keep_zeros: bool = False) -> DataFrame:
    """Matches of each term, read as a pattern, in each text: (key, term, value). No shuffle.

    Every pattern is a literal, so it is compiled once per task.
    """
    hits = F.array(*[F.struct(F.lit(t).alias("term"), S.count_matches(text, t).alias("value")) for t in terms])
    found = df.select(key, F.inline(hits))
    return found if keep_zeros else found.filter(F.col("value") > 0)


def match_terms(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """The same with the terms in a table: they travel as one array beside each text.

    The table is a curated list; it is read once into a scalar subquery.
    """
    listed = terms.agg(F.array_sort(F.collect_set("term"))).scalar()
    hits = F.size(F.regexp_extract_all(F.col(text), F.col("term"), F.lit(0)))
    paired = df.select(key, text, listed.alias("terms")).select(key, text, F.explode("terms").alias("term"))
    return paired.select(key, "term", hits.alias("value")).filter(F.col("value") > 0)


def fuzzy_words(text: Column | str) -> Column:
    """Words after everything but letters, digits, brackets and whitespace is removed."""
    text = F.col(text) if isinstance(text, str) else text
    return S.words(F.regexp_replace(text, f"[^A-Za-z0-9(){lexicon.SPACE_CLASS}]+", ""))


def hotspot_fuzzy(df: DataFrame, key: str, text: str, terms: Sequence[str], min_ratio: int = 95) -> DataFrame:
    """Chunks as long as the term that are at least ``min_ratio`` similar to it: (key, term, value).

    Repeated chunks of a text are scored once. A chunk meets a term only when both have the same number of
    words and lengths that allow the ratio, then a bounded edit distance, and only then the exact score.
    """
    spark = df.sparkSession
    slack = 1 - (min_ratio - 0.5) / 100
    rows = []
    for term in dict.fromkeys(terms):
        n_words, length = len(term.split()), len(term)
        for other in range(1, 2 * length + 2):
            if 200 * min(length, other) >= (min_ratio - 0.5) * (length + other):
                rows.append((term, n_words, other, int(slack * (length + other) + 1e-9)))
    table = spark.createDataFrame(rows, "term string, n_words int, chunk_length int, most_edits int")
    by_size: dict[int, set[int]] = {}
    for _, n_words, chunk_length, _ in rows:
        by_size.setdefault(n_words, set()).add(chunk_length)
    sizes = F.array(*[F.lit(n) for n in sorted(by_size)])
    possible = F.lit(False)
    for n_words, lengths in by_size.items():
        possible = possible | ((F.col("n_words") == n_words) & F.col("chunk_length").isin(sorted(lengths)))
    pieces = F.when(F.col("n_words") == 1, F.col("words")).otherwise(S.chunks("words", F.col("n_words")))
    chunked = (
        df.select(key, fuzzy_words(text).alias("words"))
        .select(key, "words", F.explode(sizes).alias("n_words"))
        .select(key, "n_words", F.explode(pieces).alias("chunk"))
        .withColumn("chunk_length", F.length("chunk"))
        .filter(possible)
        .groupBy(key, "n_words", "chunk", "chunk_length")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    near = chunked.join(table, ["n_words", "chunk_length"]).filter(
        F.expr("levenshtein(chunk, term, most_edits) >= 0")
    )
    hits = near.filter(S.fuzzy_ratio("chunk", "term") >= min_ratio)
    return hits.groupBy(key, "term").agg(F.sum("n").alias("value"))


def stay_days(text: Column | str) -> Column:
    """Days between the admission and discharge dates written in the raw text; 0 when either is missing."""
    missing = F.lit(lexicon.MISSING_DATE).cast("date")
    admitted = S.date_after(text, "Admission Date:")
    discharged = S.date_after(text, "Discharge Date:")
    real = (admitted != missing) & (discharged != missing)
    return F.when(real, S.absolute_days(discharged, admitted)).otherwise(0)
