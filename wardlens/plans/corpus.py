"""Inputs of the corpus queries, in Spark and in SQL: documents, labels, terms, word vectors, and SQL pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.functions import lexicon
from wardlens.operators import features as V
from wardlens.functions import scalars as S
from wardlens.session import KEYED_BYTES, keyed, materialize, spread
from wardlens.sources.tables import read_table

TERMS = ["the", "of the", "that", "tion", "and the", "th[ae]t", "in"]
FUZZY_TERMS = ["the", "of the", "thingtion", "ingthere", "anderstion", "hetheration", "tionationer"]
KEYWORDS = ["tion", "ble", "was"]
LEMMAS = {"tion": "ation", "ing": "ation", "ble": "able", "the": "that"}
VECTOR_WIDTH = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def keyed_documents(spark: SparkSession, sf_dir: str, size: int = KEYED_BYTES) -> DataFrame:
    """The documents by key, for what is folded by document: the texts move once and their tokens not at all."""
    return keyed(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", size)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label): documents with a quality label."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id")


def terms(spark: SparkSession, listed: Sequence[str] = TERMS) -> DataFrame:
    return spark.createDataFrame([(t,) for t in listed], "term string")


def word_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Primary and fallback vectors of the most frequent corpus tokens, rank by rank from the embeddings table.

    Ranks are places within range partitions plus the rows of the partitions before, so no task sees all words.
    """
    tokens = documents(spark, sf_dir).select(F.explode(S.words(F.lower("text"))).alias("token"))
    totals = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cf")), "word-totals")
    ranges = totals.repartitionByRange(F.desc("cf"), F.asc("token")).withColumn("part", F.spark_partition_id())
    # written once: range bounds come from a sample and may differ in a second run
    ranges = materialize(ranges, "word-ranges")
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("cf"), F.asc("token")))
    ranked = ranges.withColumn("place", place).join(before, "part").select(
        (F.col("before") + F.col("place") - 1).cast("bigint").alias("vec_id"), "token"
    )
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    both = materialize(ranked.join(vectors, "vec_id"), "word-vectors")
    return (
        both.filter(F.col("vec_id") % 2 == 1).select("token", "vec"),
        both.filter(F.col("vec_id") % 2 == 0).select("token", "vec"),
    )


# --- SQL pieces --------------------------------------------------------------------------------------------

def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_in(values: Sequence[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def sql_list(values: Sequence[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def sql_words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '{lexicon.SPACES}'), lambda t: t <> '')"


def sql_without(expr: str, unwanted: Sequence[str]) -> str:
    return f"list_filter({expr}, lambda t: t not in {sql_in(unwanted)})"


def sql_at_least(expr: str, n: int) -> str:
    return f"list_filter({expr}, lambda t: length(t) >= {n})"


def sql_lemmas(expr: str, lemmas: dict[str, str]) -> str:
    if not lemmas:
        return expr
    cases = " ".join(f"when {quoted(a)} then {quoted(b)}" for a, b in sorted(lemmas.items()))
    return f"list_transform({expr}, lambda t: case t {cases} else t end)"


def sql_join(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def sql_replace(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def sql_substitute(expr: str, table: Sequence[tuple[str, str]]) -> str:
    for pattern, replacement in table:
        expr = sql_replace(expr, pattern, replacement)
    return expr


def sql_delete(expr: str, characters: str) -> str:
    return f"translate({expr}, {quoted(characters)}, '')"


def sql_tokens(expr: str, pattern: str = lexicon.WORD, lowercase: bool = True, accents: bool = True) -> str:
    if lowercase:
        expr = f"lower({expr})"
    if accents:
        source, target, marks = lexicon.accent_table()
        expr = f"translate({expr}, {quoted(source + marks)}, {quoted(target)})"
    return f"regexp_extract_all({expr}, {quoted(pattern)})"


def sql_sentences(expr: str) -> str:
    trimmed = "list_transform({0}, lambda s: regexp_replace(s, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'))"
    return f"list_filter({trimmed.format(f'regexp_extract_all({expr}, {quoted(lexicon.SENTENCE)})')}, lambda s: s <> '')"


def counts_sql(name: str, source: str = "documents", key: str = "doc_id", text: str = "text",
               stop_words: Sequence[str] = lexicon.ENGLISH_STOP_WORDS, tokens: str | None = None) -> str:
    tokens = tokens or sql_tokens(text)
    where = f"where token not in {sql_in(stop_words)}" if stop_words else ""
    return f"""
{name} as (
  select {key}, token, count(*) as tf
  from (select {key}, unnest({tokens}) as token from {source}) {where} group by 1, 2)"""


def vocab_sql(name: str, counts: str, n: int | None = None) -> str:
    return f"""
{name} as (
  select token, cast(row_number() over (order by token) - 1 as integer) as idx, cf, df
  from (select token, cast(sum(tf) as bigint) as cf, count(*) as df from {counts} group by 1
        order by cf desc, token {f'limit {n}' if n else ''}))"""


WORD_VECTORS_SQL = [
    counts_sql("vector_counts", tokens=sql_words("lower(text)"), stop_words=()),
    f"""
ranked_words as (
  select token, row_number() over (order by cf desc, token) - 1 as vec_id
  from (select token, sum(tf) as cf from vector_counts group by 1))""",
    """
word_vectors as (
  select r.token, e.embedding as vec from ranked_words r join embeddings e on r.vec_id = e.vec_id)""",
]
