"""Registered queries of the training-data operators: one thin query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlens.llm import conversations as _conversations
from wardlens.llm import decontaminate as _decontaminate
from wardlens.llm import embeddings as _embeddings
from wardlens.llm import exact_dedup as _exact_dedup
from wardlens.llm import html_blocks as _html_blocks
from wardlens.llm import langid as _langid
from wardlens.llm import packing as _packing
from wardlens.llm import quality as _quality
from wardlens.llm import simhash as _simhash
from wardlens.llm import suffix as _suffix
from wardlens.llm import toxicity as _toxicity
from wardlens.llm import warc as _warc
from wardlens.llm import whitening as _whitening
from wardlens.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Vocabulary of the packing query, by its name in the package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


class _Tables:
    """The given tables: by name as DataFrames, or where they lie."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"


def _register(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), _Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@_register("op1_decontamination", _decontaminate.SQL)
def _op1(spark, table):
    return _decontaminate.digest(_decontaminate.decontaminate(table("documents"), table("benchmark")))


@_register("op6_simhash")
def _op6(spark, table):
    return _simhash.digest(table("documents"))


@_register("op7_suffix_dedup")
def _op7(spark, table):
    return _suffix.digest(table("documents"))


@_register("op10_packing")
def _op10(spark, table):
    return _packing.digest(table("documents"), tokenizer_path(TOKENIZER))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the same path on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_register("op2_warc", _warc.SQL)
def _op2(spark, table):
    return _warc.digest(table("pages"))


@_register("op3_html_text")
def _op3(spark, table):
    return _html_blocks.digest(table("pages"))


@_register("op9_cover_tree")
def _op9(spark, table):
    return _embeddings.digest(table("embeddings"))


@_register("op4_quality")
def _op4(spark, table):
    return _quality.digest(table("documents"), table("labels"))


@_register("op5_language")
def _op5(spark, table):
    return _langid.digest(table("documents"))


@_register("op8_toxicity")
def _op8(spark, table):
    return _toxicity.digest(table("documents"), table("labels"))


@_register("op13_conversation_repair")
def _op13(spark, table):
    return _conversations.digest(table("conversations"))


@_register("op12_stateful_dedup", _exact_dedup.SQL)
def _op12(spark, table):
    return _exact_dedup.digest(spark, table.path("documents"))


@_register("op11_whitening")
def _op11(spark, table):
    return _whitening.digest(table("embeddings"))
