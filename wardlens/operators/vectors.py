"""Word vectors, document vectors, and the feature matrix as sparse triples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions import scalars as S
from wardlens.operators import features as V
from wardlens.operators.relations import join_grouped
from wardlens.operators.text import lookup_tokens, token_positions
from wardlens.session import sent

# Rows of the padded matrix that the mean runs over.
AVERAGE_CAP = 4000

# Feature tables up to this many rows are broadcast; their width is known before the query runs.
BROADCAST_WIDTH = 200_000

# Numbers of a word vector table that is broadcast; a larger one is joined by token.
MOST_NUMBERS = 100_000_000

# Numbers of a word vector table that is sent to the Python workers as arrays, and tokens summed at once there.
MOST_ARRAY_NUMBERS, SUMMED_TOKENS = 50_000_000, 20_000


# --- word vectors ------------------------------------------------------------------------------------------

def combine_vectors(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """One table (token, vec): the primary vector where there is one, otherwise the fallback."""
    ranked = primary.select("token", "vec", F.lit(0).alias("source")).unionByName(
        fallback.select("token", "vec", F.lit(1).alias("source"))
    )
    return ranked.groupBy("token").agg(F.min_by("vec", "source").alias("vec"))


def lookup_vectors(tokens: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows with a token, plus its vector; NULL when neither table has it."""
    first = primary.select("token", F.col("vec").alias("v1"))
    second = fallback.select("token", F.col("vec").alias("v2"))
    joined = tokens.join(first, "token", "left").join(second, "token", "left")
    return joined.withColumn("vec", F.coalesce("v1", "v2")).drop("v1", "v2")


def zero_vector(d: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), d)


def token_vectors(
    df: DataFrame, key: str, text: str, vectors: DataFrame, d: int, max_len: int | None = None
) -> DataFrame:
    """(key, pos, vec) for every token, zeros for unknown ones; tokens past ``max_len`` are cut before the lookup."""
    tokens = S.words(text)
    if max_len is not None:
        tokens = F.slice(tokens, 1, max_len)
    found = lookup_tokens(token_positions(df, key, tokens), key, vectors.select("token", "vec"), most=MOST_NUMBERS // d)
    kept = found.filter(F.col("token").isNotNull())
    return kept.select(key, "pos", "token", F.coalesce("vec", zero_vector(d)).alias("vec"))


def pad_sequences(sequence: DataFrame, key: str, max_len: int, d: int) -> DataFrame:
    """One ``max_len`` x ``d`` matrix per key: vectors in order, cut or filled with zero vectors."""
    kept = sequence.filter(F.col("pos") < max_len)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda e: e["vec"])
    gathered = kept.groupBy(key).agg(ordered.alias("seq"))
    filler = F.array_repeat(zero_vector(d), F.lit(max_len) - F.size("seq"))
    return gathered.select(key, F.size("seq").alias("n_tokens"), F.concat("seq", filler).alias("matrix"))


def _fits_array(table: DataFrame, d: int) -> bool:
    """Whether a table (token, v) is an array of bounded size: every token once, every vector whole."""
    whole = (F.size("v") == d) & ~F.exists("v", lambda x: x.isNull())
    n, tokens, fits = table.agg(F.count(F.lit(1)), F.count_distinct("token"), F.bool_and(whole)).first()
    return bool(fits) and n == tokens and n * d <= MOST_ARRAY_NUMBERS


def _text_sums(df: DataFrame, table: DataFrame, key: str, d: int) -> DataFrame:
    """(key, sums) per row of (key, tokens): the sum of the vectors of its known tokens, null without one."""
    found = table.select("token", "v").toArrow().combine_chunks()
    context = df.sparkSession.sparkContext
    values = found.column("v").combine_chunks()
    sent_ = context.broadcast((found.column("token").combine_chunks(), values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = sent_.value
        for batch in batches:
            lists = batch.column(1)
            ids = pc.index_in(lists.flatten(), value_set=words)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy()[known]
            ids, out = ids.drop_null().to_numpy(), np.zeros((batch.num_rows, d))
            for at in range(0, len(ids), SUMMED_TOKENS):
                rows = row[at : at + SUMMED_TOKENS]
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                # rows come in order; one that goes on from the tokens before is added to
                out[rows[first]] += np.add.reduceat(vectors[ids[at : at + SUMMED_TOKENS]].astype(np.float64), first)
            met = np.zeros(batch.num_rows, bool)
            met[row] = True
            flat = pa.array(out.ravel())
            whole = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d), flat, mask=pa.array(~met))
            yield pa.RecordBatch.from_arrays([batch.column(0), whole], names=[key, "sums"])

    kind = df.schema[key].dataType.simpleString()
    return df.mapInArrow(sums, f"`{key}` {kind}, sums array<double>")


def average_embedding(
    df: DataFrame,
    key: str,
    text: str,
    vectors: DataFrame,
    d: int,
    cap: int = AVERAGE_CAP,
    mode: str = "padded",
    max_len: int | Column | None = None,
) -> DataFrame:
    """Mean vector of each document's first ``cap`` tokens: (key, vec).

    ``mode='padded'``: the divisor is ``min(max_len, cap)``, the rows of the zero-padded matrix, with
    ``max_len`` the longest document unless given. ``mode='tokens'``: the document's own tokens up to the cap.

    Vectors that fit an array are summed text by text, and no token leaves its row (``_text_sums``). Otherwise repeats of
    a word are counted within the document before the lookup, so a frequent word is at most one row per document, and
    only known words go on to the sum, one number per dimension. Where ``df`` comes by key and the vectors fit a
    broadcast, nothing but the result leaves the task. The padding is never materialized.
    """
    tokens = F.slice(S.words(text), 1, cap)
    table, small = sent(vectors.filter(F.col("vec").isNotNull()).select("token", F.col("vec").alias("v")), "vectors", MOST_NUMBERS // d)
    arrays = small and _fits_array(table, d)
    if arrays:
        # every document has a row here; one without a key meets no sum, as in a join
        texts, known = _text_sums(df.select(key, tokens.alias("tokens")), table, key, d), F.col(key).isNotNull() & (F.count("sums") > 0)
        total = texts.groupBy(key).agg(F.when(known, F.array(*[F.sum(F.col("sums")[i]) for i in range(d)])).alias("total"))
    else:
        counted = df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(
            F.count(F.lit(1)).cast("double").alias("n")
        )
        known = counted.join(table, "token") if small else join_grouped(counted, table, ["token"])
        total = known.groupBy(key).agg(F.array(*[F.sum(F.col("v")[i].cast("double") * F.col("n")) for i in range(d)]).alias("total"))
    if mode == "padded":
        if max_len is None:
            max_len = df.agg(F.max(F.size(S.words(text)))).scalar()
        divisor = F.least(F.lit(max_len) if isinstance(max_len, int) else max_len, F.lit(cap))
        sizes = None if arrays else df.select(key).distinct()
    elif mode == "tokens":
        divisor = F.least("n_tokens", F.lit(cap))
        sizes = df.groupBy(key).agg(F.sum(F.size(S.words(text))).alias("n_tokens"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    zeros = F.array_repeat(F.lit(0.0), d)
    summed = (total if sizes is None else sizes.join(total, key, "left")).withColumn("divisor", divisor)
    mean = F.transform("total", lambda x: x / F.col("divisor"))
    return summed.select(key, F.when(F.col("total").isNotNull() & (F.col("divisor") > 0), mean).otherwise(zeros).alias("vec"))


# --- feature matrix ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Block:
    """A feature block: triples (key, idx, value) with idx in 0..len(names)-1."""

    names: list[str]
    triples: DataFrame


def word_block(
    docs: DataFrame,
    fit_docs: DataFrame,
    counts: DataFrame,
    fit_counts: DataFrame,
    key: str,
    max_features: int,
) -> Block:
    """The weighted words as a block. The vocabulary, at most ``max_features`` rows, comes to the driver once:
    it names the features and goes back as a literal table."""
    fitted = V.tfidf_fit(fit_counts, V.document_count(fit_docs, key), max_features)
    entries = fitted.collect()
    vocab = docs.sparkSession.createDataFrame(entries, fitted.schema)
    words = [r["token"] for r in sorted(entries, key=lambda r: r["idx"])]
    return Block(words, V.tfidf_transform(counts, vocab, key).select(key, "idx", "value"))


def term_block(docs: DataFrame, key: str, text: str, terms: Sequence[str]) -> Block:
    """Term hits as a block, in the order of the terms; the pieces of a cut document add up."""
    index = F.create_map(*[F.lit(x) for i, t in enumerate(terms) for x in (t, i)])
    hits = V.hotspot_counts(docs, key, text, terms).groupBy(key, index[F.col("term")].alias("idx"))
    return Block([f"HP_{t}" for t in terms], hits.agg(F.sum("value").alias("value")))


def vector_block(vectors: DataFrame, key: str, d: int, prefix: str, vec: str = "vec") -> Block:
    """A dense block from a vector column: every dimension of every document is a triple."""
    triples = vectors.select(key, F.posexplode(vec).alias("idx", "value"))
    return Block([f"{prefix}{i}" for i in range(d)], triples.withColumn("value", F.col("value").cast("double")))


def combine_blocks(blocks: Sequence[Block], key: str) -> tuple[DataFrame, list[str]]:
    """All blocks side by side: triples with shifted indices, and the feature names in index order."""
    combined, names = None, []
    for block in blocks:
        shifted = block.triples.select(key, (F.col("idx") + len(names)).cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
        combined = shifted if combined is None else combined.unionByName(shifted)
        names = names + list(block.names)
    return combined, names


def min_max(
    triples: DataFrame, documents: DataFrame, key: str, fit: str = "per_split", width: int | None = None
) -> DataFrame:
    """Scale each feature to 0..1 from its least and greatest value, implicit zeros included.

    ``documents`` has (key, split); triples that carry their split are not joined with it. ``fit='per_split'`` takes
    the range of the document's own split, ``'train'`` that of the training split. A constant feature gives 0. Triples
    that are absent stay absent, which is right for features whose least value is 0 or more; blocks with negative
    values must be dense.
    """
    sizes = documents.groupBy("split").agg(F.count_distinct(key).alias("n_docs"))
    placed = triples if "split" in triples.columns else triples.join(documents.select(key, "split"), key)
    ranges = placed.groupBy("split", "idx").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n_stored")
    ).join(F.broadcast(sizes), "split")
    implicit = F.col("n_stored") < F.col("n_docs")
    ranges = ranges.select(
        "split", "idx",
        F.when(implicit, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
        F.when(implicit, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
    )
    keys = ["split", "idx"]
    if fit == "train":
        ranges, keys = ranges.filter(F.col("split") == "train").drop("split"), ["idx"]
    elif fit != "per_split":
        raise ValueError(f"unknown fit {fit!r}")
    if width is not None and width <= BROADCAST_WIDTH:
        ranges = F.broadcast(ranges)
    scaled = placed.join(ranges, keys, "left")
    spread = F.col("hi") - F.col("lo")
    value = F.when(spread > 0, (F.col("value") - F.col("lo")) / spread).when(spread == 0, 0.0).otherwise(F.col("value"))
    return scaled.select(key, "split", "idx", value.alias("value"))


def pack_vectors(triples: DataFrame, documents: DataFrame, key: str, width: int) -> DataFrame:
    """Sparse vectors for the estimators: the columns of ``documents`` plus ``features``.

    A row holds at most ``width`` entries. Documents without a stored feature get an empty vector.
    """

    @F.udf(VectorUDT(), useArrow=True)
    def to_sparse(indices: list[int] | None, values: list[float] | None) -> SparseVector:
        return Vectors.sparse(width, indices or [], values or [])

    entries = F.array_sort(F.collect_list(F.when(F.col("value") != 0, F.struct("idx", "value"))))
    packed = triples.groupBy(key).agg(entries.alias("entries"))
    joined = documents.join(packed, key, "left")
    return joined.withColumn("features", to_sparse("entries.idx", "entries.value")).drop("entries")
