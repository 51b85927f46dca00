"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every run of ``span`` words contains ``span - gram + 1`` grams of ``gram`` words; the gram with the smallest
hash in each such run is a fingerprint. Equal runs choose equal fingerprints, so joining the fingerprints of
documents and items finds every shared run; a hit is then extended to the runs around it, which are compared
word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import ascii_lower, stored

#: A word: what is neither an ASCII control, blank or punctuation mark, nor A-Z (lower-cased before).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# A gram and its place share one long: the upper bits of the hash order the grams, 28 bits hold the place.
_PLACE = (1 << 28) - 1


@dataclass(frozen=True)
class Winnowing:
    span: int = 10
    gram: int = 5
    #: Item windows and marks are broadcast up to this many rows (some 100 bytes each); above, the joins shuffle.
    broadcast_rows: int = 200_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _run(start: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", start + 1, length))


def _mark_column(length: int, gram_words: int, step) -> Column:
    """Fingerprints of the runs of one length; ``step(name, column)`` adds a column and returns it."""
    gram = min(gram_words, length)
    width = length - gram + 1
    nothing = F.array().cast("array<bigint>")
    enough = F.col("n") >= length
    grams = step("grams", F.when(
        enough, F.transform(F.sequence(F.lit(0), F.col("n") - gram), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(gram)]))
    ).otherwise(nothing))
    packed = step("packed", F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))))
    lowest = (lambda i: F.least(*[F.get(packed, i + j) for j in range(width)])) if width > 1 else (lambda i: F.get(packed, i))
    chosen = step("chosen", F.when(
        enough, F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("n") - length), lowest))
    ).otherwise(nothing))

    def mark(p):
        place = p.bitwiseAND(F.lit(_PLACE)).cast("int")
        return F.struct(F.lit(length).alias("length"), place.alias("place"), F.get(grams, place).alias("mark"))

    return F.transform(chosen, mark)


def with_marks(frame: DataFrame, lengths: list[int], gram_words: int) -> DataFrame:
    """Add ``marks``, an array of (length, place, mark): the fingerprints for runs of each length.

    ``words`` and ``n``, their number, are given. Runs shorter than ``gram_words`` are their own gram.
    """
    kept = frame.columns
    frame = frame.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    lists = []
    for length in lengths:

        def step(name: str, column: Column, length: int = length) -> Column:
            nonlocal frame
            frame = frame.withColumn(f"{name}{length}", column)
            return F.col(f"{name}{length}")

        lists.append(_mark_column(length, gram_words, step))
    return frame.select(*kept, F.concat(*lists).alias("marks"))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, span: int) -> DataFrame:
    """Windows of the items: words, n (words of the window), run (joined words), items (ids as text)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all_words"))
    items = items.filter(F.col("item").isNotNull() & (F.size("all_words") > 0))
    size = F.least(F.lit(span), F.size("all_words"))
    starts = items.select("item", "all_words", size.alias("n"), F.explode(F.sequence(F.lit(1), F.size("all_words") - size + 1)).alias("at"))
    windows = starts.select("item", F.slice("all_words", F.col("at"), F.col("n")).alias("words"), "n")
    return windows.groupBy("words", "n").agg(F.collect_set("item").alias("items")).withColumn("run", F.concat_ws(" ", "words"))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    settings: Winnowing = Winnowing(),
) -> DataFrame:
    """Per document: id, n_words, n_hit, items (sorted ids as text), spans (start word, words).

    Null or empty texts have no words and no hits. Items without an id or without a word are left out; an
    item of fewer words than ``span`` is one window. Every row is a document of its own, whether its id is null or
    repeated; rows of equal id and words are worked on once. Other columns, whatever their names, are not read.
    """
    windows = stored(item_windows(benchmark, item_col, item_text_col, settings.span), "item-windows")
    rows, names = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect()) or [settings.span]
    small = rows + names <= settings.broadcast_rows
    bounded = F.broadcast if small else (lambda frame: frame)

    marks = with_marks(windows, lengths, settings.gram).select("n", F.explode("marks").alias("m"))
    marks = marks.filter(F.col("m.length") == F.col("n")).select("m.length", "m.mark", F.lit(True).alias("known")).distinct()

    texts = documents.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    texts = texts.withColumn("n", F.size("words")).withColumn("tag", F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b")))
    key = ["id", "tag"]
    # one more entry per document keeps those without any hit, so that texts are read once
    whole = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("place"), F.lit(None).cast("bigint").alias("mark")))
    marked = with_marks(texts, lengths, settings.gram)
    if small:
        found = (
            marked.select(*key, "words", "n", F.explode(F.concat("marks", whole)).alias("m"))
            .select(*key, "words", "n", "m.*")
            .join(F.broadcast(marks), ["length", "mark"], "left")
            .filter(F.col("known") | (F.col("length") == 0))
        )
    else:
        hits = (
            # written first: the optimizer would work out all marks of a text again for each one of them
            stored(marked.select(*key, "marks"), "marks").select(*key, F.explode("marks").alias("m")).select(*key, "m.*").join(marks, ["length", "mark"])
            .groupBy(*key).agg(F.collect_set(F.struct("length", "place", "mark")).alias("hits"))
        )
        same = F.col("t.id").eqNullSafe(F.col("h.id")) & (F.col("t.tag") == F.col("h.tag"))
        found = (
            texts.alias("t").join(hits.alias("h"), same, "left").select("t.id", "t.tag", "words", "n", "hits")
            .select(*key, "words", "n", F.explode(F.concat(F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)), whole)).alias("m"))
            .select(*key, "words", "n", "m.*")
        )
    reach = F.col("length") - F.least(F.col("length"), F.lit(settings.gram))
    first = F.greatest(F.lit(0), F.col("place") - reach)
    last = F.least(F.col("place"), F.col("n") - F.col("length"))
    starts = F.when(F.col("length") == 0, F.array(F.lit(-1))).when(first <= last, F.sequence(first, last))
    runs = found.select(*key, "words", "n", "length", F.explode(starts).alias("start"))
    runs = runs.select(*key, "n", "length", "start", F.when(F.col("length") > 0, _run(F.col("start"), F.col("length"))).alias("run"))
    hit = F.col("items").isNotNull()
    per_document = (
        runs.join(bounded(windows.select(F.col("n").alias("length"), "run", "items")), ["length", "run"], "left")
        .filter(hit | (F.col("start") < 0))
        .groupBy(*key)
        .agg(
            F.count_if(F.col("start") < 0).alias("rows"),
            F.max("n").cast("long").alias("n_words"),
            F.collect_set(F.when(hit, F.struct("start", "length"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    every = per_document.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return every.select(F.col("id").alias(id_col), "n_words", F.size(places).cast("long").alias("n_hit"), "items", "spans")


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: counts, and one hash over the sorted item ids."""
    return result.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The digest, in DuckDB's SQL.
SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null
), windows as materialized (
  select distinct item, least(10, len(w)) as size, array_to_string(w[pos : pos + least(10, len(w)) - 1], ' ') as run
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as pos from b where len(w) > 0)
), sizes as (select distinct size from windows),
runs as (
  select doc_id, size, pos, array_to_string(w[pos : pos + size - 1], ' ') as run
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as pos from d, sizes where len(w) >= size)
), hits as materialized (
  select r.doc_id, r.pos, r.size, x.item from runs r join windows x on r.size = x.size and r.run = x.run
), places as (
  select doc_id, count(distinct place) as n_hit
  from (select doc_id, unnest(range(pos, pos + size)) as place from (select distinct doc_id, pos, size from hits)) group by 1
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct doc_id, item from hits) group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(listed, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""
