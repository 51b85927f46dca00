"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length is needed to
plan: best fit, longest first, places whole counts of equal pieces into counts of equally full sequences. The
plan says which ranks of a length take which slots; pieces then join it on length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from wardlens.llm.shared import stored

CAPACITY = 4096
#: Id put behind every document.
END = 1
#: Words whose ids a worker remembers, twice at most.
REMEMBERED = 400_000
#: A plan of at most this many rows (40 bytes each) is broadcast.
BROADCAST_ROWS = 500_000
#: Pieces of one length that are ranked together, about.
SHARE_ROWS = 100_000
#: Ranks meet their slots in blocks of 2 to this power.
RANK_BITS = 12

# Ids of words met lately and before, by tokenizer; a Python worker keeps them from task to task.
_MEMORY: dict[str, _Memory] = {}

class _Memory:
    """A tokenizer and the ids of words; when full, words that were not needed lately are forgotten."""

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        last = [i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[last] = True

    def coded(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        found = list(map(self.recent.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        if len(self.recent) + len(missing) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        new = []
        for k in missing:
            known = self.older.get(words[k])
            if known is None:
                new.append(k)
            else:
                found[k] = self.recent[words[k]] = known
        for plain in (True, False):
            some = [k for k in new if _plain(words[k]) == plain]
            for at in range(0, len(some), 2000):
                part = some[at : at + 2000]
                for k, data in zip(part, self._encode([words[k] for k in part], plain), strict=True):
                    found[k] = self.recent[words[k]] = data
        return found

    def _encode(self, words: list[str], plain: bool) -> Iterator[bytes]:
        """Words coded together. The tokenizer drops the blanks between them; words of ASCII letters are one word to it and
        told apart by its word ends, others by where their ids begin in the text."""
        code = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(code.ids, "<u4")
        if plain:
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(words):
                raise ValueError("the tokenizer does not mark the end of each word")
        else:
            first = np.cumsum([0, *(len(w) + 1 for w in words)])
            stops = np.searchsorted([a for a, _ in code.offsets], first[1:])
        data, start = ids.tobytes(), 0
        for stop in (4 * stops).tolist():
            yield data[start:stop]
            start = stop


def _plain(word: str) -> bool:
    return word.isascii() and word.isalpha()


def ids_of(texts: pa.StringArray, tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of all texts one after the other, and where those of each text end.

    The same ids as of the whole text at once. Words are split and numbered for all texts together, only the distinct ones are
    looked up, and their ids gathered by number. The tokenizer parts letters from marks and lower-cases, so a last comma or
    full stop is parted from its word first, and ASCII words are lower-cased (in others, marks may join with a small letter
    only), unless a special token may be written in the texts.
    """
    plain = not pc.any(pc.match_substring(texts, "<|")).as_py()
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([.,])(\s|$)", r"\1 \2\3") if plain else texts)
    numbered = words.flatten().dictionary_encode()
    number, distinct = numbered.indices, numbered.dictionary
    if plain:
        again = pc.if_else(pc.string_is_ascii(distinct), pc.ascii_lower(distinct), distinct).dictionary_encode()
        number, distinct = again.indices.take(number), again.dictionary
    if tokenizer_path not in _MEMORY:
        _MEMORY[tokenizer_path] = _Memory(tokenizer_path)
    coded = _MEMORY[tokenizer_path].coded(distinct.to_pylist())
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)])
    table = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<u4")))
    gathered = table.take(number)
    before = gathered.offsets.to_numpy()
    offsets = words.offsets.to_numpy()
    return gathered.flatten().to_numpy(), before[offsets[1:] - offsets[0]].astype(np.int64) - before[0]


def _slices(sizes: list[int], limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes, so that work arrays stay small."""
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > limit:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _pieces(tokenizer_path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = END.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for a, b in _slices(pc.binary_length(texts).to_pylist()):
                ids, ends = ids_of(texts.slice(a, b - a), tokenizer_path)
                data = memoryview(np.ascontiguousarray(ids)).cast("B")
                rows = []
                first = 0
                for n, stop in enumerate(ends.tolist()):
                    # the end id stands behind the last of the text
                    for piece, at in enumerate(range(first, stop + 1, capacity)):
                        to = min(at + capacity, stop + 1)
                        crc = zlib.crc32(data[4 * at : 4 * min(to, stop)])
                        if to > stop:
                            crc = zlib.crc32(end, crc)
                        rows.append((a + n, piece, at - first, to - at, crc))
                    first = stop
                of, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(of)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def pieces(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the ids of a text and one end id, cut at ``capacity``."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots for ``counts`` pieces of each length: rows (length, first rank, ranks, first sequence, offset).

    Longest first, each into the fullest sequence with room, exactly as over single pieces: sequences of equal
    room are handled as ranges of numbers, and a range takes as many equal pieces as fit before the next.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    used = 0

    def add(left: int, first: int, n: int) -> None:
        if not left or not n:
            return
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((first, n))

    def fill(length: int, rank: int, left: int, first: int, n: int, each: int) -> int:
        """Put ``each`` pieces into each of ``n`` sequences; the rank after them."""
        for k in range(each):
            plan.append((length, rank, n, first, capacity - left + k * length))
            rank += n
        add(left - each * length, first, n)
        return rank

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, n = capacity, -(-(total - rank) // (capacity // length))
                first, used = used, used + n
            each = left // length
            full = min(n, (total - rank) // each)
            rank = fill(length, rank, left, first, full, each) if full else rank
            rest = min(total - rank, each - 1) if full < n else 0
            if rest:
                rank = fill(length, rank, left, first + full, 1, rest)
            add(left, first + full + bool(rest), n - full - bool(rest))
    return plan


def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with an id and a length of 1 to ``capacity``.

    At most ``capacity`` counts and the plan, whose size depends on the number of different lengths and not of pieces, pass
    through the driver. Pieces of a length are ranked in shares of about SHARE_ROWS and meet their slots by block of ranks,
    so neither a frequent length nor a length with many slots is a single task.
    """
    spark = pieces_table.sparkSession
    columns = pieces_table.columns
    # which share a piece is in is written with it, so that every reader agrees and repeated rows are dealt as well
    rows = stored(pieces_table.withColumn("lot", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = spark.createDataFrame([(k, -(-n // SHARE_ROWS)) for k, n in counts.items()], "length long, shares long")
    rows = rows.join(F.broadcast(sizes), "length").withColumn("share", F.pmod("lot", "shares")).drop("shares")
    shares = rows.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shares.select("length", "share", before.alias("before"))
    # a share of a length holds equal pieces in any order
    place = F.row_number().over(Window.partitionBy("length", "share").orderBy("lot")) - 1
    ranked = rows.withColumn("place", place).join(starts, ["length", "share"]).withColumn("rank", F.col("place") + F.col("before"))
    ranked = ranked.withColumn("block", F.shiftright("rank", RANK_BITS))
    plan = _plan_table(spark, best_fit(counts, capacity), counts)
    slotted = ranked.join(plan, ["length", "block"]).filter("rank >= from_rank and rank < to_rank")
    return slotted.select(*columns, (F.col("first") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), F.col("at").alias("offset"))


def _plan_table(spark: SparkSession, plan: list[tuple[int, int, int, int, int]], counts: dict[int, int]) -> DataFrame:
    """The plan as one row per slot and block of ranks that it reaches into; broadcast below BROADCAST_ROWS rows."""
    slots = spark.createDataFrame([(length, rank, rank + n, first, offset) for length, rank, n, first, offset in plan], "length long, from_rank long, to_rank long, first long, at long")
    blocks = F.sequence(F.shiftright("from_rank", RANK_BITS), F.shiftright(F.col("to_rank") - 1, RANK_BITS))
    table = slots.withColumn("block", F.explode(blocks))
    most = len(plan) + sum((n >> RANK_BITS) + 1 for n in counts.values())
    return F.broadcast(table) if most <= BROADCAST_ROWS else table


def digest(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """The columns of the query. A null text is empty and packs as its end id alone."""
    return pack(pieces(documents, tokenizer_path)).withColumnRenamed("id", "doc_id")
