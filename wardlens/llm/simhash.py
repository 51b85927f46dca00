"""Near-duplicate detection by SimHash, pairs found by self-joins of binary tries.

Fingerprints at ``budget`` or fewer differing bits agree in at least one of ``budget + 1`` blocks of bits. Each
block value is one trie (the block rotated to the top); a trie is joined with itself by walking pairs of nodes
downwards together, adding up differing bits and dropping a pair once they exceed the budget. A block value
held by many fingerprints is dealt out again by a second block of the remaining bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import components, stored

BITS = 64
SHINGLE = 3
SEED = 42
BUDGET = 3
#: A block value held by more fingerprints than this is dealt out by a second block.
HOT_BLOCK = 4096
# pairs of nodes walked at a time
_FRONT = 400_000
# pairs of values up to which two nodes are compared at once where a second test follows
_SMALL_PAIRS = 1024


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, repeats included, some at a time.

    Words are runs of bytes other than the six ASCII blanks, A-Z lower-cased. Fewer words than a shingle count
    as one shingle.
    """
    # both bytes.lower() and bytes.split() know ASCII only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) < shingle:
        yield np.array([digest(line, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(words) - shingle + 1
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        yield np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, to - at)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> np.ndarray:
    return np.packbits(ones * 2 > total, bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without words. A bit is set when more than half of the
    hashes have it."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes(text, shingle):
        ones += _set_bits(hashes)
        total += len(hashes)
    return int(_majority(ones, total)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "print"])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print) per row; the print is the fingerprint as a signed long."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {kind}, print long")


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of all pairs: ``label`` falls to the smallest index of each component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label[label], label):
            label[:] = label[label]


def _node_pairs(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of values of pairs of nodes, each once, some of the nodes at a time."""
    wide = bhi - blo
    sizes = (ahi - alo) * wide
    for part in np.array_split(np.arange(len(sizes)), max(1, int(sizes.sum()) // (_FRONT // 4) + 1)):
        total = sizes[part]
        node = np.repeat(part, total)
        within = np.arange(len(node)) - np.repeat(np.cumsum(total) - total, total)
        a, b = alo[node] + within // wide[node], blo[node] + within % wide[node]
        once = (alo[node] != blo[node]) | (a < b)
        yield a[once], b[once]


def trie_links(values: np.ndarray, depth: int, budget: int, also: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Component label (smallest index) of each value of sorted ``values``, which are distinct unless ``also`` is given.

    Two values are linked when they agree in the first ``depth`` bits and differ in at most ``budget`` others, and when
    ``also``, called with both indices, allows it. A node of the binary trie is a range of the sorted values.
    """
    label = np.arange(len(values))
    if len(values) < 2:
        return label
    cuts = np.flatnonzero(np.diff(values >> np.uint64(BITS - depth))) + 1
    lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(values)]))
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    waiting = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    zeros: dict[int, np.ndarray] = {}
    while waiting:
        depth, alo, ahi, blo, bhi, diff = waiting.pop()
        if not len(alo):
            continue
        if len(alo) > _FRONT:
            half = len(alo) // 2
            waiting += [(depth, *(x[:half] for x in (alo, ahi, blo, bhi, diff))), (depth, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        # two single values: the rest of the walk is one count of differing bits
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            a, b = a[near], b[near]
            if also is not None:
                near = also(a, b)
                a, b = a[near], b[near]
            _settle(label, a, b)
            alo, ahi, blo, bhi, diff = (x[~leaf] for x in (alo, ahi, blo, bhi, diff))
        if also is not None:
            # small nodes pair by pair: with a wide budget the walk would prune little below them
            few = (ahi - alo) * (bhi - blo) <= _SMALL_PAIRS
            for a, b in _node_pairs(alo[few], ahi[few], blo[few], bhi[few]):
                near = np.bitwise_count(values[a] ^ values[b]) <= budget
                a, b = a[near], b[near]
                near = also(a, b)
                _settle(label, a[near], b[near])
            alo, ahi, blo, bhi, diff = (x[~few] for x in (alo, ahi, blo, bhi, diff))
        if depth == BITS and also is not None:
            # equal values at the end of the trie: a node's pairs one by one
            for a0, a1, b0, b1 in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist(), strict=True):
                for a in range(a0, a1):
                    b = np.arange(a + 1 if a0 == b0 else b0, b1)
                    b = b[also(np.full(len(b), a), b)]
                    _settle(label, np.full(len(b), a), b)
        if depth == BITS or not len(alo):
            continue
        if depth not in zeros:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate(([0], np.cumsum(bit == 0)))
        below = zeros[depth]
        amid, bmid = alo + below[ahi] - below[alo], blo + below[bhi] - below[blo]
        same = alo == blo
        for p_lo, p_hi, q_lo, q_hi, more, kept in (
            (alo, amid, blo, bmid, 0, None),
            (amid, ahi, bmid, bhi, 0, None),
            (alo, amid, bmid, bhi, 1, None),
            (amid, ahi, blo, bmid, 1, ~same),
        ):
            alive = (p_lo < p_hi) & (q_lo < q_hi) & (diff + more <= budget) & ~((p_lo == q_lo) & (p_hi - p_lo == 1))
            if kept is not None:
                alive &= kept
            waiting.append((depth + 1, p_lo[alive], p_hi[alive], q_lo[alive], q_hi[alive], diff[alive] + more))
    return label


def _tries(budget: int):
    blocks = budget + 1
    wide = BITS // blocks
    narrow = (BITS - wide) // blocks

    def links(values: np.ndarray, tag: int) -> np.ndarray:
        block, second = divmod(tag, blocks + 1)
        turned = values if not block else (values << np.uint64(wide * block)) | (values >> np.uint64(BITS - wide * block))
        if second > 1:
            low = np.uint64((1 << (BITS - wide)) - 1)
            turn = np.uint64(narrow * (second - 1))
            rest = turned & low
            turned = (turned & ~low) | (((rest << turn) | (rest >> (np.uint64(BITS - wide) - turn))) & low)
        order = np.argsort(turned)
        label = trie_links(turned[order], wide if not second else wide + narrow, budget)
        out = np.empty(len(values), np.int64)
        out[order] = order[label]
        return out

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by tag and key; whole groups are joined some tens of thousands of rows at a time
        tags, keys, values, ids = (np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))

        def emit(n: int) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            for tag in np.unique(tags[:n]).tolist():
                mine = np.flatnonzero(tags[:n] == tag)
                label = links(values[mine], tag)
                moved = label != np.arange(len(mine))
                a.append(ids[mine[moved]])
                b.append(ids[mine[label[moved]]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            tags, keys, ids = np.concatenate((tags, new[0])), np.concatenate((keys, new[1])), np.concatenate((ids, new[3]))
            values = np.concatenate((values, new[2].view(np.uint64)))
            if len(tags) >= 50_000:
                last = (tags == tags[-1]) & (keys == keys[-1])
                n = int(np.argmax(last))  # the last group may go on in the next batch
                if n:
                    yield from emit(n)
                    tags, keys, values, ids = tags[n:], keys[n:], values[n:], ids[n:]
        yield from emit(len(tags))

    return join, blocks, wide, narrow


def near_copies(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, budget: int = BUDGET, hot_block: int = HOT_BLOCK
) -> DataFrame:
    """(id, print, component): the fingerprint and the smallest id reachable over links of ``budget`` bits.

    A null or empty text has fingerprint 0 and is linked like any other. Ids are integers; rows whose id is null
    keep a null component unless another id shares their fingerprint. Repeated ids and repeated rows stay rows.
    Other columns are not read.
    """
    rows = stored(fingerprints(documents, id_col, text_col), "fingerprints")
    classes = rows.groupBy("print").agg(F.min("id").cast("long").alias("rep"))
    join, blocks, wide, narrow = _tries(budget)
    low = (1 << (BITS - wide)) - 1

    turned = [
        F.col("print") if not b else F.shiftleft("print", wide * b).bitwiseOR(F.shiftrightunsigned("print", BITS - wide * b)) for b in range(blocks)
    ]
    first = classes.filter(F.col("rep").isNotNull()).select(
        "print", "rep", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), t.alias("turned")) for b, t in enumerate(turned)])).alias("x")
    ).select("print", "rep", "x.block", "x.turned", F.shiftrightunsigned("x.turned", BITS - wide).alias("value"))
    # at most blocks * 2**wide rows whatever the input holds
    hot = first.groupBy("block", "value").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > hot_block)
    hot = F.broadcast(hot.select("block", "value", F.lit(True).alias("hot")))
    rest = F.col("turned").bitwiseAND(F.lit(low))
    seconds = [
        (rest if not s else F.shiftleft(rest, narrow * s).bitwiseOR(F.shiftrightunsigned(rest, BITS - wide - narrow * s)).bitwiseAND(F.lit(low)))
        for s in range(blocks)
    ]
    again = F.array(*[
        F.struct(
            (F.lit(s + 1)).alias("second"),
            F.shiftleft("value", narrow).bitwiseOR(F.shiftrightunsigned(t, BITS - wide - narrow)).alias("key"),
        )
        for s, t in enumerate(seconds)
    ])
    once = F.array(F.struct(F.lit(0).alias("second"), F.col("value").alias("key")))
    dealt = first.join(hot, ["block", "value"], "left").select(
        "block", "print", "rep", F.explode(F.when(F.col("hot"), again).otherwise(once)).alias("x")
    )
    dealt = dealt.select((F.col("block") * (blocks + 1) + F.col("x.second")).cast("long").alias("tag"), F.col("x.key").alias("key"), "print", "rep")
    links = dealt.repartition("tag", "key").sortWithinPartitions("tag", "key").mapInArrow(join, "a long, b long")
    roots = components(links, "a", "b")
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("root", "rep").alias("component"))
    return rows.join(named, "print").select("id", "print", "component")


# --- texts of a given similarity -------------------------------------------------------------------------------------

#: Shingle and similarity of near-copies, and the 64-bit words of their long fingerprints.
WIDE_SHINGLE, SIMILARITY, WORDS = 5, 0.8, 16
#: Words that texts are dealt by, and pairs at the very similarity that may be missed.
_DEALT_WORDS, MISSED = 16, 0.05
#: Texts that share a block value by chance, about; more texts are dealt by longer blocks.
_BY_CHANCE = 64


def long_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, words: int = WORDS) -> np.ndarray:
    """SimHash of ``64 * words`` bits over different shingles: one hash each, mixed anew for every word; zero for a text
    without words."""
    ones = np.zeros((words, BITS), np.int64)
    every = list(_shingle_hashes(text, shingle))
    hashes = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
    total = len(hashes)
    salt = np.array([0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1 for k in range(words)], np.uint64)[:, None]
    for at in range(0, total, 4096):
        x = hashes[at : at + 4096] + salt
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8).reshape(words, -1, 8), axis=2, bitorder="little")
        ones += bits.sum(1, dtype=np.uint16)
    return np.concatenate([_majority(row, total) for row in ones])


def differing_share(similarity: float) -> float:
    """The share of bits in which texts of this Jaccard similarity differ: the angle between their shingle sets over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _tables(n: int, similarity: float) -> tuple[int, int]:
    """(bits per block, blocks): blocks grow with the number of texts, and their number so that MISSED is kept."""
    bits = min(32, max(12, math.ceil(math.log2(max(1, n / _BY_CHANCE)))))
    agree = (1 - differing_share(similarity)) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(1 - agree)))


def _long_fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [long_fingerprint(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["id", "print"])

    return run


def _deal(bits: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(print, rep) -> one row per block: the word, turned so that the block is on top, and its top bits as key."""
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").reshape(-1, WORDS)
            for block in range(blocks if len(prints) else 0):
                word, turn = prints[:, block % _DEALT_WORDS], np.uint64(block // _DEALT_WORDS * bits % BITS)
                turned = (word << turn) | (word >> (np.uint64(BITS) - turn)) if turn else word
                key = (turned >> np.uint64(BITS - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(prints), block, np.int32)), pa.array(key), pa.array(turned.view(np.int64)), *batch.columns],
                    names=["block", "key", "turned", "print", "rep"],
                )

    return run


def _similar(bits: int, similarity: float):
    share = differing_share(similarity)
    # a standard error more than the share, so that most pairs at the very similarity pass
    limit = math.floor(share * BITS * WORDS + math.sqrt(share * (1 - share) * BITS * WORDS))
    # a single word strays: three standard errors more than its share
    budget = math.ceil(share * BITS + 3 * math.sqrt(share * (1 - share) * BITS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def emit(tags, keys, turned, prints, reps) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((turned, keys, tags))
            tags, keys, turned, prints, reps = (x[order] for x in (tags, keys, turned, prints, reps))
            for tag in np.unique(tags).tolist():
                a, b = np.searchsorted(tags, (tag, tag + 1))
                own = prints[a:b]
                label = trie_links(
                    turned[a:b], bits, budget, lambda i, j, own=own: np.bitwise_count(own[i] ^ own[j]).sum(1, dtype=np.int64) <= limit
                )
                moved = np.flatnonzero(label != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(reps[a:b][moved]), pa.array(reps[a:b][label[moved]])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, WORDS)
            block, key, turned, rep = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            held.append((block.astype(np.int64), key, turned.view(np.uint64), prints, rep))
            rows += batch.num_rows
            if rows >= 100_000:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
                n = int(np.argmax(last))  # the last group may go on in the next batch
                if n:
                    yield from emit(*(c[:n] for c in columns))
                held = [tuple(c[n:] for c in columns)]
                rows = len(held[0][0])
        if held:
            yield from emit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return join


def similar_copies(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """(id, component): the smallest id reachable over links between texts of ``similarity`` or more.

    Similarity is the Jaccard similarity of word shingles as told by long fingerprints: of 1,024 bits, with a standard error
    of 0.03 at 0.8, which is allowed for, so texts of 0.75 may be linked and hardly any below. Texts meet where a block of a word of their fingerprints agrees; there a trie drops pairs whose word
    differs too much, and the whole fingerprint decides. Blocks and their number follow the number of different texts, so
    that a pair at the very similarity is missed in at most MISSED of the cases, and more similar ones less often.

    A null or empty text has fingerprint zero and is linked with its like. Rows with a null id have a null component unless
    another id shares their fingerprint; repeated ids and rows stay rows. Other columns are not read.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    given = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(given.mapInArrow(_long_fingerprints(shingle), f"id {kind}, print binary"), "long-fingerprints")
    classes = stored(rows.groupBy("print").agg(F.min("id").cast("long").alias("rep")), "long-classes")
    known = classes.filter(F.col("rep").isNotNull())
    bits, blocks = _tables(known.count(), similarity)
    dealt = known.select("print", "rep").mapInArrow(_deal(bits, blocks), "block int, key long, turned long, print binary, rep long")
    links = dealt.repartition("block", "key").sortWithinPartitions("block", "key").mapInArrow(_similar(bits, similarity), "a long, b long")
    roots = components(links, "a", "b")
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("root", "rep").alias("component"))
    return rows.join(stored(named, "long-names"), "print").select("id", "component")


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query; the fingerprint as 16 hexadecimal digits."""
    found = near_copies(documents)
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
