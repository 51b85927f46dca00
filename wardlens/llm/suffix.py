"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte is removed when it lies in a string of ``WINDOW`` bytes that also starts somewhere else. Each such string
holds an anchor: the place of its smallest gram hash, which depends on the string alone, so equal strings have
equal anchors at equal distances. Only anchors whose gram occurs again take part, each with the suffix that
starts there (as far as a string can reach) and the bytes before it.

Tasks sort their suffixes into runs and send them front-coded: the length of the prefix shared with the suffix
before, then the rest. A receiving task merges its runs with a loser tree that carries those lengths along: two
suffixes are compared only beyond the prefix both are known to share with the last one put out. The shared
lengths of the merged order bound the groups of equal grams, and within a group tell which strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import stored

WINDOW = 200
#: Bytes of a gram; an anchor is at most WINDOW - GRAM bytes behind the start of its string. Longer grams match less
#: often by chance, shorter ones leave anchors further apart.
GRAM = 32
REACH = WINDOW - GRAM
#: Grams with more occurrences than this are resolved by counting their strings in an aggregate instead of in one task.
HOT_GRAM = 150_000
#: Suffixes per run and, on average, per receiving bucket.
RUN = 40_000
BUCKET = 25_000

_CHUNK = 1 << 20
_NO_ID = -(1 << 63)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    n = _CHUNK + 2 * WINDOW
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place of at most ``_CHUNK + 2 * WINDOW`` bytes."""
    if not _POWERS:
        _POWERS.append(_powers())
    up, down = _POWERS[0]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    n = len(data) - GRAM + 1
    x = (total[GRAM : GRAM + n] - total[:n]) * down[:n]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of one chunk of joined texts; ``ends`` has the end of each byte's text."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = _gram_hashes(data)
    width = REACH + 1
    n = len(hashes)
    mask = np.uint64((1 << 21) - 1)
    packed = np.full(-(-n // width) * width, ~np.uint64(0))
    packed[:n] = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    rows = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - width + 1)
    starts = starts[ends[: len(starts)] - starts >= WINDOW]
    places = np.unique((np.minimum(behind[starts], ahead[starts + width - 1]) & mask).astype(np.int64))
    return places, hashes[places]


def _text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) -> (id, mark, place, gram): short texts are joined into chunks, long ones cut with an overlap."""

    def chunk(parts: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(p[3]) for p in parts], np.int64)
        if not lengths.sum():
            return
        stops = np.cumsum(lengths)
        places, grams = anchors(np.frombuffer(b"".join(p[3] for p in parts), np.uint8), np.repeat(stops, lengths))
        of = np.searchsorted(stops, places, side="right")
        ids, marks, offsets = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[of]), pa.array(marks[of]), pa.array(places - (stops - lengths)[of] + offsets[of]), pa.array(grams.view(np.int64))],
            names=["id", "mark", "place", "gram"],
        )

    for batch in batches:
        waiting, size = [], 0
        for i, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = _text_bytes(text.as_py())
            if len(data) < WINDOW:
                continue
            for at in range(0, max(1, len(data) - WINDOW + 1), _CHUNK):
                piece = data[at : at + _CHUNK + WINDOW - 1]
                if size + len(piece) > _CHUNK and waiting:
                    yield from chunk(waiting)
                    waiting, size = [], 0
                waiting.append((i, mark, at, piece))
                size += len(piece)
        yield from chunk(waiting)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to be common."""
    n = min(len(a), len(b))
    differing = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differing.bit_length() + 7) // 8


_BLOCK = (
    "bucket int, suffix_shared binary, suffix_size binary, suffix_rest binary, "
    "before_shared binary, before_size binary, before_rest binary, ids binary, marks binary, places binary"
)
_BLOCK_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix with the string before, size and remaining bytes of each; all strings have at most 200 bytes."""
    shared, rest, last = bytearray(), [], b""
    for s in strings:
        n = len(s) if s == last else shared_prefix(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return bytes(shared), bytes(map(len, strings)), zstandard.compress(b"".join(rest))


def _decode(shared: bytes, sizes: bytes, rest: bytes) -> Iterator[tuple[int, bytes]]:
    last, at, rest = b"", 0, zstandard.decompress(rest)
    for n, size in zip(shared, sizes, strict=True):
        more = size - n
        last = last[:n] + rest[at : at + more]
        at += more
        yield n, last


def _make_runs(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, mark, text, places) -> front-coded blocks, one for each run and bucket. The gram decides the bucket."""

    def run_of(taken: list[tuple[int, bytes, bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
        taken.sort(key=lambda x: x[0].to_bytes(4, "big") + x[1])
        cuts = [0, *(i for i in range(1, len(taken)) if taken[i][0] != taken[i - 1][0]), len(taken)]
        rows = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = taken[a:b]
            numbers = [np.array([x[i] for x in part], np.int64).tobytes() for i in (3, 4, 5)]
            rows.append((part[0][0], *_front_code([x[1] for x in part]), *_front_code([x[2] for x in part]), *numbers))
        kinds = [pa.int32(), *[pa.binary()] * 9]
        for at in range(0, len(rows), 256):
            columns = zip(*rows[at : at + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_BLOCK_NAMES)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = []
        for batch in batches:
            for i, mark, text, places in zip(*(batch.column(n) for n in range(4)), strict=True):
                data, i, mark = _text_bytes(text.as_py()), i.as_py(), mark.as_py()
                for p in places.as_py():
                    # the bytes before, last one first
                    taken.append((
                        xxhash.xxh32_intdigest(data[p : p + GRAM]) % buckets, data[p : p + WINDOW], data[max(0, p - REACH) : p][::-1], i, mark, p
                    ))
                    if len(taken) >= RUN:
                        yield from run_of(taken)
                        taken = []
        if taken:
            yield from run_of(taken)

    return make


def merge_runs(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merge sorted runs of (prefix shared with the one before in its run, string, payload).

    Yields the same with the prefix shared with the one put out before. Each run's head knows how much it shares
    with the last string put out; the head that shares more is smaller, and only heads that share equally much are
    compared, from there on. The loser keeps the length it shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    head: list[bytes] = [b""] * size
    known = [-1] * size  # a run that has ended shares less than any other
    payload: list[tuple | None] = [None] * size
    for k, run in enumerate(runs):
        if (first := next(run, None)) is not None:
            known[k], head[k], payload[k] = 0, first[1], first[2]

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = known[a], known[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        s, t = head[a], head[b]
        n = shared_prefix(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * size
    winners = list(range(size))
    level = size // 2
    while level >= 1:
        new = []
        for j in range(level):
            win, lose = play(winners[2 * j], winners[2 * j + 1])
            losers[level + j] = lose
            new.append(win)
        winners, level = new, level // 2
    win = winners[0]
    while known[win] >= 0:
        yield known[win], head[win], payload[win]
        if (following := next(runs[win], None)) is None:
            known[win] = -1
        else:
            known[win], head[win], payload[win] = following
        node = (win + size) // 2
        while node >= 1:
            win, losers[node] = play(win, losers[node])
            node //= 2


def equal_strings(shared: list[int], suffixes: list[bytes], befores: list[bytes]) -> list[tuple[int, int] | None]:
    """For each member of a group of one gram the nearest and farthest start of a string that occurs again.

    Members are sorted by suffix, ``shared`` has the common prefix with the member before; ``befores`` run
    backwards. A start is given as its distance before the anchor. Members with equal suffix and equal bytes
    before are one case.
    """
    cases: dict[tuple[bytes, bytes], int] = {}
    of, held, common, least = [], [], [], WINDOW
    for n, s, b in zip(shared, suffixes, befores, strict=True):
        least = min(least, n)
        key = (s, b)
        if key not in cases:
            cases[key] = len(held)
            held.append(0)
            common.append(least)
            least = WINDOW
        of.append(cases[key])
        held[of[-1]] += 1
    kinds = list(cases)
    g = len(kinds)
    found: list[tuple[int, int] | None] = [None] * g

    def take(k: int, near: int, far: int) -> None:
        if near <= far:
            found[k] = (near, far) if found[k] is None else (min(near, found[k][0]), max(far, found[k][1]))

    for k, (s, b) in enumerate(kinds):
        if held[k] > 1:
            take(k, WINDOW - len(s), len(b))
    if 1 < g <= 6:
        for i in range(g):
            reach = WINDOW
            for j in range(i + 1, g):
                reach = min(reach, common[j])
                far = shared_prefix(kinds[i][1], kinds[j][1])
                take(i, WINDOW - reach, far)
                take(j, WINDOW - reach, far)
    elif g > 6:
        order = sorted(range(g), key=lambda k: kinds[k][1])
        back = np.array([0] + [shared_prefix(kinds[a][1], kinds[b][1]) for a, b in zip(order, order[1:], strict=False)])
        order = np.array(order)
        ahead = np.array(common)
        n_ahead, n_back = np.array([len(s) for s, _ in kinds]), np.array([len(b) for _, b in kinds])
        near, far = np.full(g, WINDOW), np.full(g, -1)
        step = max(1, 1_000_000 // g)
        for low in range(0, REACH + 1, step):
            d = np.arange(low, min(low + step, REACH + 1))[:, None]
            right = np.cumsum(ahead < WINDOW - d, axis=1)
            left = np.empty_like(right)
            left[:, order] = np.cumsum(back < d, axis=1)
            there = (n_ahead >= WINDOW - d) & (n_back >= d)
            key = np.where(there, right * (g + 1) + left, -1 - np.arange(g))
            at = np.argsort(key, axis=1, kind="stable")
            ranked = np.take_along_axis(key, at, axis=1)
            same = (ranked[:, 1:] == ranked[:, :-1]) & (ranked[:, 1:] >= 0)
            twin = np.zeros(key.shape, bool)
            twin[:, 1:] |= same
            twin[:, :-1] |= same
            again = np.zeros(key.shape, bool)
            np.put_along_axis(again, at, twin, axis=1)
            near = np.minimum(near, np.where(again, d, WINDOW).min(axis=0))
            far = np.maximum(far, np.where(again, d, -1).max(axis=0))
        for k in np.flatnonzero(far >= 0).tolist():
            take(k, int(near[k]), int(far[k]))
    return [found[k] for k in of]


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket -> (id, mark, start, stop) of the repeated strings around each anchor."""
    out: list[tuple[int, int, int, int]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "start", "stop"])

    def run(block: dict) -> Iterator[tuple[int, bytes, tuple]]:
        numbers = zip(*(np.frombuffer(block[n], np.int64).tolist() for n in ("ids", "marks", "places")), strict=True)
        suffixes = _decode(block["suffix_shared"], block["suffix_size"], block["suffix_rest"])
        befores = _decode(block["before_shared"], block["before_size"], block["before_rest"])
        for (n, suffix), (_, before), member in zip(suffixes, befores, numbers, strict=True):
            yield n, suffix, (before, *member)

    def resolve(group: list[tuple[int, bytes, tuple]]) -> None:
        if len(group) < 2:
            return
        found = equal_strings([0, *(x[0] for x in group[1:])], [x[1] for x in group], [x[2][0] for x in group])
        for (_, _, (_, i, mark, place)), span in zip(group, found, strict=True):
            if span:
                out.append((i, mark, place - span[1], place - span[0] + WINDOW))

    def bucket(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, bytes, tuple]] = []
        for item in merge_runs([run(b) for b in blocks]):
            if item[0] < GRAM:
                resolve(group)
                group = []
                if len(out) > 50_000:
                    yield from flush()
            group.append(item)
        resolve(group)

    blocks: list[dict] = []
    for batch in batches:
        for block in batch.to_pylist():
            if blocks and block["bucket"] != blocks[0]["bucket"]:
                yield from bucket(blocks)
                blocks = []
            blocks.append(block)
    if blocks:
        yield from bucket(blocks)
    yield from flush()


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text, places) -> (case, near, bytes, id, mark, place): what surrounds each anchor, and its hash."""
    for batch in batches:
        rows = []
        for i, mark, text, places in zip(*(batch.column(n) for n in range(4)), strict=True):
            data, i, mark = _text_bytes(text.as_py()), i.as_py(), mark.as_py()
            for p in places.as_py():
                before = min(p, REACH)
                around = data[p - before : p + WINDOW]
                rows.append((xxhash.xxh3_128_digest(around + before.to_bytes(2, "big")), before, around, i, mark, p))
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["case", "before", "around", "id", "mark", "place"]
            )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(case, before, around, held) -> (string, case, distance, held): the hash of every string through the anchor."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = []
            for case, before, around, held in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns), strict=True):
                for d in range(max(0, before + WINDOW - len(around)), before + 1):
                    rows.append((xxhash.xxh3_128_digest(around[before - d : before - d + WINDOW]), case, d, held))
            if rows:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["string", "case", "distance", "held"]
                )


def _hot_spans(around: DataFrame) -> DataFrame:
    """Spans of anchors whose gram is too frequent for one task: equal surroundings once, then their strings counted."""
    cases = around.mapInArrow(_cases, "case binary, before long, around binary, id long, mark long, place long")
    distinct = cases.groupBy("case", "before").agg(F.first("around").alias("around"), F.count(F.lit(1)).alias("held"))
    strings = distinct.select("case", "before", "around", "held").mapInArrow(_strings, "string binary, case binary, distance long, held long")
    # a string with several anchors is met at each of them, at another distance
    again = strings.groupBy("string", "distance").agg(F.sum("held").alias("n")).filter(F.col("n") > 1).select("string", "distance")
    # both written: an aggregate directly below a join would tie it to one task a key, and one case may be met everywhere
    again = stored(again, "hot_strings")
    spans = stored(strings.join(again, ["string", "distance"]).groupBy("case").agg(F.min("distance").alias("near"), F.max("distance").alias("far")), "hot_spans")
    return cases.select("case", "id", "mark", "place").join(spans, "case").select(
        "id", "mark", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + WINDOW).alias("stop")
    )


def repeated_spans(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hot_gram: int = HOT_GRAM, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(id, text, spans, then a struct ``carried`` of the columns named) per row; spans are (start, stop) in bytes of UTF-8, they may overlap; null where there are none.

    A null text is empty. Ids are integers or null. Repeated rows count as separate texts, so both are removed.
    Other columns are not read.
    """
    texts = documents.select(
        F.col(id_col).alias("given"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    # named wherever the texts are exchanged, so that one exchange serves all
    more = ["carried"] if carry else []
    found = stored(texts.select("id", "mark", "text").mapInArrow(_find_anchors, "id long, mark long, place long, gram long"), "anchors")
    # written, so that the join has an exchange on both sides and the rows of a frequent gram can be split
    grams = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > 1), "grams")
    hot = F.col("held") > hot_gram
    again = stored(
        found.join(grams, "gram").groupBy("id", "mark").agg(
            F.collect_set(F.when(~hot, F.col("place"))).alias("places"), F.collect_set(F.when(hot, F.col("place"))).alias("hot_places")
        ),
        "candidates",
    )
    total, n_hot = again.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)), F.coalesce(F.sum(F.size("hot_places")), F.lit(0))).first()
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BUCKET)))
    around = texts.join(again, ["id", "mark"])
    blocks = around.select("id", "mark", "text", "places", "given", *more).mapInArrow(_make_runs(4 * tasks), _BLOCK)
    spans = blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge_blocks, "id long, mark long, start long, stop long")
    if n_hot:
        spans = spans.unionByName(_hot_spans(around.select("id", "mark", "text", F.col("hot_places").alias("places"), "given", *more)))
    per_text = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return texts.join(per_text, ["id", "mark"], "left").select(F.col("given").alias("id"), "text", "spans", *more)


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, stop in spans:
        kept.append(data[at:start])
        at = stop
    kept.append(data[at:])
    return b"".join(kept)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            data, spans = _text_bytes(text.as_py()), united(found.as_py())
            rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(data, spans)).hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the query."""
    return repeated_spans(documents).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            # a span may begin or end inside a character; what is left of it is dropped
            data = kept_bytes(_text_bytes(text.as_py()), united(found.as_py()))
            texts.append(data.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:]], names=["id", "text", *batch.schema.names[3:]])


def kept_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns, with the text without its repeated passages."""
    others = tuple(c for c in documents.columns if c not in (id_col, text_col))
    found = repeated_spans(documents, id_col, text_col, carry=others)
    fields = [f"id {documents.schema[id_col].dataType.simpleString()}", "text string"]
    if others:
        fields.append("carried struct<" + ",".join(f"`{c}`:{documents.schema[c].dataType.simpleString()}" for c in others) + ">")
    kept = found.mapInArrow(_kept, ", ".join(fields))
    source = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col("carried").getField(c) for c in others}
    return kept.select(*[source[c].alias(c) for c in documents.columns])
