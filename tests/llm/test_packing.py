import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wardlens.llm import packing
from wardlens.llm.queries import QUERIES, TOKENIZER, tokenizer_path


def plain_ids(text):
    from tokenizers import Tokenizer

    plain_ids.tokenizer = getattr(plain_ids, "tokenizer", None) or Tokenizer.from_file(tokenizer_path(TOKENIZER))
    return [*plain_ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def plain_best_fit(lengths, capacity):
    rooms = []
    n = 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, n = capacity, n + 1
        if room - length:
            insort(rooms, room - length)
    return n


def check(rows, texts, fewest=True):
    expected = Counter()
    for i, text in texts:
        ids = plain_ids(text)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4").tobytes()
            expected[i, piece, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
    if fewest:
        assert len(sequences) == plain_best_fit([r.length for r in rows], 4096)


@pytest.mark.parametrize("seed", range(6))
def test_plan_over_counts_equals_best_fit_over_pieces(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 25), rng.integers(1, 40, 25))}
    plan = packing.best_fit(counts, 64)
    taken = defaultdict(set)
    ranks = defaultdict(list)
    for length, rank, n, first, offset in plan:
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            span = set(range(offset, offset + length))
            assert not taken[s] & span and max(span) < 64
            taken[s] |= span
    assert {k: sorted(v) == list(range(counts[k])) for k, v in ranks.items()} == {k: True for k in counts}
    assert all(span == set(range(len(span))) for span in taken.values())
    assert len(taken) == plain_best_fit([k for k, n in counts.items() for _ in range(n)], 64)


def test_words_one_by_one_equal_the_whole_text():
    texts = ["", "  ", "It's we'll WE'RE x's. a.b,c., d?!. 12 3.4", "Élan İstanbul ΟΔΟΣ, ß. H̱x é. nbsp here wide",
             "<|endoftext|> a<|endoftext|>, <|ENDOFTEXT|>. tab\tand\x1cfs\x85nel ls\r\nCR", "日本語、テスト。 x², ½. _a_. don't,", "A.", ".", ",", "a,.", "!!,"]
    ids, ends = packing.ids_of(pa.array(texts), tokenizer_path(TOKENIZER))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain_ids(t)[:-1] for t in texts]
    texts = [t for t in texts if "<|" not in t] + ["Größe, Übung. über-all naïve! x²y İİ. \u0301a é\u0301, THE. The, 'S. it'LL."]
    ids, ends = packing.ids_of(pa.array(texts), tokenizer_path(TOKENIZER))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain_ids(t)[:-1] for t in texts]
    # a slice of a longer column
    ids, ends = packing.ids_of(pa.array(texts).slice(2, 3), tokenizer_path(TOKENIZER))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [plain_ids(t)[:-1] for t in texts[2:5]]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    for text in ("one two three four five six", "two, seven eight", "nine ten one Two"):
        assert packing.ids_of(pa.array([text]), tokenizer_path(TOKENIZER))[0].tolist() == plain_ids(text)[:-1]


def test_small_tables(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "a b c"), (4, "word " * 4095), (5, "word " * 4096), (6, "word " * 9000), (7, "x")]
    frame = spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id long, text string, share string, rank int")
    check(packing.digest(frame, tokenizer_path(TOKENIZER)).collect(), texts)
    assert packing.digest(frame.limit(0), tokenizer_path(TOKENIZER)).count() == 0


def test_shares_and_blocks_of_ranks(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE_ROWS", 7)
    monkeypatch.setattr(packing, "RANK_BITS", 2)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    texts = [(k % 50, "word " * (1 + k % 13)) for k in range(400)] + [(900, "word " * 3000)] * 30
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    check(packing.digest(frame, tokenizer_path(TOKENIZER)).collect(), texts)


def test_query_against_plain_version(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(QUERIES["op10_packing"](spark, sf_dir).collect(), texts)
