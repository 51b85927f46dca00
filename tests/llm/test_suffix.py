import hashlib
import random
from collections import Counter

import numpy as np

from wardlens.llm import suffix


def plain(texts):
    """id -> (n_bytes, n_removed, n_spans, kept_sha256), by counting every 200-byte string."""
    counts = Counter()
    data = [(i, (t or "").encode()) for i, t in texts]
    for _, d in data:
        counts.update(d[a : a + 200] for a in range(len(d) - 199))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for a in range(len(d) - 199):
            if counts[d[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(d, gone) if not g)
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (45, 60, 90, 300)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 450, text(50)]
    for k in range(40):
        parts = [text(rng.randint(5, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 40)], text(rng.randint(0, 30))]
        texts.append(" ".join(parts))
    texts += [texts[10], texts[11], texts[12][:-3] + "zz!", texts[13][5:400]]
    exact = text(100).encode()[:260].decode("utf-8", "ignore")
    texts += [f"{exact[:199]}-1", f"{exact[:199]}-2", f"{exact[:200]}-3", f"{exact[:200]}-4", f"!{exact[10:215]}?", f"?{exact[12:230]}"]
    return list(enumerate(texts))


def test_merge_of_runs_keeps_order_and_shared_lengths():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    runs = [sorted(strings[k::7]) for k in range(7)] + [[]]

    def coded(run):
        shared, sizes, rest = suffix._front_code(run)
        for n, s in suffix._decode(shared, sizes, rest):
            yield n, s, ()

    merged = list(suffix.merge_runs([coded(r) for r in runs]))
    assert [m[1] for m in merged] == sorted(strings)
    for a, b in zip(merged, merged[1:]):
        assert b[0] == suffix.shared_prefix(a[1], b[1])


def test_small_corpus_matches_plain_version(spark):
    texts = corpus()
    frame = spark.createDataFrame([(i, t, "n", [1]) for i, t in texts], "doc_id long, text string, mark string, spans array<int>")
    expected = plain(texts)
    assert rows(suffix.digest(frame)) == expected
    forced = suffix.repeated_spans(frame, hot_gram=1).mapInArrow(
        suffix._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    assert rows(forced) == expected


def test_large_groups_use_the_sorted_classes():
    rng = random.Random(9)
    core = bytes(rng.choice(b"abc") for _ in range(400))
    members = []
    for k in range(40):
        left, right = rng.randint(0, 200), rng.randint(232, 400)
        data = bytes([200 + k % 5] * rng.randint(0, 3)) + core[left:right] + bytes([100 + k % 7] * 60)
        at = data.find(core[200:232])
        members.append((data[at : at + 200], data[max(0, at - suffix.REACH) : at][::-1]))
    members.sort()
    shared = [0] + [suffix.shared_prefix(a[0], b[0]) for a, b in zip(members, members[1:])]
    found = suffix.equal_strings(shared, [m[0] for m in members], [m[1] for m in members])
    for k, (s, b) in enumerate(members):
        near, far = 999, -1
        for j, (t, c) in enumerate(members):
            if j != k:
                r, left = suffix.shared_prefix(s, t), suffix.shared_prefix(b, c)
                if 200 - r <= left:
                    near, far = min(near, 200 - r), max(far, left)
        assert found[k] == ((near, far) if far >= 0 else None)


def test_anchor_of_equal_strings_is_equal():
    rng = np.random.default_rng(2)
    core = rng.integers(97, 101, 200, dtype=np.uint8)
    for pad in (0, 1, 50, 333):
        data = np.concatenate((rng.integers(97, 101, pad, dtype=np.uint8), core, rng.integers(97, 101, 100, dtype=np.uint8)))
        places, _ = suffix.anchors(data, np.full(len(data), len(data)))
        own, _ = suffix.anchors(core, np.full(200, 200))
        assert own[0] + pad in places


def test_long_text_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_CHUNK", 1000)
    suffix._POWERS.clear()
    try:
        import pyarrow as pa

        texts = [t or "" for _, t in corpus()]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["a", "b", "c"])
        cut = {r for b in suffix._find_anchors([batch]) for r in zip(*(c.to_pylist() for c in b.columns))}
        monkeypatch.setattr(suffix, "_CHUNK", 1 << 20)
        suffix._POWERS.clear()
        whole = {r for b in suffix._find_anchors([batch]) for r in zip(*(c.to_pylist() for c in b.columns))}
        assert cut == whole
    finally:
        suffix._POWERS.clear()


def test_empty_table_and_repeated_ids(spark):
    frame = spark.createDataFrame([(1, "q" * 10), (None, "abc " * 80)], "doc_id long, text string")
    assert rows(suffix.digest(frame.limit(0))) == []
    assert rows(suffix.digest(frame)) == plain([(1, "q" * 10), (None, "abc " * 80)])


def test_query_against_plain_version(spark, sf_dir):
    from wardlens.llm.queries import QUERIES

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows(QUERIES["op7_suffix_dedup"](spark, sf_dir)) == plain(texts)
