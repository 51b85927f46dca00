"""Decontamination against a plain search of every window, on rows that the tables do not hold."""

import hashlib
import re
from collections import Counter

import pytest

from wardlens.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(documents, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            size = min(span, len(w))
            for k in range(len(w) - size + 1):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = Counter()
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                names = windows.get(tuple(w[k : k + size]))
                if names:
                    hit.update(range(k, k + size))
                    found |= names
        out[doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("broadcast_rows", [D.Winnowing().broadcast_rows, 0])
def test_null_and_repeated_ids(spark, broadcast_rows):
    passage = " ".join(f"p{k}" for k in range(30))
    items = [("a", passage), ("b", "Two words"), ("c", None), (None, "one two three"), ("d", "p3 " * 12), ("a", passage)]
    documents = [
        (1, f"start {passage[:80]} end"), (1, "two words"), (1, "two words"), (None, "nothing here"), (None, "TWO words"), (None, None), (2, ""),
        (3, "p3 " * 40), (4, f"{passage} {passage}"), (None, "nothing here"), (5, "word " * 3_000 + passage),
    ]
    rows = [(*r, "x", 1, "y") for r in documents]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string, n int, words string").repartition(4)
    bench = spark.createDataFrame(items, "item_id string, text string")
    settings = D.Winnowing(broadcast_rows=broadcast_rows)
    found = D.digest(D.decontaminate(df, bench, settings=settings))
    assert Counter(tuple(r) for r in found.collect()) == plain(documents, items)
    assert D.digest(D.decontaminate(df.limit(0), bench, settings=settings)).count() == 0
    assert {r.n_hit for r in D.digest(D.decontaminate(df, bench.limit(0), settings=settings)).collect()} == {0}
