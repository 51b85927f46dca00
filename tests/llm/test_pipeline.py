"""Each stage of the pipeline against a plain version, on all that the stage before kept."""

from collections import Counter

import pytest

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from test_packing import check as check_packing
from test_simhash import plain_groups, similar_pairs
from wardlens.llm import langid


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def table(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "12 34", "en", "s", 5), (9004, docs.first().text, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language(stages):
    model = langid.fit(stages[0])
    rows = stages[0].collect()
    found = dict(zip([r.doc_id for r in rows], zip(*model.predict([r.text for r in rows]))))
    assert table(stages[1]) == Counter(tuple(r) for r in rows if found[r.doc_id][0] != "und" and found[r.doc_id][1] >= 0.4)
    kept = {r.doc_id for r in stages[1].collect()}
    assert not kept & {9001, 9002, 9003} and len(kept) > 0.95 * len(rows)


def test_near_copies(stages):
    rows = stages[1].collect()
    kept = {r.doc_id for r in stages[2].collect()}
    assert table(stages[2]) == Counter(tuple(r) for r in rows if r.doc_id in kept)
    pairs = similar_pairs({r.doc_id: r.text for r in rows}, 0.72)
    near = [p for p, j in pairs.items() if j >= 0.8]
    caught = sum(not (a in kept and b in kept) for a, b in near)
    assert near and caught >= 0.9 * len(near)
    # only documents with a similar one go, and one of each group stays
    assert {r.doc_id for r in rows} - kept <= {b for p in pairs for b in p}
    groups = plain_groups({r.doc_id for r in rows}, pairs)
    assert {min(g) for g in groups if len(g) > 1} <= kept


def test_repeated_passages(stages):
    rows = stages[2].collect()
    counts = Counter()
    for r in rows:
        d = (r.text or "").encode()
        counts.update(d[a : a + 200] for a in range(len(d) - 199))
    expected = Counter()
    for r in rows:
        d = (r.text or "").encode()
        gone = bytearray(len(d))
        for a in range(len(d) - 199):
            if counts[d[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        text = bytes(c for c, g in zip(d, gone) if not g).decode("utf-8", "ignore")
        expected[r.doc_id, text, r.lang, r.source, len(text)] += 1
    assert table(stages[3]) == +expected


def test_benchmark_passages(spark, sf_dir, stages):
    runs = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        runs |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1) if n}
    sizes = {len(r) for r in runs}
    rows = stages[3].collect()
    clean = [r for r in rows if not any(tuple(w[a : a + n]) in runs for w in [words(r.text)] for n in sizes for a in range(len(w) - n + 1))]
    assert len(clean) < len(rows)
    assert table(stages[4]) == Counter(map(tuple, clean))


def test_packing(stages):
    check_packing(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()])


def test_run_and_empty_table(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
