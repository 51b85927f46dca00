import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from wardlens.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """id -> smallest reachable id, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def check(rows, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    expected = plain_components(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert found == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


def test_fingerprint_matches_plain_version():
    for text in (None, "", " \n", "One", "a B", "a b c", "É é   x\ty\fz " * 50, "Same same SAME same", "　 wide \x1c sep"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = [int(v) for v in base]
    for v in base.tolist():
        for flips in (1, 2, 3, 4, 5):
            x = v
            for bit in rng.choice(64, flips, replace=False).tolist():
                x ^= 1 << bit
            values.append(x)
    values = np.unique(np.array(values, np.uint64))
    label = simhash.trie_links(values, 0, 3)
    expected = plain_components(dict(enumerate(values.tolist())))
    assert label.tolist() == [expected[i] for i in range(len(values))]


def test_near_copies_small_table(spark):
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    rng = np.random.default_rng(1)
    texts = {0: None, 1: "", 2: "  ", 3: "one", 4: "ONE"}
    for i in range(5, 60):
        texts[i] = " ".join(rng.choice(words, 80))
    for i in range(60, 120):
        copy = texts[5 + i % 7].split()
        copy[i % 80] = "changed"
        texts[i] = " ".join(copy)
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in texts.items()], "doc_id long, text string, print int, component int")
    check(simhash.digest(frame).collect(), texts)
    forced = simhash.near_copies(frame, hot_block=0)
    plain = simhash.near_copies(frame)
    assert sorted(map(tuple, forced.collect())) == sorted(map(tuple, plain.collect()))
    assert simhash.digest(frame.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z w v")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.digest(frame).collect())
    assert rows == [(-1, -1), (-1, 1), (1, 1), (1, 1)]


def test_query_against_all_pairs(spark, sf_dir):
    from wardlens.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(QUERIES["op6_simhash"](spark, sf_dir).collect(), texts)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def similar_pairs(texts, least):
    """(id, id) -> Jaccard similarity of five-word shingles, of all pairs of at least ``least``."""
    sets = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i] or {()}:
            where[s].append(i)
    common = Counter()
    for ids in where.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    return {(a, b): j for (a, b), c in common.items() if (j := c / max(1, len(sets[a] | sets[b] | ({()} if not sets[a] else set())))) >= least}


def plain_groups(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    groups = defaultdict(set)
    for i in ids:
        groups[find(i)].add(i)
    return list(groups.values())


def edited(rng, words, changes):
    words = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_similar_copies_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for base in range(60):
        words = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(100, 400)))]
        texts[len(texts)] = " ".join(words)
        for _ in range(3):
            texts[len(texts)] = edited(rng, words, max(1, int(len(words) * rng.uniform(0.002, 0.05))))
    texts |= {1000: None, 1001: "", 1002: "one two", 1003: "one two", 1004: "three four", 1005: "ONE\ttwo"}
    rows = [(i, t, "x", b"y") for i, t in texts.items()] + [(0, texts[0], "x", b"y"), (None, "alone here", "x", b"y"), (None, "one two", "x", b"y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string, print binary").repartition(5)
    found = simhash.similar_copies(df).collect()
    assert len(found) == len(rows)
    of = {r.id: r.component for r in found if r.id is not None}
    pairs = similar_pairs(texts, 0.7)
    near = [p for p, j in pairs.items() if j >= 0.8]
    assert len(near) > 50 and sum(of[a] == of[b] for a, b in near) >= 0.9 * len(near)
    loose = {i: min(g) for g in plain_groups(texts, pairs) for i in g}
    assert all(of[i] >= loose[i] for i in texts) and all(loose[i] == loose[of[i]] for i in texts)
    assert of[1000] == of[1001] == 1000 and of[1002] == of[1003] == of[1005] == 1002 and of[1004] == 1004
    assert sorted(((r.component) for r in found if r.id is None), key=str) == [1002, None]
    assert simhash.similar_copies(df.limit(0)).count() == 0


def test_blocks_follow_the_number_of_texts():
    assert [simhash._tables(n, 0.8)[0] for n in (0, 10**5, 10**7, 10**9)] == [12, 12, 18, 24]
    for n in (10**5, 10**7, 10**9):
        bits, blocks = simhash._tables(n, 0.8)
        assert (1 - (1 - simhash.differing_share(0.8)) ** bits) ** blocks <= simhash.MISSED
