"""Repair of conversations against a plain shortest-path search over single rows."""

import hashlib
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from wardlens.llm import conversations as C
from wardlens.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """conv -> rows after damage, in order."""
    found = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out = found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    for out in found.values():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return found


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def wanted(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    if not initials:
        return True
    return len(rest) >= 2 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2)


def plain_edits(rows, faults):
    """Cheapest (cost, letters, lines) over prefixes of the initials, kept whole: every way is tried, row by row."""

    def nxt(so_far):
        return "a" if so_far.endswith("u") else "u"

    def short(so_far):
        return so_far if so_far in ("", "s") else "s" * (so_far[0] == "s") + so_far[-1]

    best = {"": (0, "", ())}
    for k in range(len(rows) + 1):
        for _ in range(4):  # inserted rows
            for state, (cost, letters, lines) in list(best.items()):
                letter = nxt(state)
                new = (cost + 3, letters + "I", (*lines, ("user" if letter == "u" else "assistant") + ":"))
                to = short(state + letter)
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        if k == len(rows):
            break
        (_, role, text), fault = rows[k], faults[k]
        after = {}

        def put(to, value):
            if to not in after or value[:2] < after[to][:2]:
                after[to] = value

        for state, (cost, letters, lines) in best.items():
            put(state, (cost + 4, letters + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            letter = nxt(state)
            put(short(state + letter), (cost + 3 + more, letters + "R", (*lines, f"{'user' if letter == 'u' else 'assistant'}:{text}")))
            if role[:1] == letter or role[:1] == "s" and state == "":
                put(short(state + role[:1]), (cost + more, letters + "K", (*lines, f"{role}:{text}")))
        best = after
    return min(v for s, v in best.items() if s == "" or s.endswith("a"))


def plain(rows):
    out = []
    for conv, turns in plain_damage(rows).items():
        faults = plain_faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, letters, lines = plain_edits(turns, faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha))
    return sorted(out, key=repr)


def found(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_costs_of_runs_equal_costs_of_rows():
    rng = np.random.default_rng(3)
    for _ in range(300):
        symbols = rng.integers(0, 9, rng.integers(0, 6)).astype(np.uint8)
        lengths = rng.integers(1, 9, len(symbols))
        single = np.repeat(symbols, lengths)
        cut = int(rng.integers(0, len(symbols) + 1))
        by_run = C.edits([(symbols[:cut], lengths[:cut]), (symbols[cut:], lengths[cut:])])
        assert by_run == C.edits([(single, np.ones(len(single), np.int64))])


@pytest.mark.parametrize("n", range(5))
def test_every_short_sequence(n):
    roles = {1: "system", 2: "user", 3: "assistant", 4: "tool"}
    for symbols in product(range(9) if n < 4 else (0, 1, 2, 3, 6, 7), repeat=n):
        rows = [(k, roles.get((s - 1) % 4 + 1 if s else 2), "") for k, s in enumerate(symbols)]
        faults = ["blank" if not s else "truncated" if s > 4 else "" for s in symbols]
        cost, letters, _ = plain_edits(rows, faults)
        assert C.edits([(np.array(symbols, np.uint8), np.ones(n, np.int64))]) == (cost, letters)


def test_long_runs():
    n = 10**12
    start = C.FINAL
    assert C.before_run(0, n, start)[0] == 4 * n
    # alternate roles keep; a long run of one role reroles every second row
    assert C.edits([(np.array([2], np.uint8), np.array([1001]))])[0] == 3 * 501


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_conversation_repair"](spark, sf_dir)) == plain(rows)


def test_segments_and_hot_conversation(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["Yes.", "No", "", " ", "Why?", "Well.\n", None, "é!"]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = [(1, int(rng.integers(0, 2000)), roles[rng.integers(0, 6)], texts[rng.integers(0, 8)] if rng.random() < 0.3 else f"t{k % 700}.") for k in range(3000)]
    rows += [(int(c), int(t), roles[rng.integers(0, 3)], texts[rng.integers(0, 8)]) for c in range(2, 300) for t in range(rng.integers(0, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    monkeypatch.setattr(C, "SEGMENT", 16)
    assert found(C.digest(df)) == plain(rows)


def test_nulls_repeated_rows_and_other_columns(spark):
    schema = "conv_id string, turn long, role string, text string, conv string, digest int, n int"
    rows = [
        (None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), ("x", None, "assistant", "b."), ("x", None, "assistant", "b."),
        ("x", 2, "user", "b."), ("x", 2, "user", None), ("", 1, "system", "s."), ("", 1, "", "\n"), ("", 9, "user", "x" * 200_000),
    ]
    df = spark.createDataFrame([(*r, "q", 1, 2) for r in rows], schema)
    assert found(C.digest(df)) == plain(rows)
    assert found(C.digest(df.limit(0))) == []


def test_dropped_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert found(C.digest(df)) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So?"), (2, 0, "assistant", "A."), (2, 1, "user", "B.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = defaultdict(list)
    for r in C.repaired_turns(C.as_turns(df)).orderBy("conv", "position").collect():
        out[r.conv].append((r.edit, r.role, r.text))
    assert out[1] == [("K", "user", "Hi."), ("R", "assistant", "So?")]
    # two inserts cost as much as two new roles; the least letters win
    assert out[2] == [("I", "user", ""), ("K", "assistant", "A."), ("K", "user", "B."), ("I", "assistant", "")]
