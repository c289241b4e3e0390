"""Conversation repair against exhaustive edits and a plain dynamic programme, in one chunk and in many."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from edlens.llm import conversation_repair as C
from edlens.llm.shared import importable

SCHEMA = "conv_id long, turn long, role string, text string, k string, pos int, chunk int, code string, ops string"
INK = r"[^\x20\x09-\x0D]"
LEGAL = re.compile("(s?(ua)+)?")


def faults_of(rows):
    """1 blank, 2 duplicate, 3 truncated, 0 none; and illegal neighbours."""
    seen, out = set(), []
    for role, text in rows:
        ink = re.findall(INK, text)
        out.append(1 if not ink else 2 if (role, text) in seen else 3 if ink[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out, sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


def cheapest(rows, faults):
    """(cost, audit, lines): forward, the least (cost, audit) per state; equal costs never prefix each other there."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        out = dict(best)
        for q, (c, audit, lines) in best.items():
            for _ in range(2):
                q = follow[q]
                c, audit, lines = c + 3, audit + "I", [*lines, names[q] + ":"]
                if q not in out or (c, audit) < out[q][:2]:
                    out[q] = c, audit, lines
        return out

    best = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults):
        now = {}
        for q, (c, audit, lines) in with_inserts(best).items():
            stay = 3 if fault == 3 else 0
            ways = [(q, c + 4, "D", lines)]
            if fault not in (1, 2):
                ways.append((follow[q], c + 3 + stay, "R", [*lines, f"{names[follow[q]]}:{text}"]))
                if role[:1] in ("s", "u", "a") and (role[0] == "s" and q == "" or role[0] == follow[q]):
                    ways.append((role[0], c + stay, "K", [*lines, f"{role}:{text}"]))
            for to, cost, letter, made in ways:
                if to not in now or (cost, audit + letter) < now[to][:2]:
                    now[to] = cost, audit + letter, made
        best = now
    return min(x[:2] + (x[2],) for q, x in with_inserts(best).items() if q in ("", "a"))


def exhaustive(rows, faults, most=3):
    """Every word of edits with up to ``most`` inserts in a row."""
    found = []
    slots = len(rows) + 1
    for letters in itertools.product(*(["D"] if f in (1, 2) else ["D", "K", "U", "A"] for f in faults)):
        for inserts in itertools.product([x for n in range(most) for x in itertools.product("ua", repeat=n)], repeat=slots):
            cost, audit, line = 0, "", []
            for i in range(slots):
                for x in inserts[i]:
                    cost, audit = cost + 3, audit + "I"
                    line.append(("user" if x == "u" else "assistant", ""))
                if i < len(rows):
                    x = letters[i]
                    cost += {"D": 4, "K": 0}.get(x, 3) + (3 if x != "D" and faults[i] == 3 else 0)
                    audit += x if x in "DK" else "R"
                    if x != "D":
                        line.append((rows[i][0] if x == "K" else "user" if x == "U" else "assistant", rows[i][1]))
            if LEGAL.fullmatch("".join(r[:1] for r, _ in line)) and all(r for r, _ in line):
                found.append((cost, audit, [f"{r}:{t}" for r, t in line]))
    return min(found)


def plain(rows):
    """conv_id -> the result of its (turn, role, text) rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    said = [(r, t) for _, r, t in rows]
    faults, illegal = faults_of(said)
    cost, audit, lines = cheapest(said, faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def make(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(rng.randint(0, longest)):
            text = rng.choice([None, "", " \t", "Yes.", "Yes.", "No", "A? ", "Well!\n", f"t{rng.randint(0, 99)}.", f"t{rng.randint(0, 99)}"])
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice([None, "", "system", "user", "user", "assistant", "assistant", "tool", "User"]), text, "k", 1, 2, "c", "o"))
    return rows


def in_order(rows):
    out = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])):
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def test_plain_versions_agree():
    rng = random.Random(4)
    for n in [0, 1, 2, 2, 3, 3, 3]:
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", "", "c."])) for _ in range(n)]
        faults, _ = faults_of(rows)
        assert cheapest(rows, faults) == exhaustive(rows, faults)


@pytest.mark.parametrize(("seed", "chunk", "convs", "longest"), [(1, 4096, 60, 9), (2, 3, 12, 40), (3, 1, 6, 12), (4, 50, 3, 700)])
def test_repair(spark, monkeypatch, seed, chunk, convs, longest):
    """The same at any chunk length, with conversations cut at several places for their order too."""
    importable(spark)
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = make(seed, convs, longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = C.repair(df, max_group_rows=64 if chunk == 50 else 4_000_000).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r[1:]) for r in got} == {c: plain(x) for c, x in in_order(rows).items()}


def test_dead_chunks(spark, monkeypatch):
    """Long runs of rows that must go lie between the others; their chunks hand costs and states through."""
    importable(spark)
    monkeypatch.setattr(C, "CHUNK", 4)
    rows = [(7, i, "user" if i % 50 else "tool", "again." if i % 50 else f"new {i}.", "k", 1, 2, "c", "o") for i in range(200)] + [(8, i, "system", "", "k", 1, 2, "c", "o") for i in range(9)]
    got = {r.conv_id: tuple(r[1:]) for r in C.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {c: plain(x) for c, x in in_order(rows).items()}
    assert got[8] == (0, 9, 0, 0, 8, 36, "D" * 9, hashlib.sha256(b"").hexdigest())


def test_query_damage(spark):
    """Faults by the checksum of conversation and turn; a conversation of which nothing is left is listed with zeros."""
    importable(spark)
    rows = make(5, 40, 8)
    space = lambda x: " " if x is None else str(x)
    damaged, dropped = [], {r[0] for r in rows}
    for conv, turn, role, text, *_ in rows:
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if h:
            now = ("user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            damaged += [((turn is not None, turn or 0, role, text), conv, turn, *now)] * (2 if h == 3 else 1)
            dropped.discard(conv)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped}
    by = {}
    for _, conv, turn, role, text in sorted(damaged, key=lambda x: x[0]):
        by.setdefault(conv, []).append((turn, role, text))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = C.repair(C.damage(df), df, tie=("tie_role", "tie_text", "tie_copy")).collect()
    assert {r.conv_id: tuple(r[1:]) for r in got} == want | {c: plain(x) for c, x in by.items()}


def test_repaired_rows_and_empty(spark):
    importable(spark)
    rows = [(1, 0, "assistant", "Hello.", "k", 1, 2, "c", "o"), (1, 1, "user", "Hi?", "k", 1, 2, "c", "o"), (2, 5, "user", " ", "k", 1, 2, "c", "o")]
    got = C.repaired_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    cost, audit, lines = cheapest([("assistant", "Hello."), ("user", "Hi?")], [0, 0])
    assert [f"{r.role}:{r.text}" for r in sorted(got, key=lambda r: r.place)] == lines and {r.conv_id for r in got} == {1}
    assert "".join(r.edit for r in sorted(got, key=lambda r: r.place)) == audit.replace("D", "")
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(none).count() == 0 and C.repaired_rows(none).count() == 0 and C.repair(C.damage(none), none).count() == 0
