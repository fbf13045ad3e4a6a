"""Conversation repair against plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusdelta.llm import conversations as cv
from corpusdelta.llm import queries
from tests.conftest import SF_SMALL

WANTED = re.compile("(s?(ua)+)?")


def every_repair(rows):
    """Cheapest ``(cost, audit)`` of ``(status, initial)`` rows, from all edits
    and up to two insertions in each gap."""
    inserts = [(n, "".join(r)) for n in range(3) for r in itertools.product("ua", repeat=n)]
    edits = []
    for status, initial in rows:
        extra = 3 if status == "t" else 0
        edits.append([("D", "", 4)] + ([] if status == "d" else [("K", initial, extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]))
    best = None
    for chosen in itertools.product(*edits):
        if best and sum(e[2] for e in chosen) > best[0]:
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            roles = "".join(g[1] + e[1] for g, e in zip(gaps, chosen)) + gaps[-1][1]
            if WANTED.fullmatch(roles):
                found = (sum(e[2] for e in chosen) + 3 * sum(g[0] for g in gaps),
                         "".join("I" * g[0] + e[0] for g, e in zip(gaps, chosen)) + "I" * gaps[-1][0])
                best = min(best or found, found)
    return best


def sequential(rows):
    """The same from left to right, state by state (whole sequences only)."""
    step = {"0s": "1", "0u": "2", "1u": "2", "2a": "3", "3u": "2"}

    def insertions(now):
        for _ in range(3):
            for p, (cost, audit) in list(now.items()):
                for r in "ua":
                    if p + r in step:
                        q, new = step[p + r], (cost + 3, audit + "I")
                        now[q] = min(now.get(q, new), new)
        return now

    now = insertions({"0": (0, "")})
    for status, initial in rows:
        after = {}
        for p, (cost, audit) in now.items():
            extra = 3 if status == "t" else 0
            options = [(p, cost + 4, "D")]
            if status != "d":
                options += [(step[p + initial], cost + extra, "K")] if p + initial in step else []
                options += [(step[p + r], cost + 3 + extra, "R") for r in "ua" if p + r in step]
            for q, c, letter in options:
                new = (c, audit + letter)
                after[q] = min(after.get(q, new), new)
        now = insertions(after)
    return min(v for p, v in now.items() if p in "03")


def chosen(cell):
    return min(cell[p, q] for p, q in cell if p == 0 and q in cv.ENDS)


def test_cells_hold_the_cheapest_of_all_edits():
    codes = [(s, i) for s in "dtk" for i in "suax"]
    rng = random.Random(1)
    cases = [list(c) for n in (1, 2) for c in itertools.product(codes, repeat=n)] + [[rng.choice(codes) for _ in range(3)] for _ in range(25)]
    for rows in cases:
        want = every_repair(rows)
        assert chosen(cv.span(tuple((s, i, 1) for s, i in rows))) == want == sequential(rows), rows


def test_every_split_gives_the_same_cell():
    rng = random.Random(2)
    for _ in range(60):
        rows = tuple((rng.choice("dtkkk"), rng.choice("suauaua"), rng.choice([1, 1, 1, 3])) for _ in range(rng.randrange(2, 9)))
        table = {(i, i + 1): cv.leaf(*rows[i]) for i in range(len(rows))}
        for size in range(2, len(rows) + 1):
            for i in range(len(rows) - size + 1):
                splits = [cv.join(table[i, k], table[k, i + size]) for k in range(i + 1, i + size)]
                assert all(s == splits[0] for s in splits)
                table[i, i + size] = splits[0]
        assert table[0, len(rows)] == cv.span(rows) == cv.cells([cv.leaf(*r) for r in rows])
        flat = [("d" if k else s, i) for s, i, c in rows for k in range(c)]
        assert chosen(cv.span(rows)) == sequential(flat)


def slow(table):
    """The query over ``(conv, turn, role, text)`` rows."""
    out = []
    kept: dict = {row[0]: [] for row in table}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {r[0] for r in rows} - {None}
        seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append(({"blank": "d", "duplicate": "d", "truncated": "t"}.get(fault, "k"), role[:1] if role[:1] in ("s", "u", "a") else "x"))
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = sequential(codes)
        lines, left = [], iter(rows)
        odd = sum(c != "D" for c in audit) % 2
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter != "D":
                expected = ("user", "assistant")[(len(lines) - odd) % 2]
                lines.append(f"{row[1] if letter == 'K' else expected}:{row[2] if row else ''}")
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_whole_query_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversations(spark, SF_SMALL)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


@pytest.mark.parametrize("block", [64, 2])
def test_odd_and_long_conversations(spark, monkeypatch, block):
    for name in ("BLOCK", "FAN", "PARTS"):
        monkeypatch.setattr(cv, name, block)
    rng = random.Random(4)
    texts = ["Yes.", "No", "Why? ", "", " \n", "a" * 30_000 + ".", "Good!\t", "\x1c", "end.\n\n", None]
    rows = []
    for conv in [*range(25), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
                         rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rows += [(500, t, ("user", "assistant")[t % 2], rng.choice(texts)) for t in range(400)]  # one conversation of many rows
    rows += [(501, 3, "user", "Same.")] * 150 + [(501, None, "user", "Same.")] * 150 + [(501, 4, "assistant", "Ok.")]  # copies
    extra = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, pos int, conv int, n int")
    got = cv.damaged_and_repaired(extra)
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Hello."), (1, 3, "user", "Hello."), (1, 4, "assistant", "Cut of")]
    repair = cv.Repair(frame(spark, rows))
    assert [tuple(r) for r in repair.report().collect()] == [(1, 0, 0, 1, 1, 2, 10, "KIKKDK")]
    got = [tuple(r) for r in repair.repaired().orderBy("pos").collect()]
    assert got == [(1, 0, "K", 0, "system", "Be kind."), (1, 1, "I", None, "user", ""), (1, 2, "K", 1, "assistant", "Hi."),
                   (1, 3, "K", 2, "user", "Hello."), (1, 4, "K", 4, "assistant", "Cut of")]


def test_empty_tables_and_dropped_rows(spark):
    some = frame(spark, [(1, 0, "user", "A.")])
    assert cv.damaged_and_repaired(some.limit(0)).count() == 0
    repair = cv.Repair(some.limit(0))
    assert repair.report().count() == repair.repaired().count() == 0
    dropped = [(c, 0, "user", "A.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = sorted(map(tuple, cv.damaged_and_repaired(frame(spark, dropped)).collect()))
    assert dropped and got == [(c[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped]
