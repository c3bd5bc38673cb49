import hashlib
import random
import re
import zlib

import pytest

from insight_spark.llm import repair
from insight_spark.llm.common import table

SPACES = " \t\n\x0b\x0c\r"


def best_edits(rows):
    """rows: (initial, must go, cut) -> (cost, letters, turns) by trying everything from the end."""
    done = {0: (0, "", ()), 3: (0, "", ())}
    after = {}
    write = {0: 2, 1: 2, 3: 2, 2: 3}
    for k in range(len(rows), -1, -1):
        here = {}
        for s in range(4):
            options = []
            if k == len(rows):
                if s in done:
                    options.append(done[s])
            else:
                initial, gone, cut = rows[k]
                options.append((after[s][0] + 4, "D" + after[s][1], after[s][2]))
                if not gone:
                    more = 3 if cut else 0
                    to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(initial)
                    if to is not None:
                        options.append((after[to][0] + more, "K" + after[to][1], ((k, None), *after[to][2])))
                    w = after[write[s]]
                    options.append((w[0] + 3 + more, "R" + w[1], ((k, write[s]), *w[2])))
            here[s] = min(options, key=lambda o: o[:2], default=(10**9, "", ()))
        for _ in range(3):
            for s in range(4):
                w = here[write[s]]
                here[s] = min(here[s], (w[0] + 3, "I" + w[1], ((None, write[s]), *w[2])), key=lambda o: o[:2])
        after = here
    return after[0]


def expected(rows):
    """rows of one conversation (turn, role, text), None for missing -> the report's columns."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, letters, turns = best_edits(marks)
    said = []
    for k, to in turns:
        role = {2: "user", 3: "assistant"}.get(to) or rows[k][1]
        said.append(f"{role}:{'' if k is None else rows[k][2]}")
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
    initials = "".join(x.split(":")[0][:1] for x in said)
    assert re.fullmatch("(s?(ua)+)?", initials)
    return (gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest())


def damage(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else v for v in (c, t, r, x))
        kind = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
            out += [row] * (2 if kind == 3 else 1)
    return out


def check(got, rows, ids):
    by = {c: [] for c in ids}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    want = {c: expected(r) for c, r in by.items()}
    have = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert set(have) == set(want)
    assert not [(c, have[c], want[c]) for c in want if have[c] != want[c]][:3]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("options", [{}, {"chunk": 2, "chunk_bytes": 500}])
def test_whole_table(spark, options):
    rows = table(spark, "/root/testdata/sf0.001", "conversations")
    plain = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    ids = {r[0] for r in plain}
    check(repair.repair_report(repair.damaged(rows), rows.select("conv_id"), **options), damage(plain), ids)


def mixed(seed, n, conversations, turns):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "u", "unknown"]
    said = ["Yes.", "no", "So?", " ", "", None, "a.\n", "b!", " ", "end. x"] + [f"t{k}." for k in range(12)]
    return [
        (rng.choice(conversations), rng.choice([*range(turns), None]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice(said))
        for _ in range(n)
    ]


@pytest.mark.parametrize("options", [{"chunk": 3}, {"chunk": 4, "passes": 1}])
def test_mixed_rows_nulls_ties_and_long_conversations(spark, options):
    rows = mixed(5, 900, [None, 1, 2, -3], 400) + mixed(6, 60, list(range(10, 40)), 4)
    rows += [(50, t, "system", f"s{t}.") for t in range(90)]  # alternate reroling never forgets where it began
    rows += [(51, t, r, "x.") for t in range(40) for r in ("user", "assistant")]
    rows += [(52, t, "tool", f"{t}.") for t in range(61)] + [(52, 99, "user", "y")]
    rows += [(53, 0, "user", "z" * 300_000 + "."), (53, 1, "assistant", "é" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", chunk int, at string").repartition(3)
    ids = spark.createDataFrame([(7777,), (1,), (None,)], "conv_id long")
    got = repair.repair_report(df, ids, **options)
    want_ids = {7777, 1, None}
    check(got, [r for r in rows if r[0] in want_ids], want_ids)
    check(repair.repair_report(df, **options), rows, set())


def test_matrices_give_what_passes_give(spark):
    rows = [(1, t, "system" if t % 7 else "user", f"{t}.") for t in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (repair.repair_report(df, chunk=10, passes=p).collect() for p in (10, 0))
    assert a == b
    check(repair.repair_report(df, chunk=5), rows, set())


def test_equal_rows_are_one(spark):
    rows = [(1, 0, "user", "q."), (1, 1, "assistant", "r.")] + [(1, 5, "user", "again.")] * 500 + [(1, 6, "user", " ")] * 20
    check(repair.repair_report(spark.createDataFrame(rows, SCHEMA)), rows, set())
    assert repair.flagged(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b."), (2, 0, "tool", "t")]
    chunks = repair.repaired_chunks(spark.createDataFrame(rows, SCHEMA))
    turns = repair.repaired_turns(chunks).orderBy("conv_id", "at", "place")
    assert [(r.conv_id, r.role, r.text) for r in turns.collect()] == [(1, "user", ""), (1, "assistant", "a."), (1, "user", "b."), (1, "assistant", "")]
    assert {r.conv_id: r.audit for r in chunks.collect()}[2] == "D"
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(nothing).count() == 0
    left = repair.repair_report(nothing, spark.createDataFrame([(4,)], "conv_id long")).collect()
    assert [tuple(r) for r in left] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
