import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from insight_spark.llm import trie
from insight_spark.llm.common import table


def rule():
    return F.crc32(F.col("conv_id").cast("string")) % 6, F.col("conv_id") - F.col("conv_id") % 100


def expected(rows, shared=True):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        whole[c] = turns.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + own[h:] if shared else own
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = set()
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.add((min(members[p]), len(p), parent, len(members[p]), len(kids), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(df, rows, shared=True, **options):
    got = trie.prefix_trie(df, *(rule() if shared else (None, None)), **options)
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(set(have))
    want = expected(rows, shared)
    assert set(have) == want, (sorted(set(have) - want)[:3], sorted(want - set(have))[:3])


SCHEMA = "conv_id long, turn long, role string, text string"


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text")
    check(df, [tuple(r) for r in df.collect()])


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 130), 200, 205, 301, 302, -7]:
        for _ in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", "a", "bé😀", "a"])))
    rows += [(None, 0, "user", "x"), (7, 1, "user", "long " * 50_000)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA + ", c int, d int, part string").repartition(3)
    check(df, rows)
    check(df, rows, shared=False)


@pytest.mark.parametrize("bits", [2])
def test_deep_chains_of_prefixes(spark, bits):
    """Chains whose nodes change their smallest member at every depth, long single chains, and a comb."""
    said = [("user", f"t{d}") for d in range(40)]
    convs = {c: said[: c + 1] for c in range(40)}  # each is a prefix of the next
    convs |= {100 + c: [("user", "s"), *said[: 39 - c]] for c in range(39)}
    convs[300] = [("user", f"deep{d}") for d in range(150)]
    convs |= {301 + c: convs[300][: 7 * c] + [("user", "off")] for c in range(20)}
    rows = [(c, k, r, x) for c, t in convs.items() for k, (r, x) in enumerate(t)]
    check(spark.createDataFrame(rows, SCHEMA), rows, shared=False, block_bits=bits)


def test_copies_and_empty_table(spark):
    rows = [(c, t, "user", f"{t}") for c in range(300) for t in range(3)]
    check(spark.createDataFrame(rows, SCHEMA), rows, shared=False)
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
