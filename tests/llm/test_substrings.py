import hashlib

import numpy as np
import pytest

from insight_spark.llm import substrings
from insight_spark.llm.common import table


def expected(rows, k):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - k + 1 if d is not None else 0):
            key = b" ".join(w[i : i + k])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1 if d is not None else 0):
            if first[b" ".join(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, 50)
    assert sum(r[2] for r in want) > 0
    assert result(substrings.remove_repeats(docs)) == want


@pytest.mark.parametrize("hot", [20_000, 3])
def test_shared_passages_and_hot_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_STRINGS", hot)
    rng = np.random.default_rng(1)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for d in range(60):
        own = [f"w{x}" for x in rng.integers(0, 30, int(rng.integers(0, 60)))]
        at = int(rng.integers(0, len(own) + 1))
        cut = int(rng.integers(0, 20))
        rows.append((100 - d, " ".join(own[:at] + passage[cut:] + own[at:]) if d % 3 else "is " * 300))
    rows += [(500, rows[4][1]), (500, rows[5][1]), (None, rows[5][1]), (501, "é 　x\n" * 40), (502, "é  　x " * 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.remove_repeats(docs, k=12, m=4)) == expected(rows, 12)


def test_edge_cases(spark):
    schema = "doc_id long, text string, minimiser long, low string, spans int"
    rows = [(1, None, 1, "x", None), (2, "", None, None, 1), (3, "a b c", None, None, None), (3, "a b c", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    assert result(substrings.remove_repeats(docs)) == expected([r[:2] for r in rows], 50)
    assert substrings.remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_very_long_texts_that_share_passages(spark):
    """Texts of 150,000 words, a passage of each in the other, and one word of 200,000 characters."""
    rng = np.random.default_rng(5)
    long = [[f"w{x}" for x in rng.integers(0, 50_000, 150_000)] for _ in range(2)]
    long[1][70_000:70_300] = long[0][10:310]
    long[1][100_000] = "y" * 200_000
    rows = [(1, " ".join(long[0])), (2, " ".join(long[1])), (3, " ".join(long[1][69_990:70_200]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows, 50)
    assert [r[2] for r in want] == [0, 300, 210]
    assert result(substrings.remove_repeats(docs)) == want
