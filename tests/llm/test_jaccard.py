import re
from itertools import combinations

import numpy as np
import pytest

from insight_spark.llm import jaccard
from insight_spark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def expected(rows, n, percent):
    """All pairs, compared directly; candidates only need to share one shingle."""
    found = {d: shingle_set(t, n) for d, t in rows}
    up = {d: d for d in found}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    holders = {}
    for d, s in found.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = {p for ds in holders.values() for p in combinations(sorted(ds), 2)}
    for a, b in pairs:
        both = len(found[a] & found[b])
        if 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(found[d]), root(d)) for d in found}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_whole_table_equals_all_pairs(spark, n, percent):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(jaccard.jaccard_components(docs, n, percent)) == expected(rows, n, percent)


def edited(seed, members, words=60):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(members):
        own = list(base)
        for at in rng.integers(0, words, rng.integers(0, 4)):
            own[at] = f"x{rng.integers(0, 9)}"
        out.append(" ".join(own[: words - int(rng.integers(0, 4))]))
    return out


@pytest.mark.parametrize("limit", [300_000, 1500])
def test_near_copies_in_whole_and_split_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", limit)
    rows = [(7 * k + 1, t) for k, t in enumerate(edited(1, 80) + edited(2, 60, 25) + ["a b", "A  B", "a b c d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80), (1, 60)):
        assert result(jaccard.jaccard_components(docs, n, percent)) == expected(rows, n, percent)


def passages(seed, docs, each=3, words=12, pool=20):
    """Unlike texts with passages of one pool, which join them to one group by segments of two shingles, and a near copy of
    every fifth."""
    rng = np.random.default_rng(seed)
    shared = [[f"p{k}q{j}" for j in range(words)] for k in range(pool)]
    rows = []
    for k in range(docs):
        own = [f"d{k}w{j}" for j in range(60)]
        for p in rng.choice(pool, each, replace=False):
            at = int(rng.integers(0, 60))
            own[at:at] = shared[p]
        rows.append((k, " ".join(own)))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(own[:-3] + ["other"])))
    return rows


def test_unlike_documents_of_large_groups_are_not_compared(spark, monkeypatch):
    """A group that passages hold together is cut; before, each of its texts was copied to every block of the group."""
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 1500)
    rows = passages(4, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = jaccard.groups_of(docs, np.empty(0, np.uint64), 5, 80)
    assert groups.groupBy("c").count().agg({"count": "max"}).first()[0] * 80 > 1500
    pivots = []
    monkeypatch.setattr(jaccard, "near_pivot", lambda *a, real=jaccard.near_pivot: pivots.append(a) or real(*a))
    assert result(jaccard.jaccard_components(docs, 5, 80)) == expected(rows, 5, 80)
    assert not pivots


def test_cut_groups_hold_all_links(spark):
    """Two large groups, one text under two ids and twice under one; unlike texts are left out."""
    rows = passages(7, 60) + [(2000 + k, t) for k, t in enumerate(edited(3, 30))]
    rows += [(2003, rows[2][1]), (2003, rows[2][1])]
    large = [(d % 2, d, 70, t.encode()) for d, t in rows]
    large = spark.createDataFrame(large, "part long, doc_id long, n_shingles long, text binary")
    found = {}
    for r in jaccard.refined(large, 5, 80).collect():
        found.setdefault(r.doc_id, set()).add(r.part)
    for (a, x), (b, y) in combinations(rows, 2):
        one, two = shingle_set(x, 5), shingle_set(y, 5)
        if a != b and a % 2 == b % 2 and 100 * len(one & two) >= 80 * len(one | two):
            assert found[a] & found[b]
    assert {d for d in found if d < 60 and d % 5} == {1}  # the text of 2003


def test_segments_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for turn in range(400):
            pool = np.sort(rng.integers(0, 1 << 63, 200).astype(np.uint64))
            segments = jaccard.Segments(percent, pool if turn % 2 else pool[:0])
            size = int(rng.integers(2, 400))
            one = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            one = np.unique(np.concatenate([one[: size // (1 + turn % 7)], rng.choice(pool, turn % 150)])) if turn % 2 else one
            size = len(one)
            drop = int(rng.integers(0, max(1, size // 6) + 1))
            two = np.unique(np.concatenate([one[drop // 2 :], rng.integers(0, 1 << 63, drop - drop // 2).astype(np.uint64)]))
            both = len(np.intersect1d(one, two))
            if 100 * both >= percent * (len(one) + len(two) - both) and not np.array_equal(one, two):
                assert set(segments.of(one).tolist()) & set(segments.of(two).tolist())


def test_search_finds_every_link():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        found = sorted((sorted(set(rng.integers(0, 14, 12).tolist())) for _ in range(120)), key=len)
        search = jaccard.Search(percent)
        for k, elements in enumerate(found):
            own = set(elements)
            want = [x for x in range(k) if 100 * len(own & set(found[x])) >= percent * len(own | set(found[x]))]
            assert search.links(elements, lambda x: False) == want
            search.add(elements)


def test_edge_cases(spark):
    schema = "doc_id long, text string, segments string, a long, part long"
    text = "one two three four five six seven"
    rows = [(1, None, None, None, None), (2, "", "s", 1, 1), (3, " \t", None, None, 1), (9, text, None, 2, 3)]
    rows += [(5, text, None, None, None), (5, text, None, None, None), (None, text, None, None, None), (8, "x " * 30000, None, 1, 1)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, schema), 3, 90)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (9, 5, 5), (5, 5, 5), (5, 5, 5), (None, 5, 5), (8, 1, 8)], key=str)
    empty = spark.createDataFrame([], schema)
    assert jaccard.jaccard_components(empty).count() == 0
