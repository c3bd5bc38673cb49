import math

import numpy as np
import pytest

from insight_spark.llm import neardup
from insight_spark.llm.common import table

SCHEMA = "vec_id long, embedding array<double>"


def truth(rows, cosine):
    """vec_id -> (links, component), by comparing all pairs; vectors that take no part are alone."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in good}
    for dim in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        for a, b in zip(*np.nonzero(s >= cosine), strict=True):
            if a != b:
                near[own[a]].add(own[b])
    out, seen = {}, set()
    for k in good:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for j in near[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            seen |= group
            for j in group:
                out[rows[j][0]] = (len(near[j]), min(rows[i][0] for i in group))
    for k, (i, _) in enumerate(rows):
        if k not in near:
            out[i] = (0, i)
    return out


def found(df, **options):
    got = neardup.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}, len(got)


def groups(rng, sizes, dim, spread):
    """Groups of copies of random directions, disturbed by `spread`, in one list of vectors."""
    out = []
    for n in sizes:
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        noise = rng.standard_normal((n, dim))
        out += (base + spread * noise / np.linalg.norm(noise, axis=1, keepdims=True)).tolist()
    return out


def test_every_link_of_a_small_table(spark):
    """All vectors fit into a window, so every pair is compared; odd vectors link with nothing."""
    rng = np.random.default_rng(1)
    vectors = groups(rng, [1] * 40 + [2, 3, 9], 8, 0.2) + rng.standard_normal((30, 3)).tolist()
    rows = [(k * 3 - 20, v) for k, v in enumerate(vectors)]
    rows += [(900 + k, rows[k][1]) for k in range(6)] + [(950, [x * 1e200 for x in rows[0][1]]), (951, [x * 1e-200 for x in rows[0][1]])]
    odd = [None, [], [0.0] * 8, [1.0, None, *[0.0] * 6], [float("nan")] * 8, [float("inf")] + [1.0] * 7, [-0.0, 0.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", id int, c int, at int").repartition(5)
    got, n = found(df, cosine=0.9)
    assert n == len(rows) and got == truth(rows, 0.9)


def test_tight_groups_are_counted_whole(spark):
    """Groups far beyond the window: links proved by levels, and no pairs emitted for them."""
    rng = np.random.default_rng(2)
    rows = list(enumerate(groups(rng, [700, 90] + [1] * 500, 16, 0.1)))
    df = spark.createDataFrame(rows, SCHEMA)
    got, _ = found(df, window=16)
    want = truth(rows, 0.95)
    assert {k: got[k][1] for k in got} == {k: want[k][1] for k in want}
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.999 * sum(v[0] for v in want.values())


@pytest.mark.parametrize("spread", [0.15, 0.23])
def test_recall_of_pairs_near_the_threshold(spark, spread):
    """Pairs about the threshold, windows much smaller than the table: recall as asked, nothing below."""
    rng = np.random.default_rng(3)
    rows = list(enumerate(groups(rng, [2] * 1500, 32, spread)))
    got, _ = found(spark.createDataFrame(rows, SCHEMA), window=16, recall=0.9)
    want = truth(rows, 0.95)
    links = sum(v[0] for v in want.values())
    assert links > 100
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.9 * links
    assert neardup.passes_for(3000, 16, 0.95, 0.9) > 3


def test_repeated_ids_null_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (None, [1.0, 0.0])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    assert found(df, cosine=0.6, window=64)[0].keys() == truth(rows, 0.6).keys()
    assert found(df)[0] == truth(rows, 0.95)
