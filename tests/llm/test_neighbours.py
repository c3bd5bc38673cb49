import math

import numpy as np

from insight_spark.llm import neighbours
from insight_spark.llm.common import table


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        near = sorted((math.dist(x, y), i) for i, y in rows if i != q and len(y) == len(x))
        out[q] = near[:k]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def searched(spark, rows, k=10):
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, id int")
    return neighbours.nearest(df, df.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k)


def test_recall_on_the_whole_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = result(neighbours.nearest(df, df.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = {(q, i): d for q, x in want.items() for d, i in x}
    assert all(abs(exact[q, i] - d) < 1e-12 for q, x in got.items() for d, i in x if (q, i) in exact)


def test_recall_with_several_hashes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x[1500:] = x[:1500] + 0.2 * rng.normal(size=(1500, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    old, neighbours.BUCKET = neighbours.BUCKET, 20
    try:
        got = result(searched(spark, rows))
    finally:
        neighbours.BUCKET = old
    want = brute(rows, rows[::100], 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(0, 320, 1)] + [(i, [0.0, 1.0, float(i % 3)]) for i in range(400, 430)]
    bad = [(500, None), (600, []), (700, [0.0, 0.0, 0.0]), (800, [1.0, None, 2.0]), (900, [float("nan"), 1.0, 1.0]), (1000, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    other = [(1100, [1.0, 2.0]), (1101, [1.0, 2.0]), (1200, [3.0])]
    got = result(searched(spark, rows + bad + other + rows[:3]))
    want = brute(rows + other, [r for r in rows + other if r[0] % 100 == 0], 10)
    assert {q: x for q, x in want.items() if x} == got
    assert neighbours.nearest(
        spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "query_id long, embedding array<float>")
    ).count() == 0


def clustered(rng, n, dim):
    """Vectors in small groups: every vector has some near ones, as embeddings of texts have."""
    centres = rng.standard_normal((n // 20, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.45 * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def test_few_vectors_are_compared_at_a_large_size():
    """200,000 vectors, the hashing alone: probes as measured on other queries, recall and share compared."""
    rng = np.random.default_rng(7)
    n, k = 200_000, 10
    x = clustered(rng, n, 64)
    buckets = n // neighbours.BUCKET
    picked = rng.permutation(n)[:140]
    near = x[picked] @ x.T
    near[np.arange(140), picked] = -9
    top = np.argpartition(-near, k, axis=1)[:, :k]
    sample, asked = picked[:70], picked[70:]
    probes = neighbours.probes_for(x[sample], [x[t] for t in top[:70]], buckets, neighbours.TABLES, neighbours.RECALL)
    met = np.zeros((len(asked), n), bool)
    for table in range(neighbours.TABLES):
        r = neighbours.Rotations(table, 64, buckets)
        home = np.concatenate([r.probes(x[a : a + 20_000], 1)[:, 0] for a in range(0, n, 20_000)])
        for q, wanted in enumerate(r.probes(x[asked], probes)):
            met[q] |= np.isin(home, wanted)
    recall = np.take_along_axis(met, top[70:], 1).mean()
    assert recall >= 0.9 and met.mean() < 0.03, (probes, recall, met.mean())


def test_vectors_without_structure_get_more_probes():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 32))
    q = x[:60]
    s = np.linalg.norm(q[:, None] - x[None], axis=2)
    top = np.argsort(s, axis=1)[:, 1:11]
    near = q + 0.05 * rng.standard_normal(q.shape)
    few = neighbours.probes_for(q, [near[k : k + 1] for k in range(60)], 125, 8, 0.95)
    many = neighbours.probes_for(q, [x[t] for t in top], 125, 8, 0.95)
    assert few < many <= 126


def test_crowded_buckets_are_cut(spark, monkeypatch):
    """A third of all vectors nearly equal, and blocks of a few: every query still meets every vector there."""
    monkeypatch.setattr(neighbours, "HELD", 16)
    rng = np.random.default_rng(9)
    base = rng.standard_normal(12)
    rows = [(i, (base + 1e-4 * rng.standard_normal(12)).tolist()) for i in range(0, 400, 1)] + [(i, rng.standard_normal(12).tolist()) for i in range(400, 1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = result(neighbours.nearest(df, queries))
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want if q < 400)
    assert hits >= 0.99 * 10 * 40
    probe = df.where("vec_id % 10 = 0").selectExpr("4 AS dim", "1 AS tab", "7L AS bucket", "vec_id AS id")
    blocks = neighbours.placed(probe, df.selectExpr("4 AS dim", "1 AS tab", "7L AS bucket", "vec_id AS id")).collect()
    by = {}
    for b in blocks:
        by.setdefault(b.block, ([], []))[b.kind].append(b.id)
    met = [(q, v) for qs, vs in by.values() for q in qs for v in vs]
    assert len(met) == len(set(met)) == 120 * 1200 and max(max(map(len, x)) for x in by.values()) < 60
