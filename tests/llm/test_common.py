import numpy as np
import pytest

from insight_spark.llm.common import components


def smallest(edges):
    up = {}

    def root(v):
        up.setdefault(v, v)
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {v: root(v) for v in up}


def star(n):
    return [(n, k) for k in range(n)]


rng = np.random.default_rng(2)
ORDER = rng.permutation(200).tolist()
GRAPHS = {
    "path": [(k, k + 1) for k in range(60)],
    "shuffled path": list(zip(ORDER, ORDER[1:], strict=False)),
    "star": star(50),
    "sparse": [tuple(map(int, p)) for p in rng.integers(0, 300, (150, 2)) if p[0] != p[1]],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = GRAPHS[name] + [(None, 1), (5, None), (7, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.v: r.c for r in out.collect()} == smallest(GRAPHS[name])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
