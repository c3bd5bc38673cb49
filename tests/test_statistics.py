"""Sketch profiles, frequent values, row sets, cubes, correlations and JSON paths on frames with nulls, skew and edge cases."""

import json
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from insight_spark.operators.correlation import correlations
from insight_spark.operators.cubes import closed_under_parents, cube
from insight_spark.operators.frequent import Summary, frequent_values
from insight_spark.operators.paths import path_profile
from insight_spark.operators.rowsets import change_counts, except_all, intersect_all, multiplicities, row_changes
from insight_spark.operators.sketches import column_sketches, merged_sketches, sketch_profile, store_batch, stored_batches


def test_sketches_merge_in_any_order_within_their_error(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(5, 30_000), np.repeat(2.5, 10_000)])
    names = [f"user{int(v)}" for v in rng.integers(0, 3000, len(x))]
    rows = [(float(v), None if k % 10 == 0 else n, k % 5) for k, (v, n) in enumerate(zip(x, names, strict=True))]
    rows += [(float("nan"), "z", 0), (None, "z", 1)]
    df = spark.createDataFrame(rows, "x double, name string, part int")
    parts = [column_sketches(df.where(F.col("part") == k), ["x", "name"]) for k in range(5)]
    profiles = []
    for order, folder in (((0, 1, 2, 3, 4), "a"), ((4, 2, 0, 1, 3), "b/c")):
        path = str(tmp_path / folder)
        for k in order:
            store_batch(parts[k], path, f"2024/{k} {k}")
        store_batch(parts[order[0]], path, f"2024/{order[0]} {order[0]}")  # the same batch again changes nothing
        assert stored_batches(spark, path).count() == 10
        profiles.append({r["column"]: r for r in sketch_profile(merged_sketches(stored_batches(spark, path)), (0.1, 0.5, 0.99)).collect()})
    a, b = profiles
    for name in ("x", "name"):
        assert [a[name][c] for c in ("n", "missing", "distinct", "least", "greatest")] == [b[name][c] for c in ("n", "missing", "distinct", "least", "greatest")]
    assert (a["x"].n, a["x"].missing, a["name"].missing) == (40_002, 2, 4000)
    assert a["x"].mean == pytest.approx(x.mean()) and float(a["x"].greatest) == x.max()
    assert abs(a["x"].distinct - 30_001) < 0.08 * 30_001 and abs(a["name"].distinct - 3001) < 0.08 * 3001
    for found in profiles:
        for q, v in zip((0.1, 0.5, 0.99), found["x"].quantiles, strict=True):
            assert (x < v).mean() - 0.01 <= q <= (x <= v).mean() + 0.01
    assert a["name"].quantiles is None and a["name"].least == "user0"


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "x double, tags array<string>")
    for rows in (df, df.limit(0)):
        got = {r["column"]: r for r in sketch_profile(merged_sketches(column_sketches(rows))).collect()}
        assert all(r.distinct == 0 and r.quantiles is None and r["mean"] is None for r in got.values()) and set(got) == {"x", "tags"}


def test_summary_keeps_every_frequent_value():
    rng = random.Random(2)
    for most in (1, 3, 9):
        rows = [rng.choice("aaabbcdefghij") + str(rng.choice([0, 0, 0, rng.random()])) for _ in range(3000)]
        summary = Summary(most)
        for k in range(0, 3000, 100):
            summary.add(Counter(rows[k : k + 100]))
            assert len(summary.held) <= most
        for value, n in Counter(rows).items():
            assert summary.held.get(value, 0) <= n <= summary.held.get(value, 0) + summary.lost
        assert summary.lost <= 3000 / (most + 1) + 1e-9


def test_frequent_values_equal_exact_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None, f"rare{k}"]), rng.choice([1.5, float(k)]), k % 40) for k in range(4000)]
    df = spark.createDataFrame(rows, "s string, x double, k long").repartition(13)
    for share in (0.025, 0.2, 1.0):
        got = {(r["column"], r.value): r.n for r in frequent_values(df, share=share).collect()}
        want = {}
        for c, at in (("s", 0), ("x", 1), ("k", 2)):
            want |= {(c, str(v)): n for v, n in Counter(r[at] for r in rows if r[at] is not None).items() if n >= share * len(rows)}
        assert got == want
    assert frequent_values(df.limit(0)).count() == 0


def test_row_sets_equal_sql(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice([1, 2, None]), rng.choice(["x", "y", None]), rng.choice([0.5, None])) for _ in range(n)]
    a, b = make(150) + [(7, "hot", 1.0)] * 2500, make(90) + [(7, "hot", 1.0)] * 5 + [(8, "new", 0.0)]
    ddl = "k long, s string, x double"
    left, right = (spark.createDataFrame(rows, ddl) for rows in (a, b))
    con = duckdb.connect()
    for name, rows in (("a", a), ("b", b)):
        con.execute(f"CREATE TABLE {name} (k BIGINT, s VARCHAR, x DOUBLE)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", rows)
    for op, word in ((except_all, "EXCEPT"), (intersect_all, "INTERSECT")):
        want = Counter(con.execute(f"SELECT * FROM a {word} ALL SELECT * FROM b").fetchall())
        assert Counter(map(tuple, op(left, right.select("x", "s", "k")).collect())) == want
    assert op(left.limit(0), right).count() == 0 and except_all(left, right.limit(0)).count() == len(a)
    assert multiplicities(left, right).where("k = 7").first()["n_left"] == 2500
    with pytest.raises(ValueError):
        except_all(left, right.drop("x"))


def test_row_changes(spark):
    ddl = "id long, part string, v double, tags array<int>, only long"
    old = [(1, "a", 1.0, [1], 0), (2, "a", None, None, 0), (3, "a", float("nan"), [], 0), (4, "a", 4.0, [4], 0), (5, "b", 1.0, [1], 0), (5, "b", 1.0, [1], 0), (None, None, 1.0, None, 0)]
    new = [(1, "a", 1.0, [1]), (2, "a", 2.0, [2]), (3, "a", float("nan"), [0]), (5, "b", 1.0, [1]), (6, "a", None, None), (None, None, 1.0, None)]
    changes = row_changes(spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl.rpartition(",")[0]), ["id", "part"])
    got = {r.id: (r.status, r.changed, r.n_old, r.n_new) for r in changes.collect()}
    assert got == {
        1: ("same", [], 1, 1), 2: ("changed", ["v", "tags"], 1, 1), 3: ("changed", ["tags"], 1, 1), 4: ("removed", [], 1, 0),
        5: ("repeated", [], 2, 1), 6: ("added", [], 0, 1), None: ("same", [], 1, 1),
    }
    counts = {(r.status, r["column"]): r.n for r in change_counts(changes).collect()}
    assert counts[("changed", None)] == 2 and counts[("changed", "tags")] == 2 and counts[("changed", "v")] == 1 and counts[("same", None)] == 2


def cube_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3]), rng.choice([None, True]), rng.choice([None, rng.randrange(9)]), rng.randrange(40)) for _ in range(n)]


def test_cube_equals_sql(spark, plan):
    rows = cube_rows(5, 400)
    df = spark.createDataFrame(rows, "a string, b long, c boolean, v long, u long")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a VARCHAR, b BIGINT, c BOOLEAN, v BIGINT, u BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute(
        "SELECT a, b, c, grouping(a, b, c), count(*), sum(v), min(v), max(v), count(DISTINCT u), count(DISTINCT v) FROM t GROUP BY CUBE (a, b, c)"
    ).fetchall()
    got = cube(df, ["a", "b", "c"], ["v"], ["u", "v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(int(v) if v is not None and k > 2 else v for k, v in enumerate(r)) for r in want), key=str)
    assert "Expand" not in plan(got)
    near = {r[:4]: tuple(r)[4:] for r in cube(df, ["a", "b", "c"], ["v"], ["u", "v"], exact=False).collect()}
    assert near == {r[:4]: tuple(r)[4:] for r in got.collect()}  # sketches of so few values are exact
    some = cube(df, ["a", "b", "c"], levels=[("a",), ()]).collect()
    assert {r.grouping for r in some} == {3, 7} and sum(r.n for r in some) == 800
    assert cube(df.limit(0), ["a"], ["v"], ["u"]).count() == 0
    assert closed_under_parents([("a",), ()], ("a", "b", "c")) == [("a", "b", "c"), ("a", "b"), ("a",), ()]


def test_correlations_with_gaps_offsets_and_constants(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3000, 4))
    base[:, 1] += 0.5 * base[:, 0]
    base[:, 2] = -base[:, 0]
    base[:, 3] = 4.0
    gaps = np.where(rng.random(base.shape) < 0.1, np.nan, base)
    con = duckdb.connect()
    for offset in (0.0, 1e9):
        x = base * 1.0
        x[:, 1] += offset  # as doubles hold it
        shown = np.where(np.isnan(gaps), np.nan, x)
        rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in shown] + [(float("inf"), 1.0, None, 4.0)]
        df = spark.createDataFrame(rows, "p double, q double, r double, s double").repartition(7)
        got = {(r.column_a, r.column_b): r for r in correlations(df).collect()}
        con.execute("CREATE OR REPLACE TABLE t (p DOUBLE, q DOUBLE, r DOUBLE, s DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [tuple(None if v is None else v - (offset if k == 1 else 0) for k, v in enumerate(r)) for r in rows[:-1]])
        for a, b in (("p", "q"), ("p", "r"), ("q", "r")):
            n, want, cov = con.execute(f"SELECT count(*), corr({a}, {b}), covar_samp({a}, {b}) FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL").fetchone()
            assert got[a, b].n == n
            assert got[a, b].correlation == pytest.approx(want, abs=1e-9) and got[a, b].covariance == pytest.approx(cov, abs=1e-7)
        assert got["p", "s"].correlation is None and got["p", "s"].covariance == pytest.approx(0, abs=1e-12)
    none = correlations(df.limit(0)).collect()
    assert len(none) == 6 and {(r.n, r.covariance, r.correlation) for r in none} == {(0, None, None)}


def test_correlations_of_more_columns_than_a_block(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((80, 70))
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{k} double" for k in range(70)))
    got = {(r.column_a, r.column_b): r.correlation for r in correlations(df).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 70 * 69 // 2 and all(abs(got[f"c{i}", f"c{j}"] - want[i, j]) < 1e-9 for i in range(70) for j in range(i + 1, 70))


def test_json_paths(spark):
    docs = [{"a": 1, "b": {"c": [1, "x", None, {"d": True}]}}, {"a": "t", "b": None, "odd key.": 2.5}, [], [{"a": 1}, []], 7, None]
    texts = [json.dumps(d) for d in docs] + ["{broken", None, ""]
    got = {r.path: (r.n, r.nulls, r.n_missing, r.types) for r in path_profile(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()}
    assert got == {
        "$": (8, 1, 0, "invalid 2, list 2, object 2, null 1, number 1"), "$.a": (2, 0, 0, "number 1, text 1"), "$.b": (2, 1, 0, "null 1, object 1"),
        "$.b.c": (1, 0, 0, "list 1"), "$.b.c[*]": (4, 1, 0, "null 1, number 1, object 1, text 1"), "$.b.c[*].d": (1, 0, 0, "boolean 1"),
        '$."odd key."': (1, 0, 1, "number 1"), "$[*]": (2, 0, 0, "list 1, object 1"), "$[*].a": (1, 0, 0, "number 1"),
    }
    assert path_profile(spark.createDataFrame([(None,)], "j string"), "j").count() == 0
