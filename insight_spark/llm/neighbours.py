"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from insight_spark.llm.common import prepare
from insight_spark.operators.ordered import numbered
from insight_spark.session import stored

TABLES, BUCKET, RECALL = 16, 32, 0.95
SAMPLE = 128  # queries on which the number of probes is measured
HELD = 4096  # vectors, and queries, that one block of a bucket holds


class Rotations:
    """Pseudo-rotations of one table: three rounds of random signs and a fast Hadamard transform.

    The last hash keeps its first `last` coordinates only, so the number of buckets follows the
    number of vectors; hashes before it use all.
    """

    def __init__(self, table: int, dim: int, buckets: int):
        self.width = 1 << max(1, (dim - 1).bit_length())
        full = 2 * self.width
        self.axes = []
        while buckets > full:
            self.axes.append(self.width)
            buckets = -(-buckets // full)
        self.axes.append(max(1, min(self.width, -(-buckets // 2))))
        rng = np.random.default_rng((table, dim))
        self.signs = rng.choice([-1.0, 1.0], (len(self.axes), 3, self.width))

    def turned(self, x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x
        for signs in self.signs[k]:
            out *= signs
            half = 1
            while half < self.width:
                view = out.reshape(len(x), -1, 2, half)
                a, b = view[:, :, 0].copy(), view[:, :, 1].copy()
                view[:, :, 0], view[:, :, 1] = a + b, a - b
                half *= 2
            out /= np.sqrt(self.width)
        return out[:, : self.axes[k]]

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n buckets likeliest to hold near vectors, the own one first: signed axes by what they fall
        short of the nearest one, summed over the hashes."""
        bucket, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k, axes in enumerate(self.axes):
            turned = self.turned(x, k)
            score = np.concatenate([turned, -turned], axis=1)
            short = (score.max(axis=1, keepdims=True) - score) ** 2
            best = np.argsort(short, axis=1, kind="stable")[:, : min(n, 2 * axes)]
            bucket = (bucket[:, :, None] * (2 * axes) + best[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + np.take_along_axis(short, best, axis=1)[:, None, :]).reshape(len(x), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, :n]
            bucket, loss = np.take_along_axis(bucket, order, 1), np.take_along_axis(loss, order, 1)
        return bucket


def units(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def hashed(buckets: int, tables: int, probes: int):
    """Vectors -> their buckets, one row for each table and probe."""

    def run(batches):
        rotations: dict[tuple[int, int], Rotations] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                unit = units(np.stack(lists.take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype(np.float64))
                for table in range(tables):
                    if (table, dim) not in rotations:
                        rotations[table, dim] = Rotations(table, dim, buckets)
                    found = rotations[table, dim].probes(unit, probes)
                    n, each = len(rows), found.shape[1]
                    columns = [pa.array(np.full(n * each, v), pa.int32()) for v in (dim, table)]
                    columns += [pa.array(found.ravel()), pa.array(np.repeat(ids[rows], each))]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "tab", "bucket", "id"])

    return run


def probes_for(queries: np.ndarray, nearest: list[np.ndarray], buckets: int, tables: int, recall: float) -> int:
    """The least number of probes (doubling) with which the nearest vectors of sample queries share a bucket
    with them in some table often enough; all buckets, if no number is enough."""
    rotations = [Rotations(t, queries.shape[1], buckets) for t in range(tables)]
    owner = np.repeat(np.arange(len(queries)), [len(x) for x in nearest])
    if not len(owner):
        return 1
    homes = [r.probes(units(np.concatenate(nearest)), 1)[:, 0] for r in rotations]
    most, probes = buckets + 1, 1
    while probes < most:
        hit = np.zeros(len(owner), bool)
        for r, home in zip(rotations, homes, strict=True):
            hit |= (r.probes(units(queries), probes)[owner] == home[:, None]).any(axis=1)
        if hit.mean() >= recall:
            return probes
        probes *= 2
    return most


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, as exact as double precision gives."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances up to rounding."""
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T


def reranked(most: int):
    """Rows sorted by bucket, queries before vectors -> each query's nearest of each bucket."""

    def run(batches):
        key, queries, held, seen = None, [], [], []

        def settle():
            """Fold the held vectors into what each query of the bucket has seen."""
            nonlocal held
            if not queries or not held:
                held = []
                return
            ids = np.array([i for i, _ in held], np.int64)
            b = np.frombuffer(b"".join(v for _, v in held), "<f8").reshape(len(held), -1)
            a = np.frombuffer(b"".join(v for _, v in queries), "<f8").reshape(len(queries), -1)
            keep = min(most + 16, len(ids))
            for at in range(0, len(a), 256):
                rough = near(a[at : at + 256], b)
                for k, row in enumerate(np.argpartition(rough, keep - 1, axis=1)[:, :keep]):
                    limit = rough[k, row].max()
                    # all that rounding cannot set apart from the last one kept are measured exactly
                    row = np.flatnonzero(rough[k] <= limit + 1e-9 * (1 + abs(limit)))
                    exact = distances(a[at + k : at + k + 1], b[row])[0]
                    got = sorted([*seen[at + k], *zip(exact.tolist(), ids[row].tolist(), strict=True)])
                    seen[at + k] = got[:most]
            held = []

        def out():
            settle()
            rows = [(q, i, d) for (q, _), found in zip(queries, seen, strict=True) for d, i in found]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q", "id", "score"])

        for batch in batches:
            for block, kind, i, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != key:
                    if queries:
                        yield out()
                    key, queries, held, seen = block, [], [], []
                vector = np.array(vector, "<f8").tobytes()
                if kind == 0:
                    queries.append((i, vector))
                    seen.append([])
                elif queries:
                    held.append((i, vector))
                    if len(held) >= HELD:
                        settle()
        if queries:
            yield out()

    return run


def scanned(most: int):
    """Queries with a block of vectors each -> the block's nearest of each."""

    def run(batches):
        for batch in batches:
            rows = []
            for q, own, ids, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.array([own], np.float64)
                same = [k for k, v in enumerate(block) if len(v) == len(own)]
                if same:
                    d = distances(a, np.array([block[k] for k in same], np.float64))[0]
                    rows += [(q, i, s) for s, i in sorted(zip(d.tolist(), (ids[k] for k in same), strict=True))[:most]]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["q", "id", "score"])

    return run


def sampled_probes(heads: DataFrame, classes: DataFrame, k: int, buckets: int, tables: int, recall: float) -> int:
    """probes_for on at most SAMPLE queries, whose exact neighbours one scan finds."""
    rows = heads.orderBy(F.xxhash64("q")).limit(SAMPLE).collect()
    most = 1
    for dim in {len(r.embedding) for r in rows}:
        queries = np.array([r.embedding for r in rows if len(r.embedding) == dim], np.float64)
        held = heads.sparkSession.sparkContext.broadcast(queries)

        def run(batches, held=held, dim=dim):
            top = [[] for _ in held.value]
            for batch in batches:
                lists = batch.column(0)
                rows = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == dim)
                if not len(rows):
                    continue
                x = np.stack(lists.take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype(np.float64)
                for n, d in enumerate(near(held.value, x)):
                    for j in np.argsort(d)[: k + 1].tolist():
                        top[n].append((d[j], x[j].tolist()))
                    top[n] = sorted(top[n], key=lambda t: t[0])[: k + 1]
            flat = [(n, float(d), v) for n, found in enumerate(top) for d, v in found]
            kinds = [pa.int32(), pa.float64(), pa.list_(pa.float64())]
            columns = list(zip(*flat, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["n", "d", "v"])

        found = classes.select("embedding").mapInArrow(run, "n int, d double, v array<double>")
        best = Window.partitionBy("n").orderBy("d")
        found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).collect()
        # the query itself is no neighbour
        nearest = [np.array([r.v for r in found if r.n == n and r.d > 1e-12], np.float64).reshape(-1, dim) for n in range(len(queries))]
        most = max(most, probes_for(queries, nearest, buckets, tables, recall))
    return most


def placed(probe: DataFrame, index: DataFrame) -> DataFrame:
    """block, kind (0: query, 1: vector), id: every bucket that a query probes, cut into blocks of at most about
    HELD queries and HELD vectors, so that each of its queries meets each of its vectors in one block."""
    key = ["dim", "tab", "bucket"]
    asked = probe.groupBy(*key).agg(F.count("*").alias("n_queries"))
    there = index.groupBy(*key).agg(F.count("*").alias("n_vectors"))
    parts = asked.join(there, key).select(*key, *(F.ceil(F.col(n) / HELD).cast("int").alias(p) for n, p in (("n_queries", "qs"), ("n_vectors", "vs"))))
    parts = stored(parts)
    block = lambda q, v: F.xxhash64(*key, q, v)
    turn = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = probe.join(parts, key).withColumn("v", all_of("vs")).select(block(turn("qs"), F.col("v")).alias("block"), F.lit(0).alias("kind"), "id")
    vectors = index.join(parts, key).withColumn("q", all_of("qs")).select(block(F.col("q"), turn("vs")).alias("block"), F.lit(1).alias("kind"), "id")
    return queries.unionByName(vectors)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors found, by Euclidean distance, ties to
    the smaller vec_id; the query's own vec_id is no candidate.

    vectors: vec_id, embedding; queries: query_id, embedding. Vectors that are null, empty, all zero or
    hold null or non-finite components take no part on either side, nor do rows without id. Only vectors of
    as many components as the query are its candidates. Equal rows count once. Other columns are ignored.

    Equal vectors are one entry of the index with their k + 1 smallest ids, which is all a result can
    show of them, and equal queries are searched once. Buckets hold about BUCKET vectors at every size. How
    many buckets of a table a query probes follows from `recall`: it is measured on at most SAMPLE queries
    against all vectors, so vectors with near neighbours need few probes, and vectors without structure many.
    Probes and index are joined by bucket as ids; the vectors follow to the blocks where they are compared, and
    only to those. Crowded buckets are cut into blocks. A query for which fewer than k are found is compared
    with all vectors, in blocks.
    """
    spark = prepare(vectors.sparkSession)
    sound = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> coalesce(NOT isnan(x) AND abs(x) < double('Infinity'), false)) AND exists(embedding, x -> x <> 0)"
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    kept = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector).where("vec_id IS NOT NULL").where(sound))
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), vector).where("query_id IS NOT NULL").where(sound).distinct())
    first = Window.partitionBy("embedding").orderBy("vec_id")
    members = kept.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = members.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # numbers in order of the smallest id, so that ties between classes go by it
    classes = stored(numbered(classes.withColumn("first", F.col("ids")[0]), ["first"], "id"))
    heads = stored(asked.groupBy("embedding").agg(F.min("query_id").alias("query")).withColumn("q", F.monotonically_increasing_id()))
    n = classes.count()
    buckets = max(2, n // BUCKET)
    probes = sampled_probes(heads, classes, k, buckets, tables, recall)
    schema = "dim int, tab int, bucket long, id long"
    index = stored(classes.select("id", "embedding").mapInArrow(hashed(buckets, tables, 1), schema))
    probe = stored(heads.select("q", "embedding").mapInArrow(hashed(buckets, tables, probes), schema))
    meet = placed(probe, index)
    own = heads.select(F.lit(0).alias("kind"), F.col("q").alias("id"), "embedding").unionByName(classes.select(F.lit(1).alias("kind"), "id", "embedding"))
    dealt = meet.join(own, ["kind", "id"]).select("block", "kind", "id", "embedding").repartition("block").sortWithinPartitions("block", "kind")
    # an entry found in several tables has the same score in each
    found = stored(dealt.mapInArrow(reranked(k + 1), "q long, id long, score double").distinct())
    best = Window.partitionBy("q").orderBy("score", "id")

    def expanded(pairs: DataFrame) -> DataFrame:
        """The nearest ids: classes by distance, then by their smallest id."""
        named = pairs.join(classes.select("id", "ids"), "id")
        rows = named.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("n") <= k + 1)
        rows = rows.select("q", "score", F.explode("ids").alias("id"))
        return rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")

    hits = stored(expanded(found))
    few = heads.join(hits.groupBy("q").count().where(F.col("count") > k).select("q"), "q", "left_anti")
    few = stored(few.select("q", "embedding"))
    if not few.isEmpty():
        blocks = classes.groupBy(F.pmod(F.xxhash64("id"), F.lit(1 + n // HELD)).alias("block")).agg(
            F.collect_list("id").alias("ids"), F.collect_list("embedding").alias("block_vectors")
        )
        pairs = few.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n // HELD)))).join(blocks, "block")
        whole = pairs.select("q", "embedding", "ids", "block_vectors").mapInArrow(scanned(k + 1), "q long, id long, score double")
        hits = hits.join(few, "q", "left_anti").unionByName(expanded(whole))
    rows = asked.join(heads, "embedding").select("query_id", "q").join(hits, "q").where("id <> query_id")
    final = Window.partitionBy("query_id").orderBy("score", "id")
    rows = rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
