"""Near-duplicate vectors by sorted projection passes: windows over random orders, links verified exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from insight_spark.llm.common import components, prepare
from insight_spark.operators.ordered import numbered
from insight_spark.session import stored

BITS = 62  # random hashes in a key, one bit each
LEVELS = 512  # steps in which angles to a centre are rounded up
AT_ONCE = 3  # passes searched in one job


def passes_for(n: int, window: int, cosine: float, recall: float) -> int:
    """Passes after which a pair at the threshold has met in some window with the wanted probability.

    Two vectors at angle a get equal bits with probability 1 - a / pi. Vectors whose first log2(n / window)
    bits are equal are few enough for one window, if bits part the vectors evenly.
    """
    depth = max(0, math.ceil(math.log2(max(1, n) / window)))
    met = (1 - math.acos(cosine) / math.pi) ** depth
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def matrices(lists) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors by number of components."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        out[dim] = rows, flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; divided by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of unit vectors in pairs, one sum for each, in double precision."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def hashed(passes: int):
    """Vectors -> for every pass, random hashes in a row: the sides of BITS random planes as one number."""

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim, (rows, x) in matrices(batch.column(1)).items():
                x = unit(x)
                for k in range(passes):
                    if (k, dim) not in planes:
                        planes[k, dim] = np.random.default_rng((k, dim)).standard_normal((dim, BITS))
                    key = (x @ planes[k, dim] > 0) @ weights
                    n = len(rows)
                    columns = [pa.array(np.full(n, v), pa.int32()) for v in (k, dim)] + [pa.array(key), pa.array(ids[rows])]
                    yield pa.RecordBatch.from_arrays(columns, names=["pass", "dim", "key", "id"])

    return run


def linked(at: np.ndarray, x: np.ndarray, window: int, cosine: float):
    """Pairs of rows (sorted by place) at most `window` places apart whose cosine is reached, in pieces."""
    for low in range(0, len(at), window):
        high = min(len(at), low + window)
        until = int(np.searchsorted(at, at[high - 1] + window, "right"))
        rough = x[low:high] @ x[low:until].T
        near = (rough >= cosine - 1e-9) & (at[None, low:until] > at[low:high, None]) & (at[None, low:until] - at[low:high, None] <= window)
        i, j = np.nonzero(near)
        i, j = i + low, j + low
        sure = cosines(x[i], x[j]) >= cosine
        yield i[sure], j[sure]


def grouped(batches):
    """Rows sorted by their first column -> arrays of each group; groups are bounded by the blocks they come from."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part in np.split(np.arange(len(keys)), cuts):
            if len(part) and key is not None and keys[part[0]] != key:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if len(part):
                key = keys[part[0]]
                held.append(batch.slice(part[0], len(part)))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def forests(window: int, cosine: float):
    """Blocks of one order -> for every vector linked in the block, an edge to the first of those it hangs together with."""

    def run(batches):
        for block in grouped(batches):
            at, ids = (block.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for rows, x in matrices(block.column(3)).values():
                inverse = np.argsort(at[rows], kind="stable")
                order, x = rows[inverse], unit(x[inverse])
                root = np.arange(len(order))
                for i, j in linked(at[order], x, window, cosine):
                    while len(i):
                        a, b = root[i], root[j]
                        open_ = a != b
                        if not open_.any():
                            break
                        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                        while (root[root] != root).any():
                            root = root[root]
                child = np.flatnonzero(root != np.arange(len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[order[child]]), pa.array(ids[order[root[child]]])], names=["a", "b"])

    return run


def unsure_links(window: int, cosine: float):
    """Blocks of members of one order -> links that their levels do not prove."""

    def run(batches):
        for block in grouped(batches):
            at, ids, group, level = (block.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4, 5))
            for rows, x in matrices(block.column(3)).values():
                inverse = np.argsort(at[rows], kind="stable")
                order, x = rows[inverse], unit(x[inverse])
                for i, j in linked(at[order], x, window, cosine):
                    i, j = order[i], order[j]
                    open_ = (group[i] != group[j]) | (level[i] + level[j] > LEVELS)
                    i, j = i[open_], j[open_]
                    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def sums(batches):
    """Members -> the sum of unit vectors of each component, one row per batch and component."""
    for batch in batches:
        group = batch.column(0).to_numpy(zero_copy_only=False)
        for dim, (rows, x) in matrices(batch.column(1)).items():
            own, where = np.unique(group[rows], return_inverse=True)
            total = np.zeros((len(own), dim))
            np.add.at(total, where, unit(x))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(total), pa.list_(pa.float64()))], names=["c", "total"])


def levels(cosine: float):
    """Members with their centre -> the angle to it in steps of which LEVELS are the angle of the threshold, rounded up."""
    step = math.acos(cosine) / LEVELS

    def run(batches):
        for batch in batches:
            ids, group = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            centres = matrices(batch.column(3))
            for dim, (rows, x) in matrices(batch.column(2)).items():
                centre = centres[dim][1]
                flat = np.abs(centre).max(axis=1) == 0
                centre[flat] = 1
                apart = np.arccos(np.clip(cosines(unit(x), unit(centre)), -1, 1))
                # angles of nearly equal directions are known to about 1e-8
                level = np.minimum(np.ceil((apart + 1e-7) / step), 4 * LEVELS).astype(np.int64)
                level[flat] = 4 * LEVELS
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(group[rows]), pa.array(level)], names=["id", "c", "level"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, window: int = 256, recall: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding (array of numbers); other columns are ignored. Vectors are compared by cosine
    in double precision. Those that are null, empty, zero or hold null or non-finite components, and rows
    without vec_id, link with nothing (a null vec_id is a row with a null component_id); vectors of
    different numbers of components do not link. A repeated vec_id is a vector of its own in n_links.
    n_links: other vectors linked directly; component_id: smallest vec_id reached by links, itself included;
    kept: whether that is the vector itself. An empty table gives no row.

    Equal vectors are one class. In each pass classes are ordered by BITS random hashes (sides of random
    planes) and compared with the next `window` in that order; orders are cut into blocks that take a
    window of the next one along, so no pair is lost at borders, whatever the partitions. The number of
    passes follows from `recall`, the share of pairs at the threshold to be found (closer ones are found
    more often). Passes send one edge per linked vector, not their pairs, and components unite them.

    Large groups of near copies: two vectors whose angles to their component's mean direction add up to at
    most the threshold's angle are linked, which counts them without comparing them (angles are rounded up).
    Links that this does not prove are those that a second round of the passes finds among members. So
    n_links is exact where a component is that tight, whatever its size, and no pair is emitted for it.
    """
    if not 0 < cosine < 1 or window < 1 or not 0 < recall < 1:
        raise ValueError("cosine and recall lie between 0 and 1, a window holds a vector or more")
    spark = prepare(vectors.sparkSession)
    sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> coalesce(NOT isnan(x) AND abs(x) < double('Infinity'), false)) AND exists(embedding, x -> x <> 0)"
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    kept = stored(rows.where(sound))
    classes = kept.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()))
    total = classes.count()
    passes = passes_for(total, window, cosine, recall)
    keys = classes.select("id", "embedding").mapInArrow(hashed(passes), "pass int, dim int, key long, id long")
    places = stored(numbered(stored(keys), ["pass", "dim", "key", "id"], "at").select("pass", "at", "id"))
    wide = 4 * window

    def blocks(members: DataFrame, first: int, more: list[str]) -> DataFrame:
        own = F.expr(f"at div {wide}")
        halo = F.when((F.col("at") % wide < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
        chosen = places.where(F.col("pass").between(first, first + AT_ONCE - 1)).join(members, "id")
        dealt = chosen.select(F.explode(halo).alias("block"), "at", "id", "embedding", *more, "pass")
        # a block over the border of two passes is one of each
        block = F.col("block") * passes + F.col("pass")
        return dealt.select(block.alias("block"), "at", "id", "embedding", *more).repartition("block").sortWithinPartitions("block", "at")

    edges = None
    for first in range(0, passes, AT_ONCE):
        found = blocks(classes.select("id", "embedding"), first, []).mapInArrow(forests(window, cosine), "a long, b long")
        found = stored(found)
        edges = found if edges is None else edges.unionByName(found)
    groups = components(edges).withColumnsRenamed({"v": "id"})
    members = stored(classes.join(groups, "id"))
    centre = members.select("c", "embedding").mapInArrow(sums, "c long, total array<double>")
    centre = centre.select("c", F.posexplode("total").alias("k", "x")).groupBy("c", "k").agg(F.sum("x").alias("x"))
    centre = centre.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("parts")).select("c", F.col("parts.x").alias("centre"))
    levelled = members.select("id", "c", "embedding").join(centre, "c").select("id", "c", "embedding", "centre")
    levelled = stored(levelled.mapInArrow(levels(cosine), "id long, c long, level long"))
    members = stored(members.join(levelled.select("id", "level"), "id"))
    # members by level: at most 4 * LEVELS rows a component
    counts = members.groupBy("c", "level").agg(F.sum("n").alias("mass"))
    other = counts.select("c", F.col("level").alias("other"), F.col("mass").alias("other_mass")).where(F.col("other") < LEVELS)
    proved = counts.where(F.col("level") < LEVELS).join(other, "c").where(F.col("level") + F.col("other") <= LEVELS)
    proved = proved.groupBy("c", "level").agg(F.sum("other_mass").alias("proved"))
    pairs = None
    for first in range(0, passes, AT_ONCE):
        found = blocks(members.select("id", "embedding", "c", "level"), first, ["c", "level"])
        found = stored(found.mapInArrow(unsure_links(window, cosine), "a long, b long").distinct())
        pairs = found if pairs is None else pairs.unionByName(found)
    pairs = pairs.distinct()
    mass = members.select("id", "n")
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(mass.withColumnsRenamed({"id": "b", "n": "far"}), "b").groupBy(F.col("a").alias("id")).agg(F.sum("far").alias("far"))
    links = members.join(proved, ["c", "level"], "left").join(ends, "id", "left")
    # a level of half the angle or less proves the own class as well; others of the class are linked anyway
    own = F.when(F.col("level") * 2 <= LEVELS, F.col("proved") - F.col("n")).otherwise(F.coalesce("proved", F.lit(0)))
    named = members.groupBy("c").agg(F.min("least").alias("component_id"))
    links = stored(links.select("id", "c", (own + F.coalesce("far", F.lit(0))).alias("links")).join(named, "c"))
    found = classes.join(links, "id", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    out = kept.join(found, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(f"NOT coalesce({sound}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
