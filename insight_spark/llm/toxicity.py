"""Toxicity score: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import prepare, texts, without_ids
from insight_spark.session import stored

LENGTHS = (4, 5, 6, 7)
BITS = 20
TASK_ROWS = 1500
PART = 256 << 10
FEW = 16
SPREAD = np.uint64(0xD6E8FEB86659FD93)
FACTORS = {n: np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) & (1 << 64) - 1 | 1) for n in LENGTHS}


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the feature of every run of n characters (code points) of the joined texts, which of them
    lie in one line, and where each text begins. A-Z are lowered, other white space than line breaks is a
    space, every text has a space on both sides, and a line break parts it from the next."""
    said = [t.decode("utf-8", "replace") for t in texts]
    codes = np.frombuffer((" " + " \n ".join(said) + " ").encode("utf-32-le"), "<u4").copy()
    codes[(codes >= 65) & (codes <= 90)] += 32
    codes[(codes == 9) | ((codes >= 11) & (codes <= 13))] = 32
    begins = np.cumsum([0, *(len(t) + 3 for t in said)])
    parts = np.flatnonzero(codes == 10)
    for n in LENGTHS:
        size = max(0, len(codes) - n + 1)
        value = np.zeros(size, np.uint64)
        for k in range(n):
            value *= SPREAD
            value += codes[k : k + size]
        value *= FACTORS[n]
        value >>= np.uint64(64 - BITS)
        inside = np.ones(size, bool)
        for k in range(n):
            crossing = parts - k
            inside[crossing[(crossing >= 0) & (crossing < size)]] = False
        yield value.view(np.int64), inside, begins


def present(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, of the wanted features only if those are given. Texts are taken
    PART bytes at a time (one text at least)."""
    owners, values, first = [], [], 0
    while first < len(texts):
        to, size = first + 1, len(texts[first])
        while to < len(texts) and size + len(texts[to]) <= PART:
            size += len(texts[to])
            to += 1
        keys = []
        for value, inside, begins in runs(texts[first:to]):
            at = np.flatnonzero(inside if wanted is None else wanted[value] & inside)
            owner = np.searchsorted(begins, at, "right") - 1
            keys.append(np.unique(owner << BITS | value[at]))
        found = np.unique(np.concatenate(keys))
        owners.append((found >> BITS) + first)
        values.append(found & ((1 << BITS) - 1))
        first = to
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(values)


def tallied(batches):
    """Labelled texts -> how many toxic and other texts of the task have each feature."""
    tally = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        body = batch.column(1).to_pylist()
        for first in range(0, len(body), FEW):
            owner, value = present(body[first : first + FEW])
            np.add.at(tally, (toxic[first + owner], value), 1)
    f = np.flatnonzero(tally.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(tally[1, f]), pa.array(tally[0, f])], names=["f", "a", "b"])


class Model:
    """Bias and one weight a feature, in a table of fixed size (2**BITS)."""

    def __init__(self, bias: float, weights: np.ndarray):
        self.bias, self.weights, self.wanted = bias, weights, weights != 0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        owner, value = present(texts, self.wanted)
        total = np.bincount(owner, self.weights[value], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def descend(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, l2: float, steps: int = 400):
    """Logistic regression on a sparse matrix by accelerated gradient steps; the mean loss with an l2 term."""
    w, bias = np.zeros(n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * w[columns], len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        g = np.bincount(columns, values * error[rows], n) + l2 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_features: int = 3_000, l2: float = 2e-3) -> Model | None:
    """Fit on labelled documents of docs: at most most_rows labels, those whose doc_id hashes lowest.

    Log-count ratios come from how many toxic and other training texts contain each n-gram (one added
    to both); the most_features n-grams whose shares differ most clearly, by their z-value, are kept,
    and each is a feature of the size of its ratio. A null label or doc_id does not train, nor does a label
    without document; a doc_id that repeats trains once for each of its labels, with the least of its texts.
    None, if the labels do not have both classes.
    """
    spark = prepare(docs.sparkSession)
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    )
    there = chosen.withColumn("toxic", (F.col("toxic") != 0).cast("int")).distinct().join(texts(docs).select("doc_id"), "doc_id", "left_semi")
    chosen = stored(there.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows))
    # at most most_rows short rows are broadcast
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stored(rows.select("toxic", "text"))
    sample = sample.coalesce(-(-max(1, sample.count()) // TASK_ROWS))
    classes = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n1, n0 = classes[0] or 0, classes[1] or 0
    if not n1 or not n0:
        return None
    counts = sample.mapInArrow(tallied, "f int, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    top = counts.where("a + b >= 3").orderBy(z.desc(), "f").limit(most_features).toPandas()
    if not len(top):
        return Model(float(np.log(n1 / n0)), np.zeros(1 << BITS))
    f = top["f"].to_numpy()
    p, q = top["a"].to_numpy() + 1.0, top["b"].to_numpy() + 1.0
    ratio = np.log((p / (n1 + 2)) / (q / (n0 + 2)))
    wanted = np.full(1 << BITS, -1, np.int32)
    wanted[f] = np.arange(len(f))

    def narrowed(batches):
        for batch in batches:
            owner, value = present(batch.column(1).to_pylist(), wanted >= 0)
            at = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            kept = pa.ListArray.from_arrays(at, pa.array(wanted[value], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], names=["toxic", "columns"])

    y, parts = [], []
    for row in sample.mapInArrow(narrowed, "toxic int, columns array<int>").toLocalIterator():
        y.append(float(row.toxic))
        parts.append(np.array(row["columns"], np.int32))
    columns = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    w, bias = descend(owner, columns, ratio[columns], np.array(y), len(f), l2)
    weights = np.zeros(1 << BITS)
    weights[f] = w * ratio
    return Model(bias, weights)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every row's whole text; null text counts as empty, and without a model
    every score is 0."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            body = batch.column(1).to_pylist()
            score = held.value.scores(body) if held.value else np.zeros(len(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of its doc_id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) of every row of docs.

    Held-out rows' labels are never read. Repeated rows are scored alike; a null doc_id is not held out;
    other columns are not looked at. An empty table gives none.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns. Rows of one doc_id go if
    any of their texts does; rows without doc_id are kept."""
    return without_ids(docs, toxicity(docs, labels).where("predicted = 1").select("doc_id"))
