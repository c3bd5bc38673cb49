"""Removal of long passages that an earlier document has, by super-k-mer partitioning.

A window is k consecutive words. Its minimiser is the smallest hash of the m-word runs inside it, so
equal windows have equal minimisers, and neighbouring windows mostly share one: such a stretch (a
super-k-mer) travels as one packed string to its minimiser's bucket, where sorting finds, for every
window, the smallest document that has it.

Only stretches whose minimiser several documents have are packed at all, equal strings are reduced
to one before they meet in a bucket, exact copies of a whole document are settled by its hash, and a
bucket of very many different strings is dealt out by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from insight_spark.llm.common import prepare, texts
from insight_spark.llm.words import BASE, Words, mix
from insight_spark.session import stored

LONGEST = 128
HOT_STRINGS = 20_000
CHUNK = 4 << 20
SEEDS = (BASE, np.uint64(int(BASE) ** 2 & (1 << 64) - 1))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(a) - width + 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[:n], a[width - size : width - size + n])


def stretches(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, minimiser, first word (in its document) and number of windows of every stretch."""
    counts = np.maximum(np.diff(words.first) - k + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.empty(0, np.int64),) * 4
    low = sliding_min(words.runs(m), k - m + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    value = low[np.repeat(words.first[:-1], counts) + inside]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(new)
    since = np.arange(total) - np.repeat(begin, np.diff(np.append(begin, total)))
    begin = np.flatnonzero(since % LONGEST == 0)
    return doc[begin], value[begin].view(np.int64), inside[begin], np.diff(np.append(begin, total))


def sequence_hash(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence."""
    place = (np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(np.uint64)
    out = []
    for seed in SEEDS:
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash + mix(place * seed + seed)))])
        out.append((total[words.first[1:]] - total[words.first[:-1]]).view(np.int64))
    return out[0], out[1]


def scanned(k: int, m: int):
    """One row a document: word count, hashes, digest of all its words, and its stretches."""

    def run(batches):
        for batch in batches:
            body = batch.column(1).to_pylist()
            words = Words(body)
            doc, value, begin, windows = stretches(words, k, m)
            at = pa.array(np.searchsorted(doc, np.arange(len(body) + 1)).astype(np.int32))
            a, b = sequence_hash(words)
            sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in body]
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((value, pa.int64()), (begin, pa.int32()), (windows, pa.int32()))]
            columns = [batch.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(a), pa.array(b), pa.array(sha), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "seq_a", "seq_b", "sha", "minimiser", "begin", "windows"])

    return run


def packed(k: int):
    """Documents with their candidate stretches -> the stretches as strings, words joined by one space."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, want, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sequence_hash(Words([text]))[0][0] != want:
                    continue  # another row of the same doc_id
                words = text.split()
                for s in spans:
                    part = b" ".join(words[s["begin"] : s["begin"] + s["windows"] + k - 1])
                    key = xxhash.xxh3_128_intdigest(part)
                    rows.append((s["minimiser"], doc_id, want, s["begin"], s["windows"], key >> 65, key & ((1 << 63) - 1), part))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["minimiser", "doc_id", "seq_a", "begin", "windows", "key_a", "key_b", "string"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def windows_of(batch_rows, k: int):
    """For strings (bucket, low, string): row, place, bucket, hash and low of each window."""
    bucket, low, strings = batch_rows
    words = Words(strings)
    counts = np.diff(words.first) - k + 1
    row = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = words.runs(k)[np.repeat(words.first[:-1], counts) + place]
    return row, place, np.asarray(bucket)[row], hashes.view(np.int64), np.asarray(low)[row]


def counted(k: int):
    """Rows (minimiser, low, key_a, key_b, string) sorted by minimiser -> the places in each string
    whose window an earlier document than the string's first has."""

    def flush(rows):
        bucket, low, a, b, strings = zip(*rows, strict=True)
        row, place, where, hashes, own = windows_of((bucket, low, strings), k)
        order = np.lexsort((own, hashes, where))
        h, w = hashes[order], where[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        first = own[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        hit = np.sort(order[first < own[order]])
        at = pa.array(np.searchsorted(row[hit], np.arange(len(rows) + 1)).astype(np.int32))
        places = pa.ListArray.from_arrays(at, pa.array(place[hit], pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(low, pa.int64()), places], names=["key_a", "key_b", "low", "places"]
        )

    def run(batches):
        rows, held, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != last and held > CHUNK:  # only whole buckets
                    yield flush(rows)
                    rows, held = [], 0
                last = r[0]
                rows.append(r)
                held += len(r[4])
        if rows:
            yield flush(rows)

    return run


def opened(k: int):
    """The windows of strings from very large buckets, one row each."""

    def run(batches):
        for batch in batches:
            bucket, low, a, b, strings = (c.to_pylist() for c in batch.columns)
            if not strings:
                continue
            row, place, where, hashes, own = windows_of((bucket, low, strings), k)
            columns = [where, hashes, np.asarray(a)[row], np.asarray(b)[row], own]
            arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["minimiser", "window", "key_a", "key_b", "low", "place"])

    return run


def removed(k: int):
    """Documents with what an earlier one has -> words removed, and the digest of those kept."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, want, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = sequence_hash(Words([text]))[0][0]
                if a != want:
                    continue
                words = text.split()
                edges = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    starts = np.arange(s["windows"]) if s["whole"] else np.array(s["places"], np.int64)
                    np.add.at(edges, starts + s["begin"], 1)
                    np.add.at(edges, starts + s["begin"] + k, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)
                rows.append((doc_id, int(want), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "seq_a", "gone", "rest", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, k: int = 50, m: int = 10, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (with keep_text: and kept_text of
    the documents that lose some but not all words).

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a window of k words covers it that a document of
    smaller doc_id has too, on the texts as given. Null, empty and short texts have no window. Rows
    of the same doc_id do not remove from each other; a row without doc_id neither removes nor loses
    words. Other columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    schema = (
        "doc_id long, n_words long, seq_a long, seq_b long, sha string, minimiser array<long>, begin array<int>, windows array<int>"
    )
    base = stored(texts(docs).mapInArrow(scanned(k, m), schema))
    copies = (
        base.where(F.col("n_words") >= k)
        .groupBy("n_words", "seq_a", "seq_b")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
        .where("copies > 1 AND first IS NOT NULL")
    )
    again = base.select("doc_id", "n_words", "seq_a", "seq_b").join(copies, ["n_words", "seq_a", "seq_b"]).where("doc_id > first")
    again = stored(again.select("doc_id", "seq_a", F.lit(True).alias("copy")).distinct())
    firsts = base.where("doc_id IS NOT NULL AND size(minimiser) > 0").join(again, ["doc_id", "seq_a"], "left_anti")
    spans = firsts.select("doc_id", "seq_a", F.explode(F.arrays_zip("minimiser", "begin", "windows")).alias("s")).select(
        "doc_id", "seq_a", "s.*"
    )
    shared = (
        spans.groupBy("minimiser").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("minimiser")
    )
    chosen = (
        spans.join(shared, "minimiser")
        .groupBy("doc_id", "seq_a")
        .agg(F.collect_list(F.struct("minimiser", "begin", "windows")).alias("spans"))
    )
    held = stored(chosen.join(texts(docs), "doc_id").select("doc_id", "seq_a", "text", "spans"))
    strings = stored(
        held.mapInArrow(
            packed(k),
            "minimiser long, doc_id long, seq_a long, begin int, windows int, key_a long, key_b long, string binary",
        )
    )
    distinct = stored(
        strings.groupBy("minimiser", "key_a", "key_b", "string").agg(F.min("doc_id").alias("low"))
    ).select("minimiser", "low", "key_a", "key_b", "string")
    large = distinct.groupBy("minimiser").count().where(F.col("count") > HOT_STRINGS).select("minimiser")
    even = distinct.join(large, "minimiser", "left_anti").repartition(F.col("minimiser")).sortWithinPartitions("minimiser")
    found = even.mapInArrow(counted(k), "key_a long, key_b long, low long, places array<int>")
    each = distinct.join(large, "minimiser", "left_semi").mapInArrow(
        opened(k), "minimiser long, window long, key_a long, key_b long, low long, place int"
    )
    each = stored(each)
    least = each.groupBy("minimiser", "window").agg(F.min("low").alias("least"))
    late = F.when(F.col("least") < F.col("low"), F.col("place"))
    opened_up = (
        each.join(least, ["minimiser", "window"]).groupBy("key_a", "key_b", "low").agg(F.collect_list(late).alias("places"))
    )
    found = stored(found.unionByName(opened_up))
    whole = F.col("doc_id") > F.col("low")
    marks = (
        strings.drop("string", "minimiser")
        .join(found, ["key_a", "key_b"])
        .where(whole | (F.size("places") > 0))
        .groupBy("doc_id", "seq_a")
        .agg(F.collect_list(F.struct("begin", "windows", whole.alias("whole"), F.when(~whole, F.col("places")).alias("places"))).alias("spans"))
    )
    cut = marks.join(held.drop("spans"), ["doc_id", "seq_a"]).select("doc_id", "seq_a", "text", "spans")
    cut = cut.mapInArrow(removed(k), "doc_id long, seq_a long, gone long, rest string, kept binary")
    cut = cut.select("doc_id", "seq_a", "gone", "rest", *(["kept"] if keep_text else [])).dropDuplicates(["doc_id", "seq_a"])
    nothing = hashlib.sha256(b"").hexdigest()
    joined = base.select("doc_id", "n_words", "seq_a", "sha").join(again, ["doc_id", "seq_a"], "left").join(cut, ["doc_id", "seq_a"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
        *([F.col("kept").cast("string").alias("kept_text")] if keep_text else []),
    )
