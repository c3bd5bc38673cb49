import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from insight_spark.llm import packing
from insight_spark.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity, sizes):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert sum(r.length for r in rows) == sum(sizes)
    return len(by)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    own = Tokenizer.from_file(PATH)
    want, total = {}, 0
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[r.doc_id, k // 4096] = (k, len(part), zlib.crc32(part.tobytes()))
    rows = packing.packed_documents(docs, PATH).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert check(rows, 4096, [v[1] for v in want.values()]) == -(-total // 4096)


def test_bounds_hold_and_packing_is_whole():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(8, 200))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 120)))
        bins, offsets, filled = packing.best_fit(lengths, capacity)
        bound = packing.lower_bound(lengths, capacity)
        assert -(-lengths.sum() // capacity) <= bound <= len(filled) <= 1.3 * bound + 1
        assert np.array_equal(np.bincount(bins, lengths), filled) and filled.max() <= capacity
    assert packing.lower_bound(np.array([51] * 9), 100) == 9
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    assert packing.lower_bound(np.empty(0, int), 100) == 0


def test_partitions_exchange(spark):
    rng = np.random.default_rng(2)
    lengths = [int(x) for x in np.minimum(100, rng.geometric(0.03, 3000))] + [100] * 50
    items = spark.createDataFrame([(n, "x", 1) for n in lengths], "length long, offset string, deal int")
    out = packing.pack(items, 100, per_partition=200)
    assert out.columns == ["length", "deal", "sequence_id", "offset", "n_bound", "n_used"]
    rows = out.collect()
    assert len(rows) == len(lengths)
    assert check(rows, 100, lengths) <= packing.lower_bound(np.array(lengths), 100) + 2


def test_edge_cases(spark):
    schema = "doc_id long, text string, length int, piece int, sequence_id long"
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 9000)]
    out = packing.packed_documents(spark.createDataFrame([(*r, 5, 5, 5) for r in rows], schema), PATH).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length) for r in out), key=str)
    assert got == sorted([(1, 0, 0, 1), (2, 0, 0, 1), (2, 0, 0, 1), (None, 0, 0, 3), (3, 0, 0, 4096), (3, 1, 4096, 4096), (3, 2, 8192, 809)], key=str)
    assert check(out, 4096, [x[3] for x in got]) == 3
    assert packing.packed_documents(spark.createDataFrame([], schema), PATH).count() == 0


def test_rows_spread_over_many_partitions(spark):
    """One row or two in each partition: deals are even, and no sequence holds more than fits."""
    for n, partitions, each in ((160, 80, 20), (422, 211, 50)):
        items = spark.range(0, n, 1, partitions).selectExpr("60L AS length", "id AS deal", "1 AS open", "2 AS row", "3 AS deal_")
        out = packing.pack(items, 100, per_partition=each)
        assert out.columns == ["length", "deal", "open", "row", "deal_", "sequence_id", "offset", "n_bound", "n_used"]
        rows = out.collect()
        assert sorted(r.deal for r in rows) == list(range(n)) and {(r.open, r.row, r.deal_) for r in rows} == {(1, 2, 3)}
        assert check(rows, 100, [60] * n) == n
        deals = {}
        for r in packing.pack(items, 100, per_partition=each, rounds=1).collect():
            deals[r.sequence_id // each] = deals.get(r.sequence_id // each, 0) + 1
        assert len(deals) == -(-n // each) and max(deals.values()) - min(deals.values()) <= 1
