"""Best-fit packing with bounds: dual-feasible functions certify each partition's number of bins,
and partitions with a gap exchange documents and are packed again."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from insight_spark.llm.common import fresh, prepare, stored, texts
from insight_spark.llm.tokens import word_ids
from insight_spark.operators.ordered import consecutive

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token runs of every document, cut only where a document is longer than capacity.

    One row per piece: doc_id, piece (from 0), start (ids before it), length, ids_crc32. A null or
    empty text has the end id alone; repeated rows are documents of their own.
    """
    step, end = 4 * capacity, np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encoder = word_ids(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that these lengths can need, by two families of dual-feasible functions.

    One rounds lengths above capacity - e up to a whole bin and drops those below e; the other
    rounds down to multiples of 1/k. Every member gives a valid bound; the largest is returned.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    many, mass = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(0, capacity // 2 + 1)
    # lengths > capacity - e count as capacity, lengths in [e, capacity - e] as they are
    big = many[-1] - many[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    best = int((-(-(big * capacity + middle) // capacity)).max())
    for k in range(1, 65):
        scaled = size * (k + 1)
        whole = scaled % capacity == 0
        units = np.where(whole, size * k, (scaled // capacity) * capacity)  # in 1 / (k * capacity)
        best = max(best, int(-(-int((units * count).sum()) // (k * capacity))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each length, and what each bin holds.

    Bins are kept by the room they have left; a big integer has one bit per amount of room, so the
    tightest fitting bin is a shift and a lowest set bit.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    has, filled = 0, []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        above = has >> need
        if above:
            left = need + (above & -above).bit_length() - 1
            stack = room[left]
            which = stack.pop()
            if not stack:
                has ^= 1 << left
        else:
            left, which = capacity, len(filled)
            filled.append(0)
        bins[item], offsets[item] = which, capacity - left
        filled[which] = capacity - left + need
        left -= need
        if left:
            stack = room.setdefault(left, [])
            if not stack:
                has |= 1 << left
            stack.append(which)
    return bins, offsets, np.array(filled, dtype=np.int64)


def pack(items: DataFrame, capacity: int = 4096, per_partition: int = 20_000, rounds: int = 4) -> DataFrame:
    """Place items (column length, 1 to capacity) into sequences of at most capacity.

    Returns the input's columns with sequence_id, offset, n_bound (the bound of the last partition
    the item was packed in) and n_used (its bins). Items are numbered and dealt in turn, equal rows too, to
    partitions of at most per_partition items, whose sizes differ by one at most. A partition whose bins equal its bound keeps them all but the emptiest; one with a
    gap gives up every bin that is not full. What is given up is dealt anew and packed again, until
    one partition holds it or the rounds are over. Input columns sequence_id and offset are replaced; others pass through.
    Null lengths are refused by Spark's cast in the task. An empty input gives an empty result.
    """
    items = items.drop("sequence_id", "offset", "n_bound", "n_used")
    names = items.columns
    deal_name, open_name, row_name = fresh(items, "deal", "open", "row")
    added = f"sequence_id long, offset long, n_bound long, n_used long, {open_name} boolean"
    schema = StructType([*items.schema.fields, *StructType.fromDDL(added).fields])

    def packer(first_number: int, last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            deal = int(rows[deal_name].iloc[0])
            if len(rows) > per_partition:
                raise ValueError(f"{len(rows)} items were dealt to a partition of {per_partition}")
            lengths = rows["length"].to_numpy(np.int64)
            bins, offsets, filled = best_fit(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            is_open = np.zeros(len(filled), bool)
            if not last:
                if len(filled) > bound:
                    is_open = filled < capacity
                else:
                    is_open[np.argmin(filled)] = filled.min() < capacity
            # a number of its own for every round, partition and bin; a partition has no more bins than items
            found = {"sequence_id": first_number + deal * per_partition + bins, "offset": offsets, "n_bound": bound, "n_used": len(filled), open_name: is_open[bins]}
            return rows.drop(columns=deal_name).assign(**found)

        return run

    done, left, first_number = None, items, 0
    for turn in range(rounds):
        left = stored(left.withColumn(row_name, F.monotonically_increasing_id()))
        parts = max(1, -(-left.count() // per_partition))
        last = parts == 1 or turn == rounds - 1
        dealt = consecutive(left, row_name).withColumn(deal_name, F.col(row_name) % parts).drop(row_name)
        packed = stored(dealt.groupBy(deal_name).applyInPandas(packer(first_number, last), schema))
        first_number += parts * per_partition
        kept = packed.where(~F.col(open_name)).drop(open_name)
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        left = packed.where(open_name).select(*names)
    return done


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """Every document's pieces with their sequence and place; see pieces and pack.

    A document of null or empty text takes one token, copies and repeated rows are packed each;
    an empty table gives no sequence; other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)
