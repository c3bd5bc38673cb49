"""Benchmark decontamination: CGK walks over windows of items and documents, repeated bit sampling, exact edit verification."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from insight_spark.llm.common import prepare, texts, without_ids
from insight_spark.llm.pigeonhole import GRAM, best_fit_of, bytes_of, grams, normalised, text_of
from insight_spark.llm.words import mix
from insight_spark.session import stored

WALKS = 2  # walks per band; tables sample them in turn
MOST_TABLES = 48
EXACT = 100  # bands of items that allow no edit: EXACT + the bytes compared
EXACT_BYTES = 16
STRETCH = 1 << 16
FILTER_BITS = 1 << 28  # the filter that is broadcast has at most so many bits (32 MB)
PAD = 256
PRIME = np.uint64(0x9E3779B97F4A7C15)
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


@dataclass(frozen=True)
class Band:
    """Walks for items of at least `low` bytes: steps of a walk, how many of them a table samples, one start
    in how many places, how many windows of an item are used, and how many bytes apart in the item two windows
    must be met for a comparison (0: one is enough)."""

    number: int
    low: int
    steps: int
    sampled: int
    every: int
    need: int
    apart: int


#: A walk covers about half as many bytes as it has steps: all of a short item, a stretch of a longer one,
#: which has several windows. Walks over the whole of a long item at one edit in ten characters hardly ever
#: agree at all sampled steps.
BANDS = (Band(1, 1, 10, 5, 1, 12, 0), Band(2, 24, 16, 7, 1, 16, 6), Band(3, 64, 32, 12, 4, 24, 16))


@lru_cache(maxsize=16)
def moves(band: Band) -> np.ndarray:
    """For every walk, step and byte whether the walk goes on to the next byte."""
    rng = np.random.default_rng((band.number, 1))
    return rng.integers(0, 2, (WALKS, band.steps, 256))


@lru_cache(maxsize=16)
def samples(band: Band) -> list[np.ndarray]:
    """The steps that each table samples."""
    rng = np.random.default_rng((band.number, 2))
    return [np.sort(rng.choice(band.steps, band.sampled, replace=False)) for _ in range(MOST_TABLES)]


@lru_cache(maxsize=16)
def anchors(band: Band) -> np.ndarray:
    """Which pairs of bytes a window may start with: one in `every`."""
    return mix(np.arange(1, 65537, dtype=np.uint64) * PRIME + np.uint64(band.number)) % np.uint64(band.every) == 0


def starts_of(text: np.ndarray, size: int, band: Band) -> np.ndarray:
    """Places of the first `size` bytes where windows start, told by the two bytes there alone."""
    if band.every == 1:
        return np.arange(size)
    pair = text[:size].astype(np.uint16) << np.uint16(8) | text[1 : size + 1]
    return np.flatnonzero(anchors(band)[pair])


def keys_of(text: np.ndarray, starts: np.ndarray, band: Band, tables: int):
    """For each table its number, the key of each start, and the first byte after those its walk has read.
    Two windows have the same key where their walks read the same bytes at the sampled steps."""
    for walk in range(min(WALKS, tables)):
        at, read = starts.copy(), np.empty((band.steps, len(starts)), np.uint8)
        for step, go_on in enumerate(moves(band)[walk]):
            symbol = text[at]
            read[step] = symbol
            at += go_on[symbol]
        for table in range(walk, tables, WALKS):
            key = np.full(len(starts), band.number * 1000 + table, np.uint64)
            for step in samples(band)[table]:
                key *= PRIME
                key += read[step]
            yield table, mix(key).view(np.int64), at + 1


def exact_keys(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Keys of the next `size` bytes from each start."""
    key = np.full(len(starts), (EXACT + size) * 1000, np.uint64)
    for k in range(size):
        key = (key ^ text[starts + k]) * PRIME
        key ^= key >> np.uint64(29)
    return mix(key).view(np.int64)


def padded(text: bytes) -> np.ndarray:
    return np.concatenate([np.frombuffer(text, np.uint8), np.zeros(PAD, np.uint8)])


def item_windows(text: bytes, most: int, tables: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """band, table, key, offset of the windows of a normalised item that allows so many edits. Walks that
    leave the item are no windows. An item with very few starts in its band goes to a denser one."""
    body = padded(text)
    if most == 0:
        size = min(len(text), EXACT_BYTES)
        return [(EXACT + size, 0, int(exact_keys(body, np.zeros(1, np.int64), size)[0]), 0)]
    for band in reversed(BANDS):
        if len(text) < band.low:
            continue
        starts, rows = starts_of(body, len(text), band), []
        if 3 * len(starts) < band.need and band.number > 1:
            continue
        for table, key, end in keys_of(body, starts, band, tables[band.number]):
            inside = end <= len(text)
            rows += [(band.number, table, k, o) for k, o in zip(key[inside].tolist(), starts[inside].tolist(), strict=True)]
        if rows or band.number == 1:
            return rows
    return []


def spread_edits(text: np.ndarray, edits: int, rng) -> np.ndarray:
    """A copy with edits at even distances, of every kind."""
    letters, out, last = np.arange(97, 123, dtype=np.uint8), [], 0
    for at in sorted({int((k + rng.random()) * len(text) / max(1, edits)) for k in range(edits)}):
        out.append(text[last:at])
        kind = rng.integers(3)
        if kind < 2:
            out.append(rng.choice(letters, 1))
        last = at + (kind != 1)
    return np.concatenate([*out, text[last:]])


def simulated(band: Band, size: int, percent: int, trials: int):
    """Items of random letters and a copy of each at the full bound of edits, between other letters."""
    rng = np.random.default_rng((band.number, percent, size))
    letters = np.frombuffer(b"eeettaaooiinnsshrrdlucmfwypvbgk    ", np.uint8)
    for _ in range(trials):
        text = rng.choice(letters, size)
        copy = spread_edits(text, size * percent // 100, rng)
        whole = np.concatenate([rng.choice(letters, 8), copy, rng.choice(letters, PAD)])
        own = padded(text.tobytes())
        yield own, starts_of(own, size, band), whole, starts_of(whole, len(copy) + 8, band), rng


@lru_cache(maxsize=64)
def tables_for(band: Band, percent: int, recall: float, trials: int = 120) -> int:
    """The least number of tables with which simulated copies at the full bound of edits are found with at
    least the wanted probability, at the lengths of the band that allow the largest share of edits."""
    if not percent:
        return 1
    first = max(band.low, -(-100 // percent))
    sizes = [n for n in range(first, first + 4 * 100 // percent) if n * percent % 100 < percent][:2] or [first]
    wanted, most = min(1.0, recall + 0.01) * trials, 1
    for size in sizes:
        for tried in (3, 12, MOST_TABLES):
            hit = np.full(tried + 1, 0)
            for own, starts, whole, there, rng in simulated(band, size, percent, trials):
                theirs = {table: key for table, key, _ in keys_of(whole, there, band, tried)}
                places = [np.empty(0, np.int64)] * tried
                for table, key, end in keys_of(own, starts, band, tried):
                    kept = rng.permutation(np.flatnonzero(end <= size))[: band.need]
                    places[table] = starts[kept[np.isin(key[kept], theirs[table])]]
                low, high, first = size, -1, tried
                for table, at in enumerate(places):
                    if len(at):
                        low, high = min(low, at.min()), max(high, at.max())
                    if high - low >= band.apart:
                        first = table
                        break
                hit[first] += 1
            enough = np.flatnonzero(np.cumsum(hit)[:tried] >= wanted)
            if len(enough):
                break
        most = max(most, int(enough[0]) + 1 if len(enough) else MOST_TABLES)
    return most


def records(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=names)


ITEM = "item_id long, item binary, body binary, chars long, most long"


def prepared_items(percent: int, min_chars: int):
    """Item rows -> the digest of the normalised text, that text, its characters and the edits it allows."""

    def run(batches):
        for batch in batches:
            rows, parts = [], batch.column(1).to_pylist()
            text, begin, _ = normalised(parts)
            for k, item_id in enumerate(batch.column(0).to_pylist()):
                said = text_of(text[begin[k] : begin[k + 1]].tobytes()).strip()
                if len(said) >= max(1, min_chars):
                    body = bytes_of(said)
                    rows.append((item_id, hashlib.md5(body).digest(), body, len(said), len(said) * percent // 100))
            yield records(rows, ITEM)

    return run


WINDOWS = "item binary, band int, tab int, key long, place long"


def windowed(tables: dict[int, int]):
    """Items -> their windows; the first place of every key."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, body, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = {}
                for band, table, key, place in item_windows(body, most, tables):
                    first.setdefault((band, table, key), place)
                rows += [(item, *k, place) for k, place in first.items()]
            yield records(rows, WINDOWS)

    return run


class Filter:
    """A set of keys of bounded size that may hold too much: two bits for each key."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, np.zeros(bits >> 3, np.uint8)

    @staticmethod
    def places(bits: int):
        """The two bits of the column key, as an expression."""
        return F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.bits - 1)
        out = np.ones(len(key), bool)
        for place in (key.view(np.uint64) & mask, key.view(np.uint64) >> np.uint64(32) & mask):
            out &= (self.held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def filter_of(windows: DataFrame) -> Filter:
    """The filter of all keys; the driver receives its bits as blocks that Spark has put together."""
    bits = 1 << 20
    while bits < min(FILTER_BITS, 64 * windows.count()):
        bits *= 2
    found = Filter(bits)
    blocks = windows.select(F.explode(Filter.places(bits)).alias("bit")).select((F.col("bit") + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    for row in blocks.toLocalIterator():
        block = np.frombuffer(row.bits, np.uint8)
        low = (row.n - 1) * len(block)
        found.held[low : low + len(block)] = block[: len(found.held) - low]
    return found


HITS = "row binary, key long, place long"


def met(held, bands: list[int], tables: dict[int, int]):
    """Documents -> places where a window's key may be one of an item's."""

    def run(batches):
        may_hold = held.value.may_hold
        for batch in batches:
            rows = batch.column(0)
            text, begin, _ = normalised(batch.column(1).to_pylist())
            size = int(begin[-1])
            text = np.concatenate([text, np.zeros(PAD, np.uint8)])

            def hits(key, starts, once):
                where = np.flatnonzero(may_hold(key))
                key, at = key[where], starts[where]
                doc = np.searchsorted(begin, at, "right") - 1
                if once and len(key):  # a whole item without edits: its first copy is the best
                    order = np.lexsort((at, key, doc))
                    new = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(key[order]) != 0)])
                    doc, key, at = (x[order[new]] for x in (doc, key, at))
                return pa.RecordBatch.from_arrays([rows.take(pa.array(doc)), pa.array(key), pa.array(at - begin[doc])], names=["row", "key", "place"])

            for number in bands:
                if number >= EXACT:
                    length = number - EXACT
                    for low in range(0, size, 1 << 20):
                        starts = np.arange(low, min(size, low + (1 << 20)))
                        yield hits(exact_keys(text, starts, length), starts, length < EXACT_BYTES)
                    continue
                band = BANDS[number - 1]
                starts = starts_of(text, size, band)
                for low in range(0, len(starts), STRETCH):
                    part = starts[low : low + STRETCH]
                    for _, key, _ in keys_of(text, part, band, tables[number]):
                        yield hits(key, part, False)

    return run


FOUND = "row binary, item binary, edits int, item_chars int, start long, end long"


def verified(batches):
    """Texts, each followed by the regions to search -> the best copy of every item in its text."""
    row, known, doc, found = None, {}, None, {}

    def results():
        return [(row, item, *best[:1], best[3], *spans_of(doc, best)) for item, best in found.items()]

    for batch in batches:
        out = []
        for key, kind, item, body, most, low, high, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != row:
                out += results() if found else []
                row, doc, found = key, None, {}
            if kind == 0:
                plain, begin, origin = normalised([text])
                doc = (text, plain, int(begin[1]) - 1, origin, grams(plain))
                continue
            if doc is None:
                continue
            _, plain, end, _, runs = doc
            best = found.get(item)
            if best is not None and best[0] == 0 and best[1] <= low - 4 * most:
                continue  # nothing is better than an earlier exact copy
            if item not in known:
                if len(known) > 500:
                    known.clear()
                said = text_of(body)
                own = grams(np.frombuffer(body, np.uint8))
                # an edit changes one character, and with it at most GRAM runs of bytes and one more for each further byte
                known[item] = said, own, len(own) - most * (GRAM + max(len(bytes_of(c)) for c in set(said)) - 1)
            said, own, shared = known[item]
            if most == 0:
                at = plain.tobytes().find(body, max(0, low), min(end, high + len(body)))
                if at >= 0 and (best is None or at < best[1]):
                    found[item] = (0, at, at + len(body), len(said))
                continue
            a, b = max(0, low - 4 * most), min(end, high + len(body) + 4 * most)
            if shared > 0 and np.isin(own, runs[a : max(a, b - GRAM + 1)]).sum() < shared:
                continue  # fewer runs in common than that many edits leave
            piece = text_of(plain[a:b].tobytes())
            edits, stop = best_fit_of(said, piece)
            if edits > most:
                continue
            _, taken = best_fit_of(said[::-1], piece[:stop][::-1])
            first, last = a + len(bytes_of(piece[: stop - taken])), a + len(bytes_of(piece[:stop]))
            if best is None or (edits, first) < best[:2]:
                found[item] = (edits, first, last, len(said))
        yield records(out, FOUND)
    if found:
        yield records(results(), FOUND)


def spans_of(doc, best) -> tuple[int, int]:
    """Code points of the text as given in which the copy begins and ends."""
    text, _, _, origin, _ = doc
    first, last = int(origin[best[1]]), int(origin[best[2] - 1])
    start = len(text[:first].decode("utf-8", "ignore"))
    return start, start + len(text[first : last + 1].decode("utf-8", "ignore"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 10, min_chars: int = 1, recall: float = 0.95) -> DataFrame:
    """One row for each document and benchmark item of which a near copy was found in it.

    doc_id, item_id, edits (least edit distance of the item to a piece of the document, A-Z lowered and white
    space runs one space), item_chars, start and end of that piece (code points of the document's text as
    given; the first of equally good ones). A copy is near if edits are at most percent of the item's
    characters, so items too short for one edit need an exact copy, inside words as well; those are always
    found. Others are found with at least the probability `recall` at the full bound of evenly spread edits,
    nearly always with fewer. Items of fewer than min_chars characters (normalised as above) are not searched.
    Null and blank texts have nothing; items of equal text are each reported, as is every row of a repeated
    doc_id or item_id; null ids are reported as null. Other columns are ignored, an empty table gives none.

    Windows start at places that their first two bytes single out (every place for short items), in items and
    documents alike, so texts without white space are searched like others. A CGK walk reads a window: each
    step reads a byte and goes on to the next one or not, as a random table of step and byte says, so a walk
    that meets an edit may fall into step again behind it. A table's key are the bytes read at some of the
    steps. Walk length, sampled steps and starts follow from the item's length band, the number of tables from
    percent and recall by simulation (tables_for). Of an item's windows, those count whose keys the fewest
    items share. Items of 24 bytes and more must be met by two windows some way apart, in the same region of
    the document; phrases that texts share meet one.

    Documents are read once for all items: a filter of bounded size tells which of their keys may belong to
    an item, and only those are joined with the items' keys by Spark. Regions where keys meet are compared
    exactly; a document and an item are held there, one region at a time.
    """
    if not 0 <= percent < 100 or not 0 < recall < 1:
        raise ValueError("percent is at least 0 and less than 100, recall between 0 and 1")
    spark = prepare(docs.sparkSession)
    rows = texts(benchmark.select(F.col("item_id").alias("doc_id"), "text"))
    rows = stored(rows.mapInArrow(prepared_items(percent, min_chars), ITEM))
    items = stored(rows.groupBy("item").agg(*(F.min(c).alias(c) for c in ("body", "chars", "most"))))
    lengths = items.select(F.length("body").alias("n"), "most").where("most > 0").agg(F.max("n"), F.min("n")).first()
    tables = {band.number: tables_for(band, percent, recall) if lengths[0] and lengths[0] >= band.low else 1 for band in BANDS}
    all_windows = stored(items.select("item", "body", "most").mapInArrow(windowed(tables), WINDOWS))
    shared = all_windows.groupBy("key").agg(F.count("*").alias("n_items"))
    rank = F.row_number().over(Window.partitionBy("item", "band", "tab").orderBy("n_items", F.xxhash64("key"), "place"))
    need = F.when(F.col("band") >= EXACT, 1)
    for band in BANDS:
        need = need.when(F.col("band") == band.number, band.need)
    windows = stored(all_windows.join(shared, "key").withColumn("rank", rank).where(F.col("rank") <= need).select("key", "band", "item", "place"))
    bands = sorted(r[0] for r in windows.select("band").distinct().collect())
    held = spark.sparkContext.broadcast(filter_of(windows))
    # rows are known by their id and text, so equal rows are searched once
    named = texts(docs).withColumn("row", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))))
    hits = stored(named.select("row", "text").mapInArrow(met(held, bands, tables), HITS))
    apart = F.lit(0)
    for band in BANDS:
        apart = F.when(F.col("band") == band.number, band.apart).otherwise(apart)
    keys = windows.join(items.select("item", "most"), "item").select("key", "item", F.col("place").alias("offset"), apart.alias("apart"), F.greatest(F.lit(16), 4 * F.col("most")).alias("reach"))
    met_at = hits.join(keys, "key").select("row", "item", (F.col("place") - F.col("offset")).alias("begin"), "offset", "apart", "reach")
    # a region is a run of hits whose items would begin within the reach of edits of each other
    along = Window.partitionBy("row", "item").orderBy("begin")
    new = F.when(F.col("begin") - F.lag("begin").over(along) <= F.col("reach"), 0).otherwise(1)
    runs = met_at.withColumn("new", new).withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    regions = runs.groupBy("row", "item", "part").agg(
        F.min("begin").alias("low"), F.max("begin").alias("high"), (F.max("offset") - F.min("offset")).alias("spread"), F.max("apart").alias("apart")
    ).where("spread >= apart")
    regions = stored(regions.join(items, "item").select("row", F.lit(1).alias("kind"), "item", "body", "most", "low", "high", F.lit(None).cast("binary").alias("text")))
    # one plan at every size: the rows with regions grow with the documents
    candidates = named.join(regions.select("row").distinct().hint("merge"), "row", "left_semi").groupBy("row").agg(F.min("text").alias("text"))
    nothing = {"item": "binary", "body": "binary", "most": "long", "low": "long", "high": "long"}
    wanted = candidates.select("row", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), "text")
    dealt = wanted.unionByName(regions).repartition("row").sortWithinPartitions("row", "kind", "item", "low")
    found = stored(dealt.mapInArrow(verified, FOUND))
    ids = rows.select("item", "item_id")
    return named.select("doc_id", "row").join(found, "row").join(ids, "item").select("doc_id", "item_id", "edits", "item_chars", "start", "end")


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 10, min_chars: int = 1, recall: float = 0.95) -> DataFrame:
    """The rows of docs in which no near copy of any item was found (see leaks); rows of one doc_id go or stay
    together, rows without doc_id stay."""
    return without_ids(docs, leaks(docs, benchmark, percent, min_chars, recall).select("doc_id"))
