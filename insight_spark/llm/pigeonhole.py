"""Near copies of benchmark items, every one of them: pieces of items that edits must leave whole, exact edit verification.

This reads all documents once for every block of the benchmark. It is the measure that decontamination is
held against, and a mode for benchmarks of a few blocks.

An item of m characters with at most k edits is cut into k + 1 pieces, or k + 2 where pieces stay long
enough. An edit touches one piece at most, so every near copy holds one of them (or two, little apart
from where the item has them) unchanged, at any place of the document: no white space is needed, and
no near copy is missed (recall 1 at every length and share of edits, not a target approached by more
tables). Where pieces are met, the exact edit distance of the best fit decides.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from insight_spark.llm.common import prepare, texts
from insight_spark.llm.words import LOWER, SPACE
from insight_spark.session import stored

GRAM = 5
SEED = 8
PAIRED = 6
BLOCK_BYTES = 8 << 20
STRETCH = 1 << 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normalised(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, A-Z lowered and white space runs one space, a space after each and zeros at
    the end; where each text begins in it (and what follows the last); and each kept byte's place in the
    joined input."""
    raw = np.frombuffer(b"".join(p + b"\n" for p in parts), np.uint8)
    space = SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    place = np.concatenate([[0], np.cumsum(keep)])
    text = LOWER[np.where(space, np.uint8(32), raw)[keep]]
    return np.concatenate([text, np.zeros(SEED, np.uint8)]), place[begins], np.flatnonzero(keep)


def text_of(raw: bytes) -> str:
    """Text whose encoding by bytes_of gives the same bytes, whatever they are."""
    return raw.decode("utf-8", "surrogateescape")


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def eights(text: np.ndarray) -> np.ndarray:
    """The SEED bytes from each place on as one number, the first byte lowest; no copy."""
    return np.ndarray((len(text) - SEED + 1,), "<u8", text, strides=(1,))


def best_fit_of(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any piece of the text, and where the first such piece ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for k, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << k
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def grams(text: np.ndarray) -> np.ndarray:
    """GRAM bytes from each place on, as one number."""
    out = np.zeros(max(0, len(text) - GRAM + 1), np.int64)
    for k in range(GRAM):
        out = out << 8 | text[k : k + len(out)]
    return out


class Seeds:
    """Pieces by their first `size` bytes, with their last bytes, items and offsets in the item."""

    def __init__(self, size: int, columns: list[array]):
        self.mask = np.uint64((1 << 8 * size) - 1)
        order = np.argsort(np.frombuffer(columns[0], np.uint64), kind="stable")
        self.key, self.last = (np.frombuffer(c, np.uint64)[order] for c in columns[:2])
        self.shift, self.owner, self.offset = (np.frombuffer(c, np.int64)[order] for c in columns[2:])
        bits = min(26, max(20, (16 * len(order)).bit_length()))
        self.down = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.key * SPREAD >> self.down] = True

    def met(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, places of their pieces and places where the items would begin."""
        for at in range(0, len(words), STRETCH):
            here = words[at : at + STRETCH] & self.mask
            where = np.flatnonzero(self.filter[here * SPREAD >> self.down])
            key = here[where]
            low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, "right")
            n = high - low
            hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(where + at, n)
            end = words[np.minimum(place + self.shift[hit], len(words) - 1)]
            same = end & self.mask == self.last[hit]
            hit, place = hit[same], place[same]
            yield self.owner[hit], place, place - self.offset[hit]


class Index:
    """Pieces of the items, by how many bytes of them are compared at first."""

    def __init__(self, items: list[tuple[int, bytes, int]], percent: int, min_chars: int = 1):
        """items: id, text and how many such rows there are; equal texts are one entry with all their ids."""
        text, begin, _ = normalised([t for _, t, _ in items])
        rows_of: dict[str, list[tuple[int, int]]] = {}
        for k, (i, _, n) in enumerate(items):
            t = text_of(text[begin[k] : begin[k + 1]].tobytes()).strip()
            if len(t) >= max(1, min_chars):
                rows_of.setdefault(t, []).append((i, n))
        self.texts, self.ids = list(rows_of), list(rows_of.values())
        self.most = [len(t) * percent // 100 for t in self.texts]
        self.known: dict[int, tuple[np.ndarray, int]] = {}
        paired, rows = [], {}
        for owner, (t, most) in enumerate(zip(self.texts, self.most, strict=True)):
            body = bytes_of(t)
            at = np.cumsum([0, *(len(bytes_of(c)) for c in t)]) if len(body) > len(t) else np.arange(len(t) + 1)
            pair = most > 0 and len(t) // (most + 2) >= PAIRED
            paired.append(pair)
            cuts = at[np.arange(most + pair + 2) * len(t) // (most + pair + 1)].tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                size = min(SEED, b - a)
                first, last = (int.from_bytes(x, "little") for x in (body[a : a + size], body[b - size : b]))
                columns = rows.setdefault(size, [array(c) for c in "QQqqq"])
                for column, value in zip(columns, (first, last, b - a - size, owner, a), strict=True):
                    column.append(value)
        self.paired, self.reach = np.array(paired, bool), 4 * np.array(self.most, np.int64)
        self.seeds = [Seeds(size, r) for size, r in sorted(rows.items())]

    def runs(self, i: int) -> tuple[np.ndarray, int]:
        """The item's grams, and how many of them its edits leave at least."""
        if i not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            t = self.texts[i]
            g = grams(np.frombuffer(bytes_of(t), np.uint8))
            # an edit changes one character, and with it at most GRAM runs of bytes and one more for each further byte
            widest = max(len(bytes_of(c)) for c in set(t))
            self.known[i] = g, len(g) - self.most[i] * (GRAM + widest - 1)
        return self.known[i]

    def meets(self, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items with as many pieces in them as a near copy has, and where the items would begin."""
        words = eights(text)
        found = [x for seeds in self.seeds for x in seeds.met(words)]
        item, at, place = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(3))
        doc = np.searchsorted(begin, at, "right") - 1
        order = np.lexsort((place, item, doc))
        doc, item, place = doc[order], item[order], place[order]
        # an edit moves what follows by four bytes at most
        close = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (np.diff(place) <= self.reach[item[1:]])
        keep = ~self.paired[item]
        keep[1:] |= close
        keep[:-1] |= close
        return doc[keep], item[keep], place[keep]


def regions(doc: np.ndarray, item: np.ndarray, place: np.ndarray, gap: int = 64) -> Iterator[tuple[int, int, int, int]]:
    """Nearby places of one item in one document, as (doc, item, first, last)."""
    order = np.lexsort((place, item, doc))
    doc, item, place = doc[order], item[order], place[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > gap) | (np.diff(place >> 10) > 0)])
        begin = np.flatnonzero(new)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(doc)], strict=True):
            yield int(doc[a]), int(item[a]), int(place[a]), int(place[b - 1])


def fitted(index: Index):
    def run(batches):
        tables = index.value
        for batch in batches:
            parts = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()
            text, begin, origin = normalised(parts)
            joined = np.cumsum([0, *(len(p) + 1 for p in parts)])
            runs = grams(text)
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for d, i, first, last in regions(*tables.meets(text, begin)):
                known = found.get((d, i))
                if known is not None and known[0] == 0:
                    continue  # nothing is better than the first exact copy
                pattern, most = tables.texts[i], tables.most[i]
                size = len(bytes_of(pattern))
                low = max(int(begin[d]), first - 4 * most)
                high = min(int(begin[d + 1]) - 1, last + size + 4 * most)
                own, shared = tables.runs(i)
                if shared > 0 and np.isin(own, runs[low : max(low, high - GRAM + 1)]).sum() < shared:
                    continue  # fewer runs in common than that many edits leave
                body = text_of(text[low:high].tobytes())
                edits, end = best_fit_of(pattern, body)
                if edits > most:
                    continue
                _, taken = best_fit_of(pattern[::-1], body[:end][::-1])
                a = low + len(bytes_of(body[: end - taken]))
                b = low + len(bytes_of(body[:end]))
                if known is None or (edits, a) < known[:2]:
                    found[d, i] = (edits, a, b)
            rows = []
            for (d, i), (edits, a, b) in found.items():
                head = joined[d]
                first, last = (int(origin[x] - head) for x in (a, b - 1))
                start = len(parts[d][:first].decode("utf-8", "ignore"))
                stop = start + len(parts[d][first : last + 1].decode("utf-8", "ignore"))
                for own, n in tables.ids[i]:
                    rows += [(ids[d], own, edits, len(tables.texts[i]), start, stop)] * n
            columns = list(zip(*rows, strict=True)) or [()] * 6
            names = ["doc_id", "item_id", "edits", "item_chars", "start", "end"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def exact_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 10, min_chars: int = 6) -> DataFrame:
    """One row for each document and benchmark item of which it has a near copy.

    doc_id, item_id, edits (least edit distance of the item to a piece of the document, A-Z lowered
    and white space runs one space), item_chars, start and end of that piece (code points of the
    document's text as given; the first of equally good ones). A copy is near if edits are at most
    percent of the item's characters, so the shortest items need an exact copy, inside words as well.
    Whole texts are searched, and every near copy is found. Items of fewer than min_chars characters
    (normalised as above) are not searched; 1 searches all. Null and blank texts have nothing, items of equal text are each reported, and so is every row of a
    repeated doc_id. Items without id are reported with a null id. Other columns are ignored.

    The benchmark is taken in blocks of about BLOCK_BYTES of text (one item at least). Each is read by the
    driver, broadcast and searched for by itself, its result written before the next one is read, so what
    is held does not grow with either table; documents are read once for each block. Repeated rows are one
    with their number.
    """
    if not 0 <= percent < 100:
        raise ValueError("percent is at least 0 and less than 100: with as many edits as characters every text is a copy")
    spark = prepare(docs.sparkSession)
    items = texts(benchmark.select(F.col("item_id").alias("doc_id"), "text")).where(F.length("text") >= max(1, min_chars))
    items = stored(items.groupBy("doc_id", "text").agg(F.count("*").alias("n")))

    def searched(held: list[tuple[int, bytes, int]]):
        index = spark.sparkContext.broadcast(Index(held, percent, min_chars))
        return index, texts(docs).mapInArrow(
            fitted(index), "doc_id long, item_id long, edits int, item_chars int, start long, end long"
        )

    out, held, room = None, [], BLOCK_BYTES
    for row in items.toLocalIterator():
        if held and room < len(row.text):
            index, found = searched(held)
            found = stored(found)
            index.destroy()
            out = found if out is None else out.unionByName(found)
            held, room = [], BLOCK_BYTES
        room -= len(row.text)
        held.append((row.doc_id, bytes(row.text), row.n))
    _, found = searched(held)
    return found if out is None else out.unionByName(found)
