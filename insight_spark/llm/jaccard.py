"""Join of documents whose shingle sets overlap, and the components of its links.

Exact at every threshold, in four steps.
1. Sets. Each document's shingles are 64-bit hashes; documents of equal sets form a class and only
   its smallest doc_id goes on.
2. Groups that can hold links. Hash space is cut into more segments than two linked sets can differ
   in elements, so linked sets agree in whole segments. Equal segments join documents into groups
   (a superset of the links' components); nothing but segment hashes is shuffled, and each task
   reduces a repeated segment to one row before. Shingles that very many documents share would join
   unlike documents; they are left out of the segments, which keeps the guarantee, since sets do not
   differ more without them. Groups that are large all the same are cut by prefixes: a linked set shares
   most of its shingles, and one of its rarest.
3. T-occurrence search inside each group (DivideSkip): a set's short inverted lists are merged on a
   heap that skips ahead, its long ones are probed by binary search, and only documents that reach
   the required overlap are links. A pair that is already connected is not searched further.
4. Components of the links.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from insight_spark.llm.common import components, prepare, texts, without_ids
from insight_spark.llm.words import BASE, Words, mix
from insight_spark.session import stored

GROUP_SHINGLES = 150_000
FOREST = 300_000
CHUNK_SHINGLES = 3_000_000
CHUNK_TIMES = 3
MOST_COMMON = 1_000_000
TURN_COPIES = 2
FIRST_KEYS = 1 << 62  # of 2**64: a quarter of the shingles shows of most documents that nothing is linked with them


class Segments:
    """Segment hashes of a set, so that sets of at least percent similarity share one.

    Sizes are cut into bands; a set is hashed in its own band's scheme and, if a linked larger set
    can lie in the next band, in that one too. Two linked sets that meet in a scheme differ in at
    most `differ` elements, and in no more without the common ones; with spare + 1 more segments than
    that, at least spare + 1 agree.

    Segments of one element or none say little. A set that has at most spare of them shares a larger one
    with every linked set, so it gives the larger ones only. Two linked sets that both have more of
    them meet in segments of one element, which such sets give too, while either has at most spare empty
    ones; sets that without common elements have more than that give segments of all elements besides.
    """

    def __init__(self, percent: int, common: np.ndarray = np.empty(0, np.uint64)):
        self.percent, self.edges, self.schemes, self.common = percent, [1], [], common

    def scheme(self, band: int) -> tuple[int, np.ndarray, int]:
        while len(self.schemes) <= band:
            low = self.edges[-1]
            high = low * 100 // self.percent + 1  # sizes low to high - 1
            self.edges.append(high)
            differ = 2 * (high - 1) * (100 - self.percent) // (100 + self.percent)
            spare = 2 + differ * (6 if self.percent < 85 else 3) // 10  # most sets have fewer small segments
            n = differ + 1 + spare
            cuts = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
            self.schemes.append((differ, cuts, spare))
        return self.schemes[band]

    def band(self, size: int) -> int:
        while self.edges[-1] <= size:
            self.scheme(len(self.schemes))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def of(self, found: np.ndarray) -> np.ndarray:
        own, out = self.band(len(found)), []
        self.scheme(own)
        nearby = len(found) * 100 >= self.edges[own + 1] * self.percent
        rare = found
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, found), len(self.common) - 1)
            rare = found[self.common[at] != found]
        for band in (own, own + 1) if nearby else (own,):
            differ, cuts, spare = self.scheme(band)
            if not differ:
                continue  # linked sets are equal, and equal sets are joined by class
            hashes, sizes = self._hashes(rare, cuts, band, 0)
            least = next((k for k in (2, 1) if (sizes < k).sum() <= spare), 0)
            out.append(hashes[sizes >= max(1, least)])
            if not least:
                hashes, sizes = self._hashes(found, cuts, band, 1)
                out.append(hashes[sizes >= next((k for k in (2, 1) if (sizes < k).sum() <= spare), 0)])
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    @staticmethod
    def _hashes(found: np.ndarray, cuts: np.ndarray, band: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each segment, and how many elements it has."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(found ^ BASE))])
        at = np.concatenate([[0], np.searchsorted(found, cuts), [len(found)]])
        tag = (np.arange(len(at) - 1, dtype=np.uint64) + np.uint64((2 * band + kind) << 32)) * BASE
        return mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(tag)), np.diff(at)


def set_hashes(found: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two 64-bit hashes of a whole set."""
    if not len(found):
        return np.uint64(0), np.uint64(0)
    return mix(found).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found + BASE))


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and two 64-bit hashes of every document's set (is_doc); and, of the shingles that
    at least CHUNK_TIMES of a task's last documents have, the hash (set_a) and their number (n_shingles)."""

    def run(batches):
        seen, many = [], 0
        for batch in batches:
            words = Words(batch.column(1).to_pylist(), lower=True)
            runs = words.runs(n)
            found = [words.shingles(doc, runs, n) for doc in range(batch.num_rows)]
            hashes = np.array([set_hashes(f) for f in found], np.uint64).reshape(-1, 2).view(np.int64)
            yield set_batch(batch.column(0), [len(f) for f in found], hashes[:, 0], hashes[:, 1], True)
            seen += found
            many += sum(map(len, found))
            if many > CHUNK_SHINGLES:
                yield repeated(seen)
                seen, many = [], 0
        if many:
            yield repeated(seen)

    def repeated(seen):
        value, times = np.unique(np.concatenate(seen), return_counts=True)
        often = times >= CHUNK_TIMES
        value = value[often].view(np.int64)
        return set_batch(pa.nulls(len(value), pa.int64()), times[often], value, np.zeros(len(value), np.int64), False)

    def set_batch(ids, size, one, two, is_doc):
        columns = [ids, pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([is_doc] * len(one), pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "is_doc"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, is_doc boolean")


def common_shingles(table: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that about one in 4,000 of all documents share (20 at least), from the
    counts in sets().

    Any choice gives the same components; this one keeps groups small. There are at most 4,000
    times as many as an average set has elements, and no more than MOST_COMMON are taken.
    """
    counts = table.where("NOT is_doc").groupBy("set_a").agg(F.sum("n_shingles").alias("times"))
    least = max(20, table.where("is_doc").count() // 4000)
    rows = counts.where(F.col("times") >= least).orderBy(F.desc("times"), "set_a").limit(MOST_COMMON).select("set_a")
    return np.sort(rows.toPandas()["set_a"].to_numpy(np.int64).view(np.uint64))


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def starred(n: int, percent: int, common):
    """Texts -> (segment, doc): each segment of a batch once, with its smallest document.

    Further documents of the segment, and of equal sets, are joined with that one by a key of their own
    that only the two have, so a segment that very many documents share is not one large key.
    """

    def run(batches):
        segments = Segments(percent, common.value)
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            words = Words(batch.column(1).to_pylist(), lower=True)
            runs, parts, first = words.runs(n), {}, {}
            pairs = []
            for k in np.argsort(doc, kind="stable").tolist():
                found = words.shingles(k, runs, n)
                if len(found):
                    same = first.setdefault(set_hashes(found), int(doc[k]))
                    if same != doc[k]:
                        pairs.append((int(doc[k]), same))
                    else:
                        parts[k] = segments.of(found)
            take = np.concatenate([np.empty(0, np.uint64), *parts.values()]).view(np.int64)
            owner = np.repeat(doc[list(parts)], [len(x) for x in parts.values()])
            by = np.lexsort((owner, take))
            take, owner = take[by], owner[by]
            lead = np.concatenate([np.ones(min(1, len(take)), bool), take[1:] != take[:-1]])
            low = owner[np.maximum.accumulate(np.where(lead, np.arange(len(take)), 0))]
            more = owner != low
            joined = np.concatenate([np.array(pairs, np.int64).reshape(-1, 2), np.stack([owner[more], low[more]], axis=1)])
            joined = np.unique(joined, axis=0)
            own = mix(mix(joined[:, 0].view(np.uint64) * BASE) ^ joined[:, 1].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([take[lead], own, own])), pa.array(np.concatenate([owner[lead], joined[:, 0], joined[:, 1]]))],
                names=["segment", "doc"],
            )

    return run


def met(batches):
    """Edges that join the documents of each segment; rows come sorted by segment and doc.

    A task passes on a spanning forest of the edges it has seen, at most FOREST documents at a time.
    """
    last, low = None, 0
    up: dict[int, int] = {}

    def root(v):
        while (w := up.setdefault(v, v)) != v:
            up[v] = v = up[w]
        return v

    def forest():
        pairs = np.array([(v, root(v)) for v in up if up[v] != v], np.int64).reshape(-1, 2)
        up.clear()
        return edge_batch(pairs[:, 0], pairs[:, 1])

    for batch in batches:
        segment, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if not len(doc):
            continue
        new = np.concatenate([[last is None or segment[0] != last], segment[1:] != segment[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        leader = np.where(at >= 0, doc[at], low)
        last, low = segment[-1], leader[-1]
        more = doc != leader
        for x, y in np.unique(np.stack([doc[more], leader[more]], axis=1), axis=0).tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > FOREST:
            yield forest()
    yield forest()


def required(percent: int, a: int, b: int) -> int:
    """Smallest overlap at which sets of a and b elements are linked."""
    return -(-percent * (a + b) // (100 + percent))


class Search:
    """Inverted lists over sets that come in order of size, and DivideSkip searches in them."""

    def __init__(self, percent: int, weight: float = 0.01):
        self.percent, self.weight = percent, weight
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, elements: list[int]) -> int:
        at = len(self.sizes)
        self.sizes.append(len(elements))
        for e in elements:
            self.lists.setdefault(e, []).append(at)
        return at

    def links(self, elements: list[int], skip) -> list[int]:
        """Indexed sets linked with this one, which is at least as large. skip(k): k needs no answer."""
        size, percent = len(elements), self.percent
        least = -(-size * percent // 100)
        first = bisect_left(self.sizes, least)
        least = required(percent, size, least)
        found = [x for x in (self.lists.get(e) for e in elements) if x and x[-1] >= first]
        if len(found) < least:
            return []
        found.sort(key=len)
        long = min(least - 1, int(least / (self.weight * math.log2(len(found[-1]) + 1) + 1)))
        short, long = found[: len(found) - long], found[len(found) - long :]
        need = least - len(long)
        heap = [(x[p], k, p) for k, x in enumerate(short) if (p := bisect_left(x, first)) < len(x)]
        heapq.heapify(heap)
        out = []
        while len(heap) >= need:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= need:
                if not skip(top):
                    want, count = required(percent, size, self.sizes[top]), len(popped)
                    for rest, x in enumerate(long):
                        if count >= want or count + len(long) - rest < want:
                            break
                        p = bisect_left(x, top)
                        count += p < len(x) and x[p] == top
                    if count >= want:
                        out.append(top)
                to = top + 1
            else:  # no value below the next can be in enough lists: skip to it
                while heap and len(popped) < need - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    break
                to = heap[0][0]
            for _, k, p in popped:
                x = short[k]
                p = bisect_left(x, to, p)
                if p < len(x):
                    heapq.heappush(heap, (x[p], k, p))
        return out


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def connecting(ids: list[int], found: list[np.ndarray], near: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a group as all its links would. near: known to be connected already."""
    order = sorted(range(len(ids)), key=lambda k: len(found[k]))
    union, search, edges = Union(len(ids)), Search(percent), []
    joined = [k for k in order if near[k]]
    for a, b in zip(joined, joined[1:], strict=False):
        union.join(a, b)
    for k in order:
        elements = found[k].tolist()
        # what is connected with it gives no news; members known to be near each other seek only the others
        hits = search.links(elements, lambda x, k=k: union.root(order[x]) == union.root(k))
        for x in hits:
            if union.join(order[x], k):
                edges.append((ids[k], ids[order[x]]))
        search.add(elements)
    return edges


def searched(n: int, percent: int):
    """Rows (part, doc_id, near, text) sorted by part -> connecting links of each part."""

    def flush(rows):
        words = Words([r[2] for r in rows], lower=True)
        runs = words.runs(n)
        found = [words.shingles(k, runs, n) for k in range(len(rows))]
        return connecting([r[0] for r in rows], found, [r[1] for r in rows], percent)

    def run(batches):
        part, rows, edges = None, [], []
        for batch in batches:
            for key, doc_id, near, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != part and rows:
                    edges += flush(rows)
                    rows = []
                part = key
                rows.append((doc_id, near, text))
            if edges:
                yield edge_batch(*np.array(edges, np.int64).T)
                edges = []
        if rows and (edges := flush(rows)):
            yield edge_batch(*np.array(edges, np.int64).T)

    return run


def near_pivot(n: int, percent: int):
    """Rows with a pivot's text get near: whether the text is linked with it."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, pivots = (batch.column(names.index(c)).to_pylist() for c in ("text", "pivot_text"))
            near, cache = [], {}
            for text, pivot in zip(texts, pivots, strict=True):
                if pivot not in cache:
                    cache = {pivot: set(shingle_list(pivot, n))}
                own = shingle_list(text, n)
                both = sum(x in cache[pivot] for x in own)
                near.append(both * (100 + percent) >= percent * (len(own) + len(cache[pivot])))
            keep = [c for c in names if c != "pivot_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), pa.array(near)], names=[*keep, "near"])

    return run


def shingle_list(text: bytes, n: int) -> list[int]:
    words = Words([text], lower=True)
    return words.shingles(0, words.runs(n), n).tolist()


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) of every row of docs.

    Linked: 100 * intersection >= percent * union of the sets of n-word shingles (A-Z lowered). Fewer
    than n words make one shingle; null, empty and blank texts have none and link with nothing. Rows
    that repeat a doc_id count as one document in links and are all returned; a null doc_id takes its
    class's component or null. Other columns are ignored; an empty table gives none.

    A group of more than GROUP_SHINGLES shingles is not searched as one. It is cut into smaller groups
    that hold the same links (refined); the members of what is still as large are compared
    with one pivot, and those linked with it are connected at once. Both they and the others are dealt
    to blocks; a block of others is searched against every block, so no task holds more than two.
    """
    prepare(docs.sparkSession)
    counted = stored(sets(docs, n))
    table = counted.where("is_doc").drop("is_doc")
    filled = table.where("n_shingles > 0")
    reps = filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    classes = stored(
        table.join(reps, ["set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    )
    links = links_of_groups(docs, groups_of(docs, common_shingles(counted), n, percent), classes, n, percent)
    final = components(links)
    return classes.join(final, classes.rep == final.v, "left").select(
        "doc_id", "n_shingles", F.coalesce("c", "rep").alias("component_id")
    )


def groups_of(docs: DataFrame, common: np.ndarray, n: int, percent: int) -> DataFrame:
    """Groups that can hold links: (v, c), each document that shares a segment and its group's smallest."""
    common = docs.sparkSession.sparkContext.broadcast(common)
    dealt = texts(docs).where("doc_id IS NOT NULL").mapInArrow(starred(n, percent, common), "segment long, doc long")
    # half as many parts as usual: every part passes on a forest over its documents
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    dealt = dealt.repartition(parts, "segment").sortWithinPartitions("segment", "doc")
    return components(stored(dealt.mapInArrow(met, "a long, b long").distinct()))


def links_of_groups(docs: DataFrame, groups: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between class representatives that connect each group as all of its links would."""
    members = stored(
        groups.join(classes, groups.v == classes.doc_id)
        .where("doc_id = rep")
        .dropDuplicates(["doc_id"])
        .select("doc_id", F.col("c").alias("part"), "n_shingles")
    )
    sizes = members.groupBy("part").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight")).where("members > 1")
    wanted = members.join(sizes, "part").select(
        "doc_id", "part", "n_shingles", (F.col("weight") > GROUP_SHINGLES).alias("is_large")
    )

    held = stored(wanted.join(texts(docs).hint("merge"), "doc_id"))  # one plan at every size

    def search(rows: DataFrame) -> DataFrame:
        spread = rows.repartition(F.col("part")).sortWithinPartitions("part", "doc_id")
        return stored(spread.mapInArrow(searched(n, percent), "a long, b long"))

    small = held.where("NOT is_large").select("part", "doc_id", F.lit(False).alias("near"), "text")
    links = search(small)
    if held.where("is_large").isEmpty():
        return links
    cut = refined(held.where("is_large").select("part", "doc_id", "n_shingles", "text"), n, percent)
    links = links.unionByName(search(cut.where("NOT is_large").select("part", "doc_id", F.lit(False).alias("near"), "text")))
    large = cut.where("is_large")
    if large.isEmpty():
        return links
    pivots = large.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("p"))
    pivots = pivots.select("part", F.col("p.doc_id").alias("pivot"), F.col("p.text").alias("pivot_text"))
    judged = stored(
        large.join(pivots, "part").select("part", "doc_id", "n_shingles", "pivot", "text", "pivot_text").mapInArrow(
            near_pivot(n, percent), "part long, doc_id long, n_shingles long, pivot long, text binary, near boolean"
        )
    )
    # near ones meet the others only, in parts of a block of each; the others meet each other too
    count = lambda near: F.ceil(F.sum(F.when(near, F.col("n_shingles")).otherwise(0)) / GROUP_SHINGLES).cast("int")
    blocks = judged.groupBy("part").agg(count(F.col("near")).alias("nears"), count(~F.col("near")).alias("others")).where("others > 0")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("others"))).cast("int")

    def pairs(first: Column, n: Column, kind: int) -> Column:
        """Numbers of the parts that block `first` forms with blocks 0 to n - 1."""
        return F.when(
            n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64(F.col("part"), F.lit(kind), F.least(first, k) if kind else first, F.greatest(first, k) if kind else k))
        ).otherwise(F.array().cast("array<bigint>"))

    with_near = F.transform(F.sequence(F.lit(0), F.col("nears") - 1), lambda k: F.xxhash64(F.col("part"), F.lit(0), k, F.col("own")))
    met_by = F.when(F.col("near"), pairs(F.col("own"), F.col("others"), 0)).otherwise(
        F.concat(F.when(F.col("nears") > 0, with_near).otherwise(F.array().cast("array<bigint>")), pairs(F.col("own"), F.col("others"), 1))
    )
    placed = judged.join(blocks, "part").withColumn("own", own).withColumn("met", met_by)
    pivoted = judged.where("near").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    links = links.unionByName(pivoted)
    # a text goes to as many parts as its group has blocks: in turns, of which each writes about TURN_COPIES of every text
    sums = placed.agg(F.sum(F.col("n_shingles") * F.size("met")).alias("copies"), F.sum("n_shingles").alias("own")).first()
    turns = -(-(sums["copies"] or 0) // (TURN_COPIES * (sums["own"] or 1)))
    for turn in range(turns):
        now = placed.withColumn("met", F.explode(F.filter("met", lambda m: F.pmod(m, F.lit(turns)) == turn)))
        links = links.unionByName(search(now.select(F.col("met").alias("part"), "doc_id", "near", "text")))
    return links


def keyed(n: int, low: int, high: int):
    """Rows (part, uid, text) -> (key, uid, sizes): a key for each shingle whose hash is from low to below high,
    another in each part; and one row a text of how many these and all its shingles are (sizes; else 0)."""

    def run(batches):
        for batch in batches:
            part, uid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            words = Words(batch.column(2).to_pylist(), lower=True)
            runs, keys, sizes = words.runs(n), [], []
            salt = mix(part.view(np.uint64) * BASE)
            for k in range(batch.num_rows):
                found = words.shingles(k, runs, n)
                own = found[np.searchsorted(found, np.uint64(low)) : np.searchsorted(found, np.uint64(high - 1), "right")]
                keys.append(mix(own ^ salt[k]))
                sizes.append((len(own) << 32) + len(found))
            many = [len(x) for x in keys]
            keys = np.concatenate([np.empty(0, np.uint64), *keys, mix(uid.view(np.uint64))]).view(np.int64)
            sizes = np.concatenate([np.zeros(sum(many), np.int64), np.array(sizes, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(np.concatenate([np.repeat(uid, many), uid])), pa.array(sizes)], names=["key", "uid", "sizes"]
            )

    return run


def repeats(batches):
    """Rows of keyed, sorted by key -> (uid, key, times, sizes): keys that several rows have, with how many; and the
    rows of sizes, without key."""

    def out(uid, key, times, sizes):
        return pa.RecordBatch.from_arrays([pa.array(uid), key, pa.array(times), pa.array(sizes)], names=["uid", "key", "times", "sizes"])

    def several(key, uid):
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        times = np.diff(np.concatenate([starts, [len(key)]]))
        times = np.repeat(times, times)
        more = times > 1
        return out(uid[more], pa.array(key[more]), times[more], np.zeros(more.sum(), np.int64))

    key = uid = np.empty(0, np.int64)  # rows of the last key so far, which may go on
    for batch in batches:
        new_key, new_uid, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        told = sizes > 0
        yield out(new_uid[told], pa.nulls(told.sum(), pa.int64()), np.zeros(told.sum(), np.int64), sizes[told])
        key, uid = np.concatenate([key, new_key[~told]]), np.concatenate([uid, new_uid[~told]])
        if len(key):
            at = np.searchsorted(key, key[-1])
            yield several(key[:at], uid[:at])
            key, uid = key[at:], uid[at:]
    yield several(key, uid)


def refined(large: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (part, doc_id, n_shingles, text) of large groups in smaller groups that hold the same links, with
    is_large; texts that can have no link are left out.

    Of a linked set at least percent of all shingles are in other sets of its part as well. Those of a range of
    hashes are counted first, which leaves few texts for the others. What is left shares a shingle among its rarest
    with every set that is linked with it: of `shared` ones in order of how many sets have them, the first
    shared - need + 1. So every link keeps its key, and a passage of many unlike sets, which comes last, joins none.
    Rows are told apart by doc_id and text, as a doc_id may be repeated.
    """
    left, told = large.withColumn("uid", F.xxhash64("doc_id", "text")), None
    for low, high in ((0, FIRST_KEYS), (FIRST_KEYS, 1 << 64)):
        rows = left.select("part", "uid", "text").mapInArrow(keyed(n, low, high), "key long, uid long, sizes long")
        dealt = rows.repartition("key").sortWithinPartitions("key")
        now = stored(dealt.mapInArrow(repeats, "uid long, key long, times long, sizes long"))
        told = now if told is None else told.unionByName(now)
        counts = told.groupBy("uid").agg(
            F.count("key").alias("shared"),
            F.sum(F.shiftright("sizes", 32)).alias("seen"),
            F.max(F.col("sizes").bitwiseAND((1 << 32) - 1)).alias("size"),
        )
        counts = counts.withColumn("need", F.expr(f"(size * {percent} + 99) div 100"))
        counts = stored(counts.where("shared + size - seen >= need").select("uid", "shared", "need"))
        left = stored(left.join(counts.select("uid"), "uid", "left_semi"))
    order = Window.partitionBy("uid").orderBy("times", "key")
    first = told.where("key IS NOT NULL").join(counts, "uid").withColumn("at", F.row_number().over(order)).where("at <= shared - need + 1")
    dealt = first.select("key", "uid").repartition("key").sortWithinPartitions("key", "uid")
    groups = components(stored(dealt.mapInArrow(met, "a long, b long").distinct()))
    named = stored(left.select("uid", "n_shingles").join(groups.select(F.col("v").alias("uid"), F.col("c").alias("part")), "uid"))
    weights = named.groupBy("part").agg((F.sum("n_shingles") > GROUP_SHINGLES).alias("is_large"))
    named = named.join(weights, "part").select("uid", "part", "is_large").distinct()
    # at rest, as a join below the repartition of a search could be taken for it and read in other pieces
    return stored(left.drop("part").join(named, "uid").select("part", "doc_id", "n_shingles", "text", "is_large"))


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; see jaccard_components.

    Texts without words stay, and so do rows without doc_id, which cannot be told apart, and all rows
    that repeat a kept doc_id.
    """
    found = jaccard_components(docs, n, percent)
    return without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))
