"""Prefix trie of conversations: subtree totals by parallel tree contraction (rake, compress, re-expand)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from insight_spark.llm.common import prepare
from insight_spark.operators.ordered import PART_BITS, laid_out
from insight_spark.session import stored

BLOCK_BITS = 5  # a compress round joins chains within 32 depths, the next within 1024, and so on
ROUNDS = 200


def keys(turn: Column, said: Column) -> list[Column]:
    """128 bits of a turn at a depth: two hashes of the depth and the digest of role and text."""
    return [F.xxhash64(F.lit(seed), turn, said).alias(f"t{seed}") for seed in (1, 2)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, at, pos (from 1), said (digest of role and text), chars: every turn and its place.

    Turns are dealt by range, so a conversation of any length spreads over tasks; places come from counts
    per conversation and partition, which the n column of the second frame holds.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    # rows of one turn and role go by the text's beginning, then by the whole text
    start = F.substring("text", 1, 64)
    laid = rows.repartitionByRange("conv_id", "turn", "role", start).sortWithinPartitions("conv_id", "turn", "role", "text")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return stored(
        laid.withColumn("at", F.monotonically_increasing_id()).select(
            "conv_id", F.shiftright("at", PART_BITS).alias("part"), "at", said.alias("said"), F.length("text").cast("long").alias("chars")
        )
    )


def rebuilt(turns: DataFrame, sharing: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations with the hashes of the prefixes they end, and one row per
    conversation with its length: the first `sharing` turns of conversation `base`, then the own turns
    after as many. sharing and base are expressions on conv_id; sharing is small (its turns form a list)."""
    pieces = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(pieces.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"h": sharing, "base": base})
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    placed = pieces.join(convs.select("conv_id", "h", "k"), "conv_id").select("conv_id", "part", "first", "start", "h", "k")
    # positions of own turns; the join is on conversation and partition, so a long one stays spread
    own = stored(
        turns.join(placed, ["conv_id", "part"]).select(
            "conv_id", "part", (F.col("at") - F.col("first") + F.col("start") + 1).alias("pos"), "h", "k", "said", "chars"
        )
    )
    shared = own.where(F.col("pos") <= convs.select(F.max("h")).scalar()).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "said", "chars"
    )
    heads = convs.where("k > 0").select("conv_id", "base", "k").join(shared, "base").where("depth <= k")
    tails = own.where("pos > h").select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "said", "chars")
    rows = heads.select("conv_id", F.lit(-1).cast("long").alias("part"), "depth", "said", "chars").unionByName(tails)
    rows = stored(rows.select("conv_id", "part", "depth", "chars", *keys(F.col("depth"), F.col("said"))))
    # a prefix is known by the exclusive or of its turns' hashes, which hold the depths
    totals = rows.groupBy("conv_id", "part").agg(*(F.bit_xor(f"t{s}").alias(f"o{s}") for s in (1, 2)))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "part", *(F.coalesce(F.bit_xor(f"o{s}").over(before), F.lit(0)).alias(f"o{s}") for s in (1, 2)))
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.bit_xor(f"t{s}").over(within).alias(f"w{s}") for s in (1, 2))).join(totals, ["conv_id", "part"])
    whole = {f"x{s}": F.col(f"w{s}").bitwiseXOR(F.col(f"o{s}")) for s in (1, 2)}
    parent = {f"p{s}": F.col(f"x{s}").bitwiseXOR(F.col(f"t{s}")) for s in (1, 2)}
    rows = rows.withColumns(whole).withColumns(parent)
    return stored(rows.select("conv_id", "depth", "chars", "x1", "x2", "p1", "p2")), convs


def contracted(nodes: DataFrame, sums: list[str], block_bits: int = BLOCK_BITS, rounds: int = ROUNDS) -> DataFrame:
    """c, d and the totals of `sums` over each node's subtree.

    nodes: c, d (its key), pc, pd (its parent's key, null in the root), kids (number of children), and
    the columns to sum. Rounds of joins on the shrinking tree: rake adds every childless node to its
    parent and takes it out; compress takes out nodes with one child, adds them to the nearest kept node
    above and hangs their child there. Odd rounds compress whole runs of nodes of equal c and neighbouring
    depths (blocks grow from round to round), even ones nodes whose coin is heads where their parent's is
    tails, so chains over changing c shrink as well. What is taken out is written with what it has gathered
    and the child it still lacks; read backwards, those rows give every total. A parent of very many
    children gets their sums pre-aggregated.
    """
    active = stored(nodes.select("c", "d", "pc", "pd", "kids", *sums))
    taken = []  # (frame, whether a child's total is still to be added)
    key = ["c", "d"]
    for turn in range(rounds):
        # rake, and the only child of nodes that have one left
        leaf = F.col("kids") == 0
        gathered = active.where("pd IS NOT NULL").groupBy("pc", "pd").agg(
            F.count(F.when(~leaf, 1)).alias("left"),
            F.min(F.when(~leaf, F.struct("c", "d"))).alias("only"),
            *(F.sum(F.when(leaf, F.col(s))).alias(f"add_{s}") for s in sums),
        )
        gathered = gathered.withColumnsRenamed({"pc": "c", "pd": "d"})
        taken.append((active.where(leaf).select(*key, *sums), False))
        added = [(F.col(s) + F.coalesce(f"add_{s}", F.lit(0))).alias(s) for s in sums]
        rest = active.where(~leaf).join(gathered, key).select(*key, "pc", "pd", F.col("left").alias("kids"), "only", *added)
        rest = stored(rest)
        if rest.isEmpty():
            break
        unary = (F.col("kids") == 1) & F.col("pd").isNotNull()
        if turn % 2 == 0:
            block = F.shiftright("d", block_bits * (turn // 2 + 1))
            here = Window.partitionBy("c", block)
            inside = unary & (F.lag("d").over(here.orderBy("d")) == F.col("pd")) & (F.col("pc") == F.col("c"))
            runs = rest.withColumn("inside", F.coalesce(inside, F.lit(False)))
            runs = runs.withColumn("run", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(here.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))
            run = Window.partitionBy("c", block, "run")
            later = run.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
            out = runs.withColumns(
                {"top": F.min("d").over(run), "end": F.max("d").over(run), "last_only": F.max_by("only", "d").over(run)}
                | {f"sum_{s}": F.sum(s).over(later) for s in sums}
            ).where("inside").select(
                *key, F.col("c").alias("hc"), F.col("top").alias("hd"), (F.col("d") == F.col("end")).alias("ends"),
                F.col("last_only").alias("only"), *(F.col(f"sum_{s}").alias(f"to_{s}") for s in sums), *sums,
            )
        else:
            coin = lambda c, d: F.xxhash64(F.lit(turn), c, d).bitwiseAND(F.lit(1)) == 1  # noqa: E731, B023
            picked = unary & coin("c", "d") & ~coin("pc", "pd")
            out = rest.where(picked).select(
                *key, F.col("pc").alias("hc"), F.col("pd").alias("hd"), F.lit(True).alias("ends"), "only", *(F.col(s).alias(f"to_{s}") for s in sums), *sums
            )
        out = stored(out)
        taken.append((out.select(*key, *(F.col(f"to_{s}").alias(s) for s in sums), F.col("only.c").alias("xc"), F.col("only.d").alias("xd")), True))
        gains = out.groupBy(F.col("hc").alias("c"), F.col("hd").alias("d")).agg(*(F.sum(s).alias(f"add_{s}") for s in sums))
        hung = out.where("ends").select(F.col("only.c").alias("c"), F.col("only.d").alias("d"), F.col("hc").alias("nc"), F.col("hd").alias("nd"))
        kept = rest.join(out.select(*key), key, "left_anti").join(gains, key, "left").join(hung, key, "left")
        active = stored(
            kept.select(*key, F.coalesce("nc", "pc").alias("pc"), F.coalesce("nd", "pd").alias("pd"), "kids", *added)
        )
    else:
        raise RuntimeError(f"the tree did not contract in {rounds} rounds")
    known = None
    for frame, lacks in reversed(taken):
        if lacks:
            below = known.select(F.col("c").alias("xc"), F.col("d").alias("xd"), *(F.col(s).alias(f"add_{s}") for s in sums))
            frame = stored(frame.join(below, ["xc", "xd"]).select(*key, *((F.col(s) + F.col(f"add_{s}")).alias(s) for s in sums)))
        known = frame if known is None else known.unionByName(frame)
    return known


def digests(batches):
    """Keys and numbers in order -> one row per key: SHA-256 of its numbers, comma-joined, as they stream."""
    key, sha = None, None
    names, kinds = ["d", "x1", "x2", "ends_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        out = []
        for *own, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = own, hashlib.sha256(str(number).encode())
            else:
                sha.update(b",%d" % number)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, sha.hexdigest()), kinds, strict=True)], names=names)


def prefix_trie(conversations: DataFrame, sharing: Column | None = None, base: Column | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the columns below.

    conversations: conv_id, turn, role, text; other columns are ignored, rows without conv_id left out; null
    role or text is empty. Turns are taken by turn (null first), then role and text. Conversation c is
    rebuilt as the first `sharing` turns of conversation `base` (fewer if it has fewer, none if it is not
    there) and its own turns after its first `sharing`; by default nothing is shared and each stays as it is.
    A node is a distinct sequence of first turns, told by 128-bit hashes; depth 0 is the root.

    conv_id (smallest member) and depth name a node; parent_conv_id names its parent, of depth - 1 (null in
    the root). n_convs: members, the rebuilt conversations that start with it. n_children. n_leaves: nodes
    without children in its subtree, itself included. saved_tokens: over its subtree, members but one times
    the code points of the last text. ends_sha256: SHA-256 (hex) of the ids of the conversations that end
    here, ascending, comma-joined. An empty table has no node.

    Totals come from tree contraction (contracted). The ids that end at one node pass through one task as a
    stream; nothing else of a node or conversation meets in a task.
    """
    prepare(conversations.sparkSession)
    sharing, base = F.lit(0) if sharing is None else sharing, F.col("conv_id") if base is None else base
    rows, convs = rebuilt(numbered_turns(conversations), sharing, base)
    sums = ["n_leaves", "saved_tokens"]
    inner = rows.groupBy(F.col("depth").alias("d"), "x1", "x2").agg(
        F.min("conv_id").alias("c"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    root = convs.agg(F.min("conv_id").alias("c"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "c", "n_convs",
        F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
    )
    nodes = stored(inner.unionByName(root))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("c").alias("pc"))
    nodes = nodes.join(above, ["d", "p1", "p2"], "left")
    nodes = stored(nodes.withColumn("pd", F.when(F.col("d") > 0, F.col("d") - 1)))
    children = nodes.where("d > 0").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(F.count("*").alias("kids"))
    tree = nodes.join(children, ["c", "d"], "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    tree = tree.withColumns({"n_leaves": F.when(F.col("kids") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    tree = stored(tree.select("c", "d", "x1", "x2", "pc", "pd", "n_convs", "kids", *sums))
    totals = contracted(tree, sums, block_bits)
    last = rows.select("conv_id", F.col("depth").alias("d"), "x1", "x2").join(convs.select("conv_id", F.col("length").alias("d")), ["conv_id", "d"])
    turnless = convs.where("length = 0").select("conv_id", *(F.lit(0).cast("long").alias(n) for n in ("d", "x1", "x2")))
    ends = last.select("conv_id", "d", "x1", "x2").unionByName(turnless).select("d", "x1", "x2", "conv_id")
    ends = ends.repartition("d", "x1", "x2").sortWithinPartitions("d", "x1", "x2", "conv_id")
    ends = ends.mapInArrow(digests, "d long, x1 long, x2 long, ends_sha256 string")
    out = tree.drop(*sums).join(totals, ["c", "d"]).join(ends, ["d", "x1", "x2"], "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs",
        F.col("kids").alias("n_children"), *sums, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
