"""Conversation structure repair: cheapest edits to alternating turns by rank-convergence parallel Viterbi."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from insight_spark.llm.common import prepare
from insight_spark.operators.ordered import PART_BITS, consecutive, laid_out
from insight_spark.session import stored

# Costs of the edits, the roles that may be written, and what a truncated turn adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CHUNK, CHUNK_BYTES = 128, 1 << 20
# States: nothing written, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
WRITTEN = {USER: "user", ASSISTANT: "assistant"}
CODES = {"s": 0, "u": 1, "a": 2}
OTHER, CUT = 3, 4
FAR = 1 << 40
SPACE = "\\x20\\x09-\\x0D"

CHUNKS = (
    "conv_id long, at long, whole boolean, lead long, codes binary, after array<long>, roles array<string>,"
    " texts array<string>, n_rows long, blank long, duplicate long, truncated long, illegal long,"
    " first_initial string, last_initial string, first_turn long, last_turn long, turns long"
)


def closed(c0: int, c1: int, c2: int, c3: int) -> tuple[int, int, int, int]:
    """Costs once turns may be inserted first."""
    b2, b3 = min(c2, INSERT + c3), min(c3, INSERT + c2)
    return min(c0, INSERT + b2), min(c1, INSERT + b2), b2, b3


END = closed(0, 1 << 20, 1 << 20, 0)  # after the last row only START and ASSISTANT are complete


def kept_state(code: int, state: int) -> int | None:
    """State after keeping a row of that code, None where it can't stay as it is."""
    kind = code % CUT
    if kind == CODES["s"]:
        return SYSTEM if state == START else None
    if kind == CODES["u"]:
        return USER if state != USER else None
    return ASSISTANT if kind == CODES["a"] and state == USER else None


def before(code: int, v: tuple[int, ...]) -> tuple[int, int, int, int]:
    """Cheapest costs to the end from each state before a row, given those after it."""
    cut = TRUNCATED if code >= CUT else 0
    costs = []
    for state in range(4):
        best = min(DELETE + v[state], REROLE + cut + v[NEXT[state]])
        stays = kept_state(code, state)
        costs.append(best if stays is None else min(best, cut + v[stays]))
    return closed(*costs)


STEPS: dict[tuple, tuple[tuple[int, ...], int]] = {}


def relative(v: tuple[int, ...]) -> tuple[int, ...]:
    low = min(v)
    return tuple(x - low for x in v)


def stepped(code: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """before() on vectors whose least entry is 0, up to a constant. There are few such vectors."""
    if (code, v) not in STEPS:
        STEPS[code, v] = relative(before(code, v))
    return STEPS[code, v]


def backward(codes: bytes, v: tuple[int, ...]) -> tuple[int, ...]:
    for code in reversed(codes):
        v = stepped(code, v)
    return v


def fixed_up(codes: bytes, old: tuple[int, ...], out: tuple[int, ...], new: tuple[int, ...]) -> tuple[int, ...]:
    """Outgoing costs for new incoming ones; the rerun stops where both runs differ by a constant only."""
    for code in reversed(codes):
        if old == new:
            return out
        old, new = stepped(code, old), stepped(code, new)
    return new


def transfer(codes: bytes) -> list[int]:
    """Cheapest costs from each state before the rows to each state after them, row by row of a 4 x 4 matrix."""
    columns = []
    for state in range(4):
        v = closed(*(0 if s == state else FAR for s in range(4)))
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [min(columns[t][s], FAR) for s in range(4) for t in range(4)]


def traced(codes: bytes, incoming: tuple[int, ...], state: int, last: bool):
    """The ASCII-least of the cheapest edits from a state: (letter, row or None, state after) each."""
    costs = [incoming]
    for code in reversed(codes):
        costs.append(before(code, costs[-1]))
    costs.reverse()
    for k, code in enumerate(codes):
        cut = TRUNCATED if code >= CUT else 0
        while True:
            left, after = costs[k][state], costs[k + 1]
            if DELETE + after[state] == left:
                yield "D", k, state, DELETE
                break
            if INSERT + costs[k][NEXT[state]] == left:
                state = NEXT[state]
                yield "I", None, state, INSERT
                continue
            stays = kept_state(code, state)
            if stays is not None and cut + after[stays] == left:
                state = stays
                yield "K", k, state, cut
            else:
                state = NEXT[state]
                yield "R", k, state, REROLE + cut
            break
    while last and state in (SYSTEM, USER):
        state = NEXT[state]
        yield "I", None, state, INSERT


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fields(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}
    out = []
    for name, kind in (c.split() for c in ddl.split(",")):
        inner = kind.removeprefix("array<").removesuffix(">")
        out.append((name, pa.list_(kinds[inner]) if inner != kind else kinds[kind]))
    return pa.schema(out)


def chunked(most: int, most_bytes: int):
    """Rows in order -> runs of at most so many live rows of one conversation. Rows that must go are counted only."""
    schema = fields(CHUNKS)

    def run(batches):
        at, out, chunk, size, began = None, [], None, 0, False

        def flush(ends: bool):
            nonlocal at, chunk, size, began
            if chunk is not None:
                chunk["whole"] = began and ends
                out.append(tuple(chunk[n] for n in schema.names))
                at, chunk, size = at + 1, None, 0
            began = ends

        for batch in batches:
            for conv, turn, role, text, copies, blank, again, cut, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None:
                    at = place >> PART_BITS << PART_BITS
                elif chunk is not None and chunk["conv_id"] != conv:
                    flush(True)
                initial = role[:1]
                live = not (blank or again)
                if chunk is not None and live and (len(chunk["roles"]) >= most or size >= most_bytes):
                    flush(False)
                if chunk is None:
                    chunk = {"conv_id": conv, "at": at, "lead": 0, "codes": b"", "after": [], "roles": [], "texts": []}
                    chunk |= dict.fromkeys(("n_rows", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
                    chunk |= {"first_initial": initial, "last_initial": None, "first_turn": None, "last_turn": None}
                if chunk["last_initial"] is not None:
                    chunk["illegal"] += chunk["last_initial"] + initial not in ("su", "ua", "au")
                chunk["illegal"] += copies - 1
                chunk["last_initial"] = initial
                if turn is not None and chunk["last_turn"] != turn:
                    chunk["turns"] += 1
                    chunk["first_turn"] = turn if chunk["first_turn"] is None else chunk["first_turn"]
                    chunk["last_turn"] = turn
                chunk["n_rows"] += copies
                dead = copies - live
                if blank:
                    chunk["blank"] += copies
                else:
                    chunk["duplicate"] += dead
                if live:
                    chunk["truncated"] += cut
                    chunk["codes"] += bytes([CODES.get(initial, OTHER) + CUT * cut])
                    chunk["roles"].append(role)
                    chunk["texts"].append(text)
                    chunk["after"].append(dead)
                    size += len(role) + len(text)
                elif chunk["after"]:
                    chunk["after"][-1] += dead
                else:
                    chunk["lead"] += dead
            if out:
                yield record(out, schema)
                out = []
        flush(False)
        if out:
            yield record(out, schema)

    return run


def flagged(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and their faults: blank, seen at an earlier turn, cut off."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    own = own.withColumns({"said": said, "place": place})
    first = own.groupBy("conv_id", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("first_conv"), F.col("said").alias("first_said"), "first")
    both = own["conv_id"].eqNullSafe(F.col("first_conv")) & (own["said"] == F.col("first_said"))
    return own.join(first, both, "left").select(
        *("conv_id", "turn", "role", "text", "copies"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (F.col("first").isNotNull() & (F.col("place") != F.col("first"))).alias("again"),
        (~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")).alias("cut"),
    )


def doubled(own: DataFrame, step: int, combine) -> DataFrame:
    """at, conv_id, value -> value combined over all chunks of the conversation from this one in the direction
    of step (1 or -1), by doubling: as many joins as the longest conversation's chunks have binary digits."""
    longest = own.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    reach = 1
    while reach < longest:
        other = own.select((F.col("at") - step * reach).alias("at"), F.col("conv_id").alias("other_conv"), F.col("value").alias("far"))
        near = own.join(other, "at", "left")
        same = F.col("other_conv").eqNullSafe(F.col("conv_id")) & F.col("far").isNotNull()
        own = stored(near.select("at", "conv_id", F.when(same, combine("value", "far")).otherwise(F.col("value")).alias("value")))
        reach *= 2
    return own


def products(a: str, b: str):
    """Min-plus product of 4 x 4 matrices kept as lists of 16."""
    one = f"transform(sequence(0, 3), k -> {a}[int(n div 4) * 4 + k] + {b}[k * 4 + n % 4])"
    return F.expr(f"transform(sequence(0, 15), n -> least(array_min({one}), {FAR}L))")


STATE = "conv_id long, at long, codes binary, incoming array<int>, outgoing array<int>, last boolean"


def backward_costs(split: DataFrame, passes: int) -> DataFrame:
    """Incoming and outgoing costs, up to constants, of the chunks of conversations that have several.

    Every chunk starts from the costs after a last row, as if it were the last. Then each takes its
    successor's outgoing costs; where they differ by more than a constant, it is run again until the two
    runs agree. A pass moves only changed vectors, and the passes end when none changes. Runs of rows that
    never forget (alternate reroling, say) carry a difference on: what is unsettled after `passes` is
    given the exact product of its successors' cost matrices.
    """
    schema = fields(STATE)

    def started(batches):
        for batch in batches:
            rows = [(c, a, codes, END, backward(codes, END), True) for c, a, codes in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield record(rows, schema)

    def again(batches):
        for batch in batches:
            rows = []
            for conv, at, codes, old, out, _, new, last in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows.append((conv, at, codes, new, fixed_up(codes, tuple(old), tuple(out), tuple(new)), last))
            yield record(rows, schema)

    def matrices(batches):
        kind = fields("conv_id long, at long, value array<long>")
        for batch in batches:
            yield record([(c, a, transfer(codes)) for c, a, codes in zip(*(x.to_pylist() for x in batch.columns), strict=True)], kind)

    def with_next(state: DataFrame, following: DataFrame) -> DataFrame:
        """What each chunk should start from, and whether it is its conversation's last."""
        after = following.select((F.col("at") - 1).alias("at"), F.col("conv_id").alias("next_conv"), F.col("outgoing").alias("next_out"), F.lit(True).alias("is_there"))
        own = F.coalesce("is_there", F.lit(False)) & F.col("next_conv").eqNullSafe(F.col("conv_id"))
        end = F.array(*map(F.lit, END))
        return state.join(after, "at", "left").select(
            *state.columns, F.when(own, F.col("next_out")).otherwise(end).alias("wanted"), (~own).alias("is_last")
        )

    state = stored(split.select("conv_id", "at", "codes").mapInArrow(started, STATE))
    names = state.columns
    for _ in range(passes):
        moved = stored(with_next(state, state))
        stale = "wanted <> incoming OR is_last <> last"
        if moved.where(stale).isEmpty():
            return state
        fresh = moved.where(stale).mapInArrow(again, STATE)
        state = stored(moved.where(f"NOT ({stale})").select(*names).unionByName(fresh))
    moved = stored(with_next(state, state))
    if moved.where("wanted <> incoming OR is_last <> last").isEmpty():
        return state
    suffix = doubled(stored(split.select("conv_id", "at", "codes").mapInArrow(matrices, "conv_id long, at long, value array<long>")), 1, products)
    # costs to the end from the start of each chunk: its product on the costs after the last row, least 0
    end = "array(" + ", ".join(f"{x}L" for x in END) + ")"
    raw = F.expr(f"transform(sequence(0, 3), s -> array_min(transform(sequence(0, 3), t -> value[s * 4 + t] + {end}[t])))")
    whole = suffix.withColumn("raw", raw).select("at", "conv_id", F.expr("transform(raw, x -> int(x - array_min(raw)))").alias("outgoing"))
    return stored(with_next(state, whole).select("conv_id", "at", "codes", F.col("wanted").alias("incoming"), "outgoing", F.col("is_last").alias("last")))


def entry_states(settled: DataFrame) -> DataFrame:
    """at -> state in which the trace enters the chunk, by composing what each chunk does to the four states."""
    kind = "conv_id long, at long, value array<int>"

    def maps(batches):
        schema = fields(kind)
        for batch in batches:
            rows = []
            for conv, at, codes, incoming, last in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                ends = []
                for state in range(4):
                    for _, _, state, _ in traced(codes, tuple(incoming), state, last):
                        pass
                    ends.append(state)
                rows.append((conv, at, ends))
            yield record(rows, schema)

    own = stored(settled.select("conv_id", "at", "codes", "incoming", "last").mapInArrow(maps, kind))
    through = doubled(own, -1, lambda later, earlier: F.transform(earlier, lambda s: F.get(F.col(later), s)))
    previous = through.select((F.col("at") + 1).alias("at"), F.col("conv_id").alias("from_conv"), F.get("value", F.lit(START)).alias("state"))
    entered = own.select("at", "conv_id").join(previous, "at", "left")
    same = F.col("from_conv").eqNullSafe(F.col("conv_id")) & F.col("state").isNotNull()
    return entered.select("at", F.when(same, F.col("state")).otherwise(F.lit(START)).alias("state"))


EDITED = "audit string, cost long, roles array<string>, texts array<string>"


def edited(batches):
    """Chunks with their costs and entry states -> letters of the edits, their cost, and the turns they leave."""
    own = fields(CHUNKS)
    kept = [n for n in own.names if n not in ("codes", "after", "lead", "roles", "texts")]
    schema = pa.schema([own.field(n) for n in kept] + list(fields(EDITED)))
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            letters, cost, roles, texts = ["D" * row["lead"]], DELETE * row["lead"], [], []
            for letter, k, state, price in traced(row["codes"], tuple(row["incoming"]), row["state"], row["last"]):
                cost += price
                letters.append(letter)
                if k is not None:
                    letters.append("D" * row["after"][k])
                    cost += DELETE * row["after"][k]
                if letter != "D":
                    roles.append(row["roles"][k] if letter == "K" else WRITTEN[state])
                    texts.append("" if k is None else row["texts"][k])
            rows.append((*(row[n] for n in kept), "".join(letters), cost, roles, texts))
        yield record(rows, schema)


def repaired_chunks(conversations: DataFrame, chunk: int = CHUNK, passes: int = 8, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Runs of each conversation in order (at), with the letters of their edits and the turns they leave.

    conversations: conv_id, turn, role, text; other columns are ignored; null role or text is one space, a
    null conv_id a conversation of its own. Rows are taken by turn (nulls first), then role and text. A row is
    blank (no character but space and \\t-\\r), else a duplicate (role and text seen earlier), else truncated
    (its last other character is none of . ! ?). Edits and costs: Keep 0, Rerole to user or assistant 3,
    Delete 4 (blank and duplicate rows must go), Insert an empty user or assistant turn 3; a truncated row
    that stays adds 3. The cheapest edits are taken that leave nothing, or an optional system turn and then
    user and assistant turns by turns, by the first letter of the role (an empty role has none and can't be
    kept); of equally cheap ones the letters that come first in ASCII.

    Rows are dealt by range, so a conversation of any length spreads over tasks. Rows that must go take no
    part in the search; equal rows are one with their number. The others form chunks of at most `chunk`
    rows or about chunk_bytes of text: backward costs start from a guess in every chunk and are mended by
    passes (see backward_costs), and the trace enters each chunk in the state its predecessors lead to.
    """
    prepare(conversations.sparkSession)
    rows = stored(flagged(conversations))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "text"]
    laid = laid_out_by_prefix(rows, order).select("conv_id", "turn", "role", "text", "copies", "blank", "again", "cut", "at")
    chunks = stored(laid.mapInArrow(chunked(chunk, chunk_bytes), CHUNKS))
    chunks = stored(consecutive(chunks, "at"))
    settled = backward_costs(chunks.where("NOT whole"), passes)
    states = stored(settled.select("at", "incoming", "last").join(entry_states(settled), "at"))
    end = F.array(*map(F.lit, END))
    alone = chunks.where("whole").select("*", end.alias("incoming"), F.lit(True).alias("last"), F.lit(START).alias("state"))
    ready = alone.unionByName(chunks.where("NOT whole").join(states, "at").select(*alone.columns))
    kept = [f for f in chunks.drop("codes", "after", "lead", "roles", "texts").schema.fields]
    return ready.mapInArrow(edited, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", " + EDITED)


def laid_out_by_prefix(rows: DataFrame, order: list) -> DataFrame:
    """laid_out by conversation, turn, role and the text's beginning; sorted by the whole text as well."""
    dealt = rows.repartitionByRange(*order[:-1]).sortWithinPartitions(*order[:3], order[-1])
    return dealt.withColumn("at", F.monotonically_increasing_id())


def repaired_turns(chunks: DataFrame) -> DataFrame:
    """conv_id, at, place, role, text: the turns that repaired_chunks leaves, in order of at and place."""
    return chunks.select("conv_id", "at", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")).select(
        "conv_id", "at", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text")
    )


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string"
)


def reported(batches):
    """Chunks in order -> one row per conversation. Texts go through the digest as they come; none is kept."""
    schema = fields(REPORT)
    empty, total = True, None

    def row():
        t = total
        gaps = t["last_turn"] - t["first_turn"] + 1 - t["turns"] if t["turns"] else 0
        return (t["conv_id"], gaps, *(t[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(t["audit"]), t["sha"].hexdigest())

    for batch in batches:
        out = []
        for conv, initial, final, first, last, turns, blank, again, cut, illegal, cost, audit, roles, texts in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if empty or total["conv_id"] != conv:
                if not empty:
                    out.append(row())
                empty, total = False, {"conv_id": conv, "first_turn": None, "last_turn": None, "initial": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                total |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
            t = total
            for name, value in (("blank", blank), ("duplicate", again), ("truncated", cut), ("illegal", illegal), ("cost", cost)):
                t[name] += value
            t["illegal"] += t["initial"] is not None and t["initial"] + initial not in ("su", "ua", "au")
            t["initial"] = final
            t["turns"] += turns - (turns > 0 and t["last_turn"] == first)
            t["first_turn"] = first if t["first_turn"] is None else t["first_turn"]
            t["last_turn"] = t["last_turn"] if last is None else last
            t["audit"].append(audit)
            for role, text in zip(roles, texts, strict=True):
                t["sha"].update((("\n" if t["any"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                t["any"] = True
        yield record(out, schema)
    if not empty:
        yield record([row()], schema)


def repair_report(conversations: DataFrame, ids: DataFrame | None = None, **options) -> DataFrame:
    """One row per conversation: faults, cost and letters of the edits, digest of what they leave.

    gaps counts the turns missing between the least and the greatest; illegal the adjacent rows whose roles'
    first letters are not su, ua or au. With ids (conv_id), every id there gets a row, and one without rows
    zeros, no letters and the digest of nothing. An empty table gives no row but those. The chunks of a
    conversation pass through one task in order, which holds the letters but no texts.
    """
    chunks = repaired_chunks(conversations, **options)
    names = ["conv_id", "first_initial", "last_initial", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts"]
    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "at").select(*names)
    found = dealt.mapInArrow(reported, REPORT)
    if ids is None:
        return found
    all_ids = ids.select(F.col("conv_id").cast("long").alias("an_id")).distinct()
    blank = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    columns = [F.coalesce(c, blank.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "conv_id"]
    return all_ids.join(found, F.col("an_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("an_id").alias("conv_id"), *columns)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with damage by a rule on conversation and turn (null: one space): of twenty
    parts, one loses the row, one its text, one its . ! ?, one has it twice, and one gets the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return (
        conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )
