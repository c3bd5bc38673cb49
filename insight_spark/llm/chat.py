"""Chat formatting: turn order checked by a finite-state machine, texts written by a declarative template.

Built-in expressions only. A template names, for each role, what comes before and after a text and
whether the text counts for the loss; TURNS says which role may follow which.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import prepare


@dataclass(frozen=True)
class Role:
    before: str
    after: str = "<|end|>\n"
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """What is written around the texts of each role, and which role may follow which.

    escapes: characters that may not occur in a written text, and the letter that stands for each after a
    backslash; the backslash itself comes first. other: what comes before a text of any further role, whose
    name stands for {role}, and other_after what comes after it. A template is refused if one of its marks
    could arise in an escaped text, or if a written conversation could be read in two ways: every mark holds
    an escaped character other than the backslash, what follows a text or a role's name begins with one, and
    no mark before a text is the beginning of another.
    """

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<|system|>\n"),
            "user": Role("<|user|>\n"),
            "assistant": Role("<|assistant|>\n", loss=True),
        }
    )
    other: str = "<|role:{role}|>\n"
    other_after: str = "<|end|>\n"
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    escapes: dict[str, str] = field(default_factory=lambda: {"\\": "s", "<": "l", "[": "b", "|": "p"})

    def __post_init__(self):
        special, letters = self.special(), list(self.escapes.values())
        if list(self.escapes)[:1] != ["\\"] or any(len(c) != 1 for c in [*self.escapes, *letters]):
            raise ValueError("escapes map single characters to single letters, the backslash first")
        if len(set(letters)) < len(letters) or set(letters) & set(self.escapes):
            raise ValueError("letters of escapes differ from each other and from the escaped characters")
        if self.other.count("{role}") != 1:
            raise ValueError("other has one {role}")
        head, tail = self.other.split("{role}")
        before = [r.before for r in self.roles.values()] + [head]
        after = [r.after for r in self.roles.values()] + [self.other_after, tail]
        if not all(special & set(mark) for mark in before + after):
            raise ValueError("a mark without escaped character could arise in a text")
        if not all(mark[0] in special for mark in after):
            raise ValueError("what follows a text or a role's name begins with an escaped character")
        if any(a != b and (a.startswith(b) or b.startswith(a)) for a in before[:-1] for b in before[:-1]) or len(set(before)) < len(before):
            raise ValueError("marks before texts differ, and none is the beginning of another")
        if any(self.read_as_other(b) or head.startswith(b) for b in before[:-1]):
            raise ValueError("a role's mark could be read as the mark of other roles")

    def special(self) -> set[str]:
        """Characters that no written text holds."""
        return set(self.escapes) - {"\\"}

    def text_class(self) -> str:
        """Regular expression of a written text."""
        return "[^" + "".join(re.escape(c) for c in sorted(self.special())) + "]*+"

    def read_as_other(self, mark: str) -> bool:
        """Whether the mark could be the beginning of a turn of another role, or such a turn's mark its beginning."""
        head, tail = self.other.split("{role}")
        if not mark.startswith(head):
            return False
        rest = mark[len(head) :]
        name = re.match("[^" + "".join(re.escape(c) for c in sorted(self.special())) + "]*", rest).end()
        return rest[name:].startswith(tail) or tail.startswith(rest[name:])


CHAT = Template()


def quoted(mark: str) -> str:
    """A mark as a Java regular expression."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in mark)


def escaped(text: Column, template: Template = CHAT) -> Column:
    """The text without any of the template's special characters; the backslash goes first."""
    for char, letter in template.escapes.items():
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescaped(text: Column, template: Template = CHAT) -> Column:
    """The inverse of escaped: every backslash begins an escape, so its own is undone last."""
    for char, letter in reversed(template.escapes.items()):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def segments(turn: Column, template: Template) -> Column:
    """A turn as three segments (text, loss): before, the escaped text, after."""
    role = turn["role"]
    head, tail = template.other.split("{role}")
    before = F.concat(F.lit(head), escaped(role, template), F.lit(tail))
    after, loss = F.lit(template.other_after), F.lit(False)
    for name, spec in template.roles.items():
        before = F.when(role == name, F.lit(spec.before)).otherwise(before)
        after = F.when(role == name, F.lit(spec.after)).otherwise(after)
        loss = F.when(role == name, F.lit(spec.loss)).otherwise(loss)
    part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return F.array(part(before, F.lit(False)), part(escaped(turn["text"], template), loss), part(after, F.lit(False)))


def broken_at(turns: Column, template: Template) -> Column:
    """Number of the first turn (from 0) that may not stand where it does, or null: the machine's state is
    the last role, and it stays where it first failed."""
    def step(acc: Column, turn: Column) -> Column:
        ok = F.lit(False)
        for state, follow in template.turns.items():
            ok = ok | ((acc["state"] == state) & turn["role"].isin(*follow))
        bad = F.when(acc["bad"].isNull() & ~ok, acc["at"]).otherwise(acc["bad"])
        return F.struct(turn["role"].alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(turns, start, step, lambda acc: acc["bad"])


def conversations(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conv_id: n_turns, broken_at, segments (text, loss), formatted.

    Turns are taken in order of turn, then role, then text (null turns first); repeated rows are turns
    of their own. A null text or role is empty. Roles that the template does not name are written by
    its `other` marker and never count for the loss. Turns in a wrong order are formatted too, and
    broken_at says where the order fails first. A null conv_id is one conversation. Other columns are
    ignored; an empty table gives none. All turns of one conversation meet in one row, as its text is one
    value; conversations are spread over all tasks.
    """
    prepare(rows.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    grouped = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id")
    ordered = grouped.agg(F.array_sort(F.collect_list("t")).alias("turns"))
    written = ordered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        broken_at(F.col("turns"), template).alias("broken_at"),
        F.flatten(F.transform("turns", lambda t: segments(t, template))).alias("segments"),
    )
    return written.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """Roles and texts of a formatted conversation: array of (role, text).

    The reader comes from the template: a turn is one of its marks, a text without escaped characters, and
    what belongs after it.
    """
    body = template.text_class()
    head, tail = template.other.split("{role}")
    named = {name: (quoted(spec.before), quoted(spec.after)) for name, spec in template.roles.items()}
    other = f"{quoted(head)}{body}{quoted(tail)}"
    turns = [f"{before}{body}{after}" for before, after in named.values()] + [f"{other}{body}{quoted(template.other_after)}"]

    def turn(piece: Column) -> Column:
        # the other roles' mark is tried last, as written
        role = unescaped(F.regexp_extract(piece, f"^{quoted(head)}({body}){quoted(tail)}", 1), template)
        text = F.regexp_extract(piece, f"^{other}({body})", 1)
        for name, (before, _) in named.items():
            here = piece.startswith(template.roles[name].before)
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, F.regexp_extract(piece, f"^{before}({body})", 1)).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text, template).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit("|".join(turns)), F.lit(0)), turn)


def read_loss(written: Column, template: Template = CHAT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(written, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
