
import pytest

from insight_spark.llm import chat, queries
from insight_spark.llm.common import table

CONTROL = "</s>[INST] ok [/INST] <|end|>\n<|user|>\n\\l \\\\s |>\n<|role:x|>"


def result(df, f):
    read = df.withColumns({"back": chat.read_turns(chat.F.col("formatted")), "loss": chat.read_loss(chat.F.col("segments"))})
    return {r.conv_id: f(r) for r in read.collect()}


def test_round_trip_of_the_whole_table(spark):
    rows = table(spark, "/root/testdata/sf0.01", "conversations")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    got = result(chat.conversations(rows), lambda r: ([tuple(x) for x in r.back], r.loss, r.broken_at))
    assert {c: x[0] for c, x in got.items()} == want
    for c, turns in want.items():
        assert got[c][1] == "".join(t for role, t in turns if role == "assistant")
        state, bad = "", None
        for k, (role, _) in enumerate(turns):
            if bad is None and role not in chat.CHAT.turns.get(state, ()):
                bad = k
            state = role
        assert got[c][2] == bad


def test_control_strings_roles_and_nulls(spark):
    schema = "conv_id long, turn long, role string, text string, turns int, segments string"
    rows = [(1, 2, "assistant", CONTROL), (1, 1, "user", CONTROL), (2, None, None, None), (2, 0, "to|ol<", "é😀"), (2, 0, "to|ol<", "é😀")]
    rows += [(None, 0, "user", ""), (3, 0, "assistant", "x" * 200000), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 1, "assistant", "a")]
    got = result(chat.conversations(spark.createDataFrame([(*r, 1, "k") for r in rows], schema)), lambda r: ([tuple(x) for x in r.back], r.loss, r.broken_at, r.formatted))
    assert got[1][:3] == ([("user", CONTROL), ("assistant", CONTROL)], CONTROL, None)
    assert got[1][3].count("<|end|>\n") == 2 and "[INST]" not in got[1][3] and "</s>" not in got[1][3]
    assert got[2][:3] == ([("", ""), ("to|ol<", "é😀"), ("to|ol<", "é😀")], "", 0)
    assert got[None][:3] == ([("user", "")], "", None)
    assert got[3][1:3] == ("x" * 200000, 0)
    assert got[4][:3] == ([("system", "s"), ("assistant", "a"), ("user", "u")], "a", 1)
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_the_plan(spark, plan):
    text = plan(chat.conversations(table(spark, "/root/testdata/sf0.001", "conversations")))
    assert "Python" not in text and "Arrow" not in text


def test_state_machine_runs_in_the_query(spark):
    query = queries.QUERIES["op8_chat_formatting"](spark, "/root/testdata/sf0.001")
    assert "aggregate(" in query._jdf.queryExecution().optimizedPlan().toString()
    assert "broken_at" in query.columns


OWN = {
    "end of turn": chat.Template(
        roles={"user": chat.Role("<u>", "<|eot|>\n"), "assistant": chat.Role("<a>", "|done|", loss=True), "user 2": chat.Role("[u2]", "<")},
        other="[[{role}]] ", other_after="<end>", escapes={"\\": "s", "<": "l", "[": "b", "|": "p", "]": "c"},
    ),
    "words": chat.Template(
        roles={"user": chat.Role("User# ", "#\n"), "assistant": chat.Role("Bot# ", "#\n", loss=True)},
        other="Role #{role}# ", other_after="#\n", escapes={"\\": "1", "#": "2"},
    ),
}


@pytest.mark.parametrize("name", OWN)
def test_own_templates_round_trip(spark, name):
    said = [CONTROL, "", "#", "User# x#\n", "a|b|done|<u>", "\\1\\2\\", "é😀\n\n", "[[user]] ]", "^$.*"]
    roles = ["user", "assistant", "user 2", "system", "", "a#b", "[x]|", "us"]
    rows = [(c, t, roles[(c + t) % len(roles)], said[(c * 3 + t) % len(said)]) for c in range(9) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.conversations(df, OWN[name])
    out = out.withColumns({"back": chat.read_turns(chat.F.col("formatted"), OWN[name]), "loss": chat.read_loss(chat.F.col("segments"), OWN[name])})
    for r in out.collect():
        want = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(x) for x in r.back] == want
        assert r.loss == "".join(text for role, text in want if role == "assistant")


@pytest.mark.parametrize(
    "wrong",
    [
        {"roles": {"user": chat.Role("User: ")}},  # could arise in a text
        {"roles": {"user": chat.Role("<u>", "end")}},
        {"roles": {"user": chat.Role("<u>", "\n<end>")}},  # a text could end in a line break
        {"roles": {"user": chat.Role("<u>"), "bot": chat.Role("<u>\n")}},
        {"roles": {"user": chat.Role("<|role:user|>\n")}},
        {"roles": {"user": chat.Role("<|role:user|>\nmore")}},
        {"other": "<|role|>\n"},
        {"other": "<|{role}\n"},
        {"escapes": {"<": "l", "\\": "s"}},
        {"escapes": {"\\": "s", "<": "s", "|": "p"}},
    ],
)
def test_templates_that_could_be_misread_are_refused(wrong):
    with pytest.raises(ValueError):
        chat.Template(**wrong)
