import random

import pytest
from pyspark.sql import functions as F

from deskflow.llm.chat_format import CHAT, Template, format_conversations, loss_text, read_turns, spoken_text

KINDS = "conv_id long, turn long, role string, text string"


TEMPLATES = [
    CHAT,
    Template(head="<<", colon="> ", tail="|end|\n"),
    Template(head="<|start|>", colon="\n", tail="<|stop|>\n", titles={"system": "system", "user": "user", "assistant": "assistant"}),
    Template(head="", colon="::", tail="xxy", titles={"user": "U", "assistant": "A"}, loss=("assistant", "tool")),
]


def back(df, template=CHAT):
    done = format_conversations(df, template)
    turns = read_turns(F.col("formatted"), template)
    return {
        r.conv_id: r for r in done.select(
            "conv_id", "formatted", "valid", "segments", turns.alias("turns"), loss_text(F.col("segments")).alias("loss"),
            spoken_text(turns, template).alias("spoken"),
        ).collect()
    }


@pytest.mark.parametrize("template", TEMPLATES, ids=["built-in", "angles", "bars", "no head"])
def test_round_trip(spark, template):
    rng = random.Random(7)
    control = [template.head, template.colon, template.tail, template.tail[:-1], template.tail[1:], template.head[:1], template.tail[:1] * 2]
    parts = ["\\", "</turn>", "<\\/turn>", "###", "##", "#", "### User: ", "\n", "/", ":", "$1", "\\E", "é😀", "</turn>\n### Assistant: x", "a"] + control * 2
    roles = ["user", "assistant", "system", "tool", "a: b\\", None, "", "=", "User", "\\", *control, "".join(control)]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "".join(rng.choices(parts, k=rng.randrange(9)))]))
            for c in range(60) for t in range(rng.randrange(1, 150 if c < 3 else 9))]
    found = back(spark.createDataFrame(rows, KINDS).repartition(6), template)
    for c in range(60):
        turns = [(r or "", x or "") for i, _, r, x in rows if i == c]
        assert [tuple(t) for t in found[c].turns] == turns
        assert found[c].loss == found[c].spoken == "".join(x for r, x in turns if r in template.loss)
        assert "".join(s.text for s in found[c].segments) == found[c].formatted
        assert found[c].formatted.count(template.tail) == len(turns)
        for k, said in enumerate(found[c].segments[1::3]):
            assert template.tail not in said.text and (not template.head or template.head not in said.text), (c, k)


@pytest.mark.parametrize("parts", [
    {"tail": "\n"}, {"tail": "aaa"}, {"colon": ""}, {"head": "#"}, {"tail": "\\end"}, {"tail": "### User"}, {"tail": " end"}, {"tail": "r: x"},
    {"titles": {"user": "a:b"}}, {"titles": {"user": "=a"}}, {"titles": {"user": "a", "assistant": "a"}},
])
def test_refused_templates(parts):
    with pytest.raises(ValueError):
        Template(**parts)


def test_marks():
    assert [t.marks for t in TEMPLATES] == [["##", "</turn>"], ["<", "|end"], ["<|start|>", "<|stop|>"], ["xxy"]]


def test_state_machine(spark):
    talks = ["u a", "s u a", "u a u a", "u", "a", "s", "s a", "u u a", "u a a", "u a s u a", "u x", "u a " * 70, "u a " * 70 + "a", "s " + "u a " * 40 + "u"]
    role = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(c, t, role[r], "hi") for c, talk in enumerate(talks) for t, r in enumerate(talk.split())]
    found = back(spark.createDataFrame(rows, KINDS).repartition(4))
    assert [found[c].valid for c in range(len(talks))] == [True, True, True, False, False, False, False, False, False, False, False, True, False, False]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (1, None, "assistant", "last"), (1, -5, "user", "first"), (1, 2, "user", "b"), (1, 2, "user", "a"),
            (2, 0, None, None), (2, 0, None, None)]
    df = spark.createDataFrame(rows, KINDS).withColumns({"chunk": F.lit(1), "segments": F.lit("x"), "valid": F.lit(0)})
    found = back(df)
    assert [t.text for t in found[1].turns] == ["first", "a", "b", "last"] and found[None].valid and found[1].loss == "last"
    assert [tuple(t) for t in found[2].turns] == [("", ""), ("", "")] and not found[2].valid
    assert format_conversations(df.limit(0)).count() == 0


def test_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], KINDS)
    plan = format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
