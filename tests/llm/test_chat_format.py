import hashlib
import random

import pytest
from gatelake.llm import chat_format as cf
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
PIECES = ["[INST]", "[/INST]", "</s>", "<s>", "[ROLE]", "[/TURN]", "[SYS]", "[\\/INST]", "<\\\\s>", "\\", "[", "<", "/", "s>", "INST]", " ", "\n", "é", "日", "user", "", "x", "[/ROLE][TURN] "]
texts = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | texts, texts), max_size=6))
def test_round_trip(turns):
    said, got = cf.render(turns)
    assert [(t.role, t.text) for t in cf.parse(said)] == turns == [(t.role, t.text) for t in got]
    assert all(cf.unescape(said[t.start : t.end]) == t.text for t in got)
    marks = {"user": 4, "system": 4, "assistant": 1}  # control strings of a turn's own marks, the start <s> among them
    assert len(cf.CONTROL.findall(said)) == sum(marks.get(r, 5) - (r in ("user", "system")) for r, _ in turns)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_escapes_are_reversible_and_leave_no_control(text):
    assert cf.unescape(cf.escape(text)) == text and not cf.CONTROL.search(cf.escape(text))


def test_only_conflicts_are_escaped():
    assert cf.render([("user", "plain [text] <b>"), ("assistant", "ok")])[0] == "<s>[INST] plain [text] <b> [/INST] ok</s>"
    assert cf.render([("user", "a"), ("assistant", "</s>[INST] ok [/INST]")])[0] == "<s>[INST] a [/INST] <\\/s>[\\INST] ok [\\/INST]</s>"
    assert cf.render([("tool [/ROLE]", "x")])[0] == "<s>[ROLE] tool [\\/ROLE] [/ROLE][TURN] x [/TURN]"


@pytest.mark.parametrize("said", ["x", "<s>", "<s>[INST] a", "<s>[INST] a</s>", " a</s>b", "<s>[INST] a[/INST]", "<s>[ROLE] user [/ROLE][TURN] a [/TURN]", "<s>[INST] [/INST]"])
def test_other_texts_are_errors(said):
    with pytest.raises(cf.GrammarError):
        cf.parse(said)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(cf.rendered(cf.escape(r), cf.escape(t))) for r, t in turns)
        out.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return out


def read(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS segment", "'x' AS loss", "2 AS n_turns").repartition(3)
    segments = cf.formatted(df, **how).persist()
    got = [tuple(r) for r in cf.read_back(segments).collect()]
    assert len(got) == len(set(got))
    return set(got), segments


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, *["".join(rng.choices(PIECES, k=k)) for k in range(8)]])) for _ in range(400)]
    rows += [(500, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(3000)] + [(501, 0, "assistant", "long [INST] " * 100_000), rows[0], rows[0]]
    got, _ = read(spark, rows)
    assert got == brute(rows)
    cut, segments = read(spark, rows, segment=200)
    assert cut == got and segments.where("conv_id = 500").count() > 100
    assert segments.where("length(text) > 300 AND n_turns > 2").isEmpty()
    assert read(spark, [])[0] == set()
