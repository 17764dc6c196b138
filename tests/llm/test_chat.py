"""Chat formatting: reversible, masks exactly the assistant texts, native plan."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import chat


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        kept = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(kept), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_query_equals_plain_reading(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    out = chat.op3_chat_formatting(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == brute(rows)
    assert all(r.formatted_chars > r.loss_chars for r in out)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = chat.op3_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


CONTROL = st.lists(st.sampled_from(["<|end|>", "<|turn|>", "<|says|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "a", " ", "\n", "é", "\U0001f600"]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|says|>", ""]), CONTROL), min_size=25, max_size=40))
def test_round_trip_of_control_strings(spark, turns):
    df = spark.createDataFrame([(k, [{"role": r, "content": x}]) for k, (r, x) in enumerate(turns)], "k long, messages array<struct<role:string,content:string>>")
    out = chat.format_chat(df).select("k", "formatted", chat.parse_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()
    for row in out:
        r, x = turns[row.k]
        assert [tuple(t) for t in row.back] == [(r, x)]
        assert row.m == (x if r == "assistant" else "")
        assert row.formatted.count("<|turn|>") == row.formatted.count("<|end|>") == 1


def test_layouts_by_fingerprint(spark):
    schema = "id int, prompt string, response string, instruction string, input string, output string, conversations array<struct<`from`:string,value:string>>, turns string"
    rows = [
        (1, "p", "r", None, None, None, None, "mine"),
        (2, None, None, "do", None, "done", None, None),
        (3, None, None, "do", "this", "done", None, None),
        (4, None, None, None, None, None, [("human", "h"), ("gpt", "g")], None),
        (5, "p", None, None, None, None, None, None),
        (6, None, None, None, None, None, [], None),
    ]
    out = {r.id: r for r in chat.format_chat(spark.createDataFrame(rows, schema)).collect()}
    assert [out[k].layout for k in range(1, 7)] == ["prompt", "instruction", "instruction", "conversations", None, "conversations"]
    assert [tuple(t) for t in out[3].turns_] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert [tuple(t) for t in out[4].turns_] == [("user", "h"), ("assistant", "g")]
    assert out[5].turns_ is None and out[6].turns_ == [] and out[1].turns == "mine"
    assert chat.format_chat(spark.createDataFrame(rows, schema).limit(0)).count() == 0


def test_fingerprints_look_at_the_leaves(spark):
    kind = "id int, messages array<struct<role:string,content:string>>"
    rows = [(1, [("user", "a"), ("assistant", None)]), (2, [("user", None)]), (3, []), (4, None), (5, [(None, "x")]), (6, [("user", "")])]
    out = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns], r.fingerprint) for r in chat.canonical_turns(spark.createDataFrame(rows, kind)).collect()}
    assert out[1][:2] == ("messages", [("user", "a"), ("assistant", "")]) and out[6][:2] == ("messages", [("user", "")])
    assert all(out[k][0] is None and out[k][1] is None for k in (2, 4, 5)) and out[3][:2] == ("messages", [])
    assert out[1][2] == out[6][2] == out[3][2] != out[2][2] and len({out[k][2] for k in (1, 2, 4, 5)}) == 4
