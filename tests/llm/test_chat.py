"""Chat formatting against a plain parser, on texts made of marks and their neighbours."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxelgrove.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, id string, start int, formatted string, piece string"
BITS = ["[s>", "<INST]", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>", "\\", "\\\\", "<", "[", ">", "]", "s>", "/s>", " ", "\n", "a", "é", "😀", "INST]", "<\\s>", "[\\\\INST]", "<<ROLE x>> "]
ROLES = ["user", "assistant", "system", "tool", None, "", "x>y", "\\g", "\\b>", "a\\", "USER", "<s>", "[INST] "]


def plain_parse(s):
    """The turns of a formatted text, read mark by mark."""
    kinds = [("<<SYS>> ", " <</SYS>>", "system"), ("[INST] ", " [/INST]", "user"), ("<s> ", " </s>", "assistant")]
    turns, at = [], 0
    while at < len(s):
        for a, b, role in kinds:
            if s.startswith(a, at):
                break
        else:
            m = re.compile(r"<<ROLE ([^>]*)>> ").match(s, at)
            a, b, role = m[0], " <</ROLE>>", m[1].replace("\\g", ">").replace("\\b", "\\")
        end = s.index(b, at + len(a))
        inner = s[at + len(a) : end]
        assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|<<ROLE |<</ROLE>>", inner)
        turns.append((role, re.sub(r"([\[<])\\(\\*)(<SYS>>|</SYS>>|/?INST\]|/?s>|<ROLE |</ROLE>>)", r"\1\2\3", inner), at, end + len(b), at + len(a), end))
        at = end + len(b)
    return turns


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(max(1, n // 4)), rng.choice([0, 1, 2, 2, None]), rng.choice(ROLES), None if rng.random() < 0.05 else "".join(rng.choices(BITS, k=rng.randrange(9))), "x", 1, "y", "z") for _ in range(n)]


def turns_by_conversation(rows):
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_turn_comes_back(spark, seed):
    rows = rows_of(seed, 600) + [(None, 0, "user", "lost", "x", 1, "y", "z"), (900, 0, "user", "same", "x", 1, "y", "z"), (900, 0, "user", "same", "x", 1, "y", "z")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("spans"))).collect()
    want = turns_by_conversation(rows)
    assert {r["conv_id"] for r in got} == set(want)
    for r in got:
        parsed, turns = plain_parse(r["formatted"]), want[r["conv_id"]]
        assert [p[:2] for p in parsed] == turns == [tuple(t) for t in r["turns"]] and r["n_turns"] == len(turns)
        assert [(s["start"], s["start"] + s["chars"]) for s in r["spans"]] == [p[2:4] for p in parsed]
        masked = [(s["loss_start"], s["loss_start"] + s["loss_chars"]) for s in r["spans"] if s["loss_start"] is not None]
        assert masked == [p[4:] for p in parsed if p[0] == "assistant"]
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert r["n_escaped"] == sum(bool(re.search(chat.MARK, t) or re.search(chat.ESCAPED, t)) for _, t in turns)


def test_clean_texts_are_left_alone_and_marks_are_broken(spark):
    rows = [(1, 0, "user", "a < b [x] \\alpha", *"x1yz"), (2, 0, "assistant", "</s>[INST] ok [/INST]", *"x1yz")]
    rows = [(*r[:5], 1, *r[6:]) for r in rows]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["formatted"] == "[INST] a < b [x] \\alpha [/INST]" and got[1]["n_escaped"] == 0
    assert got[2]["formatted"] == "<s> <\\/s>[\\INST] ok [\\/INST] </s>" and got[2]["n_escaped"] == 1


def test_a_broken_text_does_not_parse(spark):
    bad = ["[INST] a", "x[INST] a [/INST]", "[INST] a [/INST] ", "[INST] <s> [/INST]", "<s> a [/INST]", "[INST]a[/INST]"]
    df = spark.createDataFrame([(b,) for b in bad], "s string")
    assert all(r["t"] is None for r in df.select(chat.parse_turns(F.col("s")).alias("t")).collect())
    assert spark.range(1).select(chat.parse_turns(F.lit("")).alias("t")).first()["t"] == []


def test_long_texts_and_no_rows(spark):
    long = "word </s> [x] " * 150_000
    out = chat.format_chats(spark.createDataFrame([(1, k, r, long, "x", 1, "y", "z") for k, r in enumerate(("user", "assistant", "other"))], SCHEMA)).first()
    assert [t["text"] for t in out["turns"]] == [long] * 3 and out["n_escaped"] == 3
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_has_no_python(spark):
    df = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a", "x", 1, "y", "z")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("hashpartitioning(id") == 1
