import hashlib

import pytest
from lodeworks.llm import chat_format, registry
from lodeworks.sources.tables import table
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, `a.b` int"
HARD = ["", None, "</s>[INST] ok [/INST]", "<|end|>", "<|turn user|>", "\\l\\\\<", "\\", "[|<\\p", "é😀\n<s>", "x" * 40_000]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_as_plain_python(spark, sf_dir):
    turns = {}
    for r in table(spark, sf_dir, "conversations").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in registry.op4_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(turns)
    for k, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        x = got[k]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss))


def test_control_strings_are_read_back(spark):
    rows = [(1, i, role, text) for i, text in enumerate(HARD) for role in ("user", "assistant", "<|end|>", None)]
    chats = chat_format.format_chats(frame(spark, rows))
    x = chats.select("formatted", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    want = sorted((i, r or "", t or "") for _, i, r, t in rows)
    assert [(t.role, t.text) for t in x.t] == [(r, t) for _, r, t in want]
    assert x.m == "".join(t for _, r, t in want if r == "assistant")
    assert x.formatted.count("<|end|>") == len(rows) and "</s>" not in x.formatted and "[INST]" not in x.formatted


def test_parts(spark):
    part = "kind string, text string, ref string, width int, height int, seconds double, pages int"
    parts = [("text", "look <", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3), ("odd", "x", "d", None, None, None, None), None, ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 1, "assistant", parts[:2])], f"conv_id int, turn int, role string, parts array<struct<{part}>>")
    x = chat_format.format_chats(df, text=None, parts="parts").first()
    assert x.formatted == "<|turn user|>look \\l<|image 0|><|audio 1|><|document 2|><|file 3|><|file 4|><|end|><|turn assistant|><|end|><|turn assistant|>look \\l<|image 0|><|end|>"
    assert [(a.turn_no, a.n, a.kind, a.ref, a.tokens) for a in x.attachments] == [(0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 38), (0, 2, "document", "c.pdf", 768), (0, 3, "file", "d", 1), (0, 4, "file", None, 1), (2, 0, "image", "a.png", 3)]
    assert [x.formatted[s.start : s.stop] for s in x.loss_spans] == ["look \\l<|image 0|>"]


def test_texts_go_through_the_visitor(spark, sf_dir, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "a <b>"), (1, 1, "assistant", None)], "conv_id int, turn int, role string, text string")
    one = df.select("conv_id", "turn", "role", F.array(chat_format.part_of(F.col("text"))).alias("parts"))
    assert chat_format.format_chats(df).collect() == chat_format.format_chats(one, text=None, parts="parts").collect()
    monkeypatch.setattr(chat_format, "visit", lambda parts: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        registry.op4_chat_format(spark, sf_dir)


def test_ties_nulls_repeats_and_nothing(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "assistant", "z"), (1, None, "user", "first"), (None, 1, "user", "x"), (None, 1, "user", "x")]
    got = {r.conv_id: [tuple(t) for t in r.t] for r in chat_format.format_chats(frame(spark, rows)).select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", "first"), ("assistant", "z"), ("user", "a"), ("user", "b")], None: [("user", "x"), ("user", "x")]}
    assert chat_format.digests(chat_format.format_chats(frame(spark, []))).count() == 0
