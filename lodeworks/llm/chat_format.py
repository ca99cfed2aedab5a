"""Chat formatting with typed content parts (operator 4), DataFrame functions only.

A turn is rendered where it is read::

    <|turn ROLE|>CONTENT<|end|>

and a conversation is its turns in order. In roles and texts the characters ``\\ < [ |`` are written ``\\b \\l \\s \\p``,
so no control string of this or a common other template (``<s>``, ``</s>``, ``[INST]``, ``<|...|>``) survives inside
them, and reading back is exact. Content is a list of typed parts (a plain text is a list of one), which a visitor flattens in order: text is
escaped; image, audio and document parts become ``<|KIND N|>``, N counting the turn's attachments from 0, and are
recorded as (n, kind, ref, tokens), tokens being what the placeholder expands to.

The loss mask is a list of code-point spans of the formatted string, one for each assistant turn with content.

Only rendered turns are shuffled. A conversation is one row of the result, so its turns have to fit in one row; turns
of different conversations never share a buffer.

Defined cases: null text, role or part text is empty; a null part or a part of another kind gives ``<|file N|>`` of one
token, a null list no content. Turns are ordered by turn (nulls first), then role, then content, so ties and repeated
rows have one order. A null conv_id is a conversation like any other. Other columns, whatever their
names, are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.rows import named

ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), ("|", "\\p"))
END = "<|end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 256


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def expanded(part: Column) -> Column:
    """Tokens that a part's placeholder stands for."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.coalesce(
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_A_SECOND))
        .when(part["kind"] == "document", (part["pages"] * TOKENS_A_PAGE).cast("bigint")),
        F.lit(1).cast("bigint"),
    )


def visit(parts: Column) -> Column:
    """struct(content, attachments) of a list of parts, in order."""
    empty = F.struct(F.lit("").alias("content"), F.expr("cast(array() as array<struct<n:int,kind:string,ref:string,tokens:bigint>>)").alias("attachments"))

    def step(done: Column, part: Column) -> Column:
        n = F.size(done["attachments"])
        kind = F.when(part["kind"].isin("image", "audio", "document"), part["kind"]).otherwise("file")
        mark = F.concat(F.lit("<|"), kind, F.lit(" "), n.cast("string"), F.lit("|>"))
        item = F.struct(n.alias("n"), kind.alias("kind"), part["ref"].alias("ref"), expanded(part).alias("tokens"))
        is_text = F.coalesce(part["kind"] == "text", F.lit(False))
        return F.struct(
            F.concat(done["content"], F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)).alias("content"),
            F.when(is_text, done["attachments"]).otherwise(F.concat(done["attachments"], F.array(item))).alias("attachments"),
        )

    return F.aggregate(F.coalesce(parts, F.expr(f"cast(array() as {PARTS})")), empty, step)


def part_of(text: Column) -> Column:
    """A text as a typed part."""
    none = F.lit(None)
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None) -> DataFrame:
    """A row per conversation: conv_id, n_turns, formatted, loss_spans (start, stop), attachments (turn_no, n, kind, ref, tokens)."""
    # a text is a list of one part
    content = named(parts) if parts else F.array(part_of(named(text)))
    rendered = visit(content)
    who = F.coalesce(named(role), F.lit(""))
    rows = turns.select(named(conv_id).alias("conv_id"), named(turn).alias("t"), who.alias("r"), rendered.alias("c"))
    rows = rows.select("conv_id", F.struct("t", "r", F.col("c.content").alias("x"), F.col("c.attachments").alias("a"), F.concat(F.lit("<|turn "), escape(F.col("r")), F.lit("|>")).alias("h")).alias("turn"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))

    def span(done: Column, t: Column) -> Column:
        first = done["at"] + F.length(t["h"])
        stop = first + F.length(t["x"])
        masked = (t["r"] == "assistant") & (stop > first)
        here = F.array(F.struct(first.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(END)).alias("at"), F.when(masked, F.concat(done["spans"], here)).otherwise(done["spans"]).alias("spans"))

    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["h"], t["x"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", start, span, lambda d: d["spans"]).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["a"], lambda a: F.struct(i.alias("turn_no"), a["n"].alias("n"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text). Placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|end\|>")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(t: Column) -> Column:
        head = F.instr(t, "|>")
        return F.struct(
            unescape(F.substring(t, F.lit(len("<|turn ") + 1), head - len("<|turn ") - 1)).alias("role"),
            unescape(F.substring(t, head + 2, F.length(t))).alias("text"),
        )

    return F.transform(turns, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))), ""))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted``; n_attachments, attachment_tokens."""
    expanded_tokens = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"])
    back = chats.select("conv_id", "formatted", F.size("attachments").alias("n_attachments"), expanded_tokens.alias("attachment_tokens"), read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("n_attachments").cast("bigint").alias("n_attachments"),
        "attachment_tokens",
    )
