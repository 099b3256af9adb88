"""Chat formatting with Spark expressions only.

A conversation becomes one text: turns are sorted, adjacent turns of one role share a block,

    <|im_start|>role\\ntext<|im_next|>text<|im_end|>\\n<|im_start|>...

and control strings inside roles and texts are escaped, so that a text can neither end
its block nor open another, and reading back gives exactly the turns that went in.
``loss_spans`` are the places (0-based, in characters) of the assistant's texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import col

BLOCK, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"

# The backslash comes first when escaping and last when undoing it.  Every
# backslash of an escaped text is followed by one of these letters, so the order is enough
# to make the escapes reversible.
ESCAPES = [("\\", "\\b"), ("<|", "\\o"), ("</s>", "\\e"), ("<s>", "\\s"), ("[INST]", "\\i"), ("[/INST]", "\\j")]
LINE_END = ("\n", "\\n")
CHUNK_TURNS = 256
PIECE_CHARS = 4096


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return reduce(lambda t, pair: _replace(t, *pair), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, pair: _replace(t, pair[1], pair[0]), reversed(ESCAPES), text)


def _header(role: Column) -> Column:
    return _replace(escape(role), *LINE_END)


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans array<struct<at, length>>``.

    Turns are ordered by turn number, then role and text, so ties and repeated turns have one
    result; a turn without a number comes first.  A null role or text counts as empty.  Turns
    whose conversation is null form one conversation.  A conversation is one output row, so
    its turns meet in one task; conversations are never gathered together.
    """
    turn = F.struct(
        col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"),
        F.coalesce(col(text_col), F.lit("")).alias("text"))
    collected = turns.select(col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns"))

    def add(acc: Column, t: Column) -> Column:
        # ``at`` is the length so far; pieces are joined once at the end
        same = acc["role"].eqNullSafe(t["role"])
        body = escape(t["text"])
        head = F.when(same, F.lit(NEXT)).otherwise(F.concat(
            F.when(acc["role"].isNull(), F.lit("")).otherwise(F.lit(END)),
            F.lit(BLOCK), _header(t["role"]), F.lit("\n")))
        start = acc["at"] + F.length(head)
        span = F.struct(start.alias("at"), F.length(body).alias("length"))
        return F.struct(
            t["role"].alias("role"), (start + F.length(body)).alias("at"),
            F.concat(acc["pieces"], F.array(head, body)).alias("pieces"),
            F.when(t["role"] == trained_role, F.concat(acc["spans"], F.array(span)))
            .otherwise(acc["spans"]).alias("spans"))

    def state(role: Column, at: Column) -> Column:
        return F.struct(
            role.alias("role"), at.alias("at"), F.array().cast("array<string>").alias("pieces"),
            F.array().cast("array<struct<at:int,length:int>>").alias("spans"))

    def add_chunk(acc: Column, number: Column) -> Column:
        # arrays grow inside a chunk, and once per chunk outside: not once per turn of a long conversation
        chunk = F.slice("turns", number * CHUNK_TURNS + 1, F.lit(CHUNK_TURNS))
        done = F.aggregate(chunk, state(acc["role"], acc["at"]), add)
        return F.transform(F.array(done), lambda d: F.struct(
            d["role"].alias("role"), d["at"].alias("at"), F.concat(acc["pieces"], d["pieces"]).alias("pieces"),
            F.concat(acc["spans"], d["spans"]).alias("spans")))[0]

    chunks = F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / CHUNK_TURNS).cast("int"))
    start = state(F.lit(None).cast("string"), F.lit(0))
    merged = collected.withColumn("m", F.aggregate(chunks, start, add_chunk))
    return merged.select(
        "conv_id", F.concat(F.array_join("m.pieces", ""), F.lit(END)).alias("formatted"),
        F.col("m.spans").alias("loss_spans"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted texts back: ``conv_id, turns array<struct<role, text>>, loss_texts, formatted``."""
    blocks = F.split(F.col("formatted"), r"\Q" + END + r"\E", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def block_turns(block: Column) -> Column:
        cut = F.instr(block, "\n")
        role = F.substring(block, F.lit(len(BLOCK) + 1), cut - 1 - len(BLOCK))
        texts = F.split(F.substring(block, cut + 1, F.length(block)), r"\Q" + NEXT + r"\E", -1)
        plain_role = unescape(_replace(role, LINE_END[1], LINE_END[0]))
        return F.transform(texts, lambda t: F.struct(plain_role.alias("role"), unescape(t).alias("text")))

    turns = F.flatten(F.transform(blocks, block_turns))
    # spans are cut from short pieces: a place far into a long text is found by walking there
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("formatted") / PIECE_CHARS).cast("int")),
        lambda i: F.substring(F.col("formatted"), i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)))

    def text_at(pieces: Column, s: Column) -> Column:
        first, last = (F.floor(x / PIECE_CHARS).cast("int") for x in (s["at"], s["at"] + s["length"]))
        near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return unescape(F.substring(near, s["at"] % PIECE_CHARS + 1, s["length"]))

    # bound as an element, so that the pieces are made once and not for every span
    under_mask = F.transform(F.array(pieces), lambda p: F.transform("loss_spans", lambda s: text_at(p, s)))[0]
    return formatted.select("conv_id", turns.alias("turns"), under_mask.alias("loss_texts"), "formatted")


def conversation_digests(read: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of what was read back."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
