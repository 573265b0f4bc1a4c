"""Chat formatting with Spark expressions only: sorted turn structs, merged runs, reversible escapes.

A formatted conversation is a sequence of runs. A run opens with ``<|im_start|>role`` and a line feed, holds the texts
of adjacent turns of that role with ``<|im_sep|>`` between them, and ends with ``<|im_end|>`` and a line feed.

Escapes: a control string in a text gets a backslash after its first character; one that has backslashes there already
gets one more. Taking one away from every such string therefore gives the text back, and no escaped text holds a control
string. In roles, backslash, line feed and the openers of control strings are escaped the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: First character, backslashes, remainder of every control string, those of other templates included.
CONTROL = r"([<\[])(\\*)(\|im_(?:start|sep|end)\|>|\|endoftext\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|im_(?:start|sep|end)\|>|\|endoftext\|>|/?s>|/?INST\])"
#: Turns whose structs are collected together; a longer conversation is formatted in chunks of turns.
CHUNK = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a doubled backslash must not meet the n after it: split on pairs first
    pairs = F.split(role, r"\\\\")
    plain = F.transform(pairs, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(plain, "\\"))


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted`` from rows ``conv_id, turn, role, text`` (other columns are not read).

    Turns are sorted by ``turn`` (null first), then role and text, so ties and repeated rows have one order and all of
    them stay. Null roles and texts are empty; rows with a null ``conv_id`` form one conversation. An empty table
    gives an empty result. Turns are collected in chunks dealt by ``(conv_id, turn range)`` and each chunk becomes one
    string before chunks of a conversation meet, so no task holds the structs of a conversation of any length.
    """
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chunk = F.floor(F.col("turn") / CHUNK)
    packed = (turns.groupBy("conv_id", chunk.alias("chunk"))
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")))
    # each turn: what stands between it and the turn before, then its text
    joined = F.transform("t", lambda x, i: F.concat(
        F.when(i == 0, F.lit("")).when(F.get(F.col("t"), i - 1)["role"] == x["role"], F.lit(SEP))
        .otherwise(F.concat(F.lit(f"{END}\n{START}"), escape_role(x["role"]), F.lit("\n"))),
        escape(x["text"])))
    pieces = packed.select("conv_id", "chunk", F.element_at("t", 1)["role"].alias("head"),
                           F.element_at("t", -1)["role"].alias("tail"), F.array_join(joined, "").alias("body"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "head", "tail", "body")))
                                          .alias("c"))
    glued = F.transform("c", lambda x, i: F.concat(
        F.when((i > 0) & (F.get(F.col("c"), i - 1)["tail"] == x["head"]), F.lit(SEP))
        .otherwise(F.concat(F.when(i > 0, F.lit(f"{END}\n")).otherwise(F.lit("")), F.lit(START),
                            escape_role(x["head"]), F.lit("\n"))),
        x["body"]))
    return whole.select("conv_id", F.concat(F.array_join(glued, ""), F.lit(f"{END}\n")).alias("formatted"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """``turns array<struct<role, text>>`` read back from ``formatted``, the loss mask being the assistant's turns."""
    runs = F.transform(
        F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != ""),
        lambda run: F.struct(
            unescape_role(F.substring_index(run, "\n", 1)).alias("role"),
            F.transform(F.split(F.substring(run, F.locate("\n", run) + 1,
                                            F.length(run) - F.locate("\n", run) - len(END) - 1),
                                r"<\|im_sep\|>", -1), unescape).alias("texts")))
    turns = F.flatten(F.transform(runs, lambda r: F.transform(
        r["texts"], lambda t: F.struct(r["role"].alias("role"), t.alias("text")))))
    return chats.withColumn("turns", turns)


def read_back(chats: DataFrame, trained: str = "assistant") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read from ``conv_id, formatted`` alone."""
    t = parse_chats(chats)
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == trained), lambda x: x["text"]), "")
    return t.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
