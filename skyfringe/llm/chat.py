"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text); neighbours of one role become one block
with an array of texts. A conversation is written as

    ### user: first text</turn>second text of the same role</turn>### assistant: answer</turn>

A header opens each block and an end mark closes each turn, so texts that share a block can be told apart again. Inside
texts and roles a backslash is doubled, and ``</``, ``##`` and, in roles, ``: `` get a backslash between their two
characters; no mark of the template can then occur in them, and dropping one backslash before each character gives
the text back. The loss mask is a list of run lengths, one (before, loss, after) a turn, that add up to the whole string:
the characters of an assistant's escaped text count, headers and marks don't.

One shuffle brings a conversation together; everything after it is a function of the row and linear in the number of turns.
A conversation is one string, so one conversation must fit in a task; conversations of any number are spread by conv_id.

Defined results: null texts and roles count as empty; rows of equal turn go by role and text, null turns first; repeated rows are
turns each; rows without a conv_id are one conversation without one; an empty table gives an empty table; long texts
are taken whole; further columns, whatever their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>"


def escape(text: Column) -> Column:
    """``text`` without any mark of the template."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</"), F.lit("<\\/")), F.lit("##"), F.lit("#\\#"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(AFTER_ROLE), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _blocks(turns: Column) -> Column:
    """Sorted turns to (role, texts) with neighbours of one role merged. A block reaches from one first turn to the next."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    bounds = F.concat(starts, F.array(F.size(turns)))
    pairs = F.zip_with(starts, F.slice(bounds, 2, F.size(starts)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda p: F.struct(F.get(turns, p["a"])["role"].alias("role"), F.transform(F.slice(turns, p["a"] + 1, p["b"] - p["a"]), lambda t: t["text"]).alias("texts")))


def format_conversations(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """conv_id, blocks (role, texts), formatted and loss_mask of every conversation of (conv_id, turn, role, text)."""
    empty = lambda c: F.coalesce(turns[c].cast("string"), F.lit("")).alias(c)
    rows = turns.select("conv_id", F.struct(turns["turn"], empty("role"), empty("text")).alias("t"))
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    merged = each.select("conv_id", _blocks(F.col("turns")).alias("blocks"))

    def pieces(b: Column) -> Column:
        head = lambda i: F.when(i == 0, F.concat(F.lit(HEAD), escape_role(b["role"]), F.lit(AFTER_ROLE))).otherwise("")
        return F.transform(b["texts"], lambda t, i: F.struct(head(i).alias("head"), escape(t).alias("body"), (b["role"] == loss_role).alias("loss")))

    cut = merged.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    run = lambda p: F.struct(
        (F.length(p["head"]) + F.when(p["loss"], 0).otherwise(F.length(p["body"]))).alias("before"),
        F.when(p["loss"], F.length(p["body"])).otherwise(0).alias("loss"),
        F.lit(len(END)).alias("after"),
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return cut.select("conv_id", "blocks", text.alias("formatted"), F.transform("pieces", run).alias("loss_mask"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), losses (the texts under the mask) and formatted_chars, from ``formatted`` and ``loss_mask``
    alone. A turn of a merged block has the role of the header before it."""
    marked = F.split("formatted", END)
    cut = formatted.select("conv_id", "formatted", "loss_mask", F.slice(marked, 1, F.size(marked) - 1).alias("pieces"))

    def part(p: Column, i: Column) -> Column:
        headed = p.startswith(HEAD)
        at = F.instr(p, AFTER_ROLE)
        role = F.when(headed, unescape(F.substring(p, len(HEAD) + 1, at - 1 - len(HEAD))))
        body = F.when(headed, F.substring(p, at + len(AFTER_ROLE), F.length(p))).otherwise(p)
        return F.struct(role.alias("role"), unescape(body).alias("text"), i.alias("i"))

    parts = cut.withColumn("parts", F.transform("pieces", part))
    heads = F.filter("parts", lambda t: t["role"].isNotNull())
    bounds = F.concat(F.transform(heads, lambda t: t["i"]), F.array(F.size("parts")))
    blocks = F.zip_with(heads, F.slice(bounds, 2, F.size(heads)), lambda h, b: F.struct(h["role"].alias("role"), h["i"].alias("a"), b.alias("b")))
    named = parts.withColumn("__blocks", blocks)
    turns = F.flatten(F.transform("__blocks", lambda b: F.transform(F.slice("parts", b["a"] + 1, b["b"] - b["a"]), lambda t: F.struct(b["role"].alias("role"), t["text"].alias("text")))))
    under = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["loss"] > 0, unescape(F.substring(p, m["before"] + 1, m["loss"]))).otherwise(""))
    return named.select("conv_id", turns.alias("turns"), under.alias("losses"), F.length("formatted").cast("long").alias("formatted_chars"))
