"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, and only
that reply under the loss mask. Turns after the last assistant turn (or a conversation that has
none) would be in no example, so the last turn always ends one more example, with an empty mask.

Template of a turn: ``### <role>: <text></turn>`` and a line end. Inside role and text a
backslash is doubled and the control strings get one backslash (``\\### ``, ``<\\/turn>``), a
colon in a role becomes ``<\\c>``; :func:`unescape` takes that back.

Defined results: null role or text count as empty; turns are ordered by ``turn`` (nulls first),
ties by role and text, repeated rows are turns of their own; rows with a null ``conv_id`` form
one conversation; an empty table gives no example; other columns are ignored.
A conversation is one row, as its examples need all of it; examples of n turns hold O(n * n)
characters by definition, but they are made one at a time and nothing else grows that way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
HEAD, END = "### ", "</turn>"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(HEAD), F.lit("\\" + HEAD))
    out = F.replace(out, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("<\\c>")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("<\\c>"), F.lit(":")) if role else text
    out = F.replace(out, F.lit("<\\/turn>"), F.lit(END))
    out = F.replace(out, F.lit("\\" + HEAD), F.lit(HEAD))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def expand_examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, target (1-based turn), formatted, loss_start (0-based code
    point), loss_chars (of the escaped reply; 0 where nothing is trained), is_last."""
    conv = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    conv = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    conv = conv.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(
            F.concat(F.lit(HEAD), escape(t["role"], role=True), F.lit(": ")).alias("head"),
            escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("train"))).alias("ts"))
    conv = conv.select("conv_id", "ts", F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))).alias("parts"))
    n = F.size("ts")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.element_at("ts", i)["train"])
    rows = conv.select("conv_id", "ts", "parts", F.explode(targets).alias("target"))
    t = F.element_at("ts", F.col("target"))
    rows = rows.select("conv_id", "target", t["head"].alias("head"), t["body"].alias("body"), t["train"].alias("train"),
                       (F.col("target") == n).alias("is_last"),
                       F.array_join(F.slice("parts", F.lit(1), F.col("target") - 1), "").alias("context"))
    return rows.select(
        "conv_id", "target",
        F.concat("context", "head", "body", F.lit(END + "\n")).alias("formatted"),
        (F.length("context") + F.length("head")).alias("loss_start"),
        F.when(F.col("train"), F.length("body")).otherwise(0).alias("loss_chars"), "is_last")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(formatted, END + "\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(HEAD) + 1), F.instr(p, ":") - len(HEAD) - 1), role=True).alias("role"),
        unescape(F.substring(p, F.instr(p, ":") + 2, F.length(p))).alias("text")))


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The reply under the mask, unescaped."""
    return unescape(F.substring(formatted, start + 1, chars))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say when read back: all turns (from the example
    of the last turn) and the trained text of all examples in order."""
    formatted = F.col("formatted")
    rows = examples.select(
        "conv_id", "target",
        F.when(F.col("is_last"), read_turns(formatted)).alias("turns"),
        read_loss(formatted, F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.length(formatted).cast("long").alias("chars"))
    rows = rows.select(
        "conv_id", "target", "loss", "chars", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"))
    done = rows.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.struct("target", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    done = done.select("conv_id", "n_turns", "turns_sha256", loss.alias("loss"), "formatted_chars", "n_examples")
    return done.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
