"""Chat formatting with Spark expressions only: sorted turn structs, adjacent same-role turns merged, one string a conversation.

A block is `[INST]role[/INST]text[NEXT]text</s>`; the whole string starts with `<s>`. Control strings inside
roles and texts get a backslash after their first character (one more if some are there), which unescape() takes out
again. Defined results: null texts and roles count as empty; turns are ordered by turn, role, text (null turns first);
repeated rows are turns of their own; rows with a null conv_id form one conversation, and any conversation is one string, which
Spark bounds by 2 GB; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

START, HEAD, BODY, NEXT, END = "<s>", "[INST]", "[/INST]", "[NEXT]", "</s>"
#: Code points of a stretch from which loss spans are cut.
STRETCH = 8192
#: First character of a control string, backslashes, the rest of it.
CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|NEXT\])"
ESCAPED = r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|NEXT\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: the places (from 0, end excluded, in code points) of the texts of role learn_from."""
    rows = turns.select(
        "conv_id", F.col("turn").alias("turn"), escape(F.coalesce(F.col("role"), F.lit(""))).alias("role"), escape(F.coalesce(F.col("text"), F.lit(""))).alias("text")
    )
    # Where a text begins is a running sum over its conversation's rows, in the order of the sorted structs below.
    order = W.Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    opening = F.length("role") + len(HEAD) + len(BODY)
    behind = F.when(before.isNull(), opening + len(START)).when(before == F.col("role"), F.lit(len(NEXT))).otherwise(opening + len(END))
    placed = rows.withColumn("behind", behind).withColumn("end", F.sum(F.col("behind") + F.length("text")).over(order.rowsBetween(W.Window.unboundedPreceding, 0)).cast("int"))
    turn = F.struct("turn", "role", "text", (F.col("end") - F.length("text")).alias("start"), "end")
    sorted_turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # A turn opens a block where its role differs from the one before; blocks keep the order of their first turns.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), i - 1)["role"]),
    )
    spans = F.transform(F.col("starts"), lambda s, k: F.struct(s.alias("at"), (F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns")) - s).alias("n")))
    blocks = F.transform(
        F.col("spans"),
        lambda s: F.struct(
            F.get(F.col("turns"), s["at"])["role"].alias("role"),
            F.transform(F.slice(F.col("turns"), s["at"] + 1, s["n"]), lambda t: t["text"]).alias("texts"),
        ),
    )
    learnt = F.transform(F.filter("turns", lambda t: t["role"] == F.lit(learn_from)), lambda t: t.dropFields("turn", "role", "text"))
    merged = sorted_turns.withColumn("starts", starts).withColumn("spans", spans).select("conv_id", blocks.alias("blocks"), learnt.alias("loss_spans"))
    rendered = F.transform("blocks", lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(BODY), F.array_join(b["texts"], NEXT), F.lit(END)))
    return merged.select("conv_id", F.concat(F.lit(START), F.array_join(rendered, "")).alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, in order, unescaped) and loss_text, from the formatted string and its spans alone."""
    body = F.substring(F.col("formatted"), F.lit(len(START) + 1), F.length("formatted"))
    blocks = F.filter(F.split(body, END), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = F.split(F.substring(b, F.lit(len(HEAD) + 1), F.length(b)), r"\[/INST\]")
        return F.transform(F.split(F.get(parts, F.lit(1)), r"\[NEXT\]"), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    # substring() walks from the start of its string: spans are cut from stretches of it. The stretches are exploded as one
    # row, so that they are a value of their own and not worked out again for each span.
    parts = F.transform(F.sequence(F.lit(0), F.length("formatted"), F.lit(STRETCH)), lambda i: F.substring(F.col("formatted"), i + 1, F.lit(STRETCH)))
    cut = formatted.select("conv_id", "formatted", "loss_spans", F.explode(F.array(parts)).alias("_parts"))

    def text(span: Column) -> Column:
        first = F.floor(span["start"] / STRETCH).cast("int")
        some = F.slice("_parts", first + 1, F.floor(span["end"] / STRETCH).cast("int") - first + 1)
        return unescape(F.substring(F.array_join(some, ""), span["start"] - first * STRETCH + 1, span["end"] - span["start"]))

    loss = F.array_join(F.transform("loss_spans", text), "")
    return cut.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_text"))
