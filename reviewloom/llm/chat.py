"""Chat formatting with Spark expressions only.

Template, one conversation a string::

    ### user: text</turn>text of the next turn of the same role</turn>
    ### assistant: text</turn>

A block begins with ``### role: ``; every turn of it ends with ``</turn>``; blocks are separated by a line
break. Inside roles and texts a backslash becomes two, ``#`` becomes ``\\#`` and ``</`` becomes ``<\\/`` (in roles also
``:`` becomes ``\\:``), so the marks never occur in them and :func:`read_turns` gives back exactly what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, COLON, END, BREAK = "### ", ": ", "</turn>", "\n"


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("#"), F.lit("\\#"))
    text = F.replace(text, F.lit("</"), F.lit("<\\/"))
    return F.replace(text, F.lit(":"), F.lit("\\:")) if role else text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """``(conv, formatted, loss array<struct<start, length>>)``, one row per conversation.

    Turns are put in order by ``(turn, role, text)``, nulls first; repeated rows stay repeated. Null texts and roles
    are empty ones; a null ``conv`` is a conversation of its own. ``loss`` holds the spans (code points from
    0) of the texts of ``loss_role``, marks not included. Other columns are left out; an empty table gives no rows.

    Offsets come from running sums in the order of the turns, so a long conversation costs no more per turn than a
    short one; the turn structs are then collected, sorted and cut at the changes of role.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    rows = (rows.withColumn("at", F.row_number().over(order))
            .withColumn("before", F.lag("role").over(order)))
    opens = F.col("before").isNull() | (F.col("before") != F.col("role"))
    head = F.concat(F.when(F.col("at") > 1, F.lit(BREAK)).otherwise(F.lit("")),
                    F.lit(HEAD), escape(F.col("role"), True), F.lit(COLON))
    rows = rows.select(
        "conv", "at", (F.col("role") == loss_role).alias("loss"), opens.alias("opens"),
        F.when(opens, head).otherwise(F.lit("")).alias("head"), escape(F.col("text")).alias("body"))
    # The same window partition and order as above: no further shuffle or sort.
    length = F.length("head") + F.length("body") + F.lit(len(END))
    rows = rows.withColumn("start", F.sum(length.cast("long")).over(W.partitionBy("conv").orderBy("at")) - length
                           + F.length("head"))
    sorted_turns = F.sort_array(F.collect_list(F.struct("at", "opens", "head", "body", "loss", "start")))
    chats = rows.groupBy("conv").agg(sorted_turns.alias("turns"))
    number = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), number - 1), lambda k: F.get("turns", k)["opens"])
    # Adjacent turns of one role: the slice of the array between two openings becomes one block.
    blocks = F.transform("starts", lambda s, k: F.struct(
        F.get("turns", s)["head"].alias("head"),
        F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), number) - s),
                    lambda t: F.concat(t["body"], F.lit(END))).alias("texts")))
    return (chats.withColumn("starts", starts).withColumn("blocks", blocks).select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], ""))), "")
        .alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(
            t["start"].alias("start"), F.length(t["body"]).cast("long").alias("length"))).alias("loss")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.filter(F.split(formatted, HEAD, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        # The role ends at the first colon that no backslash precedes; what follows the last mark is the line break.
        role = F.regexp_extract(block, r"(?s)^((?:[^\\:]|\\.)*): ", 1)
        parts = F.split(F.substr(block, F.length(role) + 3), END, -1)
        return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda t: F.struct(
            unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, cut from the formatted string and unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
