"""Chat formatting by prefix-target expansion, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that the template's marks need, and what stands for them inside roles and texts.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))
OPEN, SHUT = "<turn ", "</turn>\n"
#: The role whose turns are trained on.
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    """The text without any of the template's own characters; null gives the empty string."""
    text = F.coalesce(text, F.lit(""))
    for mark, instead in ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(instead))
    return text


def unescaped(text: Column) -> Column:
    """Undo :func:`escaped`; the backslash comes last, so no replacement can meet another's output."""
    for mark, instead in reversed(ESCAPES):
        text = F.replace(text, F.lit(instead), F.lit(mark))
    return text


def expand_replies(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One training example for every assistant turn, with all turns before it as context.

    Returns ``(conv, example, formatted, loss_start, loss_chars, last)``: ``formatted``
    is the context and the reply, ``loss_start`` (code points, from 0) and
    ``loss_chars`` mark the escaped reply, the only trainable part.  If turns
    follow the last reply, or there is no reply, a last example without trainable
    text holds the whole conversation, so that no turn is lost.  ``last`` marks a
    conversation's last example.

    Turns are ordered by number, then role, then text; equal rows stay.  Null roles
    and texts are empty, a null turn number comes first, rows with a null
    conversation id form one conversation.  Other columns are ignored.  Examples
    grow with the square of a conversation's length, as the method demands; a
    conversation is the unit of work.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        escaped(F.col(text)).alias("text"),
    )
    formed = rows.withColumn("piece", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(">"), F.col("text"), F.lit(SHUT)))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = formed.select(
        "conv", "role", F.length("text").alias("chars"),
        F.collect_list("piece").over(upto).alias("pieces"),
        F.row_number().over(order).alias("example"), F.lead(F.lit(False), 1, True).over(order).alias("last"),
    )
    kept = seen.where((F.col("role") == TRAINED) | F.col("last"))
    trained = F.col("role") == TRAINED
    whole = kept.withColumn("formatted", F.array_join("pieces", ""))
    return whole.select(
        F.col("conv").alias(conv), "example", "formatted",
        F.when(trained, F.length("formatted") - F.col("chars") - len(SHUT)).alias("loss_start"),
        F.when(trained, F.col("chars")).otherwise(0).alias("loss_chars"), "last",
    )


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of each conversation, parsed from the formatted examples.

    Only the trainable part of an example and a conversation's last example are
    carried to the grouping, so what is grouped is linear in the input.
    """
    own = examples.select(
        F.col(conv).alias("conv"), "example", F.length("formatted").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), unescaped(F.expr("substring(formatted, loss_start + 1, loss_chars)"))).alias("reply"),
        F.when(F.col("last"), F.col("formatted")).alias("whole"),
    )
    grouped = own.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"),
    )
    turns = F.split("whole", SHUT, -1)
    said = F.transform(
        F.slice(turns, 1, F.size(turns) - 1),
        lambda t: F.concat(
            unescaped(F.substring_index(F.replace(t, F.lit(OPEN), F.lit("")), ">", 1)), F.lit("\n"),
            unescaped(F.substring_index(t, ">", -1)), F.lit("\n"),
        ),
    )
    reply = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return grouped.select(
        F.col("conv").alias(conv), (F.size(turns) - 1).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(reply).cast("bigint").alias("loss_chars"), F.sha2(reply, 256).alias("loss_sha256"), "formatted_chars",
    )
