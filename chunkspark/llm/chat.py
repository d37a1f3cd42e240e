"""Chat formatting with Spark expressions alone: collect turns, sort, merge neighbours of one role, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One training text for each conversation: (conversation, n_turns, n_messages, chat).

    A message is written ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed; neighbouring turns of one role
    become one message, joined by a line feed. So that no turn can forge a mark, a ``<|`` in a text or role is written
    ``<\\|``, and one with backslashes in between gets a further one; taking one backslash off restores it. Turns
    are sorted by (turn, role, text), nulls first; equal rows count once; ties can't be told apart. Texts of any length are whole.
    A null role is ``unknown``, a null text is empty; rows with a null conversation are left out; other columns are
    ignored; an empty table gives an empty table. The work is linear in the turns.
    """
    def plain(column: str, default: str) -> Column:
        return F.regexp_replace(F.coalesce(quoted(column), F.lit(default)), r"<(\\*)\|", r"<\\$1|")

    turn = F.struct(quoted(turn_col).alias("turn"), plain(role_col, "unknown").alias("role"), plain(text_col, "").alias("text"))
    t = F.array_distinct(F.sort_array(F.collect_list(turn)))
    chats = turns.where(quoted(conv_col).isNotNull()).groupBy(quoted(conv_col).alias("conv")).agg(t.alias("t"))
    begins = F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[greatest(i - 1, 0)].role)")
    message = F.expr("transform(begins, (b, j) -> concat('<|', t[b].role, '|>\n', array_join(transform(slice(t, b + 1, coalesce(get(begins, j + 1), size(t)) - b), x -> x.text), '\n'), '<|end|>\n'))")
    return (
        chats.withColumn("begins", begins)
        .withColumn("messages", message)
        .select(F.col("conv").alias(conv_col), F.size("t").cast("bigint").alias("n_turns"), F.size("begins").cast("bigint").alias("n_messages"), F.array_join("messages", "").alias("chat"))
    )
