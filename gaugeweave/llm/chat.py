"""Chat rendering with cumulative-snapshot collapse, in DataFrame expressions only.

A service that logs a conversation after every turn stores each conversation many times, each a prefix of the next.
A rolling hash of the turns up to each turn identifies prefixes: two 64-bit hashes of (position, role, text) are
combined turn by turn. A conversation goes if its whole hash is the prefix hash of a longer one (anti-join); of equal
conversations the one with the smallest id stays. What stays is rendered.

Both sides of the anti-join hold a hash once, so a conversation opening that a third of the log shares is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gaugeweave.llm.tables import columns
from gaugeweave.session import materialize


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, at, last, role, text, h1, h2)``: turns in order (turn, role, text), with hashes of all turns so far.

    Null roles and texts count as empty. Rows without a conversation id are left out: they belong to none.
    """
    own = columns(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    own = own.selectExpr("conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = own.withColumns({"at": F.row_number().over(order), "last": F.lead("conv_id").over(order).isNull()})
    first = F.xxhash64("at", "role", "text")
    second = F.xxhash64(F.lit("second"), "text", "at", "role")
    return numbered.select(
        "conv_id", "at", "last", "role", "text", F.bit_xor(first).over(so_far).alias("h1"), F.bit_xor(second).over(so_far).alias("h2")
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_logged)`` of the conversations that are no prefix of a longer one."""
    whole = turns.where("last").groupBy("at", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    # A hash after n turns that is continued by another turn in some conversation.
    continued = turns.where("NOT last").select("at", "h1", "h2").distinct()
    kept = whole.join(continued, ["at", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("at").alias("n_turns"), "n_logged")


def render(conversations: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> DataFrame:
    """``conv_id, n_turns, n_logged, text`` of the maximal conversations; a turn is opening, role, line feed, text, closing."""
    turns = materialize(turns_of(conversations), "turns")
    kept = maximal(turns)
    piece = F.concat(F.lit(opening), "role", F.lit("\n"), "text", F.lit(closing), F.lit("\n"))
    texts = turns.select("conv_id", "at", piece.alias("piece")).join(kept.select("conv_id"), "conv_id", "left_semi")
    texts = texts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    texts = texts.select("conv_id", F.array_join("pieces.piece", "").alias("text"))
    return kept.join(texts, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_logged", "text")
