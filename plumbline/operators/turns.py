"""Conversation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.prompts import MESSAGES
from plumbline.operators.rows import exploded

BLOCK = 4_096


def visible_history(turns: DataFrame, key: str = "sample_id", block: int = BLOCK) -> DataFrame:
    """What a model sees at each turn: messages and characters so far.

    ``turn`` is a whole number, unique per conversation. The running totals
    are taken inside blocks of ``block`` turns and then shifted by the totals
    of the earlier blocks, so a conversation of any length is spread over
    many tasks.
    """
    rows = turns.select(
        key,
        "turn",
        "role",
        F.length("content").cast("bigint").alias("_chars"),
        F.floor(F.col("turn") / block).alias("_block"),
    )
    totals = rows.groupBy(key, "_block").agg(
        F.count("*").alias("_n"), F.sum("_chars").alias("_c")
    )
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        key,
        "_block",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"),
    )
    within = (
        Window.partitionBy(key, "_block")
        .orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = rows.withColumns(
        {"_rn": F.count("*").over(within), "_rc": F.sum("_chars").over(within)}
    )
    return running.join(offsets, [key, "_block"]).select(
        key,
        "turn",
        "role",
        (F.col("_n0") + F.col("_rn")).alias("num_messages"),
        (F.col("_c0") + F.col("_rc")).alias("num_chars"),
    )


def request_histories(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Messages of the request at each turn, for samples that hold their turns.

    ``turns`` and ``responses`` are arrays of one sample; the history grows by
    one user and one assistant message per turn.
    """
    size = F.size("turns")
    numbers = F.when(size > 0, F.sequence(F.lit(0), size - 1))
    return exploded(
        samples, key, "turns", "responses", array=numbers, item="turn", pos="_pos"
    ).select(
        key, "turn", _history(F.col("turn")).alias("messages")
    )


def _history(turn: Column) -> Column:
    exchanges = F.transform(
        F.slice("turns", 1, turn + 1),
        lambda text, i: F.filter(
            F.array(
                F.struct(F.lit("user").alias("role"), text.alias("content")),
                F.when(
                    i < turn,
                    F.struct(
                        F.lit("assistant").alias("role"),
                        F.coalesce(F.get("responses", i), F.lit("")).alias("content"),
                    ),
                ),
            ),
            lambda m: m.isNotNull(),
        ),
    )
    return F.flatten(exchanges).cast(MESSAGES)
