"""Combinations of two frames whose every pair is part of the result, as an equi-join of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Blocks of either side; their square is the number of groups that the combinations are made in.
BLOCKS = 16


def combined(left: DataFrame, right: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``; their columns must have different names.

    Each row lies in one block of its side by its hash and meets all blocks of the other, so that a task makes the combinations of two
    blocks and no side is sent whole to every task.
    """

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.array(*map(F.lit, range(blocks)))))

    return side(left, "__a", "__b").join(side(right, "__b", "__a"), ["__a", "__b"]).drop("__a", "__b")
