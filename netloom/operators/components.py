"""Connected components of the row/column graph of a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut


def matrix_components(nz: DataFrame, *, symmetric: bool = False, rounds: int = 200) -> DataFrame:
    """``i, label``: each non-empty row's component, named by its smallest row.

    Rows take the smallest row that shares a column, with pointer jumping, and are merged with it: from round to round fewer rows and
    entries are left, until no row has a smaller one; ``symmetric`` ties row k and column k.
    """
    e = nz.select("i", "j").distinct()
    if symmetric:
        e = e.union(e.select("j", "i")).union(e.select("i", "i")).union(e.select("j", "j")).distinct()
    e = cut(e)
    found = e.select("i").distinct().select("i", F.col("i").alias("label"))
    for _ in range(rounds):
        low = e.groupBy("j").agg(F.min("i").alias("low"))
        near = e.join(low, "j").groupBy("i").agg(F.min("low").alias("label"))
        jump = near.select(F.col("i").alias("label"), F.col("label").alias("up"))
        step = cut(near.join(jump, "label", "left").select("i", F.least("label", F.coalesce("up", "label")).alias("label")))
        moved = step.where("i <> label")
        if moved.isEmpty():
            return found
        found = cut(found.join(step.select(F.col("i").alias("label"), F.col("label").alias("to")), "label").select("i", F.col("to").alias("label")))
        e = cut(e.join(step, "i").select(F.col("label").alias("i"), "j").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def component_weights(nz: DataFrame, rows: DataFrame) -> DataFrame:
    """``label, weight``: entries of each component."""
    return nz.join(rows, "i").groupBy("label").agg(F.count("*").alias("weight"))
