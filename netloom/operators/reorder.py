"""Orderings of lines by a whole recursive bisection, and their blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import AXIS
from .ordinal import compact, ordinal

#: Rank of left, cut and right lines by mode.
RANKS = {"prefix": (1, 0, 2), "infix": (0, 1, 2), "postfix": (0, 2, 1)}


def line_keys(nz: DataFrame, axis: str, p: int, mode: str = "infix") -> DataFrame:
    """``idx, key``: one digit per split the line takes part in, parts 0..p-1 being halved as in recursive bisection.

    A line lies left or right of a split if all its parts do; the first split that separates its parts cuts it, which ends
    its path. Only a line's smallest and largest part matter.
    """
    left, cut, right = (F.lit(str(r)) for r in RANKS[mode])
    d = nz.groupBy(F.col(AXIS[axis]).alias("idx")).agg(F.min("part").alias("a"), F.max("part").alias("b"))
    d = d.withColumns({"lo": F.lit(0), "hi": F.lit(p), "key": F.lit("")})
    for _ in range(math.ceil(math.log2(p)) if p > 1 else 0):
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        d = d.withColumns({"mid": mid, "open": (F.col("hi") - F.col("lo") > 1)})
        digit = F.when(~F.col("open"), F.lit("")).when(F.col("b") < F.col("mid"), left).when(F.col("a") >= F.col("mid"), right).otherwise(cut)
        d = d.withColumn("digit", digit).withColumns({
            "key": F.concat("key", "digit"),
            "hi": F.when(F.col("digit") == "", F.col("hi")).when(F.col("b") < F.col("mid"), F.col("mid")).when(F.col("a") >= F.col("mid"), F.col("hi")).otherwise(F.col("lo")),
            "lo": F.when(F.col("digit") == "", F.col("lo")).when(F.col("b") < F.col("mid"), F.col("lo")).when(F.col("a") >= F.col("mid"), F.col("mid")).otherwise(F.col("lo")),
        })
    return d.select("idx", "key")


def recursive_order(nz: DataFrame, axis: str, p: int, mode: str = "infix") -> DataFrame:
    """``pos, idx, key``: lines in the order of all splits, old order inside a block."""
    keys = line_keys(nz, axis, p, mode)
    # At most 2 p - 1 blocks, numbered in the order of their keys: equal digits so far, then the digit.
    names = keys.select("key").distinct().withColumn("block", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))
    return ordinal(keys.join(F.broadcast(names), "key"), "block", "idx").select("pos", "idx", "key")


def blocks(order: DataFrame) -> DataFrame:
    """``ord, start, size, key, parent``: the blocks of an order with their boundaries; the parent is the part of the tree
    that the block's last split halved, as the key up to it."""
    b = order.groupBy("key").agg(F.min("pos").alias("start"), F.count("*").alias("size"))
    return compact(b, "start", "ord").join(b, "start").select("ord", "start", "size", "key", F.expr("left(key, length(key) - 1)").alias("parent"))
