"""Entries per line and part, kept up to date while entries change parts, with the lambdas and volumes that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(nz: DataFrame, part: str, n) -> DataFrame:
    lines = F.inline(F.array(F.struct(F.lit("row").alias("axis"), F.col("i").alias("idx")), F.struct(F.lit("col").alias("axis"), F.col("j").alias("idx"))))
    return nz.select(F.col(part).alias("part"), lines).select("axis", "idx", "part", F.lit(n).cast("long").alias("n"))


def counted(nz: DataFrame) -> DataFrame:
    """``axis, idx, part, n`` of ``nz(i, j, part)``: how many entries of each part a row or column has."""
    return _sides(nz, "part", 1).groupBy("axis", "idx", "part").agg(F.sum("n").alias("n"))


def moved(table: DataFrame, changed: DataFrame) -> DataFrame:
    """The table after the entries ``changed(i, j, was, part)`` went from one part to another: only these are counted."""
    change = _sides(changed, "was", -1).union(_sides(changed, "part", 1))
    return table.union(change).groupBy("axis", "idx", "part").agg(F.sum("n").alias("n")).where("n <> 0")


def lambdas(table: DataFrame) -> DataFrame:
    """``axis, idx, lam``: the number of parts of each line."""
    return table.groupBy("axis", "idx").agg(F.count("*").alias("lam"))


def volume(table: DataFrame) -> int:
    """Sum of lambda - 1 over all lines."""
    return lambdas(table).agg(F.coalesce(F.sum(F.col("lam") - 1), F.lit(0))).first()[0]
