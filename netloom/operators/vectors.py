"""Vector distribution steps with closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import comm, lambdas
from .ordinal import ordinal


def unique_owners(nz: DataFrame, axis: str) -> DataFrame:
    """``idx, part``: lines with one part belong to it."""
    return comm(nz, axis).join(lambdas(nz, axis).where("lam = 1"), "idx").select("idx", "part")


def reduced(nz: DataFrame, axis: str) -> DataFrame:
    """The communication matrix of lines with two parts or more."""
    return comm(nz, axis).join(lambdas(nz, axis).where("lam >= 2"), "idx").select("idx", "part")


def fill_unowned(owner: DataFrame, p: int) -> DataFrame:
    """``idx, part``: unowned lines, in order, first raise every part to the largest count, part by part, then go around."""
    spark = owner.sparkSession
    have = spark.range(p).select(F.col("id").cast("int").alias("part")).join(owner.where("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("nv")), "part", "left").fillna(0, ["nv"])
    lack = have.withColumn("lack", F.max("nv").over(Window.partitionBy()) - F.col("nv"))  # p rows
    lack = lack.withColumn("upto", F.sum("lack").over(Window.orderBy("part"))).withColumn("after", F.col("upto") - F.col("lack"))
    free = ordinal(owner.where("part IS NULL").select("idx", F.lit(0).cast("long").alias("zero")), "zero", "idx", "r").select("idx", "r")
    total = lack.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("total"))
    free = free.crossJoin(F.broadcast(total))  # one row
    early = free.where("r < total").join(F.broadcast(lack.select("part", "after", "upto")), (F.col("r") >= F.col("after")) & (F.col("r") < F.col("upto"))).select("idx", "part")
    late = free.where("r >= total").select("idx", F.pmod(F.col("r") - F.col("total"), F.lit(p)).cast("int").alias("part"))
    return owner.where("part IS NOT NULL").select("idx", "part").union(early).union(late)


def fill_free_entries(nz3: DataFrame) -> DataFrame:
    """Free entries (part 2) in order of t: to the lighter of 0 and 1 until they are level, then in turn, 1 first."""
    w = nz3.agg(F.count_if(F.col("part") == 0).alias("w0"), F.count_if(F.col("part") == 1).alias("w1"))
    free = ordinal(nz3.where("part = 2").withColumn("zero", F.lit(0).cast("long")), "zero", "t", "r").drop("zero").crossJoin(F.broadcast(w))
    gap = F.abs(F.col("w0") - F.col("w1"))
    part = F.when(F.col("r") < gap, F.when(F.col("w0") < F.col("w1"), 0).otherwise(1)).otherwise(F.when((F.col("r") - gap) % 2 == 0, 1).otherwise(0))
    return nz3.where("part <> 2").unionByName(free.withColumn("part", part).select(*nz3.columns))


def common_parts(nz: DataFrame) -> DataFrame:
    """``idx, part``: parts in both row idx and column idx of a square matrix."""
    return comm(nz, "row").join(comm(nz, "col"), ["idx", "part"])


def move_free(nz: DataFrame, donor: int, receiver: int, p_donor: int = 1, p_receiver: int = 1) -> DataFrame:
    """Moves free entries of ``donor`` in order of t while the receiver, with them, is not relatively heavier than what is left."""
    from .matrix import free_nonzeros

    w = nz.agg(F.count_if(F.col("part") == donor).alias("wd"), F.count_if(F.col("part") == receiver).alias("wr"))
    free = ordinal(free_nonzeros(nz, donor, receiver).withColumn("zero", F.lit(0).cast("long")), "zero", "t", "r").select("t", "r").crossJoin(F.broadcast(w))
    s = F.col("r") + 1
    goes = ((F.col("wr") + s) * p_donor <= (F.col("wd") - s) * p_receiver) & ((F.col("wr") + 1) * p_donor < (F.col("wd") - 1) * p_receiver)
    moved = free.where(goes).select("t", F.lit(True).alias("moved"))
    return nz.join(moved, "t", "left").withColumn("part", F.when(F.col("moved"), F.lit(receiver)).otherwise(F.col("part"))).drop("moved")
