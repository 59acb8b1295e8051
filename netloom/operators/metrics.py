"""Measures of a distributed matrix: lambdas, volumes, loads, bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXIS = {"row": "i", "col": "j"}


def comm(nz: DataFrame, axis: str) -> DataFrame:
    """Which parts occur in which line: ``idx, part``, distinct."""
    return nz.select(F.col(AXIS[axis]).alias("idx"), "part").distinct()


def lambdas(nz: DataFrame, axis: str, size: int | None = None) -> DataFrame:
    """``idx, lam``: number of parts in each line; with ``size`` empty lines have 0."""
    out = comm(nz, axis).groupBy("idx").agg(F.count("*").cast("int").alias("lam"))
    if size is None:
        return out
    return nz.sparkSession.range(size).select(F.col("id").alias("idx")).join(out, "idx", "left").fillna(0, ["lam"])


def histogram(lam: DataFrame, high: int) -> DataFrame:
    """``lam, n`` for 0..high."""
    n = lam.groupBy("lam").agg(F.count("*").alias("n"))
    return lam.sparkSession.range(high + 1).select(F.col("id").cast("int").alias("lam")).join(n, "lam", "left").fillna(0, ["n"])


def volumes(nz: DataFrame, axis: str) -> DataFrame:
    """One row: ``vol`` (lambda - 1), ``cut`` (lines with more than one part), ``vol_ll1`` (lambda (lambda - 1))."""
    lam = F.col("lam").cast("long")
    return lambdas(nz, axis).agg(
        F.coalesce(F.sum(lam - 1), F.lit(0)).alias("vol"), F.coalesce(F.sum((lam > 1).cast("long")), F.lit(0)).alias("cut"), F.coalesce(F.sum(lam * (lam - 1)), F.lit(0)).alias("vol_ll1")
    )


def cut_lines(nz: DataFrame, axis: str) -> DataFrame:
    return lambdas(nz, axis).where("lam > 1").select("idx")


def proc_stats(nz: DataFrame, owner: DataFrame, axis: str, p: int) -> DataFrame:
    """``part, ns, nr, nv``: sends, receives and components with given owners (null: unowned, ignored)."""
    owner = owner.where("part IS NOT NULL").select("idx", F.col("part").alias("owner"))
    c = comm(nz, axis).join(owner, "idx")
    away = c.where("part <> owner")
    ns = away.groupBy(F.col("owner").alias("part")).agg(F.count("*").alias("ns"))
    nr = away.groupBy("part").agg(F.count("*").alias("nr"))
    nv = owner.groupBy(F.col("owner").alias("part")).agg(F.count("*").alias("nv"))
    out = nz.sparkSession.range(p).select(F.col("id").cast("int").alias("part"))
    for x in (ns, nr, nv):
        out = out.join(x, "part", "left")
    return out.fillna(0, ["ns", "nr", "nv"])


def comm_summary(stats: DataFrame) -> DataFrame:
    """One row of totals and maxima."""
    return stats.agg(F.sum("ns").alias("vol"), F.max("ns").alias("max_send"), F.max("nr").alias("max_recv"), F.max("nv").alias("max_comp"), F.sum("nv").alias("components"))


def inevitable(nz: DataFrame, axis: str) -> DataFrame:
    """``part, sums``: cut lines that hold the part."""
    c = comm(nz, axis)
    return c.join(lambdas(nz, axis).where("lam >= 2"), "idx").groupBy("part").agg(F.count("*").alias("sums"))


def local_bounds(nz: DataFrame, axis: str) -> DataFrame:
    """``part, lb``: least possible maximum of sends and receives of a part, from its lines' lambdas alone.

    With L lines of lambda >= 2, all received at first: taking over a line of lambda r trades one receive for r - 1 sends.
    Taking the smallest lambdas first, whole classes while the sends stay within the receives, then part of one class.
    """
    lam = lambdas(nz, axis).where("lam >= 2")
    a = comm(nz, axis).join(lam, "idx").groupBy("part", "lam").agg(F.count("*").alias("n"))
    w = Window.partitionBy("part").orderBy("lam")
    a = a.withColumns({"total": F.sum("n").over(Window.partitionBy("part")), "c": F.sum(F.col("lam") * F.col("n")).over(w), "taken": F.sum("n").over(w)})
    a = a.withColumns({"c0": F.col("c") - F.col("lam") * F.col("n"), "taken0": F.col("taken") - F.col("n")})
    stop = F.col("total") - F.col("taken0") - F.floor((F.col("total") - F.col("c0")) / F.col("lam"))
    a = a.withColumn("lb", F.when(F.col("c") > F.col("total"), stop))
    return a.groupBy("part").agg(F.coalesce(F.min_by("lb", F.when(F.col("lb").isNotNull(), F.col("lam"))), F.max("total") - F.max("taken")).cast("long").alias("lb"))


def best_bound(nz: DataFrame, axis: str) -> DataFrame:
    """One row: ``local_lb, active, active_lb, best``."""
    lb = local_bounds(nz, axis).agg(F.coalesce(F.max("lb"), F.lit(0)).cast("long").alias("local_lb"), F.count("*").alias("active"))
    out = lb.crossJoin(volumes(nz, axis).select("vol"))
    out = out.withColumn("active_lb", F.when(F.col("active") > 0, F.ceil(F.col("vol") / F.col("active"))).otherwise(0).cast("long"))
    return out.select("local_lb", "active", "active_lb", F.greatest("local_lb", "active_lb").alias("best"))


def imbalance(weights: DataFrame, p: int) -> DataFrame:
    """One row over all p parts: ``min_w, max_w, avg_w, imbalance`` (max over mean) and ``imbalance_opt`` (over the rounded-up mean)."""
    w = weights.agg(F.min("weight").alias("lo"), F.max("weight").alias("max_w"), F.sum("weight").alias("total"), F.count("*").alias("n"))
    return w.select(F.when(F.col("n") < p, 0).otherwise(F.col("lo")).cast("long").alias("min_w"), "max_w", (F.col("total") / p).alias("avg_w"), (F.col("max_w") * p / F.col("total") - 1).alias("imbalance"), (F.col("max_w") / F.ceil(F.col("total") / p) - 1).alias("imbalance_opt"))


def i2f_volume(nz3: DataFrame, axis: str) -> DataFrame:
    """Cut lines of an exact two-way result: parts 0 and 1, 2 for free entries (which count as both)."""
    return nz3.groupBy(AXIS[axis]).agg(F.bit_or(F.col("part") + 1).alias("b")).agg(F.count_if(F.col("b") == 3).alias("vol"))


def i2f_imbalance(nz3: DataFrame) -> DataFrame:
    """The least imbalance that placing the free entries can reach."""
    w = nz3.agg(F.count_if(F.col("part") == 0).alias("a"), F.count_if(F.col("part") == 1).alias("b"), F.count_if(F.col("part") == 2).alias("f"))
    total = F.col("a") + F.col("b") + F.col("f")
    most = F.greatest(F.col("a"), F.col("b"), F.ceil(total / 2).cast("long"))
    return w.select(F.col("a").alias("w0"), F.col("b").alias("w1"), F.col("f").alias("free"), (2 * most / total - 1).alias("imbalance"))


def best_split_check(nz: DataFrame, m: int, n: int, p: int) -> DataFrame:
    """One row: does the distribution meet the volume bound ``(min(m, n) + 1)(p - 1)`` and have no part over ``ceil(nz / p)``?"""
    v = volumes(nz, "row").select(F.col("vol").alias("a")).crossJoin(volumes(nz, "col").select(F.col("vol").alias("b")))
    w = nz.groupBy("part").agg(F.count("*").alias("w")).agg(F.max("w").alias("w"), F.sum("w").alias("t"))
    return v.crossJoin(w).select((F.col("a") + F.col("b") <= (min(m, n) + 1) * (p - 1)).alias("volume_ok"), (F.col("w") <= F.ceil(F.col("t") / p)).alias("balanced"))


def mean_variance(runs: DataFrame, *columns: str) -> DataFrame:
    """Mean and population variance of each column, over all rows."""
    return runs.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_avg"), F.var_pop(c).alias(f"{c}_var"))])


def balance(weights: DataFrame, p: int) -> DataFrame:
    """``part, weight, procs``: processors in proportion to weight, at least one each, spare ones to the largest shortfalls."""
    every = Window.partitionBy()  # a row per part
    d = weights.withColumn("share", F.col("weight") * float(p) / F.sum("weight").over(every))
    d = d.withColumn("base", F.greatest(F.lit(1), F.floor("share")).cast("long"))
    d = d.withColumns({"k": F.row_number().over(Window.orderBy(F.col("base") - F.col("share"), "part")), "spare": p - F.sum("base").over(every)})
    return d.select("part", "weight", (F.col("base") + F.when(F.col("k") <= F.col("spare"), 1).otherwise(0)).alias("procs"))
