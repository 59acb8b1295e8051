"""Positions, prefix sums and local numberings without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut

BLOCK = 1 << 16


def prefix(df: DataFrame, key: str, weight: str, name: str = "before", block: int = BLOCK) -> DataFrame:
    """Sum of ``weight`` over smaller integer keys (unique in df): sums of blocks of keys first, then inside each block."""
    d = df.withColumn("_pb", F.floor(F.col(key) / block).cast("long"))
    sums = d.groupBy("_pb").agg(F.sum(weight).alias("_ps"))
    sums = sums.withColumn("_po", F.coalesce(F.sum("_ps").over(Window.orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_ps")
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("_pb").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_pi", inside).join(sums, "_pb").withColumn(name, (F.col("_po") + F.col("_pi")).cast("long")).drop("_pb", "_po", "_pi")


def ordinal(df: DataFrame, major: str = "i", minor: str = "j", name: str = "pos") -> DataFrame:
    """0-based position of each row by (major, minor), which no two rows share."""
    return placed(df, major, minor, name=name)


def compact(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys numbered from 0 in order: ``key, name``."""
    return prefix(df.select(key).distinct().withColumn("_one", F.lit(1)), key, "_one", name).drop("_one")


def block_partition(nz: DataFrame, p: int) -> DataFrame:
    """Parts of equal size in (i, j) order."""
    total = nz.agg(F.count("*").alias("_total"))
    return ordinal(nz).crossJoin(F.broadcast(total)).withColumn("part", F.floor(F.col("pos") * p / F.col("_total")).cast("int")).drop("pos", "_total")


def part_starts(nz: DataFrame, p: int) -> DataFrame:
    """``part, start, size`` for all parts 0..p-1, empty ones too."""
    sizes = nz.groupBy("part").agg(F.count("*").alias("size"))
    every = nz.sparkSession.range(p).select(F.col("id").cast("int").alias("part")).join(sizes, "part", "left").fillna(0, ["size"])
    return every.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def local_index(nz: DataFrame, axis: str = "row") -> DataFrame:
    """``part, local, global``: lines of each part numbered from 0 in global order."""
    by = "i" if axis == "row" else "j"
    lines = nz.select("part", F.col(by).alias("global")).distinct()
    return lines.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("global")) - 1).select("part", "local", "global")


def local_view(nz: DataFrame) -> DataFrame:
    """Entries with part-local row and column numbers."""
    r = local_index(nz, "row").withColumnsRenamed({"local": "local_i", "global": "i"})
    c = local_index(nz, "col").withColumnsRenamed({"local": "local_j", "global": "j"})
    return nz.join(r, ["part", "i"]).join(c, ["part", "j"])


def owner_index(owner: DataFrame) -> DataFrame:
    """``idx, part, local``: owned vector components numbered inside their part."""
    return owner.where("part IS NOT NULL").withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("idx")) - 1)


def local_to_vector(nz: DataFrame, owner: DataFrame, axis: str = "row") -> DataFrame:
    """For each part's local line: which part owns the vector component, and its index there."""
    own = owner_index(owner).select(F.col("idx").alias("global"), F.col("part").alias("owner"), F.col("local").alias("owner_local"))
    return local_index(nz, axis).join(own, "global", "left").select("part", "local", "owner", "owner_local")


def cartesian(nz: DataFrame) -> DataFrame:
    """Per part the sorted distinct rows and columns it touches."""
    return nz.groupBy("part").agg(F.array_sort(F.collect_set("i")).alias("rows"), F.array_sort(F.collect_set("j")).alias("cols"))


def simple_split(nz: DataFrame, weight: Column, low: int, high: int) -> DataFrame:
    """Cuts the order of ``t`` in two: at the least position that leaves at most ``high``, or further while the head is
    within the ideal ``max(low - surplus / 2, 0)``; the surplus is what both bounds allow beyond the total."""
    d = prefix(nz.withColumn("_w", weight), "t", "_w", "_before").withColumn("_cum", F.col("_before") + F.col("_w"))
    total = d.agg(F.sum("_w")).first()[0] or 0
    ideal = max(low - (low + high - total) / 2, 0)
    need = d.where(F.col("_before") + high >= total).agg(F.min("_before")).first()[0]
    need = total if need is None else need
    reach = d.where(F.col("_cum") <= ideal).agg(F.max("_cum")).first()[0] or 0
    head = max(need, reach)
    if head > low:
        raise ValueError("no split within the bounds")
    return d.withColumn("part", F.when(F.col("_cum") <= head, 0).otherwise(1)).drop("_w", "_before", "_cum")


def split_order(side: DataFrame, mode: str = "infix") -> DataFrame:
    """``pos, idx`` after one split: lines left, right and cut (``has_left``, ``has_right``), then those in neither.

    prefix: cut, left, right (reverse bordered block diagonal); infix: left, cut, right (separated block diagonal);
    postfix: left, right, cut (bordered block diagonal). Old order inside each class.
    """
    rank = {"prefix": (1, 0, 2), "infix": (0, 1, 2), "postfix": (0, 2, 1)}[mode]
    cls = F.when(F.col("has_left") & F.col("has_right"), rank[1]).when(F.col("has_left"), rank[0]).when(F.col("has_right"), rank[2]).otherwise(3)
    return ordinal(side.withColumn("_class", cls.cast("long")), "_class", "idx").select("pos", "idx")


def placed(df: DataFrame, *order: str | Column, name: str = "pos", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """0-based position of each row in ``order``, by one shuffle into ranges; no key needs to fit into one task.

    Spark's counting id holds the partition above bit 33 and the place within it below; the sorted rows are checkpointed, so
    counting the partitions and reading the rows see the same places. Only the columns ``keep`` are. Rows that ``order`` can't tell apart come in any order.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("_place")))
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    pos = F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, pos).drop("_part", "_place", "_first")
