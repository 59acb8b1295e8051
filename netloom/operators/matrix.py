"""Structural transforms of a coordinate table, and the joins and sums they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a table that one task sorts or holds in hash tables.
ROWS = 250_000


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to so many tasks; as it is without a number."""
    return df.repartition(tasks, *keys) if tasks else df


def to_nz(df: DataFrame, row: str, col: str, value: str | Column | None = None, *, tasks: int | None = None) -> DataFrame:
    """Any table as a matrix: equal (row, col) are summed; without ``value`` rows are counted. With ``tasks`` it is dealt to as many by
    (i, j), which later joins on both keep."""
    df = df.select(F.col(row).cast("long").alias("i"), F.col(col).cast("long").alias("j"), (F.lit(1) if value is None else F.col(value) if isinstance(value, str) else value).alias("re"))
    return spread(df, tasks, "i", "j").groupBy("i", "j").agg((F.count("*") if value is None else F.sum("re")).cast("double").alias("re"))


def dedup_sum(nz: DataFrame) -> DataFrame:
    """One entry per (i, j), values added; the position of the last occurrence stays if there is a ``t``."""
    sums = [F.sum(c).alias(c) for c in ("re", "im") if c in nz.columns]
    if "t" in nz.columns:
        sums.append(F.max("t").alias("t"))
    return nz.groupBy("i", "j").agg(*sums) if sums else nz.select("i", "j").distinct()


def out_of_bounds(nz: DataFrame, m: int, n: int) -> int:
    """Entries outside 0..m-1 x 0..n-1."""
    return nz.agg(F.count_if((F.col("i") < 0) | (F.col("i") >= m) | (F.col("j") < 0) | (F.col("j") >= n))).first()[0]


def transpose(nz: DataFrame) -> DataFrame:
    return nz.select(*[F.col({"i": "j", "j": "i"}.get(c, c)).alias(c) for c in nz.columns])


def sym_to_full(nz: DataFrame, symmetry: str = "S") -> DataFrame:
    """Adds the mirror of each off-diagonal entry; ``K`` negates its value, ``H`` the imaginary part. Parts are copied."""
    if symmetry not in "SKH":
        raise ValueError("symmetry must be S, K or H")
    if symmetry == "K" and not nz.where("i = j").isEmpty():
        raise ValueError("a skew-symmetric matrix has no diagonal")
    mirror = transpose(nz.where("i <> j"))
    for name, flip in (("re", symmetry == "K"), ("im", symmetry in "KH")):
        if flip and name in nz.columns:
            mirror = mirror.withColumn(name, -F.col(name))
    return nz.unionByName(mirror.select(*nz.columns))


def full_to_sym(nz: DataFrame) -> DataFrame:
    """The lower triangle, checked to stand for all of a symmetric pattern."""
    total, low, diagonal = nz.agg(F.count("*"), F.count_if(F.col("i") >= F.col("j")), F.count_if(F.col("i") == F.col("j"))).first()
    if 2 * low != total + diagonal:
        raise ValueError("the matrix is not structurally symmetric")
    return nz.where("i >= j")


def _swapped(nz: DataFrame, when: Column) -> DataFrame:
    return nz.withColumns({"i": F.when(when, F.col("j")).otherwise(F.col("i")), "j": F.when(when, F.col("i")).otherwise(F.col("j"))})


def random_triangle(nz: DataFrame, seed: int = 99) -> DataFrame:
    """Each entry in its own or its mirror's place, by a coin that depends on the place and the seed alone."""
    return _swapped(nz, F.pmod(F.xxhash64(F.greatest("i", "j"), F.least("i", "j"), F.lit(seed)), F.lit(2)) == 0)


def lower_triangle(nz: DataFrame) -> DataFrame:
    return _swapped(nz, F.col("i") < F.col("j"))


def add_dummies(nz: DataFrame, n: int) -> DataFrame:
    """Zero entries marked ``is_dummy`` for the missing diagonal of an n x n matrix."""
    spark = nz.sparkSession
    missing = spark.range(n).select(F.col("id").alias("i")).join(nz.where("i = j").select("i"), "i", "left_anti")
    have = nz if "is_dummy" in nz.columns else nz.withColumn("is_dummy", F.lit(False))
    fill = {"i": F.col("i"), "j": F.col("i"), "is_dummy": F.lit(True)}
    return have.unionByName(missing.select(*[fill.get(c, F.lit(0).cast(have.schema[c].dataType)).alias(c) for c in have.columns]))


def remove_dummies(nz: DataFrame) -> DataFrame:
    return nz.where(~F.col("is_dummy"))


def parts_to_values(nz: DataFrame) -> DataFrame:
    """Values become part numbers from 1."""
    return nz.withColumn("re", (F.col("part") + 1).cast("double"))


def values_to_parts(nz: DataFrame) -> DataFrame:
    """Parts from values 1..P; anything below 1 is an error."""
    if nz.agg(F.count_if(F.col("re") < 1)).first()[0]:
        raise ValueError("processor numbers start at 1")
    return nz.withColumn("part", F.col("re").cast("int") - 1)


def merge_values(index: DataFrame, values: DataFrame) -> DataFrame:
    """Parts of one matrix with the values of another of the same pattern."""
    both = index.select("i", "j", "part").join(values.select("i", "j", "re"), ["i", "j"])
    if both.count() != index.count() or index.count() != values.count():
        raise ValueError("the patterns differ")
    return both


def asymmetric(nz: DataFrame) -> DataFrame:
    """Entries without a mirror entry."""
    return nz.join(nz.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_anti")


def permute(nz: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """PAQ: i and j become positions in ``rows(pos, idx)`` and ``cols(pos, idx)``."""
    out = nz.join(rows.select(F.col("idx").alias("i"), F.col("pos").alias("_r")), "i").join(cols.select(F.col("idx").alias("j"), F.col("pos").alias("_c")), "j")
    return out.withColumns({"i": F.col("_r"), "j": F.col("_c")}).select(*nz.columns)


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("idx").alias("pos"), F.col("pos").alias("idx"))


def adjacency(nz: DataFrame, axis: str = "row") -> DataFrame:
    """Compressed rows (or columns): ``idx`` and the sorted indices in it."""
    by, other = ("i", "j") if axis == "row" else ("j", "i")
    return nz.groupBy(F.col(by).alias("idx")).agg(F.sort_array(F.collect_list(other)).alias("inner"))


def from_crs(crs: DataFrame) -> DataFrame:
    """Coordinates from ``idx, inner[, re]`` arrays of rows."""
    cols = F.arrays_zip("inner", "re") if "re" in crs.columns else F.arrays_zip("inner")
    out = crs.select(F.col("idx").alias("i"), F.explode(cols).alias("e"))
    return out.select("i", F.col("e.inner").alias("j"), *([F.col("e.re").alias("re")] if "re" in crs.columns else []))


def line_weights(nz: DataFrame, axis: str = "row", scale: float = 1.0) -> DataFrame:
    """Weight of each line: scale times (sum of absolute values + 0.5), truncated."""
    by = "i" if axis == "row" else "j"
    return nz.groupBy(F.col(by).alias("idx")).agg((scale * (F.sum(F.abs("re")) + 0.5)).cast("long").alias("w"))


def part_weights(nz: DataFrame, *, single_entry: bool = False, col_weight: DataFrame | None = None) -> DataFrame:
    """``part, weight``: entries without dummies; off-diagonal ones twice in single-entry symmetric storage; or, with column
    weights, the weights of the distinct columns of the part."""
    real = remove_dummies(nz) if "is_dummy" in nz.columns else nz
    if col_weight is not None:
        return real.select("part", F.col("j").alias("idx")).distinct().join(col_weight, "idx").groupBy("part").agg(F.sum("w").alias("weight"))
    w = F.when(F.col("i") != F.col("j"), 2).otherwise(1) if single_entry else F.lit(1)
    return real.groupBy("part").agg(F.sum(w).cast("long").alias("weight"))


def mediumgrain_initial(nz: DataFrame, tie: str = "col", *, tasks: int | None = None) -> DataFrame:
    """``in_ac``: the entry goes with its column (true) or its row.

    First choice: the shorter line, ties by ``tie``, an entry alone in its row with its column. A line all but one of whose
    entries went the other way then keeps that entry out of a group of one. With ``tasks`` each numbering is dealt to as many.
    """
    row, col = Window.partitionBy("i"), Window.partitionBy("j")
    d = spread(nz, tasks, "i").withColumn("rows", F.count("*").over(row))
    d = spread(d, tasks, "j").withColumn("cols", F.count("*").over(col))
    longer = (F.col("rows") > F.col("cols")) | ((F.col("rows") == F.col("cols")) & F.lit(tie == "col"))
    d = d.withColumn("first", (F.col("rows") == 1) | ((F.col("cols") != 1) & longer))
    d = d.withColumn("with_row", F.sum((~F.col("first")).cast("int")).over(col))
    d = spread(d, tasks, "i").withColumn("with_col", F.sum(F.col("first").cast("int")).over(row))
    final = ((F.col("with_row") == 1) & (F.col("cols") != 1)) | (F.col("rows") == 1) | ((F.col("cols") != 1) & (F.col("with_col") != 1) & longer)
    return d.withColumn("in_ac", final).select(*nz.columns, "in_ac")


def free_nonzeros(nz: DataFrame, donor: int, receiver: int) -> DataFrame:
    """Entries of ``donor`` whose row and column both hold the receiver's part already."""
    there = nz.where(F.col("part") == receiver)
    mine = nz.where(F.col("part") == donor)
    mine = mine.where(~F.col("is_dummy")) if "is_dummy" in nz.columns else mine
    return mine.join(there.select("i").distinct(), "i", "left_semi").join(there.select("j").distinct(), "j", "left_semi")
