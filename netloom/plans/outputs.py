"""A whole run: read a matrix, partition it, distribute its vectors, write the results in one of three modes.

Every output is a folder of Spark's making whose files, in order of name, are the text; nothing is gathered in one task.
``original`` writes one such text per result (``-P`` parts, ``-I`` part numbers as values, ``-local`` local indices, ``-u`` and ``-v`` owners,
``-C`` index sets, and with a permutation ``-reor-P``, ``-row``, ``-col``, ``-rowblocks``, ``-colblocks``); ``onefile`` writes them as numbered
objects of one extended text; ``DIMACS`` writes the owner of each component, which needs equal vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from ..operators import bids, matrix, metrics, ordinal, reorder, vectors
from ..sources import matrix_market, mtx
from ..sources.matrix_market import MatrixMeta
from .options import Options
from .partition import distribute_vector, partition

#: The orders of the Permute option.
MODES = {"reverseBBD": "prefix", "SBD": "infix", "BBD": "postfix"}


@dataclass(frozen=True)
class Run:
    """Results of a run: ``nz(t, i, j, ..., part)``, ``u`` and ``v`` as ``(idx, part)``, and one row of figures."""

    nz: DataFrame
    meta: MatrixMeta
    u: DataFrame
    v: DataFrame
    figures: DataFrame


def equal_owners(nz: DataFrame, size: int, p: int) -> DataFrame:
    """``idx, part``: one owner for row k and column k of a square matrix: a part of both where there is one, else of either."""
    u, v = (metrics.comm(nz, axis) for axis in ("row", "col"))
    sides = u.withColumn("s", F.lit(1)).union(v.withColumn("s", F.lit(2))).groupBy("idx", "part").agg(F.sum("s").alias("s"))
    both = sides.where("s = 3").select("idx").distinct()
    pick = sides.where("s = 3").union(sides.join(both, "idx", "left_anti")).groupBy("idx").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    pick = cut(pick)
    known = pick.where("size(parts) = 1").select("idx", F.col("parts")[0].alias("part")).union(bids.owners(pick.where("size(parts) > 1"), p).select("idx", F.col("owner").alias("part")))
    every = nz.sparkSession.range(size).select(F.col("id").alias("idx")).join(known, "idx", "left")
    return vectors.fill_unowned(every, p)


def run(spark: SparkSession, path: str, out: str | None, p: int, eps: float = 0.03, options: Options | None = None) -> Run:
    """Reads the matrix at ``path``, distributes it over ``p`` parts and, if ``out`` is given, writes the results below that name."""
    options = options or Options()
    found = mtx.load(spark, path)
    nz = found.nz.drop("part")
    if found.meta.symmetry != "G":
        nz = ordinal.placed(matrix.sym_to_full(nz.drop("t"), found.meta.symmetry), "i", "j", name="t")
    nz = cut(nz)
    m, n = found.meta.m, found.meta.n
    result = partition(nz, p, eps, options)
    equal = options["SquareMatrix_DistributeVectorsEqual"] == "yes" and m == n
    if equal:
        u = v = cut(equal_owners(result.nz, m, p))
    else:
        u, v = (cut(distribute_vector(result.nz, axis, size, p, options)) for axis, size in (("row", m), ("col", n)))
    meta = replace(found.meta, object="D", symmetry="G", nprocs=p, nnz=nz.count(), extended=options["OutputFormat"] == "EMM" or options["OutputMode"] == "onefile", row_weights=False, col_weights=False)
    done = Run(result.nz, meta, u, v, figures(result.nz, u, v, p))
    if out:
        write(done, out, options)
    return done


def figures(nz: DataFrame, u: DataFrame, v: DataFrame, p: int) -> DataFrame:
    """One row per vector: ``vec, vol, cut, max_send, max_recv, max_comp, max_w, imbalance``."""
    load = metrics.imbalance(matrix.part_weights(nz), p).select("max_w", "imbalance")
    rows = []
    for name, axis, owner in (("v", "col", v), ("u", "row", u)):
        sums = metrics.comm_summary(metrics.proc_stats(nz, owner, axis, p)).select("max_send", "max_recv", "max_comp")
        one = metrics.volumes(nz, axis).select(F.lit(name).alias("vec"), "vol", "cut")
        rows.append(one.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(load)))  # one row each
    return rows[0].union(rows[1])


def text(rows: DataFrame, path: str, *order: str) -> None:
    """Writes ``line`` in order, by ranges."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def numbered(head: list[str], values: DataFrame, pos: str = "pos") -> DataFrame:
    """``pos, line``: head lines before rows ``pos, line``."""
    top = values.sparkSession.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "pos long, line string")
    return top.union(values.select(F.col(pos).cast("long"), F.col("line")))


def cartesian_lines(nz: DataFrame, m: int, n: int, p: int) -> DataFrame:
    """``a, b, c, line``: sizes; then per part its number and sizes, the rows and the columns that it touches, 1-based."""
    spark = nz.sparkSession
    sides = [nz.select("part", F.lit(k).alias("b"), F.col(c).alias("c")).distinct() for k, c in ((1, "i"), (2, "j"))]
    sizes = sides[0].union(sides[1]).groupBy("part").agg(F.count_if(F.col("b") == 1).alias("mq"), F.count_if(F.col("b") == 2).alias("nq"))
    heads = spark.range(p).select(F.col("id").cast("int").alias("part")).join(F.broadcast(sizes), "part", "left").na.fill(0)  # a row per part
    top = spark.createDataFrame([(-1, 0, 0, f"{m} {n} {p}")], "a int, b int, c long, line string")
    heads = heads.select(F.col("part").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.concat_ws(" ", F.col("part") + 1, "mq", "nq").alias("line"))
    index = sides[0].union(sides[1]).select(F.col("part").alias("a"), "b", "c", (F.col("c") + 1).cast("string").alias("line"))
    return top.union(heads).union(index)


def order_of(nz: DataFrame, axis: str, size: int, p: int, mode: str) -> tuple[DataFrame, DataFrame]:
    """``pos, idx`` of all lines, empty ones last, and the ``blocks`` of the others."""
    order = cut(reorder.recursive_order(nz, axis, p, mode))
    used = order.count()
    rest = nz.sparkSession.range(size).select(F.col("id").alias("idx")).join(order, "idx", "left_anti")
    rest = ordinal.placed(rest, "idx").select((F.col("pos") + used).alias("pos"), "idx")
    return order.select("pos", "idx").union(rest), reorder.blocks(order)


def write(done: Run, base: str, options: Options) -> None:
    """Writes a run's results in the mode of ``OutputMode``."""
    meta, p, nz = done.meta, done.meta.nprocs, done.nz
    if options["OutputMode"] == "DIMACS":
        if meta.m != meta.n or options["SquareMatrix_DistributeVectorsEqual"] != "yes":
            raise ValueError("DIMACS output needs a square matrix with equal vectors")
        text(done.u.select(F.col("idx").alias("pos"), F.col("part").cast("string").alias("line")), f"{base}{p}.part", "pos")
        return
    one = options["OutputMode"] == "onefile"
    step = iter(range(100))
    place = (lambda name: f"{base}-P{p}.emm/{next(step):02d}-{name}") if one else (lambda name: f"{base}-{name}{p}")
    mtx.save(nz, place("P"), meta)
    whole = replace(meta, object="M", nprocs=0)
    if options["Permute"] != "none":
        mode, placed = MODES[options["Permute"]], nz
        for axis, c, size in (("row", "i", meta.m), ("col", "j", meta.n)):
            order, blocks = order_of(nz, axis, size, p, mode)
            placed = placed.join(order.select(F.col("idx").alias(c), F.col("pos").alias("to")), c).withColumn(c, F.col("to")).drop("to")
            text(numbered([str(size)], order.select("pos", (F.col("idx") + 1).cast("string").alias("line"))), place(axis), "pos")
            text(blocks.select(F.col("start").alias("pos"), F.concat_ws(" ", F.col("start") + 1, "size", "key").alias("line")), place(f"{axis}blocks"), "pos")
        mtx.save(placed, place("reor-P"), whole)
    local = ordinal.local_view(nz).withColumns({"i": F.col("local_i").cast("long"), "j": F.col("local_j").cast("long")})
    mtx.save(local, place("local"), replace(meta, view="local"))
    values = ordinal.placed(nz.select("part", "t", "i", "j"), "part", "t").select(F.col("pos").alias("t"), "i", "j", (F.col("part") + 1).cast("double").alias("re"))
    mtx.save(values, place("I"), replace(whole, field="I"))
    for name, owner, size in (("u", done.u, meta.m), ("v", done.v, meta.n)):
        text(matrix_market.vector_lines(owner, size, p), place(name), "pos")
    text(cartesian_lines(nz, meta.m, meta.n, p), place("C"), "a", "b", "c")
