"""Queries of the sequential kernels and of whole partitioning runs: each returns one row of invariants that must hold."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.checkpoints import shared_folder
from ..functions.hyper import build, exact_bipartition, gains, initial_side, multilevel, path_matching, refine, subset_sum
from ..functions.vector_kernels import by_local_bound, by_sums, costs, equal_owners, improve, measure, pairs_optimal
from ..operators import matrix, metrics, ordinal
from ..operators.vectors import reduced
from ..sources import matrix_market
from ..streaming.lambdas import lambda_stream
from . import catalog
from .catalog import P, query, table
from .options import Options
from .partition import distribute_vector, partition, report, upper_bound_partition


SQ = "sq AS (SELECT l_orderkey % 300 AS i, l_partkey % 300 AS j, CAST(COUNT(*) AS DOUBLE) AS re FROM lineitem WHERE l_quantity <= 2 AND l_linenumber = 1 GROUP BY 1, 2)"


def sq(spark, d):
    """A folded 300 x 300 matrix of small orders, for the kernels that work in one task."""
    small = table(spark, d, "lineitem").where("l_quantity <= 2 AND l_linenumber = 1")
    return matrix.to_nz(small.select((F.col("l_orderkey") % 300).alias("r"), (F.col("l_partkey") % 300).alias("c")), "r", "c")


def row(spark, **values):
    return spark.createDataFrame([tuple(bool(v) for v in values.values())], ", ".join(f"{k} boolean" for k in values))


def all_true(*names):
    return "SELECT " + ", ".join(f"true AS {n}" for n in names)


def kernel(df, key, f, **names):
    """Runs ``f(pdf) -> dict of booleans`` once per group of ``key`` and ands the answers."""
    columns = list(names)

    def run(pdf):
        answer = f(pdf)
        return pd.DataFrame([[bool(answer[c]) for c in columns]], columns=columns)

    out = df.groupBy(key).applyInPandas(run, ", ".join(f"{c} boolean" for c in columns))
    return out.agg(*[F.bool_and(c).alias(c) for c in columns])


def sq_lines(spark, d):
    """Cut columns of sq in 8 parts by row blocks, as part lists in one group."""
    m = sq(spark, d).withColumn("part", F.floor(F.col("i") * P / 300).cast("int"))
    return reduced(m, "col").groupBy("idx").agg(F.sort_array(F.collect_list("part")).alias("parts")).withColumn("g", F.lit(0))


def lists(pdf):
    return [list(map(int, x)) for x in pdf.sort_values("idx")["parts"]]


def sound(lines, owner):
    ns, nr = costs(lines, owner, P)
    return {"owners_ok": all(q in s for q, s in zip(owner, lines, strict=True)), "sums_ok": sum(ns) == sum(nr) == sum(len(s) - 1 for s in lines)}


@query(all_true("owners_ok", "sums_ok"))
def vec_orig(spark, d):
    return kernel(sq_lines(spark, d), "g", lambda pdf: sound(lists(pdf), by_sums(lists(pdf), P)), owners_ok=1, sums_ok=1)


@query(all_true("owners_ok", "sums_ok"))
def vec_local(spark, d):
    return kernel(sq_lines(spark, d), "g", lambda pdf: sound(lists(pdf), by_local_bound(lists(pdf), P)), owners_ok=1, sums_ok=1)


@query(all_true("owners_ok", "sums_ok", "no_worse"))
def vec_greedy(spark, d):
    def f(pdf):
        lines = lists(pdf)
        start = by_sums(lines, P)
        better = improve(lines, start, P)
        return sound(lines, better) | {"no_worse": measure(lines, better, P) <= measure(lines, start, P)}

    return kernel(sq_lines(spark, d), "g", f, owners_ok=1, sums_ok=1, no_worse=1)


@query(all_true("owners_ok", "optimal"))
def opt2_owners(spark, d):
    """Every pair of 6 parts shares 7 lines: the optimum is known."""
    pairs = spark.createDataFrame([(0, k, [a, b]) for k, (a, b) in enumerate((a, b) for a in range(6) for b in range(a) for _ in range(7))], "g int, idx long, parts array<int>")

    def f(pdf):
        lines = lists(pdf)
        owner = pairs_optimal(lines, 6)
        return {"owners_ok": all(q in s for q, s in zip(owner, lines, strict=True)), "optimal": measure(lines, owner, 6) == -(-5 * 7 // 2)}

    return kernel(pairs, "g", f, owners_ok=1, optimal=1)


@query(all_true("owners_ok", "common_first"))
def equal_vectors(spark, d):
    m = sq(spark, d).withColumn("part", F.pmod(F.col("i") + 2 * F.col("j"), F.lit(P)).cast("int"))
    u, v = (metrics.comm(m, a).groupBy("idx").agg(F.sort_array(F.collect_list("part")).alias(a)) for a in ("row", "col"))
    none = F.array().cast("array<int>")
    both = spark.range(300).select(F.col("id").alias("idx")).join(u, "idx", "left").join(v, "idx", "left").select(F.lit(0).alias("g"), "idx", F.coalesce("row", none).alias("row"), F.coalesce("col", none).alias("col"))

    def f(pdf):
        pdf = pdf.sort_values("idx")
        a, b = ([list(map(int, x)) for x in pdf[c]] for c in ("row", "col"))
        owner = equal_owners(a, b, P)
        return {"owners_ok": all(0 <= q < P for q in owner), "common_first": all(q in set(x) & set(y) for q, x, y in zip(owner, a, b, strict=True) if set(x) & set(y))}

    return kernel(both, "g", f, owners_ok=1, common_first=1)


@query(all_true("exact_found", "differencing_sound"))
def kk_subset_sum(spark, d):
    """The parts of every supplier, weighted by quantity, dealt into two bins; the exact search on the lightest of them."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("g"), "l_partkey").agg(F.sum("l_quantity").cast("int").alias("w"))

    def f(pdf):
        w = sorted(pdf["w"].tolist())
        few, half = w[:12], -(-sum(w[:12]) // 2)
        bins = subset_sum(few, (half + max(few), half + max(few)))
        many = subset_sum(w * 2, (sum(w) + max(w), sum(w) + max(w)))
        loads = lambda xs, b: [sum(x for x, s in zip(xs, b, strict=True) if s == k) for k in (0, 1)]
        return {"exact_found": bins is not None and max(loads(few, bins)) <= half + max(few), "differencing_sound": many is None or max(loads(w * 2, many)) <= sum(w) + max(w)}

    return kernel(items, "g", f, exact_found=1, differencing_sound=1)


@query(all_true("cut_ok", "balanced", "no_worse", "gains_ok"))
def fm_bipartition(spark, d):
    def f(pdf):
        pdf = pdf.sort_values(["i", "j"])
        h, _ = build(pdf["i"].to_numpy(), pdf["j"].to_numpy())
        caps = (int(h.total * 0.52) + 1,) * 2
        side = initial_side(h, caps, np.random.default_rng(1))
        before, g = h.cut(side), gains(h, side)
        v = int(np.argmax(g))
        moved = [s if k != v else 1 - s for k, s in enumerate(side)]
        gains_ok = before - h.cut(moved) == g[v]
        cut = refine(h, side, caps)
        return {"cut_ok": cut == h.cut(side), "balanced": max(sum(side), len(side) - sum(side)) <= caps[0], "no_worse": cut <= before, "gains_ok": gains_ok}

    return kernel(sq(spark, d).withColumn("g", F.lit(0)), "g", f, cut_ok=1, balanced=1, no_worse=1, gains_ok=1)


@query(all_true("pairs_ok", "share_a_net"))
def pga_matching(spark, d):
    def f(pdf):
        h, _ = build(pdf["i"].to_numpy(), pdf["j"].to_numpy())
        group = path_matching(h, 0.2 * h.total)
        members: dict[int, list[int]] = {}
        for v, x in enumerate(group):
            members.setdefault(x, []).append(v)
        return {"pairs_ok": max(map(len, members.values())) == 2, "share_a_net": all(set(h.nets[x[0]]) & set(h.nets[x[1]]) for x in members.values() if len(x) == 2)}

    return kernel(sq(spark, d).withColumn("g", F.lit(0)), "g", f, pairs_ok=1, share_a_net=1)


@query(all_true("cut_ok", "balanced"))
def multilevel_partition(spark, d):
    def f(pdf):
        pdf = pdf.sort_values(["i", "j"])
        h, _ = build(pdf["i"].to_numpy(), pdf["j"].to_numpy())
        caps = (int(h.total * 0.52) + 1,) * 2
        side, cut = multilevel(h, caps, coarsest=40)
        return {"cut_ok": cut == h.cut(side), "balanced": max(sum(side), len(side) - sum(side)) <= caps[0]}

    return kernel(sq(spark, d).withColumn("g", F.lit(0)), "g", f, cut_ok=1, balanced=1)


@query(all_true("nnz_ok", "parts_ok", "balanced", "within_bound"))
def recursive_partition(spark, d):
    m = sq(spark, d)
    return report(partition(m, P, 0.1), m, P)


@query(all_true("nnz_ok", "volume_ok", "balanced"))
def upper_bound_parts(spark, d):
    m = sq(spark, d)
    out = upper_bound_partition(m, P)
    same = out.select("i", "j").exceptAll(m.select("i", "j")).isEmpty() and out.count() == m.count()
    return metrics.best_split_check(out, 300, 300, P).select(F.lit(same).alias("nnz_ok"), "volume_ok", "balanced")


@query(all_true("covers", "in_range", "bounded"))
def vector_distribution(spark, d):
    m = sq(spark, d).withColumn("part", F.floor(F.col("i") * P / 300).cast("int"))
    owner = distribute_vector(m, "col", 300, P, Options({"VectorPartition_MaxNrLoops": 2}))
    stats = metrics.comm_summary(metrics.proc_stats(m, owner, "col", P)).first()
    best = metrics.best_bound(m, "col").first()["best"]
    ok = owner.agg(F.count("*"), F.countDistinct("idx"), F.min("part"), F.max("part")).first()
    return row(spark, covers=ok[0] == ok[1] == 300, in_range=0 <= ok[2] <= ok[3] < P, bounded=max(stats["max_send"], stats["max_recv"]) >= best)


@query(all_true("proven", "feasible", "no_worse_than_heuristic"))
def exact_split(spark, d):
    """Every block of 14 rows of sq, split exactly and by the heuristic."""
    m = sq(spark, d).withColumn("g", F.floor(F.col("i") / 14))

    def f(pdf):
        pdf = pdf.sort_values(["i", "j"])
        i, j = pdf["i"].tolist(), pdf["j"].tolist()
        cap = int(1.03 * -(-len(i) // 2))
        owner, volume, proven = exact_bipartition(i, j, cap)
        load = [owner.count(0), owner.count(1)]
        h, _ = build(np.r_[np.arange(len(i)), np.arange(len(i))], np.r_[2 * np.array(i), 2 * np.array(j) + 1])
        _, cut = multilevel(h, (cap, cap))
        return {"proven": proven, "feasible": len(owner) == len(i) and max(load) <= cap, "no_worse_than_heuristic": volume <= cut}

    return kernel(m, "g", f, proven=1, feasible=1, no_worse_than_heuristic=1)


@query(f"WITH {SQ} SELECT i, j, re FROM sq")
def matrix_market_round_trip(spark, d):
    """sq written as Matrix-Market text in the shared folder and read again."""
    m = ordinal.ordinal(sq(spark, d), name="t")
    path = f"{shared_folder(spark)}/sq-{uuid.uuid4().hex}.mtx"
    meta = matrix_market.MatrixMeta(m=300, n=300, nnz=m.count())
    matrix_market.write(matrix_market.Matrix(meta, m), path)
    return matrix_market.read(spark, path).nz.select("i", "j", "re")


@query("SELECT user_id AS i, CAST(COUNT(DISTINCT event_type) AS INT) AS lam FROM events GROUP BY user_id")
def streaming_lambdas(spark, d):
    """Lambdas of users over event types, kept up to date over a stream of the events."""
    return lambda_stream(spark, f"{d}/events.parquet", "user_id", "event_type")


@query(
    f"WITH {catalog.DNZ}, w AS (SELECT part, COUNT(*) AS weight FROM dnz GROUP BY part), s AS (SELECT part, weight, weight * 16.0 / SUM(weight) OVER () AS share FROM w), "
    "f AS (SELECT *, GREATEST(1, CAST(FLOOR(share) AS BIGINT)) AS base FROM s), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY base - share, part) AS k, 16 - SUM(base) OVER () AS spare FROM f) "
    "SELECT part, weight, CAST(base + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS procs FROM r"
)
def balance_parts(spark, d):
    w = matrix.part_weights(catalog.dnz(spark, d))
    return metrics.balance(w, 16)


catalog.QUERIES["upper_bound_partition"] = catalog.QUERIES.pop("upper_bound_parts")
catalog.SQL["upper_bound_partition"] = catalog.SQL.pop("upper_bound_parts")
catalog.QUERIES["exact_bipartition"] = catalog.QUERIES.pop("exact_split")
catalog.SQL["exact_bipartition"] = catalog.SQL.pop("exact_split")
