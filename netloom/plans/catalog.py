"""The query catalogue: each operator over matrices made of the tables, with DuckDB SQL for the same rows.

Matrices: ``nz`` part x supplier with summed quantities; ``sq`` order x part, taken as a square matrix of the number of orders; ``dnz`` nz with
part (7 i + 3 j) mod 8; ``bnz`` nz in 8 blocks of equal size. Positions ``t`` follow (i, j).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, hypergraph, matrix, metrics, ordinal, reorder, vectors
from ..sources import matrix_market

P = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NZ = "nz AS (SELECT l_partkey AS i, l_suppkey AS j, SUM(l_quantity) AS re FROM lineitem GROUP BY 1, 2)"
SQ = "sq AS (SELECT l_orderkey AS i, l_partkey AS j, CAST(COUNT(*) AS DOUBLE) AS re FROM lineitem GROUP BY 1, 2)"
ORDERS = "(SELECT COUNT(*) FROM orders)"
DNZ = f"{NZ}, dnz AS (SELECT i, j, re, CAST((7 * i + 3 * j) % 8 AS INT) AS part FROM nz)"
BNZ = f"{NZ}, bnz AS (SELECT i, j, re, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY i, j) - 1) * 8 / COUNT(*) OVER ()) AS INT) AS part FROM nz)"
TNZ = f"{NZ}, tnz AS (SELECT i, j, re, ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS t, CAST((i + j) % 2 AS INT) AS part FROM nz)"
OWN = "own AS (SELECT j AS idx, CAST(j % 8 AS INT) AS part FROM (SELECT s_suppkey AS j FROM supplier))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def tasks(spark, d):
    """Tasks for the rows of ``lineitem``, so that what one task holds doesn't grow with the table."""
    return 1 + count_table(spark, d, "lineitem") // matrix.ROWS


def nz(spark, d):
    return matrix.to_nz(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", tasks=tasks(spark, d))


def sq(spark, d):
    return matrix.to_nz(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", tasks=tasks(spark, d))


def orders(spark, d):
    return count_table(spark, d, "orders")


def dnz(spark, d):
    return nz(spark, d).withColumn("part", ((7 * F.col("i") + 3 * F.col("j")) % 8).cast("int"))


def bnz(spark, d):
    return ordinal.block_partition(nz(spark, d), P)


def tnz(spark, d):
    return ordinal.ordinal(nz(spark, d), name="t").withColumn("part", ((F.col("i") + F.col("j")) % 2).cast("int"))


def owner(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("idx"), (F.col("s_suppkey") % 8).cast("int").alias("part"))


def count_table(spark, d, name):
    return table(spark, d, name).count()


# Cleaning and structure


@query(f"WITH {NZ} SELECT * FROM nz")
def dedup_sum(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("re"))
    return matrix.dedup_sum(items)


@query("SELECT l_partkey AS i, l_suppkey AS j, CAST(COUNT(*) AS DOUBLE) AS re FROM lineitem GROUP BY 1, 2")
def dedup_counts(spark, d):
    return matrix.to_nz(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query(f"WITH {NZ} SELECT i AS idx, COUNT(*) AS n FROM nz GROUP BY i")
def nnz_per_row(spark, d):
    return nz(spark, d).groupBy(F.col("i").alias("idx")).agg(F.count("*").alias("n"))


@query(f"WITH {NZ} SELECT j AS idx, COUNT(*) AS n FROM nz GROUP BY j")
def nnz_per_col(spark, d):
    return nz(spark, d).groupBy(F.col("j").alias("idx")).agg(F.count("*").alias("n"))


@query(f"WITH {SQ} SELECT i, ROW_NUMBER() OVER (ORDER BY i) - 1 AS vertex FROM (SELECT DISTINCT i FROM sq)")
def nonempty_lines(spark, d):
    return ordinal.compact(sq(spark, d), "i", "vertex")


@query(f"WITH {SQ} SELECT COUNT(*) AS unmatched, COUNT(*) = 0 AS symmetric FROM sq a ANTI JOIN sq b ON a.i = b.j AND a.j = b.i")
def structural_symmetry(spark, d):
    return matrix.asymmetric(sq(spark, d)).agg(F.count("*").alias("unmatched"), (F.count("*") == 0).alias("symmetric"))


@query(f"WITH {SQ} SELECT i, j, re FROM sq WHERE i >= j UNION ALL SELECT j, i, re FROM sq WHERE i > j")
def sym_to_full(spark, d):
    return matrix.sym_to_full(sq(spark, d).where("i >= j"), "S")


@query(f"WITH {SQ} SELECT i, j, re FROM sq WHERE i > j UNION ALL SELECT j, i, -re FROM sq WHERE i > j")
def skew_to_full(spark, d):
    return matrix.sym_to_full(sq(spark, d).where("i > j"), "K")


@query(f"WITH {SQ} SELECT i, j, re FROM sq WHERE i >= j")
def full_to_lower(spark, d):
    return matrix.full_to_sym(matrix.sym_to_full(sq(spark, d).where("i >= j"), "S"))


@query(f"WITH {SQ} SELECT i, j, re FROM sq WHERE i >= j")
def random_to_lower(spark, d):
    return matrix.lower_triangle(matrix.random_triangle(sq(spark, d).where("i >= j")))


@query(f"WITH {SQ} SELECT i, j, re, false AS is_dummy FROM sq UNION ALL SELECT r, r, 0.0, true FROM (SELECT o_orderkey AS r FROM orders) WHERE r NOT IN (SELECT i FROM sq WHERE i = j)")
def add_dummies(spark, d):
    return matrix.add_dummies(sq(spark, d), orders(spark, d))


@query(f"WITH {SQ} SELECT i, j, re, false AS is_dummy FROM sq")
def remove_dummies(spark, d):
    return matrix.remove_dummies(matrix.add_dummies(sq(spark, d), orders(spark, d)))


@query(f"WITH {DNZ} SELECT part, COUNT(*) AS weight FROM dnz GROUP BY part")
def part_weight(spark, d):
    return matrix.part_weights(dnz(spark, d))


@query(f"WITH {SQ} SELECT CAST((i + j) % 4 AS INT) AS part, CAST(SUM(CASE WHEN i <> j THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM sq WHERE i >= j GROUP BY 1")
def part_weight_single_entry(spark, d):
    return matrix.part_weights(sq(spark, d).where("i >= j").withColumn("part", ((F.col("i") + F.col("j")) % 4).cast("int")), single_entry=True)


@query(f"WITH {BNZ} SELECT part, CAST(SUM(j % 5 + 1) AS BIGINT) AS weight FROM (SELECT DISTINCT part, j FROM bnz) GROUP BY part")
def part_weight_col_weighted(spark, d):
    weight = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("idx"), (F.col("s_suppkey") % 5 + 1).cast("long").alias("w"))
    return matrix.part_weights(bnz(spark, d), col_weight=weight)


@query(f"WITH {NZ} SELECT j AS idx, CAST(TRUNC(2.0 * (SUM(ABS(re)) + 0.5)) AS BIGINT) AS w FROM nz GROUP BY j")
def net_weights_from_values(spark, d):
    return matrix.line_weights(nz(spark, d), "col", 2.0)


@query(f"WITH {DNZ} SELECT i, j, CAST(part + 1 AS DOUBLE) AS re, part FROM dnz")
def parts_as_values(spark, d):
    return matrix.values_to_parts(matrix.parts_to_values(dnz(spark, d)).drop("part"))


@query(f"WITH {DNZ} SELECT i, j, part, re FROM dnz")
def merge_index_and_values(spark, d):
    m = dnz(spark, d)
    return matrix.merge_values(m.select("i", "j", "part"), m.select("i", "j", "re"))


@query(f"WITH {NZ} SELECT (i * 7 + 3) % (SELECT COUNT(*) FROM part) AS i, (SELECT COUNT(*) FROM supplier) - 1 - j AS j, re FROM nz")
def permuted_matrix(spark, d):
    m, n = count_table(spark, d, "part"), count_table(spark, d, "supplier")
    rows = spark.range(m).select(((F.col("id") * 7 + 3) % m).alias("pos"), F.col("id").alias("idx"))
    cols = spark.range(n).select((n - 1 - F.col("id")).alias("pos"), F.col("id").alias("idx"))
    return matrix.permute(nz(spark, d), rows, cols)


@query(f"WITH {SQ} SELECT i AS idx, array_to_string(list(j ORDER BY j), ' ') AS inner_ids, COUNT(*) AS n FROM sq GROUP BY i")
def compressed_rows(spark, d):
    return matrix.adjacency(sq(spark, d)).select("idx", F.array_join(F.col("inner").cast("array<string>"), " ").alias("inner_ids"), F.size("inner").cast("long").alias("n"))


# Lambdas and volumes


@query(f"WITH {BNZ} SELECT i AS idx, CAST(COUNT(DISTINCT part) AS INT) AS lam FROM bnz GROUP BY i UNION ALL SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT i FROM bnz)")
def lambda_rows(spark, d):
    return metrics.lambdas(bnz(spark, d), "row", count_table(spark, d, "part"))


@query(f"WITH {BNZ} SELECT j AS idx, CAST(COUNT(DISTINCT part) AS INT) AS lam FROM bnz GROUP BY j")
def lambda_cols(spark, d):
    return metrics.lambdas(bnz(spark, d), "col", count_table(spark, d, "supplier"))


@query(
    f"WITH {DNZ}, l AS (SELECT i, COUNT(DISTINCT part) AS lam FROM dnz GROUP BY i UNION ALL SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT i FROM dnz)) "
    "SELECT CAST(r AS INT) AS lam, CAST(COUNT(l.lam) AS BIGINT) AS n FROM range(9) x(r) LEFT JOIN l ON l.lam = r GROUP BY r"
)
def lambda_histogram(spark, d):
    return metrics.histogram(metrics.lambdas(dnz(spark, d), "row", count_table(spark, d, "part")), P)


@query(f"WITH {BNZ} SELECT DISTINCT j AS idx, part FROM bnz")
def comm_matrix(spark, d):
    return metrics.comm(bnz(spark, d), "col")


VOLUME = "WITH {m}, c AS (SELECT j AS idx, COUNT(DISTINCT part) AS lam FROM {t} GROUP BY j), r AS (SELECT i AS idx, COUNT(DISTINCT part) AS lam FROM {t} GROUP BY i) SELECT 'v' AS vec, {e} FROM c UNION ALL SELECT 'u', {e} FROM r"
LAM1, CUT, LL1 = "CAST(SUM(lam - 1) AS BIGINT) AS vol", "CAST(SUM(CASE WHEN lam > 1 THEN 1 ELSE 0 END) AS BIGINT) AS cut", "CAST(SUM(lam * (lam - 1)) AS BIGINT) AS vol_ll1"


def both_axes(m, *columns):
    v, u = (metrics.volumes(m, axis).select(F.lit(name).alias("vec"), *columns) for name, axis in (("v", "col"), ("u", "row")))
    return v.union(u)


@query(VOLUME.format(m=BNZ, t="bnz", e=f"{LAM1}, {CUT}, {LL1}"))
def block_partition_volume(spark, d):
    return both_axes(bnz(spark, d), "vol", "cut", "vol_ll1")


@query(VOLUME.format(m=DNZ, t="dnz", e=LAM1))
def volume_lambda1(spark, d):
    return both_axes(dnz(spark, d), "vol")


@query(VOLUME.format(m=DNZ, t="dnz", e=CUT))
def volume_cutnet(spark, d):
    return both_axes(dnz(spark, d), "cut")


@query(VOLUME.format(m=DNZ, t="dnz", e=LL1))
def volume_lambda_lambda1(spark, d):
    return both_axes(dnz(spark, d), "vol_ll1")


@query(f"WITH {BNZ} SELECT i AS idx FROM bnz GROUP BY i HAVING COUNT(DISTINCT part) > 1")
def cut_rows(spark, d):
    return metrics.cut_lines(bnz(spark, d), "row")


@query(f"WITH {BNZ} SELECT j AS idx FROM bnz GROUP BY j HAVING COUNT(DISTINCT part) > 1")
def cut_cols(spark, d):
    return metrics.cut_lines(bnz(spark, d), "col")


STATS = (
    f"WITH {BNZ}, {OWN}, c AS (SELECT DISTINCT j AS idx, part FROM bnz), a AS (SELECT c.part, own.part AS owner FROM c JOIN own USING (idx) WHERE c.part <> own.part), "
    "s AS (SELECT CAST(q AS INT) AS part, (SELECT COUNT(*) FROM a WHERE owner = q) AS ns, (SELECT COUNT(*) FROM a WHERE a.part = q) AS nr, (SELECT COUNT(*) FROM own WHERE own.part = q) AS nv FROM range(8) x(q)) "
)


@query(STATS + "SELECT * FROM s")
def vector_sends_recvs(spark, d):
    return metrics.proc_stats(bnz(spark, d), owner(spark, d), "col", P)


@query(STATS + "SELECT CAST(SUM(ns) AS BIGINT) AS vol, MAX(ns) AS max_send, MAX(nr) AS max_recv, MAX(nv) AS max_comp, CAST(SUM(nv) AS BIGINT) AS components FROM s")
def comm_summary(spark, d):
    return metrics.comm_summary(metrics.proc_stats(bnz(spark, d), owner(spark, d), "col", P))


BOUND = (
    f"WITH {BNZ}, c AS (SELECT DISTINCT i AS idx, part FROM bnz), l AS (SELECT idx, COUNT(*) AS lam FROM c GROUP BY idx HAVING COUNT(*) >= 2), "
    "a AS (SELECT part, lam, COUNT(*) AS n FROM c JOIN l USING (idx) GROUP BY part, lam), "
    "b AS (SELECT *, SUM(n) OVER (PARTITION BY part) AS total, SUM(lam * n) OVER (PARTITION BY part ORDER BY lam) AS c, SUM(n) OVER (PARTITION BY part ORDER BY lam) AS taken FROM a), "
    "e AS (SELECT part, lam, total, taken, CASE WHEN c > total THEN total - (taken - n) - CAST(FLOOR((total - (c - lam * n)) / lam) AS BIGINT) END AS lb FROM b), "
    "lb AS (SELECT part, CAST(COALESCE(ARG_MIN(lb, lam) FILTER (lb IS NOT NULL), MAX(total) - MAX(taken)) AS BIGINT) AS lb FROM e GROUP BY part) "
)


@query(BOUND + "SELECT * FROM lb")
def local_lower_bound(spark, d):
    return metrics.local_bounds(bnz(spark, d), "row")


@query(
    BOUND + ", s AS (SELECT MAX(lb) AS local_lb, COUNT(*) AS active, (SELECT CAST(SUM(k - 1) AS BIGINT) FROM (SELECT COUNT(*) AS k FROM c GROUP BY idx)) AS vol FROM lb) "
    "SELECT local_lb, active, CAST(CEIL(vol / active) AS BIGINT) AS active_lb, GREATEST(local_lb, CAST(CEIL(vol / active) AS BIGINT)) AS best FROM s"
)
def active_bound(spark, d):
    return metrics.best_bound(bnz(spark, d), "row")


@query(f"WITH {BNZ}, c AS (SELECT DISTINCT j AS idx, part FROM bnz), l AS (SELECT idx FROM c GROUP BY idx HAVING COUNT(*) >= 2) SELECT part, COUNT(*) AS sums FROM c SEMI JOIN l USING (idx) GROUP BY part")
def inevitable_comms(spark, d):
    return metrics.inevitable(bnz(spark, d), "col")


@query(f"WITH {DNZ}, w AS (SELECT part, COUNT(*) AS w FROM dnz GROUP BY part) SELECT MIN(w) AS min_w, MAX(w) AS max_w, ROUND(MAX(w) * 8 / SUM(w) - 1, 9) AS imbalance FROM w")
def load_imbalance(spark, d):
    return metrics.imbalance(matrix.part_weights(dnz(spark, d)), P).select("min_w", "max_w", F.round("imbalance", 9).alias("imbalance"))


@query(f"WITH {DNZ}, w AS (SELECT part, COUNT(*) AS w FROM dnz GROUP BY part) SELECT MAX(w) AS max_w, ROUND(MAX(w) / CEIL(SUM(w) / 8) - 1, 9) AS imbalance_opt FROM w")
def load_imbalance_opt(spark, d):
    return metrics.imbalance(matrix.part_weights(dnz(spark, d)), P).select("max_w", F.round("imbalance_opt", 9).alias("imbalance_opt"))


I2F = f"{SQ}, f AS (SELECT i, j, CAST((i + 2 * j) % 3 AS INT) AS part FROM sq)"


def i2f(spark, d):
    return sq(spark, d).withColumn("part", ((F.col("i") + 2 * F.col("j")) % 3).cast("int"))


@query(f"WITH {I2F} SELECT (SELECT COUNT(*) FROM (SELECT BIT_OR(part + 1) AS b FROM f GROUP BY i) WHERE b = 3) AS vol_u, (SELECT COUNT(*) FROM (SELECT BIT_OR(part + 1) AS b FROM f GROUP BY j) WHERE b = 3) AS vol_v")
def i2f_volume(spark, d):
    m = i2f(spark, d)
    return metrics.i2f_volume(m, "row").withColumnRenamed("vol", "vol_u").crossJoin(metrics.i2f_volume(m, "col").withColumnRenamed("vol", "vol_v"))


@query(
    f"WITH {I2F}, w AS (SELECT COUNT(*) FILTER (part = 0) AS w0, COUNT(*) FILTER (part = 1) AS w1, COUNT(*) FILTER (part = 2) AS free FROM f) "
    "SELECT *, ROUND(2 * GREATEST(w0, w1, CEIL((w0 + w1 + free) / 2)) / (w0 + w1 + free) - 1, 9) AS imbalance FROM w"
)
def i2f_imbalance(spark, d):
    return metrics.i2f_imbalance(i2f(spark, d)).withColumn("imbalance", F.round("imbalance", 9))


@query(f"WITH {BNZ}, c AS (SELECT DISTINCT i FROM bnz), s AS (SELECT (SELECT CAST(SUM(k - 1) AS BIGINT) FROM (SELECT COUNT(DISTINCT part) AS k FROM bnz GROUP BY i)) + (SELECT CAST(SUM(k - 1) AS BIGINT) FROM (SELECT COUNT(DISTINCT part) AS k FROM bnz GROUP BY j)) AS v) SELECT v <= (LEAST((SELECT COUNT(*) FROM part), (SELECT COUNT(*) FROM supplier)) + 1) * 7 AS volume_ok, true AS balanced FROM s")
def upper_bound_check(spark, d):
    return metrics.best_split_check(bnz(spark, d), count_table(spark, d, "part"), count_table(spark, d, "supplier"), P)


@query("SELECT l_returnflag AS grp, ROUND(AVG(l_quantity), 6) AS q_avg, ROUND(VAR_POP(l_quantity), 6) AS q_var FROM lineitem GROUP BY 1")
def profile_mean_variance(spark, d):
    runs = table(spark, d, "lineitem").withColumnsRenamed({"l_quantity": "q", "l_returnflag": "grp"}).groupBy("grp")
    return runs.agg(F.round(F.avg("q"), 6).alias("q_avg"), F.round(F.var_pop("q"), 6).alias("q_var"))


# Numbering and views


@query(f"WITH {BNZ} SELECT part, array_to_string(list(DISTINCT i ORDER BY i), ' ') AS row_ids, array_to_string(list(DISTINCT j ORDER BY j), ' ') AS col_ids FROM bnz GROUP BY part")
def cartesian_submatrices(spark, d):
    c = ordinal.cartesian(bnz(spark, d))
    return c.select("part", F.array_join(F.col("rows").cast("array<string>"), " ").alias("row_ids"), F.array_join(F.col("cols").cast("array<string>"), " ").alias("col_ids"))


@query(f"WITH {BNZ} SELECT i, j, part, DENSE_RANK() OVER (PARTITION BY part ORDER BY i) - 1 AS local_i, DENSE_RANK() OVER (PARTITION BY part ORDER BY j) - 1 AS local_j FROM bnz")
def local_view(spark, d):
    return ordinal.local_view(bnz(spark, d)).select("i", "j", "part", F.col("local_i").cast("long"), F.col("local_j").cast("long"))


@query(f'WITH {BNZ} SELECT DISTINCT part, DENSE_RANK() OVER (PARTITION BY part ORDER BY j) - 1 AS local, j AS "global" FROM bnz')
def local_to_global(spark, d):
    return ordinal.local_index(bnz(spark, d), "col").select("part", F.col("local").cast("long").alias("local"), "global")


@query(
    f"WITH {BNZ}, {OWN}, l AS (SELECT DISTINCT part, j, DENSE_RANK() OVER (PARTITION BY part ORDER BY j) - 1 AS local FROM bnz), o AS (SELECT idx, part AS owner, ROW_NUMBER() OVER (PARTITION BY part ORDER BY idx) - 1 AS owner_local FROM own) "
    "SELECT part, local, owner, owner_local FROM l LEFT JOIN o ON o.idx = l.j"
)
def local_to_vector(spark, d):
    v = ordinal.local_to_vector(bnz(spark, d), owner(spark, d), "col")
    return v.select("part", F.col("local").cast("long").alias("local"), "owner", F.col("owner_local").cast("long").alias("owner_local"))


@query(f"WITH {DNZ} SELECT CAST(q AS INT) AS part, CAST(COALESCE(size, 0) AS BIGINT) AS size, CAST(COALESCE(SUM(size) OVER (ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM range(8) x(q) LEFT JOIN (SELECT part, COUNT(*) AS size FROM dnz GROUP BY part) ON part = q")
def part_starts(spark, d):
    return ordinal.part_starts(dnz(spark, d), P)


@query(f"WITH {NZ}, s AS (SELECT i, j, ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS t, COUNT(*) OVER () AS total FROM nz) SELECT i, j, CASE WHEN t < GREATEST(total - total * 6 // 10, CAST(FLOOR(total * 6 // 10 - (2 * (total * 6 // 10) - total) / 2) AS BIGINT)) THEN 0 ELSE 1 END AS part FROM s")
def simple_split(spark, d):
    m = ordinal.ordinal(nz(spark, d), name="t")
    limit = m.count() * 6 // 10
    return ordinal.simple_split(m, F.lit(1), limit, limit).select("i", "j", "part")


MEDIUM = (
    f"{SQ}, d AS (SELECT *, COUNT(*) OVER (PARTITION BY i) AS rc, COUNT(*) OVER (PARTITION BY j) AS cc FROM sq), "
    "e AS (SELECT *, rc = 1 OR (cc <> 1 AND rc >= cc) AS f FROM d), g AS (SELECT *, SUM(f::INT) OVER (PARTITION BY i) AS wc, SUM((NOT f)::INT) OVER (PARTITION BY j) AS wr FROM e), "
    "h AS (SELECT i, j, re, (wr = 1 AND cc <> 1) OR rc = 1 OR (cc <> 1 AND wc <> 1 AND rc >= cc) AS in_ac FROM g)"
)


@query(f"WITH {MEDIUM} SELECT i, j, in_ac FROM h")
def mediumgrain_initial(spark, d):
    return matrix.mediumgrain_initial(sq(spark, d), "col", tasks=tasks(spark, d)).select("i", "j", "in_ac")


# Hypergraphs


@query(f"WITH {SQ} SELECT i AS v, COUNT(*) AS wgt FROM sq GROUP BY i")
def rownet_vertices(spark, d):
    return hypergraph.line_model(sq(spark, d), "row")[0]


@query(f"WITH {NZ} SELECT i AS v, j AS n FROM nz")
def rownet_pins(spark, d):
    return hypergraph.line_model(nz(spark, d), "row")[1]


@query(f"WITH {TNZ} SELECT t AS v, i AS n FROM tnz UNION ALL SELECT t, j + (SELECT COUNT(*) FROM part) FROM tnz")
def finegrain_pins(spark, d):
    return hypergraph.fine_model(tnz(spark, d), count_table(spark, d, "part"))


@query(f"WITH {SQ}, s AS (SELECT i, j, ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS t FROM sq WHERE i >= j) SELECT t AS v, i AS n FROM s UNION SELECT t, j FROM s")
def symfinegrain_pins(spark, d):
    return hypergraph.symmetric_fine_model(ordinal.ordinal(sq(spark, d).where("i >= j"), name="t"))


@query(
    f"WITH {MEDIUM}, p AS (SELECT DISTINCT CASE WHEN in_ac THEN j ELSE {ORDERS} + i END AS v, CASE WHEN in_ac THEN {ORDERS} + i ELSE j END AS net FROM h) "
    "SELECT * FROM p UNION SELECT v, v FROM p WHERE v IN (SELECT net FROM p)"
)
def mediumgrain_pins(spark, d):
    return hypergraph.medium_model(matrix.mediumgrain_initial(sq(spark, d), "col", tasks=tasks(spark, d)), orders(spark, d), tasks=tasks(spark, d))


GAIN = f"WITH {NZ}, p AS (SELECT i AS v, j AS n, i % 2 AS side FROM nz), s AS (SELECT n, SUM(side) AS ones, COUNT(*) AS k FROM p GROUP BY n), m AS (SELECT v, CASE WHEN side = 1 THEN ones ELSE k - ones END AS mine, k FROM p JOIN s USING (n)) "


@query(GAIN + "SELECT v, CAST(SUM(CASE WHEN mine = 1 THEN 1 ELSE 0 END - CASE WHEN mine = k THEN 1 ELSE 0 END) AS BIGINT) AS gain FROM m GROUP BY v")
def initial_gains(spark, d):
    vtx, pin = hypergraph.line_model(nz(spark, d), "row")
    return hypergraph.initial_gains(pin, vtx.select("v", (F.col("v") % 2).alias("side")))


@query(f"WITH {SQ}, p AS (SELECT j AS n, COUNT(DISTINCT i % 2) AS lam FROM sq GROUP BY j) SELECT n, CAST(2 * lam AS BIGINT) AS wgt, false AS free FROM p")
def metric_net_weights(spark, d):
    vtx, pin = hypergraph.line_model(sq(spark, d), "row")
    return hypergraph.net_weights(pin, vtx.select("v", (F.col("v") % 2).alias("part")), "lambdalambda1")


SIM = (
    f"{SQ}, n AS (SELECT i, COUNT(*) AS size FROM sq GROUP BY i), g AS (SELECT j, COUNT(*) AS deg FROM sq GROUP BY j), "
    "q AS (SELECT a.j AS v, b.j AS w, ANY_VALUE(x.deg) AS d1, ANY_VALUE(y.deg) AS d2, SUM(1.0 / size) AS ip, COUNT(*) AS k FROM sq a JOIN sq b ON a.i = b.i AND a.j < b.j JOIN n ON n.i = a.i JOIN g x ON x.j = a.j JOIN g y ON y.j = b.j GROUP BY 1, 2)"
)


def sim(spark, d, scaling):
    pin = hypergraph.line_model(sq(spark, d), "col")[1]
    return hypergraph.similarity(pin, scaling)


@query(f"WITH {SIM} SELECT v, w, ROUND(ip / LEAST(d1, d2), 9) AS ip FROM q")
def similarity_minscaled(spark, d):
    return sim(spark, d, "min").withColumn("ip", F.round("ip", 9))


@query(f"WITH {SIM} SELECT v, w, ROUND(ip / (d1 + d2 - k), 9) AS ip FROM q")
def similarity_jaccard(spark, d):
    return sim(spark, d, "jaccard").withColumn("ip", F.round("ip", 9))


@query(f"WITH {SIM} SELECT v, w, ROUND(ip / SQRT(d1 * d2), 9) AS ip FROM q")
def similarity_cosine(spark, d):
    return sim(spark, d, "cos").withColumn("ip", F.round("ip", 9))


BEST = f"WITH {SIM}, s AS (SELECT v, w, ip / LEAST(d1, d2) AS ip, d2 FROM q UNION ALL SELECT w, v, ip / LEAST(d1, d2), d1 FROM q), r AS (SELECT v, w, ROW_NUMBER() OVER (PARTITION BY v ORDER BY ROUND(ip, 9) DESC, d2, w) AS k FROM s) "


@query(BEST + "SELECT v, w FROM r WHERE k = 1")
def best_neighbour(spark, d):
    return hypergraph.best_neighbour(hypergraph.similar(hypergraph.line_model(sq(spark, d), "col")[1], "min", directed=True))


@query(BEST + ", b AS (SELECT v, w FROM r WHERE k = 1) SELECT a.v, a.w FROM b a JOIN b c ON a.v = c.w AND a.w = c.v WHERE a.v < a.w")
def handshake_matching(spark, d):
    return hypergraph.mutual_pairs(best_neighbour(spark, d))


@query(f"WITH {NZ}, p AS (SELECT DISTINCT i // 2 AS v, j AS n FROM nz) SELECT v, n FROM p WHERE n IN (SELECT n FROM p GROUP BY n HAVING COUNT(*) > 1)")
def contract_pairs(spark, d):
    vtx, pin = hypergraph.line_model(nz(spark, d), "row")
    return hypergraph.contract(vtx, pin, vtx.select("v", F.floor(F.col("v") / 2).alias("grp")))[1]


# Reordering


ORDER = "WITH {nz}, s AS (SELECT j AS idx, bool_or(i % 5 < 2 AND j < (SELECT COUNT(*) FROM supplier) * 0.6) AS l, bool_or(i % 5 >= 2 AND j >= (SELECT COUNT(*) FROM supplier) * 0.3) AS r FROM nz GROUP BY j) SELECT ROW_NUMBER() OVER (ORDER BY CASE WHEN l AND r THEN {b} WHEN l THEN {a} WHEN r THEN {c} ELSE 3 END, idx) - 1 AS pos, idx FROM s"


def order(spark, d, mode):
    n = count_table(spark, d, "supplier")
    side = nz(spark, d).groupBy(F.col("j").alias("idx")).agg(
        F.bool_or((F.col("i") % 5 < 2) & (F.col("j") < 0.6 * n)).alias("has_left"), F.bool_or((F.col("i") % 5 >= 2) & (F.col("j") >= 0.3 * n)).alias("has_right")
    )
    return ordinal.split_order(side, mode)


@query(ORDER.format(nz=NZ, a=0, b=1, c=2))
def sbd_order(spark, d):
    return order(spark, d, "infix")


@query(ORDER.format(nz=NZ, a=0, b=2, c=1))
def bbd_order(spark, d):
    return order(spark, d, "postfix")


@query(ORDER.format(nz=NZ, a=1, b=0, c=2))
def reverse_bbd_order(spark, d):
    return order(spark, d, "prefix")


# After a split, and vectors

FREE = f"WITH {SQ}, t AS (SELECT i, j, re, ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS t, CAST(CASE WHEN (i + j) % 3 = 0 THEN 1 ELSE 0 END AS INT) AS part FROM sq), f AS (SELECT * FROM t WHERE part = 0 AND i IN (SELECT i FROM t WHERE part = 1) AND j IN (SELECT j FROM t WHERE part = 1)) "


def two_parts(spark, d):
    m = ordinal.ordinal(sq(spark, d), name="t")
    return m.withColumn("part", F.when((F.col("i") + F.col("j")) % 3 == 0, 1).otherwise(0))


@query(FREE + "SELECT i, j, t FROM f")
def free_nonzeros(spark, d):
    return matrix.free_nonzeros(two_parts(spark, d), 0, 1).select("i", "j", "t")


@query(
    FREE + ", w AS (SELECT COUNT(*) FILTER (part = 0) AS w0, COUNT(*) FILTER (part = 1) AS w1 FROM t), g AS (SELECT t, ROW_NUMBER() OVER (ORDER BY t) AS s FROM f) "
    "SELECT t.i, t.j, CASE WHEN t.t IN (SELECT g.t FROM g, w WHERE w1 + s <= w0 - s AND w1 + 1 < w0 - 1) THEN 1 ELSE part END AS part FROM t"
)
def free_nonzero_moves(spark, d):
    return vectors.move_free(two_parts(spark, d), 0, 1).select("i", "j", "part")


@query(f"WITH {BNZ}, c AS (SELECT DISTINCT i AS idx, part FROM bnz), l AS (SELECT idx, MIN(part) AS part FROM c GROUP BY idx HAVING COUNT(*) = 1) SELECT idx, part FROM l")
def unique_owners(spark, d):
    return vectors.unique_owners(bnz(spark, d), "row")


@query(f"WITH {BNZ}, c AS (SELECT DISTINCT i AS idx, part FROM bnz) SELECT idx, part FROM c WHERE idx IN (SELECT idx FROM c GROUP BY idx HAVING COUNT(*) > 1)")
def reduced_comm(spark, d):
    return vectors.reduced(bnz(spark, d), "row")


@query(
    "WITH o AS (SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 5 AS INT) END AS part FROM supplier), h AS (SELECT CAST(q AS INT) AS part, (SELECT COUNT(*) FROM o WHERE o.part = q) AS nv FROM range(8) x(q)), "
    "k AS (SELECT part, (SELECT MAX(nv) FROM h) - nv AS d FROM h), c AS (SELECT part, SUM(d) OVER (ORDER BY part) AS hi, d FROM k), u AS (SELECT idx, ROW_NUMBER() OVER (ORDER BY idx) - 1 AS r FROM o WHERE part IS NULL) "
    "SELECT idx, part FROM o WHERE part IS NOT NULL UNION ALL SELECT idx, CASE WHEN r < (SELECT MAX(hi) FROM c) THEN (SELECT MIN(part) FROM c WHERE hi > r) ELSE CAST((r - (SELECT MAX(hi) FROM c)) % 8 AS INT) END FROM u"
)
def fill_empty_lines(spark, d):
    o = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("idx"), F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_suppkey") % 5).cast("int")).alias("part"))
    return vectors.fill_unowned(o, P)


@query(
    f"WITH {SQ}, t AS (SELECT i, j, ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS t, CAST(CASE WHEN (i + j) % 7 < 2 THEN 0 WHEN (i + j) % 7 < 5 THEN 1 ELSE 2 END AS INT) AS part FROM sq), w AS (SELECT COUNT(*) FILTER (part = 0) AS a, COUNT(*) FILTER (part = 1) AS b FROM t), "
    "f AS (SELECT i, j, ROW_NUMBER() OVER (ORDER BY t) - 1 AS r FROM t WHERE part = 2) "
    "SELECT i, j, part FROM t WHERE part <> 2 UNION ALL SELECT i, j, CASE WHEN r < ABS(a - b) THEN CASE WHEN a < b THEN 0 ELSE 1 END ELSE CASE WHEN (r - ABS(a - b)) % 2 = 0 THEN 1 ELSE 0 END END FROM f, w"
)
def fill_free_entries(spark, d):
    m = ordinal.ordinal(sq(spark, d), name="t")
    k = (F.col("i") + F.col("j")) % 7
    return vectors.fill_free_entries(m.withColumn("part", F.when(k < 2, 0).when(k < 5, 1).otherwise(2))).select("i", "j", "part")


@query(f"WITH {SQ}, p AS (SELECT i, j, CAST((i + 2 * j) % 8 AS INT) AS part FROM sq) SELECT DISTINCT a.i AS idx, a.part FROM p a JOIN p b ON a.i = b.j AND a.part = b.part")
def intersection_uv(spark, d):
    return vectors.common_parts(sq(spark, d).withColumn("part", ((F.col("i") + 2 * F.col("j")) % 8).cast("int")))


@query(
    f"WITH RECURSIVE {SQ}, r AS (SELECT 0 AS k, i, i AS label FROM sq GROUP BY i UNION ALL "
    "(WITH c AS (SELECT j, MIN(label) AS label FROM r JOIN sq USING (i) GROUP BY j), n AS (SELECT i, MIN(c.label) AS label FROM sq JOIN c USING (j) GROUP BY i) "
    "SELECT r.k + 1, i, n.label FROM r JOIN n USING (i) WHERE EXISTS (SELECT 1 FROM r JOIN n USING (i) WHERE n.label < r.label))) SELECT i, MIN(label) AS label FROM r GROUP BY i"
)
def connected_components(spark, d):
    return components.matrix_components(sq(spark, d))


# Whole recursive orders and outputs

RANGE = (
    f"WITH {SQ}, l AS (SELECT j AS idx, MIN(LEAST(7, j * 8 // (SELECT COUNT(*) FROM part) + (i % 97 = 0)::INT)) AS a, MAX(LEAST(7, j * 8 // (SELECT COUNT(*) FROM part) + (i % 97 = 0)::INT)) AS b FROM sq GROUP BY j), "
    "k AS (SELECT idx, CASE WHEN b < 4 THEN '0' || CASE WHEN b < 2 THEN '0' || CASE WHEN b < 1 THEN '0' WHEN a >= 1 THEN '2' ELSE '1' END WHEN a >= 2 THEN '2' || CASE WHEN b < 3 THEN '0' WHEN a >= 3 THEN '2' ELSE '1' END ELSE '1' END "
    "WHEN a >= 4 THEN '2' || CASE WHEN b < 6 THEN '0' || CASE WHEN b < 5 THEN '0' WHEN a >= 5 THEN '2' ELSE '1' END WHEN a >= 6 THEN '2' || CASE WHEN b < 7 THEN '0' WHEN a >= 7 THEN '2' ELSE '1' END ELSE '1' END ELSE '1' END AS key FROM l), "
    "o AS (SELECT ROW_NUMBER() OVER (ORDER BY key, idx) - 1 AS pos, idx, key FROM k) "
)


def blocks_of_parts(spark, d):
    """Eight blocks of columns, of which every 97th order belongs to the next block."""
    block = F.floor(F.col("j") * P / count_table(spark, d, "part")) + (F.col("i") % 97 == 0).cast("int")
    return sq(spark, d).withColumn("part", F.least(F.lit(P - 1), block).cast("int"))


@query(RANGE + "SELECT * FROM o")
def recursive_sbd_order(spark, d):
    return reorder.recursive_order(blocks_of_parts(spark, d), "col", P, "infix")


@query(RANGE + ", b AS (SELECT key, MIN(pos) AS start, COUNT(*) AS size FROM o GROUP BY key) SELECT ROW_NUMBER() OVER (ORDER BY start) - 1 AS ord, start, size, key, left(key, length(key) - 1) AS parent FROM b")
def block_hierarchy(spark, d):
    return reorder.blocks(reorder.recursive_order(blocks_of_parts(spark, d), "col", P, "infix"))


@query(f"WITH {SQ} SELECT (i + 1) || ' ' || (j + 1) || ' ' || CAST(re AS BIGINT) AS line FROM sq")
def entry_lines(spark, d):
    return matrix_market.entry_lines(sq(spark, d), matrix_market.MatrixMeta(field="I")).select("line")


@query(f"WITH {OWN} SELECT idx AS pos, (idx + 1) || ' ' || (part + 1) AS line FROM own UNION ALL SELECT -1, (SELECT COUNT(*) FROM supplier) || ' 8'")
def vector_lines(spark, d):
    return matrix_market.vector_lines(owner(spark, d), count_table(spark, d, "supplier"), P)


@query("SELECT DISTINCT s_suppkey AS pos, CAST(s_suppkey % 8 AS VARCHAR) AS line FROM supplier")
def dimacs_owners(spark, d):
    return owner(spark, d).select(F.col("idx").alias("pos"), F.col("part").cast("string").alias("line"))


@query(f"""WITH {SQ} SELECT '<rect x="' || (j * 10) || '" y="' || (i * 10) || '" width="10" height="10" fill="' || CASE (i * 4 // {ORDERS}) WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'green' ELSE 'orange' END || '"/>' AS line FROM sq""")
def svg_rectangles(spark, d):
    return matrix_market.svg(sq(spark, d).withColumn("part", F.floor(F.col("i") * 4 / orders(spark, d)).cast("int")), orders(spark, d), orders(spark, d))


@query(
    f"WITH {DNZ}, k AS (SELECT CAST(FLOOR(i * 64 / (SELECT COUNT(*) FROM part)) AS BIGINT) AS y, CAST(FLOOR(j * 64 / (SELECT COUNT(*) FROM supplier)) AS BIGINT) AS x, part, COUNT(*) AS n FROM dnz GROUP BY 1, 2, 3) "
    "SELECT y, x, part FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY y, x ORDER BY n DESC, part) AS r FROM k) WHERE r = 1"
)
def raster_image(spark, d):
    return matrix_market.raster(dnz(spark, d), count_table(spark, d, "part"), count_table(spark, d, "supplier"), 64)
