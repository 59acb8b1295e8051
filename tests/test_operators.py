"""Analytic cases with known answers."""

import pytest
from pyspark.sql import functions as F

from netloom.functions.hyper import exact_bipartition, subset_sum, upper_bound_parts
from netloom.functions.vector_kernels import measure, pairs_optimal
from netloom.operators import matrix, metrics, ordinal, vectors
from netloom.plans.options import Options
from netloom.plans.partition import parts_for, partition, split_bounds


def grid(spark, p=8, k=80, q=4):
    """Entries at (q a, q b); parts are chunks of k * k / p in row order."""
    d = spark.range(k * k)
    return d.select((F.floor(F.col("id") / k) * q).alias("i"), (F.col("id") % k * q).alias("j"), F.floor(F.col("id") * p / (k * k)).cast("int").alias("part"))


def test_volume_and_owners_on_a_grid(spark):
    p, k, q = 8, 80, 4
    n = k * q
    nz = grid(spark, p, k, q)
    owner = spark.range(n).select(F.col("id").alias("idx"), (F.floor(F.col("id") / q) % p).cast("int").alias("part"))
    s = metrics.comm_summary(metrics.proc_stats(nz, owner, "col", p)).first()
    assert (s["vol"], s["max_send"], s["max_recv"], s["max_comp"], s["components"]) == (n * (p - 1) // q, n * (p - 1) // (q * p), n * (p - 1) // (q * p), n // p, n)
    assert metrics.volumes(nz, "row").first()["vol"] == 0


def test_dedup_of_doubled_dense_matrix(spark):
    n = 19
    one = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j")).withColumn("re", (F.col("i") + n * F.col("j")).cast("double"))
    out = matrix.dedup_sum(one.union(one))
    assert out.count() == n * n and out.where("re <> 2 * (i + 19 * j)").isEmpty()


def test_symmetry_round_trips(spark):
    low = spark.createDataFrame([(k, k, 1.0, 0.0) for k in range(16)] + [(k + 1, k, 2.0, 3.0) for k in range(15)], "i long, j long, re double, im double")
    full = matrix.sym_to_full(low, "H")
    assert full.count() == 16 + 30 and full.where("i < j AND im <> -3").isEmpty()
    assert matrix.full_to_sym(full).count() == 31
    with pytest.raises(ValueError):
        matrix.sym_to_full(low, "K")
    assert matrix.lower_triangle(matrix.random_triangle(low)).exceptAll(low).isEmpty()


def test_dummies(spark):
    nz = spark.createDataFrame([(0, 0, 1.0), (2, 1, 1.0)], "i long, j long, re double")
    out = matrix.add_dummies(nz, 4)
    assert out.where("is_dummy").count() == 3 and matrix.remove_dummies(out).count() == 2


def test_ordinal_is_a_position(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 61).alias("i"), F.col("id").alias("j"))
    got = [r["pos"] for r in ordinal.ordinal(d.repartition(7)).orderBy("i", "j").collect()]
    assert got == list(range(5000))


def test_simple_split_bounds(spark):
    d = spark.range(100).withColumnRenamed("id", "t")
    out = ordinal.simple_split(d, F.lit(1), 60, 60)
    assert out.groupBy("part").count().orderBy("part").collect()[0]["count"] == 50
    with pytest.raises(ValueError):
        ordinal.simple_split(d, F.lit(60), 100, 5000)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "i long, j long, re double, part int")
    assert matrix.dedup_sum(none).count() == 0
    assert metrics.volumes(none, "row").first()["vol"] == 0
    assert ordinal.ordinal(none).count() == 0
    assert partition(none, 4).nz.count() == 0


def test_fill_unowned_levels_first(spark):
    owner = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, None), (4, None), (5, None), (6, None), (7, None)], "idx long, part int")
    got = {r["idx"]: r["part"] for r in vectors.fill_unowned(owner, 3).collect()}
    assert [got[k] for k in range(8)] == [0, 0, 1, 1, 2, 2, 0, 1]


def test_pairs_are_split_optimally():
    lines = [[a, b] for a in range(6) for b in range(a) for _ in range(7)]
    assert measure(lines, pairs_optimal(lines, 6), 6) == -(-5 * 7 // 2)


def test_processors_follow_weight():
    assert parts_for([60, 20, 20], 5) == [3, 1, 1]
    assert sum(parts_for([1, 1, 98], 10)) == 10
    low, high, cap_low, cap_high = split_bounds(1000, 4, 260)
    assert (low, high) == (2, 2) and cap_low + cap_high >= 1000 and cap_low <= 520


def test_subset_sum_exact_and_large():
    assert subset_sum([3, 5, 8], (8, 8)) in ([0, 0, 1], [1, 1, 0])
    assert subset_sum([7, 7], (13, 1)) is None
    items = list(range(1, 41))
    bins = subset_sum(items, (430, 430))
    assert bins is not None and max(sum(w for w, s in zip(items, bins, strict=True) if s == k) for k in (0, 1)) <= 430


def test_upper_bound_is_balanced():
    counts = [5, 1, 9, 2, 2, 7, 4]
    pieces = upper_bound_parts(counts, 3)
    load = [sum(c for x in pieces for q, c in x if q == k) for k in range(3)]
    assert max(load) <= -(-sum(counts) // 3) and [sum(c for _, c in x) for x in pieces] == counts
    assert sum(len(x) - 1 for x in pieces) <= 2


def brute_volume(i, j, cap):
    best = None
    for mask in range(1 << len(i)):
        load = bin(mask).count("1")
        if max(load, len(i) - load) <= cap:
            side = [mask >> k & 1 for k in range(len(i))]
            v = sum(len({s for s, y in zip(side, line, strict=True) if y == x}) - 1 for line in (i, j) for x in set(line))
            best = v if best is None else min(best, v)
    return best


def test_exact_bipartition_equals_brute_force():
    for i, j in (([0, 0, 1, 1, 2, 2], [0, 1, 1, 2, 2, 0]), ([0, 0, 0, 1, 1, 2, 3], [0, 1, 2, 0, 1, 2, 3]), ([0, 1, 2, 3], [0, 1, 2, 3])):
        cap = -(-len(i) // 2)
        _, volume, proven = exact_bipartition(i, j, cap)
        assert proven and volume == brute_volume(i, j, cap)


@pytest.mark.parametrize("strategy", ["mediumgrain", "localbest", "finegrain", "onedimrow"])
def test_partition_balances_a_tridiagonal_matrix(spark, strategy):
    n = 60
    nz = spark.createDataFrame([(a, b) for a in range(n) for b in (a - 1, a, a + 1) if 0 <= b < n], "i long, j long")
    for p in (3, 4):
        out = partition(nz, p, 0.1, Options({"SplitStrategy": strategy}))
        assert out.feasible and out.nz.count() == nz.count()
        assert sum(metrics.volumes(out.nz, a).first()["vol"] for a in ("row", "col")) <= 8 * (p - 1)


def arrow_matrix(spark, n):
    """Tridiagonal with a full first row: one net that no split leaves whole."""
    return spark.createDataFrame(sorted({(a, b) for a in range(n) for b in (a - 1, a, a + 1) if 0 <= b < n} | {(0, b) for b in range(n)}), "i long, j long")


@pytest.mark.parametrize("strategy", ["mediumgrain", "symfinegrain"])
def test_large_parts_keep_strategy_and_bounds(spark, monkeypatch, strategy):
    from netloom.plans import partition as module

    nz = arrow_matrix(spark, 40)
    options = Options({"SplitStrategy": strategy, "CheckUpperBound": "no"})
    small = partition(nz, 2, 0.1, options)
    monkeypatch.setattr(module, "KERNEL_PINS", 110)
    large = partition(nz, 2, 0.1, options)
    volume = [sum(metrics.volumes(x.nz, a).first()["vol"] for a in ("row", "col")) for x in (small, large)]
    print(strategy, volume)
    assert large.feasible and large.nz.select("i", "j").exceptAll(nz).isEmpty() and large.nz.count() == nz.count()
    assert volume[1] <= 41  # what any split into two keeps to


def test_alternate_turns_with_the_level():
    from netloom.plans.partition import kinds_of

    options = Options({"SplitStrategy": "alternate", "Alternate_FirstDirection": "row"})
    assert [kinds_of(options, k, 5, 9) for k in range(3)] == [["onedimrow"], ["onedimcol"], ["onedimrow"]]
    assert kinds_of(Options({"SplitStrategy": "alternate"}), 1, 5, 9) == ["onedimrow"]


def test_split_bounds_leave_room_for_the_splits_of_each_half():
    assert split_bounds(1000, 5, 230)[2:] == (400 + int(400 * 0.15 / 2), 600 + int(600 * 0.15 / 3))


def test_unsupported_options_raise(spark):
    with pytest.raises(NotImplementedError):
        partition(arrow_matrix(spark, 4), 2, 0.5, Options({"Coarsening_MatchingStrategy": "random"}))


def test_options_reject_what_is_unknown():
    assert Options.parse("Seed 7 # a comment\nMetric cutnet\n")["Seed"] == 7
    for bad in ({"Nope": 1}, {"Metric": "x"}, {"Seed": "abc"}, {"Metric": "cutnet", "Discard_Free_Nets": "no"}):
        with pytest.raises(ValueError):
            Options(bad)
    assert Options.parse(Options().to_text()).values == Options.arguments([f"-{k}={Options()[k]}" for k in Options.parse(Options().to_text()).values]).values
