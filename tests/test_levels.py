"""Operators for hypergraphs beyond one task: numbering, candidate neighbours, matching, refinement; the data source."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from netloom.operators import bids, hypergraph, matching, metrics, neighbours, ordinal, refinement
from netloom.plans import partition as module
from netloom.plans.options import Options
from netloom.plans.partition import distribute_vector, partition
from netloom.sources import matrix_market as mm
from netloom.sources import mtx


def hypergraph_of(spark, rng, vertices, nets, size):
    pins = sorted({(v, n) for n in range(nets) for v in rng.sample(range(vertices), rng.randint(1, size))})
    weights = {v: rng.randint(1, 3) for v in range(vertices)}
    return pins, weights, spark.createDataFrame(list(weights.items()), "v long, wgt long"), spark.createDataFrame(pins, "v long, n long")


def cut_of(pins, side):
    seen = {}
    for v, n in pins:
        seen.setdefault(n, set()).add(side[v])
    return sum(len(s) > 1 for s in seen.values())


def test_placed_numbers_rows_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), k) for k in range(500)]
    got = ordinal.placed(spark.createDataFrame(rows, "a long, b long").repartition(7), "a", F.col("b").desc()).orderBy("pos").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda r: (r[0], -r[1])) and [r["pos"] for r in got] == list(range(500))
    assert ordinal.placed(spark.createDataFrame([], "a long"), "a").count() == 0


@pytest.mark.parametrize("source", [0, 1])
def test_batches_change_the_cut_as_moving_them_does(spark, source):
    rng = random.Random(source)
    pins, weights, vtx, pin = hypergraph_of(spark, rng, 40, 60, 6)
    side = {v: rng.randint(0, 1) for v in weights}
    found = refinement.batches(vtx, pin, spark.createDataFrame(list(side.items()), "v long, side int"), source)
    at = {r["v"]: r["batch"] for r in found.movers.collect()}
    before = cut_of(pins, side)
    assert refinement.cut_size(pin, spark.createDataFrame(list(side.items()), "v long, side int")) == before
    for batch, delta, weight in found.table:
        movers = [v for v, b in at.items() if b == batch]
        assert all(side[v] == source for v in movers) and sum(weights[v] for v in movers) == weight
        side |= {v: 1 - source for v in movers}
        after = cut_of(pins, side)
        assert after - before == delta
        before = after


@pytest.mark.parametrize("seed", range(4))
def test_refinement_cuts_fewer_nets_within_bounds(spark, seed):
    """Two planted halves with few nets between them, a third of the vertices misplaced."""
    rng = random.Random(seed)
    pins = [(v, n) for n in range(120) for v in rng.sample(range(30) if n % 2 else range(30, 60), 3)] + [(v, n) for n in range(120, 126) for v in rng.sample(range(60), 2)]
    side = {v: int(v >= 30) if rng.random() > 0.33 else rng.randint(0, 1) for v in range(60)}
    vtx, pin, start = spark.createDataFrame([(v, 1) for v in range(60)], "v long, wgt long"), spark.createDataFrame(pins, "v long, n long"), spark.createDataFrame(list(side.items()), "v long, side int")
    caps = (33, 33)
    out = {r["v"]: r["side"] for r in refinement.refine(vtx, pin, start, caps).collect()}
    load = [list(out.values()).count(k) for k in (0, 1)]
    assert len(out) == 60 and max(load) <= 33 and cut_of(pins, out) <= 12 < cut_of(pins, side)


def test_best_prefix_mends_balance_first():
    assert refinement.best_prefix([(0, -1, 5), (1, 2, 5), (2, -4, 50)], [50, 10], (40, 40), 0) == (1, 1, 10)
    assert refinement.best_prefix([(0, 1, 5)], [30, 30], (40, 40), 0) is None


@pytest.mark.parametrize("reach", [4, 16])
def test_candidates_are_linear_in_pins_and_whole_in_small_nets(spark, reach):
    rng = random.Random(3)
    pins = [(v, n) for n in range(40) for v in rng.sample(range(50), rng.randint(1, 4))]
    pin = spark.createDataFrame(pins, "v long, n long")
    rows = lambda df: {(r["v"], r["w"]): round(r["ip"], 9) for r in df.collect()}
    for scaling in ("min", "no", "cos", "max", "jaccard"):
        assert rows(neighbours.near_similarity(pin, scaling, reach=reach)) == rows(hypergraph.similarity(pin.distinct(), scaling))
    hub = spark.createDataFrame([(v, n) for v in range(600) for n in (-1, v // 3)], "v long, n long")  # one net with all vertices
    found = {(r["v"], r["w"]) for r in neighbours.candidates(hub, reach).collect()}
    assert len(found) <= (reach - 1) * 1200 and {(v, w) for v in range(600) for w in range(v + 1, 600) if v // 3 == w // 3} <= found


def greedy(edges):
    used, out = set(), set()
    low = 1 << 32
    key = lambda e: (-round(e[2], 9), (e[0] * neighbours.MIX_1 % low + e[1] * neighbours.MIX_2) % low, e[0], e[1])
    for v, w, _ in sorted(((min(e[:2]), max(e[:2]), e[2]) for e in edges if e[0] != e[1]), key=key):
        if not used & {v, w}:
            used |= {v, w}
            out.add((v, w))
    return out


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_matching_equals_greedy(spark, levels):
    rng = random.Random(levels)
    edges = {(min(a, b), max(a, b)): rng.randint(1, levels) / 7 for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(300))}
    rows = [(*e, s) for e, s in edges.items()]
    got = matching.dominant_matching(spark.createDataFrame(rows, "v long, w long, ip double"))
    assert {(r["v"], r["w"]) for r in got.collect()} == greedy(rows)
    chain = [(k, k + 1, 1.0) for k in range(400)]  # equal scores along a path
    got = {(r["v"], r["w"]) for r in matching.dominant_matching(spark.createDataFrame(chain, "v long, w long, ip double")).collect()}
    assert got == greedy(chain)


def test_groups_stay_within_their_size(spark):
    rng = random.Random(4)
    edges = spark.createDataFrame([(a, b, rng.random()) for a in range(30) for b in range(a + 1, 30)], "v long, w long, ip double")
    vertices = spark.range(31).withColumnRenamed("id", "v")
    for largest, most in ((1, 31), (2, 16), (4, 9), (5, 11)):
        got = matching.groups(edges, vertices, largest).collect()
        sizes = {}
        for r in got:
            sizes[r["grp"]] = sizes.get(r["grp"], 0) + 1
        assert len(got) == 31 and max(sizes.values()) <= largest and len(sizes) <= most and all(r["grp"] <= r["v"] for r in got)


def matrices(spark):
    rng = random.Random(6)
    square = 12
    grid = {(a * square + b, c * square + d) for a in range(square) for b in range(square) for c, d in ((a, b), (a + 1, b), (a, b + 1)) if c < square and d < square}
    blocks = {(20 * k + rng.randrange(20), 20 * k + rng.randrange(20)) for k in range(4) for _ in range(80)} | {(rng.randrange(80), rng.randrange(80)) for _ in range(6)}
    return {
        "tridiagonal": {(a, b) for a in range(80) for b in (a - 1, a, a + 1) if 0 <= b < 80},
        "arrow": {(a, b) for a in range(40) for b in (a - 1, a, a + 1) if 0 <= b < 40} | {(0, b) for b in range(40)},
        "grid": grid | {(b, a) for a, b in grid},
        "blocks": blocks,
    }


@pytest.mark.parametrize(("name", "limit"), [("tridiagonal", 200), ("arrow", 150), ("grid", 480), ("blocks", 300)])
def test_a_lower_limit_of_the_kernel_keeps_quality(spark, monkeypatch, name, limit):
    """Coarsening and refining in Spark is nearly as good as one task that sees all. Loads and volume are counted by SQL."""
    entries = sorted(matrices(spark)[name])
    nz = spark.createDataFrame(entries, "i long, j long")
    options = Options({"CheckUpperBound": "no"})
    volume = []
    for pins in (2_000_000, limit):
        monkeypatch.setattr(module, "KERNEL_PINS", pins)
        parts = partition(nz, 2, 0.1, options).nz.select("i", "j", "part").toPandas()
        con = duckdb.connect()
        con.register("x", parts)
        assert sorted(zip(parts["i"], parts["j"], strict=True)) == entries
        assert con.execute("SELECT max(n) FROM (SELECT count(*) n FROM x GROUP BY part)").fetchone()[0] <= 1.1 * len(entries) / 2
        volume.append(con.execute("SELECT (SELECT sum(k - 1) FROM (SELECT count(DISTINCT part) k FROM x GROUP BY i)) + (SELECT sum(k - 1) FROM (SELECT count(DISTINCT part) k FROM x GROUP BY j))").fetchone()[0])
        assert volume[-1] == sum(metrics.volumes(spark.createDataFrame(parts), a).first()["vol"] for a in ("row", "col"))
    assert volume[1] <= max(1.2 * volume[0], volume[0] + 1), volume


def source_rows(spark, path, **options):
    mtx.register(spark)
    return [tuple(r) for r in spark.read.format("mtx").options(**options).load(str(path)).collect()]


def test_source_reads_ranges_of_any_size(spark, tmp_path):
    rng = random.Random(2)
    entries = [(rng.randrange(90), rng.randrange(70), rng.random() * 10 ** rng.randint(-3, 5)) for _ in range(200)]
    text = "%%MatrixMarket matrix coordinate real general\n% about\n90 70 200\n" + "".join(f" {i + 1}\t{j + 1}  {x!r}\n" for i, j, x in entries)
    (tmp_path / "a.mtx").write_text(text + "% the end")
    expected = [(k, *e) for k, e in enumerate(entries)]
    for size in (211, 1 << 20):
        assert sorted(source_rows(spark, tmp_path / "a.mtx", rangebytes=size)) == expected
    m = mtx.load(spark, str(tmp_path / "a.mtx"), range_bytes=300)
    assert sorted(tuple(r) for r in m.nz.collect()) == expected and m.meta.tail == "% the end" and m.meta.header == "% about"


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 1000])
def test_ranges_share_out_lines(tmp_path, size):
    text = b"abc\n\n  \nlonger line\nx\n" + b"y" * 40 + b"\nlast"
    for ending in (b"", b"\n", b"\n\n"):
        (tmp_path / "t").write_bytes(text + ending)
        system, _ = mtx.opened(str(tmp_path / "t"))
        each = [[line for some in mtx.lines_of(system, r) for line in some] for r in mtx.ranges(str(tmp_path / "t"), size)]
        assert [line for lines in each for line in lines] == (text + ending).removesuffix(b"\n").split(b"\n")
        assert [len(lines) for lines in each] == [mtx.count_lines(system, r) for r in mtx.ranges(str(tmp_path / "t"), size)]


def test_source_reads_a_folder_in_order_of_names(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "0.mtx").write_text("%%MatrixMarket distributed-matrix coordinate pattern symmetric\n3 3 3 2\n0\n1\n3\n")
    for k, line in enumerate(("3 1", "2 1", "3 3")):
        (tmp_path / "x" / f"{k + 1}.mtx").write_text(f"{line}\n")
    (tmp_path / "x" / "_ignored").write_text("nothing")
    assert sorted(source_rows(spark, tmp_path / "x")) == [(0, 2, 0, 0), (1, 1, 0, 1), (2, 2, 2, 1)]


def test_source_reads_weights(spark, tmp_path):
    (tmp_path / "w.mtx").write_text("%%MatrixMarket weighted-matrix coordinate integer general\n3 2 2 3\n1 1 4\n3 2 5\n7\n8\n9\n5\n6\n% tail")
    m = mtx.load(spark, str(tmp_path / "w.mtx"), range_bytes=5)
    assert sorted(tuple(r) for r in m.nz.collect()) == [(0, 0, 0, 4.0), (1, 2, 1, 5.0)] and m.meta.tail == "% tail"
    assert sorted(tuple(r) for r in m.row_weight.collect()) == [(0, 7), (1, 8), (2, 9)] and sorted(tuple(r) for r in m.col_weight.collect()) == [(0, 5), (1, 6)]


@pytest.mark.parametrize("body", ["2 2 2\n1 1 1\n2 3 1\n", "2 2 2\n1 1\n2 2 1\n", "2 2 2\n1 1 x\n2 2 1\n"])
def test_source_raises_on_bad_entries(spark, tmp_path, body):
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix coordinate real general\n" + body)
    with pytest.raises(Exception, match=r"entry|bounds|convert|ValueError"):
        source_rows(spark, tmp_path / "bad.mtx")


@pytest.mark.parametrize(("field", "extended"), [("R", False), ("C", True), ("I", False), ("P", True)])
def test_writer_round_trip(spark, tmp_path, field, extended):
    rng = random.Random(7)
    rows = [(k, rng.randrange(50), rng.randrange(60), float(rng.randint(-9, 9)) if field == "I" else rng.random(), rng.random(), rng.randrange(4)) for k in range(300)]
    nz = spark.createDataFrame(rows, "t long, i long, j long, re double, im double, part int").repartition(6)
    meta = mm.MatrixMeta(object="D", field=field, extended=extended, m=50, n=60, nprocs=5, header="% head", tail="% tail")
    for _ in range(2):  # a second run takes the first one's place
        mtx.save(nz, str(tmp_path / "out"), meta)
    columns = ["i", "j", *mtx.VALUES[field], "part"]
    m = mtx.load(spark, str(tmp_path / "out"), range_bytes=500)
    assert [tuple(r) for r in m.nz.orderBy("t").select(columns).collect()] == [tuple(r) for r in nz.orderBy("part", "t").select(columns).collect()]
    assert (m.meta.nnz, m.meta.nprocs, m.meta.header, m.meta.tail, m.meta.extended) == (300, 5, "% head", "% tail", extended)
    whole = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("*.mtx")))  # the files in order are one text
    (tmp_path / "one.mtx").write_text(whole)
    again = mm.read(spark, str(tmp_path / "one.mtx"))
    assert [tuple(r) for r in again.nz.orderBy("t").select(columns).collect()] == [tuple(r) for r in m.nz.orderBy("t").select(columns).collect()]


def test_writer_digits_and_failures(spark, tmp_path):
    nz = spark.createDataFrame([(0, 0, 0, 1 / 3)], "t long, i long, j long, re double")
    mtx.save(nz, str(tmp_path / "c"), mm.MatrixMeta(m=1, n=1), compat=True)
    assert "1 1 0.333333\n" in "".join(f.read_text() for f in (tmp_path / "c").glob("part-*.mtx"))
    mtx.save(nz.where("i > 0"), str(tmp_path / "none"), mm.MatrixMeta(m=1, n=1))
    mtx.register(spark)
    bad = spark.range(40).select((F.col("id") % 2).alias("i"), F.raise_error(F.lit("stop")).cast("long").alias("j")).repartition(3)
    with pytest.raises(Exception, match="stop"):
        bad.write.format("mtx").options(m="2", n="2", field="P").mode("append").save(str(tmp_path / "gone"))
    assert not list((tmp_path / "gone").glob("_parts.json"))
    with pytest.raises(Exception, match="missing columns"):
        spark.range(3).write.format("mtx").options(m="2", n="2").mode("append").save(str(tmp_path / "gone"))


def line_sets(rng, n, p, most):
    return [(k, sorted(rng.sample(range(p), rng.randint(2, most)))) for k in range(n)]


def sums(rows, p):
    ns, nr = [0] * p, [0] * p
    for _, s, q in rows:
        assert q in s
        ns[q] += len(s) - 1
        for x in s:
            nr[x] += x != q
    return ns, nr


@pytest.mark.parametrize(("block", "order"), [(50, "decrease"), (5000, "increase"), (7, "random")])
def test_bids_come_near_the_bound(spark, block, order):
    rng, p = random.Random(block), 8
    lines = line_sets(rng, 600, p, 5)
    df = spark.createDataFrame(lines, "idx long, parts array<int>")
    got = [tuple(r) for r in bids.owners(df.repartition(5), p, block=block, order=order).collect()]
    assert sorted(r[:2] for r in got) == lines
    ns, nr = sums(got, p)
    assert bids.part_sums(spark.createDataFrame(got, "idx long, parts array<int>, owner int"), p) == (ns, nr)
    volume = sum(len(s) - 1 for _, s in lines)
    bound = max(-(-volume // p), max(r["lb"] for r in metrics.local_bounds(df.select(F.col("idx").alias("i"), F.explode("parts").alias("part")), "row").collect()))
    assert max(*ns, *nr) <= 1.2 * bound
    assert sorted(got) == sorted(tuple(r) for r in bids.owners(df.repartition(2), p, block=block, order=order).collect())
    assert bids.owners(df.where("idx < 0"), p).count() == 0


def test_pair_owners_are_optimal(spark):
    lines = [(k, [b, a]) for k, (a, b) in enumerate((a, b) for a in range(6) for b in range(a) for _ in range(7))]  # each two of 6 parts share 7 lines
    ns, nr = sums([tuple(r) for r in bids.pair_owners(spark.createDataFrame(lines, "idx long, parts array<int>"), 6).collect()], 6)
    assert max(*ns, *nr) == -(-5 * 7 // 2)
    rng = random.Random(3)
    lines = line_sets(rng, 301, 5, 2)
    got = [tuple(r) for r in bids.pair_owners(spark.createDataFrame(lines, "idx long, parts array<int>").repartition(3), 5).collect()]
    ns, nr = sums(got, 5)
    assert sorted(r[:2] for r in got) == lines and all(abs(a - b) <= 1 for a, b in zip(ns, nr, strict=True))


def test_vectors_have_owners_in_their_lines(spark):
    rng = random.Random(8)
    nz = sorted({(rng.randrange(60), rng.randrange(40), rng.randrange(4)) for _ in range(300)})
    df = spark.createDataFrame(nz, "i long, j long, part int")
    for axis, size, k in (("row", 70, 0), ("col", 45, 1)):
        owner = {r["idx"]: r["part"] for r in distribute_vector(df, axis, size, 4).collect()}
        parts = {}
        for e in nz:
            parts.setdefault(e[k], set()).add(e[2])
        assert len(owner) == size and all(owner[x] in s for x, s in parts.items()) and set(owner.values()) <= set(range(4))


@pytest.mark.parametrize("strategy", ["hybrid", "localbest"])
def test_models_as_tasks_and_line_counts_by_changes(spark, strategy):
    """Each level's kept counts equal a recount; the models' tasks give what one task gives that tries all in turn."""
    from netloom.operators import line_parts

    nz = spark.createDataFrame(sorted(matrices(spark)["blocks"]), "i long, j long")
    options, seen = Options({"SplitStrategy": strategy, "CheckUpperBound": "no"}), []
    out = partition(nz, 4, 0.2, options, on_split=lambda level, x: seen.append(level) or True, keep_line_parts=True)
    row = lambda df: sorted(tuple(r) for r in df.select("axis", "idx", "part", "n").collect())
    assert seen == [1, 2] and row(out.line_parts) == row(line_parts.counted(out.nz))
    assert line_parts.volume(out.line_parts) == sum(metrics.volumes(out.nz, a).first()["vol"] for a in ("row", "col"))
    i, j = (nz.orderBy("i", "j").toPandas()[c].to_numpy() for c in "ij")
    _, side = module.bisect(i, j, module.split_bounds(len(i), 2, int(1.2 * len(i) / 2))[2:], options, options["Seed"])
    two = partition(nz, 2, 0.2, options).nz.orderBy("i", "j").toPandas()["part"]
    assert two.tolist() == side.tolist()
