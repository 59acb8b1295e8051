"""Whole runs: results are read back from what was written and counted again by SQL."""

import random
from pathlib import Path

import duckdb
import pytest

from netloom.plans.options import Options
from netloom.plans.outputs import run
from netloom.sources import mtx


def written(path):
    return "".join(f.read_text() for f in sorted(Path(path).glob("part-*"))).split("\n")[:-1]


def a_matrix(tmp_path, n=24, seed=1):
    rng = random.Random(seed)
    entries = sorted({(a, b) for a in range(n - 1) for b in (a - 1, a, a + 1) if 0 <= b < n} | {(rng.randrange(n), rng.randrange(n)) for _ in range(20)})
    (tmp_path / "a.mtx").write_text(f"%%MatrixMarket matrix coordinate real general\n{n} {n} {len(entries)}\n" + "".join(f"{i + 1} {j + 1} {k}.5\n" for k, (i, j) in enumerate(entries)))
    return str(tmp_path / "a.mtx"), entries


def test_original_mode(spark, tmp_path):
    path, entries = a_matrix(tmp_path)
    base = str(tmp_path / "r")
    done = run(spark, path, base, 3, 0.1, Options({"Permute": "SBD"}))
    m = mtx.load(spark, f"{base}-P3")
    parts = m.nz.toPandas()
    assert m.meta.nprocs == 3 and sorted(zip(parts["i"], parts["j"], strict=True)) == entries
    owners = {name: [tuple(int(x) - 1 for x in line.split()) for line in written(f"{base}-{name}3")[1:]] for name in "uv"}
    con = duckdb.connect()
    con.register("x", parts)
    for name, axis in (("v", "j"), ("u", "i")):
        con.execute(f"CREATE OR REPLACE TABLE o AS SELECT * FROM (VALUES {', '.join(map(str, owners[name]))}) t(idx, q)")
        assert [k for k, _ in owners[name]] == list(range(24))
        sums = f"WITH c AS (SELECT DISTINCT {axis} AS idx, part FROM x), a AS (SELECT part, q FROM c JOIN o USING (idx) WHERE part <> q) "
        vol = con.execute(sums + "SELECT count(*) FROM a").fetchone()[0]
        most = con.execute(sums + "SELECT (SELECT max(n) FROM (SELECT count(*) n FROM a GROUP BY q)), (SELECT max(n) FROM (SELECT count(*) n FROM a GROUP BY part))").fetchone()
        row = done.figures.where(f"vec = '{name}'").first()
        assert (row["vol"], row["max_send"], row["max_recv"]) == (vol, *most)
        assert con.execute(f"SELECT count(*) FROM o JOIN (SELECT {axis} AS idx, list(part) s FROM x GROUP BY 1) USING (idx) WHERE NOT list_contains(s, q)").fetchone()[0] == 0
    values = mtx.load(spark, f"{base}-I3").nz.orderBy("t").collect()
    assert [(r["i"], r["j"], int(r["re"]) - 1) for r in values] == [(r.i, r.j, r.part) for r in parts.sort_values("t").itertuples()]
    # Local indices lead back to the entries by way of the index sets.
    lines = [list(map(int, x.split())) for x in written(f"{base}-C3")]
    assert lines[0] == [24, 24, 3]
    at, sets = 1, {}
    for _ in range(3):
        q, mq, nq = lines[at]
        sets[q - 1] = [x[0] - 1 for x in lines[at + 1 : at + 1 + mq]], [x[0] - 1 for x in lines[at + 1 + mq : at + 1 + mq + nq]]
        at += 1 + mq + nq
    assert at == len(lines)
    local = mtx.load(spark, f"{base}-local3").nz.collect()
    assert sorted((sets[r["part"]][0][r["i"]], sets[r["part"]][1][r["j"]], r["re"]) for r in local) == sorted((r.i, r.j, r.re) for r in parts.itertuples())
    # The permuted matrix is the matrix in the written orders.
    order = {name: [int(x) - 1 for x in written(f"{base}-{name}3")] for name in ("row", "col")}
    assert all(x[0] == 23 and sorted(x[1:]) == list(range(24)) for x in order.values())
    moved = mtx.load(spark, f"{base}-reor-P3").nz.collect()
    assert sorted((order["row"][1 + r["i"]], order["col"][1 + r["j"]], r["re"]) for r in moved) == sorted((r.i, r.j, r.re) for r in parts.itertuples())
    assert written(f"{base}-rowblocks3")


def test_one_file_and_dimacs(spark, tmp_path):
    path, entries = a_matrix(tmp_path, seed=2)
    base = str(tmp_path / "r")
    run(spark, path, base, 2, 0.1, Options({"OutputMode": "onefile"}))
    objects = sorted(p.name for p in (tmp_path / "r-P2.emm").iterdir())
    assert objects == ["00-P", "01-local", "02-I", "03-u", "04-v", "05-C"]
    m = mtx.load(spark, f"{base}-P2.emm/00-P")
    assert m.meta.extended and m.nz.count() == len(entries)
    done = run(spark, path, base, 2, 0.1, Options({"OutputMode": "DIMACS", "SquareMatrix_DistributeVectorsEqual": "yes"}))
    owner = [int(x) for x in written(f"{base}2.part")]
    assert len(owner) == 24 and owner == [r["part"] for r in done.v.orderBy("idx").collect()] == [r["part"] for r in done.u.orderBy("idx").collect()]
    rows, cols = ({k: {r[1] for r in done.nz.select(c, "part").collect() if r[0] == k} for k in range(24)} for c in "ij")
    assert all(owner[k] in (rows[k] & cols[k] or rows[k] | cols[k] or {owner[k]}) for k in range(24))
    with pytest.raises(ValueError, match="equal vectors"):
        run(spark, path, base, 2, 0.1, Options({"OutputMode": "DIMACS"}))


def test_symmetric_input_is_unfolded(spark, tmp_path):
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n4 4 6\n1 1\n2 1\n2 2\n3 2\n4 3\n4 4\n")
    done = run(spark, str(tmp_path / "s.mtx"), None, 2, 0.3)
    assert done.nz.count() == 9 and done.nz.select("part").distinct().count() == 2
