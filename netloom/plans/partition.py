"""Partitioning a matrix over P parts by recursive bisection.

All parts of one level are split at the same time: each part's nonzeros go to one task (``applyInPandas``), which builds the
hypergraph model, bisects it by the multilevel kernel and improves the result. A part with more pins than
``KERNEL_PINS`` has the same model built and coarsened by DataFrame steps until it fits, and the split refined on every level on
the way back, so no task gets more than a bounded hypergraph, and the same strategies and bounds hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.checkpoints import cut
from ..functions.hyper import build, multilevel, refine, subset_sum, upper_bound_parts
from ..operators import bids, hypergraph, line_parts, matching, metrics, neighbours, ordinal, refinement
from ..operators.vectors import fill_unowned, reduced, unique_owners
from .options import Options

KERNEL_PINS = 2_000_000
#: Models of the strategies that try several.
GRID = {"localbest": ["onedimrow", "onedimcol"], "hybrid": ["onedimrow", "onedimcol", "finegrain"]}


def parts_for(weights: list[int], p: int, finished: set[int] = frozenset()) -> list[int]:
    """Processors per part in proportion to weight: at least one each, the rest to the largest shortfalls; finished parts have one."""
    open_ = [k for k in range(len(weights)) if k not in finished]
    left, total = p - (len(weights) - len(open_)), sum(weights[k] for k in open_)
    out = [1] * len(weights)
    share = {k: weights[k] * left / total if total else 0 for k in open_}
    for k in open_:
        out[k] = max(1, math.floor(share[k]))
    spare = left - sum(out[k] for k in open_)
    for k in sorted(open_, key=lambda k: (out[k] - share[k], k))[: max(spare, 0)]:
        out[k] += 1
    for _ in range(-spare):  # what the minimum of one has used too much comes from those with most beyond their share
        out[max((k for k in open_ if out[k] > 1), key=lambda k: (out[k] - share[k], -k))] -= 1
    return out


def split_bounds(weight: int, procs: int, maxweight: int, strategy: str = "constant") -> tuple[int, int, int, int]:
    """(procs of the small half, of the large half, most weight of each) so that later splits stay feasible."""
    low = procs // 2
    high = procs - low
    eps = maxweight * procs / weight - 1 if weight else 0.0

    def most(q: int) -> int:
        if q == 1:
            return maxweight
        levels = math.ceil(math.log2(q)) + 1  # this split and those of the half
        delta = {"constant": eps / levels, "increase": eps / (2 * q), "decrease": eps / 2}[strategy]
        return min(math.floor((1 + delta) * weight * q / procs), maxweight * q)

    return low, high, most(low), most(high)


def _model(i: np.ndarray, j: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertex, net, vertex of each entry) as arrays; rows are nets 2 i, columns nets 2 j + 1."""
    if kind == "onedimrow":
        return i, j, i
    if kind == "onedimcol":
        return j, i, j
    if kind == "finegrain":
        t = np.arange(len(i))
        return np.r_[t, t], np.r_[2 * i, 2 * j + 1], t
    if kind == "symfinegrain":  # an entry and its mirror image are one vertex, row k and column k one net
        low, high = np.minimum(i, j), np.maximum(i, j)
        _, t = np.unique(np.column_stack([low, high]), axis=0, return_inverse=True)
        t = t.ravel()
        return np.r_[t, t], np.r_[low, high], t
    _, ri, rc = np.unique(i, return_inverse=True, return_counts=True)
    _, ci, cc = np.unique(j, return_inverse=True, return_counts=True)
    with_col = (rc[ri] == 1) | ((cc[ci] != 1) & (rc[ri] >= cc[ci]))
    vertex, net = np.where(with_col, 2 * j + 1, 2 * i), np.where(with_col, 2 * i, 2 * j + 1)
    both = np.intersect1d(vertex, net)  # a line that is both has a pin that ties the two
    return np.r_[vertex, both], np.r_[net, both], vertex


def components_of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component number of each entry's row."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        parent[find(("r", a))] = find(("c", b))
    number: dict = {}
    return np.array([number.setdefault(find(("r", a)), len(number)) for a in i.tolist()])


def kinds_of(options: Options, level: int, m: int, n: int) -> list[str]:
    """The models that a strategy tries on a part with ``m`` rows and ``n`` columns at a level of the recursion."""
    name = options["SplitStrategy"]
    ratio = "onedimrow" if m > n else "onedimcol"
    if name == "alternate":
        first = {"row": "onedimrow", "col": "onedimcol", "ratio": ratio}[options["Alternate_FirstDirection"]]
        turn = {"onedimrow": "onedimcol", "onedimcol": "onedimrow"}
        return [turn[first] if level % 2 else first]
    return GRID.get(name) or ([ratio] if name == "localratio" else [name])


def bisect(i: np.ndarray, j: np.ndarray, caps: tuple[int, int], options: Options, seed: int, level: int = 0, kinds: list[str] | None = None) -> tuple[tuple[int, int], np.ndarray]:
    """(excess and volume that its model reached, side 0 or 1 of each entry) by the best of the strategy's models, or of ``kinds``."""
    if options["ZeroVolumeSearch"] == "yes":
        comp = components_of(i, j)
        sizes = np.bincount(comp).tolist()
        if len(sizes) > 1 and (bins := subset_sum(sizes, caps)) is not None and 0 < sum(bins) < len(bins):
            return (0, 0), np.array(bins)[comp]
    if options["SplitMethod"] == "simple":
        return (0, 0), (np.arange(len(i)) >= min(caps[0], max(len(i) - caps[1], round(len(i) * caps[0] / sum(caps))))).astype(int)
    kinds = kinds or kinds_of(options, level, len(np.unique(i)), len(np.unique(j)))
    best = None
    for kind in kinds:
        vertex, net, of = _model(i, j, kind)
        weight = dict(zip(*(x.tolist() for x in np.unique(of, return_counts=True)), strict=True))
        h, names = build(vertex, net, weight)
        side, _ = multilevel(
            h, caps, seed=seed, coarsest=options["Coarsening_NrVertices"], levels=options["Coarsening_MaxCoarsenings"], restarts=options["KLFM_InitPart_NrRestarts"],
            stop_ratio=options["Coarsening_StopRatio"], scaling=options["Coarsening_InprodScaling"], passes=options["KLFM_Refine_MaxNrLoops"], no_gain=options["KLFM_Refine_MaxNrNoGainMoves"],
        )
        entry = np.array(side)[np.searchsorted(names, of)]
        over = max((entry == 0).sum() - caps[0], 0) + max((entry == 1).sum() - caps[1], 0)
        key = (over, _volume(i, j, entry))
        if best is None or key < best[0]:
            best = (key, entry)
    key, entry = best
    if options["Iterative_Refinement"] != "never":
        entry = _again(i, j, entry, caps)
    return key, _free(i, j, entry, caps) if options["ImproveFreeNonzeros"] == "yes" else entry


def _volume(i, j, side) -> int:
    return sum(len(set(zip(x.tolist(), side.tolist(), strict=True))) - len(set(x.tolist())) for x in (i, j))


def _again(i, j, side, caps):
    """Alternates the two medium-grain readings of the current split (one side by rows, the other by columns) while either helps."""
    best, idle, turn = _volume(i, j, side), 0, 0
    while idle < 2:
        with_col = side == turn
        vertex, net = np.where(with_col, 2 * j + 1, 2 * i), np.where(with_col, 2 * i, 2 * j + 1)
        both = np.intersect1d(vertex, net)
        weight = dict(zip(*(x.tolist() for x in np.unique(vertex, return_counts=True)), strict=True))
        h, names = build(np.r_[vertex, both], np.r_[net, both], weight)
        start = np.zeros(len(names), int)
        start[np.searchsorted(names, vertex)] = side
        start = start.tolist()
        refine(h, start, caps)
        new = np.array(start)[np.searchsorted(names, vertex)]
        fits = (new == 0).sum() <= max(caps[0], (side == 0).sum()) and (new == 1).sum() <= max(caps[1], (side == 1).sum())
        if fits and (v := _volume(i, j, new)) < best:
            side, best, idle = new, v, 0
        else:
            idle += 1
        turn = 1 - turn
    return side


def _free(i, j, side, caps):
    """Moves entries whose row and column hold both sides to the relatively lighter side."""
    side = side.copy()
    light = min((0, 1), key=lambda s: (side == s).sum() / max(caps[s], 1))
    rows, cols = set(i[side == light].tolist()), set(j[side == light].tolist())
    load = [int((side == 0).sum()), int((side == 1).sum())]
    for t in np.flatnonzero(side != light).tolist():
        if (load[light] + 1) * caps[1 - light] > (load[1 - light] - 1) * caps[light]:
            break
        if i[t] in rows and j[t] in cols:
            side[t] = light
            load[light] += 1
            load[1 - light] -= 1
    return side


@dataclass(frozen=True)
class Partition:
    nz: DataFrame
    maxweight: int
    feasible: bool
    #: Entries per line and part (``axis, idx, part, n``), if they were kept.
    line_parts: DataFrame | None = None


@dataclass(frozen=True)
class Level:
    """A hypergraph ``vtx(v, wgt)``, ``pin(v, n)`` and, unless it is the coarsest, the groups ``match(v, grp)`` that the next one is made of."""

    vtx: DataFrame
    pin: DataFrame
    match: DataFrame | None = None


def coarsen(vtx: DataFrame, pin: DataFrame, target: int, rounds: int = 60) -> list[Level]:
    """The levels down to one with at most ``target`` pins and vertices: distributed coarsening for large hypergraphs.

    Vertices are merged along a maximal matching of candidate neighbours, whose number is linear in pins. Where that shrinks
    the hypergraph no more, as few vertices have a net in common, light ones are merged by a hash, which halves their number, so the target is always met.
    """
    levels, before, stalled = [], vtx.count() + pin.count(), False
    for _ in range(rounds):
        if before <= target:
            return [*levels, Level(vtx, pin)]
        if stalled:
            mean = vtx.agg(F.avg("wgt")).first()[0]
            spot = F.when(F.col("wgt") <= 4 * mean, F.pmod(F.xxhash64("v"), F.lit(max(vtx.count() // 2, 1))))
            least = vtx.select("v", spot.alias("spot")).where("spot IS NOT NULL").groupBy("spot").agg(F.min("v").alias("grp"))
            match = vtx.select("v", spot.alias("spot")).join(least, "spot", "left").select("v", F.coalesce("grp", "v").alias("grp"))
        else:
            match = matching.groups(cut(neighbours.near_similarity(pin)), vtx)
        match = cut(match)
        levels.append(Level(vtx, pin, match))
        vtx, pin = (cut(x) for x in hypergraph.contract(vtx, pin, match))
        after = vtx.count() + pin.count()
        stalled = after > 0.95 * before
        before = after
    raise RuntimeError(f"coarsening did not reach {target} pins in {rounds} rounds")


def partition(nz: DataFrame, p: int, eps: float = 0.03, options: Options | None = None, on_split: Callable[[int, DataFrame], bool] | None = None, keep_line_parts: bool = False) -> Partition:
    """``nz(i, j, ..., part)`` over parts 0..p-1 with at most (1 + eps) of the mean weight each.

    ``on_split(level, nz)`` sees each level; a false answer stops the recursion. ``feasible`` tells whether every part is
    within the bound. A result whose volume exceeds the guaranteed bound gives way to one that keeps it (``CheckUpperBound``).
    ``keep_line_parts`` keeps the counts of entries per line and part, updated by what each level moves.
    The models of a strategy that tries several are tasks of their own. Options that aren't implemented raise unless they have their default. Same seed, same result, however the rows are spread. Without rows there is nothing to split.
    """
    options = options or Options()
    options.require_supported()
    total = nz.count()
    maxweight = math.floor((1 + eps) * total / p)
    current = cut(nz.drop("part").withColumns({"part": F.lit(0), "procs": F.lit(p)}))
    table = cut(line_parts.counted(current)) if keep_line_parts else None
    level = 0
    while not current.where("procs > 1").isEmpty():
        sizes = {r["part"]: (r["n"], r["procs"]) for r in current.groupBy("part", "procs").agg(F.count("*").alias("n")).collect()}
        bounds = {q: split_bounds(n, k, maxweight, options["LoadbalanceStrategy"]) for q, (n, k) in sizes.items() if k > 1}
        big = [q for q in bounds if 2 * sizes[q][0] > KERNEL_PINS]
        current = current.withColumn("was", F.col("part"))
        maps = {q: _coarse_sides(current.where(F.col("part") == q), bounds[q][2:], options, level) for q in big}
        schema, columns, seed = current.schema, current.columns, options["Seed"]

        def split(pdf: pd.DataFrame, kind: str | None) -> pd.DataFrame:
            q = int(pdf["part"].iloc[0])
            low, high, cap_low, cap_high = bounds[q]
            pdf = pdf.sort_values(["i", "j"], ignore_index=True)
            key, side = bisect(pdf["i"].to_numpy(), pdf["j"].to_numpy(), (cap_low, cap_high), options, seed + 1000 * level + q, level, [kind] if kind else None)
            pdf["part"] = np.where(side == 0, q, q + low).astype(np.int32)
            pdf["procs"] = np.where(side == 0, low, high).astype(np.int32)
            return pdf.assign(over=key[0], volume=key[1])[[*columns, "kind", "over", "volume"]] if kind else pdf[columns]

        small = current.where((F.col("procs") > 1) & ~F.col("part").isin(big or [-1]))
        kinds = GRID.get(options["SplitStrategy"]) if options["SplitMethod"] != "simple" else None
        if kinds:  # each part and model is a task; a part's best model is the one with least excess and volume, the first of equals
            models = small.select("*", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).groupBy("part", "kind")
            models = cut(models.applyInPandas(lambda pdf: split(pdf, pdf["kind"].iloc[0]), StructType([*schema.fields, *StructType.fromDDL("kind string, over long, volume long").fields])))
            order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
            best = models.groupBy("was", "kind").agg(F.min(F.struct("over", "volume", order.alias("at"))).alias("key")).groupBy("was").agg(F.min_by("kind", "key").alias("kind"))
            small = models.join(F.broadcast(best), ["was", "kind"]).select(*columns)  # a row per part
        else:
            small = small.groupBy("part").applyInPandas(lambda pdf: split(pdf, None), schema)
        out = current.where("procs = 1").unionByName(small)
        for q, sides in maps.items():
            low, high, *_ = bounds[q]
            mine = current.where(F.col("part") == q).join(sides, ["i", "j"])
            out = out.unionByName(mine.withColumns({"part": F.when(F.col("side") == 0, q).otherwise(q + low).cast("int"), "procs": F.when(F.col("side") == 0, low).otherwise(high).cast("int")}).drop("side"))
        current = cut(out)
        if table is not None:
            table = cut(line_parts.moved(table, current.where("part <> was")))
        current = current.drop("was")
        level += 1
        if on_split and not on_split(level, current.drop("procs")):
            break
    if options["CheckUpperBound"] == "yes" and p > 1 and total and current.where("procs > 1").isEmpty():
        m, n = nz.agg(F.countDistinct("i"), F.countDistinct("j")).first()
        if sum(metrics.volumes(current, a).first()["vol"] for a in ("row", "col")) > (min(m, n) + 1) * (p - 1):
            current = cut(upper_bound_partition(nz, p).withColumn("procs", F.lit(1)))
            table = cut(line_parts.counted(current)) if keep_line_parts else None
    heaviest = current.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return Partition(current.drop("procs"), maxweight, heaviest <= maxweight, table)


def _large_model(nz: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(entries with their vertex ``of``, ``pin(v, n)``) of :func:`_model`, as DataFrames; an entry's vertex is the place in order
    where it has one of its own."""
    row, col = 2 * F.col("i"), 2 * F.col("j") + 1
    if kind in ("finegrain", "symfinegrain"):
        low, high = (F.least("i", "j"), F.greatest("i", "j")) if kind == "symfinegrain" else (F.col("i"), F.col("j"))
        nets = (low, high) if kind == "symfinegrain" else (row, col)
        # Vertices are numbered in order, as hashes would leave no room for degrees beside them.
        names = ordinal.placed(nz.select(low.alias("low"), high.alias("high")).distinct(), "low", "high", name="of")
        at = nz.withColumns({"low": low, "high": high}).join(names, ["low", "high"])
        at = cut(at.select("i", "j", "of", F.array(*nets).alias("nets")))
        return at.drop("nets"), at.select(F.col("of").alias("v"), F.explode("nets").alias("n")).distinct()
    if kind in ("onedimrow", "onedimcol"):
        at = nz.select("i", "j", (row if kind == "onedimrow" else col).alias("of"), (col if kind == "onedimrow" else row).alias("n"))
        return at.drop("n"), at.select(F.col("of").alias("v"), "n").distinct()
    rows, cols = (nz.groupBy(c).agg(F.count("*").alias(f"n_{c}")) for c in "ij")
    with_col = (F.col("n_i") == 1) | ((F.col("n_j") != 1) & (F.col("n_i") >= F.col("n_j")))
    at = cut(nz.join(rows, "i").join(cols, "j").select("i", "j", F.when(with_col, col).otherwise(row).alias("of"), F.when(with_col, row).otherwise(col).alias("n")))
    pin = at.select(F.col("of").alias("v"), "n").distinct()
    both = pin.select("v").distinct().join(pin.select(F.col("n").alias("v")).distinct(), "v").select("v", F.col("v").alias("n"))
    return at.drop("n"), pin.union(both).distinct()


def _coarse_sides(nz: DataFrame, caps: tuple[int, int], options: Options, level: int) -> DataFrame:
    """``i, j, side`` for a part too large for one task: the strategy's models, each coarsened in Spark, then the kernel on what is
    left, then refinement by batches of moves on every level; the one with the least excess and volume is taken."""
    m, n = nz.agg(F.countDistinct("i"), F.countDistinct("j")).first()
    best, seed = None, options["Seed"] + level
    for kind in kinds_of(options, level, m, n):
        entry, pin = _large_model(nz, kind)
        entry = cut(entry)
        vtx = cut(entry.groupBy(F.col("of").alias("v")).agg(F.count("*").alias("wgt")))
        *finer, coarsest = coarsen(vtx, cut(pin), KERNEL_PINS)
        # A vertex without a net of its own gets one that nobody shares.
        packed = coarsest.vtx.join(coarsest.pin, "v", "left").select("v", F.coalesce("n", -1 - F.abs("v")).alias("n"), "wgt", F.lit(0).alias("g"))

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["v", "n"])
            h, names = build(pdf["v"].to_numpy(), pdf["n"].to_numpy(), dict(zip(pdf["v"].tolist(), pdf["wgt"].tolist(), strict=True)))
            side, _ = multilevel(
                h, caps, seed=seed, coarsest=options["Coarsening_NrVertices"], levels=options["Coarsening_MaxCoarsenings"], restarts=options["KLFM_InitPart_NrRestarts"],
                stop_ratio=options["Coarsening_StopRatio"], scaling=options["Coarsening_InprodScaling"], passes=options["KLFM_Refine_MaxNrLoops"], no_gain=options["KLFM_Refine_MaxNrNoGainMoves"],
            )
            return pd.DataFrame({"v": names, "side": np.array(side, np.int32)})

        side = cut(packed.groupBy("g").applyInPandas(kernel, "v long, side int"))
        for level_ in reversed(finer):
            side = level_.match.join(side.withColumnRenamed("v", "grp"), "grp").select("v", "side")
            side = refinement.refine(level_.vtx, level_.pin, side, caps)
        found = cut(entry.join(side.withColumnRenamed("v", "of"), "of").select("i", "j", "side"))
        load = {r["side"]: r["n"] for r in found.groupBy("side").agg(F.count("*").alias("n")).collect()}
        over = sum(max(load.get(k, 0) - caps[k], 0) for k in (0, 1))
        volume = sum(metrics.volumes(found.withColumnRenamed("side", "part"), a).first()["vol"] for a in ("row", "col"))
        if best is None or (over, volume) < best[0]:
            best = ((over, volume), found)
    return best[1]


def upper_bound_partition(nz: DataFrame, p: int) -> DataFrame:
    """Parts of at most ``ceil(nz / p)`` entries with volume at most (min(m, n) + 1)(p - 1): whole lines of the longer axis, few of
    them cut. The line counts go to one task, the entries stay where they are."""
    m, n = nz.agg(F.countDistinct("i"), F.countDistinct("j")).first()
    axis, other = ("i", "j") if m >= n else ("j", "i")
    counts = nz.groupBy(F.col(axis).alias("line")).agg(F.count("*").alias("c")).withColumn("g", F.lit(0))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        rows = []
        for line, pieces in zip(pdf["line"].tolist(), upper_bound_parts(pdf["c"].tolist(), p), strict=True):
            at = 0
            for q, c in pieces:
                rows.append((line, at, at + c, q))
                at += c
        return pd.DataFrame(rows, columns=["line", "lo", "hi", "part"])

    pieces = counts.groupBy("g").applyInPandas(kernel, "line long, lo long, hi long, part int")
    from pyspark.sql import Window

    d = nz.drop("part").withColumn("_k", F.row_number().over(Window.partitionBy(axis).orderBy(other)) - 1)
    return d.join(pieces, (F.col(axis) == F.col("line")) & (F.col("_k") >= F.col("lo")) & (F.col("_k") < F.col("hi"))).drop("_k", "line", "lo", "hi")


def distribute_vector(nz: DataFrame, axis: str, size: int, p: int, options: Options | None = None) -> DataFrame:
    """``idx, part`` for every component: lines of one part first, then the cut lines, then the empty lines for balance.

    Cut lines that all have two parts get the optimum; others the owners of rounds of blocks, which no task sees as a whole.
    """
    options = options or Options()
    lines = cut(reduced(nz, axis).groupBy("idx").agg(F.sort_array(F.collect_list("part")).alias("parts")))
    if lines.where("size(parts) > 2").isEmpty():
        chosen = bids.pair_owners(lines, p)
    else:
        chosen = bids.owners(lines, p, rounds=options["VectorPartition_MaxNrLoops"], order=options["VectorPartition_Step3"], sweeps=options["VectorPartition_MaxNrGreedyImproves"])
    chosen = chosen.select("idx", F.col("owner").alias("part"))
    known = unique_owners(nz, axis).union(chosen)
    every = nz.sparkSession.range(size).select(F.col("id").alias("idx")).join(known, "idx", "left")
    return fill_unowned(every, p)


def report(result: Partition, original: DataFrame, p: int) -> DataFrame:
    """One row of invariants: every entry once, parts in range, weights within the bound."""
    kept = result.nz.select("i", "j").exceptAll(original.select("i", "j")).isEmpty() and result.nz.count() == original.count()
    volume = sum(metrics.volumes(result.nz, a).first()["vol"] for a in ("row", "col"))
    m, n = original.agg(F.countDistinct("i"), F.countDistinct("j")).first()
    in_range = result.nz.where((F.col("part") < 0) | (F.col("part") >= p)).isEmpty()
    return original.sparkSession.createDataFrame([(kept, in_range, result.feasible, volume <= (min(m, n) + 1) * (p - 1))], "nnz_ok boolean, parts_ok boolean, balanced boolean, within_bound boolean")
