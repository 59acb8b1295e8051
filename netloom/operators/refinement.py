"""Refinement of a bipartition by batches of moves, for hypergraphs too large for one task.

A sweep moves vertices of one side to the other in order of gain. What the first k batches change is known exactly without
moving anything: in a net with ``mine`` pins on the side that is left, all of which move, or none on the other side, only the
first and the last mover matter, so sums per net and batch give the cut after each batch. Gains and batches are bounded
numbers, so only a table of fixed size reaches the driver, which picks the best batch within the bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from .neighbours import mixed

#: Gains beyond this count as this in the order of moves; batches that vertices of one gain are spread over.
TOP, SUB = 64, 256
#: Least gain of a vertex that may move.
LEAST = -2
PAIRS = 8


@dataclass
class Batches:
    """What a sweep may do: ``movers(v, batch)`` and per batch the change of the cut and the weight that moves."""

    movers: DataFrame
    table: list[tuple[int, int, int]]  # batch, delta, weight


def net_sides(pin: DataFrame, side: DataFrame) -> DataFrame:
    """``n, ones, size`` of all nets."""
    return pin.join(side, "v").groupBy("n").agg(F.sum("side").cast("long").alias("ones"), F.count("*").alias("size"))


def cut_size(pin: DataFrame, side: DataFrame) -> int:
    """Number of cut nets."""
    return net_sides(pin, side).agg(F.count_if((F.col("ones") > 0) & (F.col("ones") < F.col("size")))).first()[0]


def loads(vtx: DataFrame, side: DataFrame) -> list[int]:
    found = {r["side"]: r["w"] for r in vtx.join(side, "v").groupBy("side").agg(F.sum("wgt").alias("w")).collect()}
    return [found.get(0) or 0, found.get(1) or 0]


def batch_of(gain: str = "gain", v: str = "v"):
    """The batch of a move: higher gains first, vertices of one gain scattered."""
    return (F.lit(TOP) - F.greatest(F.lit(LEAST), F.least(F.lit(TOP), F.col(gain)))) * SUB + F.floor(mixed(v) / ((1 << 32) // SUB)).cast("long")


def movers(pin: DataFrame, side: DataFrame, source: int) -> DataFrame:
    """``v, batch``: the vertices of one side that may move, by gain: 1 for a net where a vertex is alone on its side, -1 for a net with nothing on the other."""
    net = net_sides(pin, side).select("n", F.when(F.lit(source == 1), F.col("ones")).otherwise(F.col("size") - F.col("ones")).alias("mine"), "size").where("size > 1")
    pins = pin.join(side.where(F.col("side") == source).select("v"), "v").join(net, "n")
    gain = (F.col("mine") == 1).cast("long") - (F.col("mine") == F.col("size")).cast("long")
    moving = pins.groupBy("v").agg(F.sum(gain).alias("gain")).where(F.col("gain") >= LEAST)
    return moving.select("v", batch_of().alias("batch"))


def deltas(pin: DataFrame, side: DataFrame, moving: DataFrame, source: int) -> DataFrame:
    """``batch, delta``: the exact change of the number of cut nets as batches of one side's vertices move in order."""
    mine = F.col("side") == source
    pins = pin.join(side, "v").join(moving, "v", "left")
    net = pins.groupBy("n").agg(F.count("*").alias("size"), F.count_if(mine).alias("mine"), F.count("batch").alias("moved"), F.min("batch").alias("first"), F.max("batch").alias("last")).where("moved > 0 AND size > 1")
    opens = (F.col("mine") == F.col("size"))  # uncut before: cut from its first mover on
    closes = F.col("moved") == F.col("mine")  # uncut from its last mover on
    steps = F.array(F.struct(F.col("first").alias("batch"), opens.cast("long").alias("delta")), F.struct(F.col("last").alias("batch"), (-closes.cast("long")).alias("delta")))
    return net.select(F.inline(steps)).where("delta <> 0").groupBy("batch").agg(F.sum("delta").alias("delta"))


def batches(vtx: DataFrame, pin: DataFrame, side: DataFrame, source: int) -> Batches:
    moving = movers(pin, side, source)
    change = deltas(pin, side, moving, source).select("batch", "delta", F.lit(0).cast("long").alias("wgt"))
    weight = moving.join(vtx, "v").select("batch", F.lit(0).cast("long").alias("delta"), F.col("wgt").cast("long"))
    table = change.union(weight).groupBy("batch").agg(F.sum("delta").alias("delta"), F.sum("wgt").alias("wgt")).collect()
    return Batches(moving, sorted((r["batch"], r["delta"], r["wgt"]) for r in table))


def best_prefix(table: list[tuple[int, int, int]], load: list[int], caps: tuple[int, int], source: int, extra: int = 0, must: bool = False) -> tuple[int, int, int] | None:
    """(last batch, change of the cut, weight) of the best run of batches from the first on; None if no move helps.

    The side that gains may weigh ``extra`` beyond its cap. Of equal changes the one with the least excess, then the best
    balance counts. ``must`` asks for the source to come within its cap, whatever that costs.
    """
    excess = lambda w: (max(load[1 - source] + w - caps[1 - source], 0), max(load[source] - w - caps[source], 0))
    tilt = lambda w: abs((load[source] - w) * caps[1 - source] - (load[1 - source] + w) * caps[source])
    best, delta, moved = None, 0, 0
    start = (sum(excess(0)) if not extra else 0, 0, tilt(0))
    for batch, change, weight in table:
        delta, moved = delta + change, moved + weight
        over, under = excess(moved)
        if over > extra:
            break
        if must and under:
            continue
        key = ((over + under) if not extra else 0, delta, tilt(moved))
        if (must or key < start) and (best is None or key < best[0]):
            best = (key, (batch, delta, moved))
    return best and best[1]


def moved(side: DataFrame, movers_: DataFrame, last: int, source: int) -> DataFrame:
    chosen = movers_.where(F.col("batch") <= last).select("v", F.lit(1 - source).alias("to"))
    return cut(side.join(chosen, "v", "left").select("v", F.coalesce("to", "side").cast("int").alias("side")))


def refine(vtx: DataFrame, pin: DataFrame, side: DataFrame, caps: tuple[int, int], pairs: int = PAIRS) -> DataFrame:
    """``v, side`` with no more cut nets than before and, as far as moves allow, both sides within ``caps``.

    Sweeps of both sides take turns while one helps. Where none does, a pair is tried: one side overfills the other, which
    gives back what it must; it counts if the cut has become smaller.
    """
    side, load, stuck = cut(side), loads(vtx, side), 0
    for _ in range(pairs):
        helped = False
        for source in sorted((0, 1), key=lambda s: -load[s] / max(caps[s], 1)):
            found = batches(vtx, pin, side, source)
            if best := best_prefix(found.table, load, caps, source):
                side = moved(side, found.movers, best[0], source)
                load[source], load[1 - source] = load[source] - best[2], load[1 - source] + best[2]
                helped |= best[1] < 0
        if helped:
            stuck = 0
            continue
        if stuck == 2 or sum(max(load[k] - caps[k], 0) for k in (0, 1)):
            break
        source, stuck = stuck, stuck + 1
        there = batches(vtx, pin, side, source)
        extra = max(sum(load) // 20, 1)
        if not (out := best_prefix(there.table, load, caps, source, extra)):
            continue
        middle = moved(side, there.movers, out[0], source)
        then = list(load)
        then[source], then[1 - source] = load[source] - out[2], load[1 - source] + out[2]
        back = batches(vtx, pin, middle, 1 - source)
        home = best_prefix(back.table, then, caps, 1 - source, must=True) if then[1 - source] > caps[1 - source] else best_prefix(back.table, then, caps, 1 - source) or (-1, 0, 0)
        if home and out[1] + home[1] < 0:
            side = moved(middle, back.movers, home[0], 1 - source)
            load = then
            load[1 - source], load[source] = then[1 - source] - home[2], then[source] + home[2]
            stuck = 0
    return side
