"""Owners of cut lines by rounds of blocks, for any number of lines.

Cut lines are dealt into blocks by a hash, a bounded number of lines each. In a round every block improves the owners of its own lines
against the sums of all blocks, of which it takes an equal share, so blocks that change in like ways mend the whole together. The sums of
sends and receives are added up between rounds, one row a part, until their maximum falls no more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from ..functions.vector_kernels import pairs_optimal
from .neighbours import MIX_1
from .ordinal import placed

LINES, ROUNDS, SWEEPS = 4096, 12, 10


def part_sums(lines: DataFrame, p: int) -> tuple[list[int], list[int]]:
    """(sends, receives) of each part, of ``lines(parts, owner)``."""
    each = lines.select("owner", F.explode("parts").alias("part"), (F.size("parts") - 1).alias("d"))
    own = F.col("part") == F.col("owner")
    rows = each.groupBy("part").agg(F.sum(F.when(own, F.col("d")).otherwise(0)).alias("ns"), F.count_if(~own).alias("nr")).collect()  # a row per part
    found = {r["part"]: (r["ns"], r["nr"]) for r in rows}
    return [found.get(q, (0, 0))[0] for q in range(p)], [found.get(q, (0, 0))[1] for q in range(p)]


def settle(sets: list[list[int]], owner: list[int], ns: dict[int, float], nr: dict[int, float], order: str = "decrease", sweeps: int = SWEEPS) -> list[int]:
    """Owners of one block's lines: a line without one goes where the larger sum stays least, others move while that helps."""
    by = {"decrease": lambda k: -len(sets[k]), "increase": lambda k: len(sets[k]), "random": lambda k: k * MIX_1 % (1 << 32)}[order]
    for k in sorted(range(len(sets)), key=by):
        if owner[k] < 0:
            s, d = sets[k], len(sets[k]) - 1
            q = owner[k] = min(s, key=lambda x: (max(ns[x] + d, nr[x] - 1), ns[x], x))
            ns[q], nr[q] = ns[q] + d, nr[q] - 1
    heavy = lambda x, up, down: max(ns[x] + up, 0.0) ** 4 + max(nr[x] + down, 0.0) ** 4  # noqa: E731  a smooth stand-in for the larger of the two
    for _ in range(sweeps):
        changed = False
        for k, s in enumerate(sets):
            q, d = owner[k], len(s) - 1
            out = heavy(q, 0, 0) - heavy(q, -d, 1)
            gain, x = max((out + heavy(x, 0, 0) - heavy(x, d, -1), -x) for x in s if x != q)
            if gain > 1e-9:
                x = -x
                ns[q], nr[q], ns[x], nr[x], owner[k], changed = ns[q] - d, nr[q] + 1, ns[x] + d, nr[x] - 1, x, True
        if not changed:
            break
    return owner


def owners(lines: DataFrame, p: int, *, block: int = LINES, rounds: int = ROUNDS, order: str = "decrease", sweeps: int = SWEEPS) -> DataFrame:
    """``idx, parts, owner`` of cut ``lines(idx, parts)``, ``parts`` sorted arrays of two parts or more.

    The same lines get the same owners, however rows are spread. An empty table gives no rows.
    """
    n = lines.count()
    blocks = max(1, -(-n // block))
    best = state = cut(lines.select("idx", "parts", F.lit(-1).alias("owner"), F.pmod(F.xxhash64("idx"), F.lit(blocks)).alias("block")))
    least, ns, nr = None, [0] * p, [0] * p

    def run(sent: list[float], received: list[float], first: bool):
        def block_of(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx", ignore_index=True)
            sets = [list(map(int, s)) for s in pdf["parts"]]
            up, down = dict(enumerate(sent)), dict(enumerate(received))
            if first:  # all is received at first
                for s in sets:
                    for x in s:
                        down[x] += 1
            pdf["owner"] = settle(sets, pdf["owner"].tolist(), up, down, order, sweeps)
            return pdf.astype({"owner": "int32"})

        return block_of

    for turn in range(rounds):
        share = [[x / blocks for x in sums] for sums in (ns, nr)]
        state = cut(state.groupBy("block").applyInPandas(run(*share, turn == 0), "idx long, parts array<int>, owner int, block long"))
        ns, nr = part_sums(state, p)
        most = max([0, *ns, *nr])
        if least is not None and most >= least:
            break
        best, least = state, most
    return best.select("idx", "parts", "owner")



def pair_owners(lines: DataFrame, p: int) -> DataFrame:
    """``idx, parts, owner`` of lines of two parts with the least maximum that there is.

    Half of the lines that two parts share go each way, in turn; of an odd number one is left. These, at most one for each two
    parts, are directed along trails on the driver, so sends and receives of a part differ by one at most.
    """
    a, b = F.col("parts")[0], F.col("parts")[1]
    rows = cut(placed(lines.select("idx", "parts", a.alias("a"), b.alias("b")), "a", "b", "idx"))
    pair = rows.groupBy("a", "b").agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    odd = [[r["a"], r["b"]] for r in pair.where("n % 2 = 1").orderBy("a", "b").collect()]
    left = rows.sparkSession.createDataFrame([(*s, q) for s, q in zip(odd, pairs_optimal(odd, p), strict=True)], "a int, b int, to int")
    rows = rows.join(F.broadcast(pair.join(F.broadcast(left), ["a", "b"], "left")), ["a", "b"])  # a row for each two parts
    k = F.col("pos") - F.col("start")
    owner = F.when((k == F.col("n") - 1) & F.col("to").isNotNull(), F.col("to")).when(k % 2 == 0, F.col("a")).otherwise(F.col("b"))
    return rows.select("idx", "parts", owner.cast("int").alias("owner"))
