"""Bipartitioning kernels on a bounded hypergraph held as Python lists."""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Hyper:
    """``nets[v]``: nets of vertex v; ``pins[n]``: vertices of net n; ``weight[v]``."""

    nets: list[list[int]]
    weight: list[int]
    pins: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        if not self.pins:
            count = 1 + max((n for x in self.nets for n in x), default=-1)
            self.pins = [[] for _ in range(count)]
            for v, x in enumerate(self.nets):
                for n in x:
                    self.pins[n].append(v)

    @property
    def total(self) -> int:
        return sum(self.weight)

    def cut(self, side: list[int]) -> int:
        return sum(0 < sum(side[v] for v in p) < len(p) for p in self.pins if p)


def build(vertex: np.ndarray, net: np.ndarray, weight: dict[int, int] | None = None) -> tuple[Hyper, np.ndarray]:
    """A hypergraph of pin arrays, and the vertices' names."""
    names, v = np.unique(vertex, return_inverse=True)
    _, n = np.unique(net, return_inverse=True)
    nets: list[list[int]] = [[] for _ in names]
    for a, b in sorted(set(zip(v.tolist(), n.tolist(), strict=True))):
        nets[a].append(b)
    return Hyper(nets, [1 if weight is None else weight.get(int(x), 0) for x in names]), names


def initial_side(h: Hyper, caps: tuple[int, int], rng) -> list[int]:
    """Heavy vertices first (ties shuffled), each to the side with the most room relative to its bound."""
    side, load = [0] * len(h.weight), [0, 0]
    for v in sorted(range(len(h.weight)), key=lambda v: (-h.weight[v], rng.random())):
        s = max((0, 1), key=lambda k: (caps[k] - load[k] - h.weight[v]) / max(caps[k], 1))
        side[v] = s
        load[s] += h.weight[v]
    return side


def gains(h: Hyper, side: list[int]) -> list[int]:
    """Fall of the cut if a vertex changes sides."""
    ones = [sum(side[v] for v in p) for p in h.pins]
    out = []
    for v, x in enumerate(h.nets):
        g = 0
        for n in x:
            mine = ones[n] if side[v] else len(h.pins[n]) - ones[n]
            g += (mine == 1) - (mine == len(h.pins[n]))
        out.append(g)
    return out


def refine(h: Hyper, side: list[int], caps: tuple[int, int], *, passes: int = 25, no_gain: int = 200) -> int:
    """Fiduccia-Mattheyses passes in place; returns the cut. A pass moves each vertex once at most and keeps its best prefix:
    lowest overweight first, then lowest cut, then the later one."""
    load = [sum(w for w, s in zip(h.weight, side, strict=True) if s == k) for k in (0, 1)]
    count = [[0, 0] for _ in h.pins]
    for v, x in enumerate(h.nets):
        for n in x:
            count[n][side[v]] += 1
    cut = sum(a > 0 and b > 0 for a, b in count)
    over = lambda: max(load[0] - caps[0], 0) + max(load[1] - caps[1], 0)
    for _ in range(passes):
        gain = gains(h, side)
        heap = [(-g, v) for v, g in enumerate(gain)]
        heapq.heapify(heap)
        locked, log, start = [False] * len(side), [], (over(), cut)
        best, best_at, idle, aside = start, 0, 0, []
        while heap and idle < no_gain:
            g, v = heapq.heappop(heap)
            if locked[v] or -g != gain[v]:
                continue
            s, t = side[v], 1 - side[v]
            if load[t] + h.weight[v] > caps[t] and over() <= load[t] + h.weight[v] - caps[t]:
                aside.append((g, v))
                continue
            for x in aside:
                heapq.heappush(heap, x)
            aside = []
            locked[v], side[v] = True, t
            load[s] -= h.weight[v]
            load[t] += h.weight[v]
            for n in h.nets[v]:
                a, b = count[n][s], count[n][t]
                count[n][s], count[n][t] = a - 1, b + 1
                cut += (a > 1) - (b > 0 and a > 0) if len(h.pins[n]) > 1 else 0
                if min(b, a - 1) <= 1 or b == 0:  # the net is critical: its pins' gains may change
                    for w in h.pins[n]:
                        if locked[w]:
                            continue
                        q = side[w]
                        old = ((a if q == s else b) == 1) - ((b if q == s else a) == 0)
                        new = (count[n][q] == 1) - (count[n][1 - q] == 0)
                        if old != new:
                            gain[w] += new - old
                            heapq.heappush(heap, (-gain[w], w))
            log.append(v)
            state = (over(), cut)
            idle = 0 if state < best else idle + 1
            if state <= best:
                best, best_at = state, len(log)
        for v in log[best_at:]:
            s, t = side[v], 1 - side[v]
            side[v] = t
            load[s] -= h.weight[v]
            load[t] += h.weight[v]
            for n in h.nets[v]:
                count[n][s] -= 1
                count[n][t] += 1
        cut = best[1]
        if best >= start:
            break
    return cut


def inner_products(h: Hyper, v: int, free: list[bool], scaling: str = "min", linear: bool = True) -> list[tuple[float, int]]:
    """(score, w) of v's free neighbours, best first, ties by lower degree then number."""
    score: dict[int, float] = defaultdict(float)
    for n in h.nets[v]:
        if len(h.pins[n]) < 2:
            continue
        for w in h.pins[n]:
            if w != v and free[w]:
                score[w] += 1 / len(h.pins[n]) if linear else 1.0
    d = len(h.nets[v])
    scale = {"no": lambda e: 1, "cos": lambda e: (d * e) ** 0.5, "min": lambda e: min(d, e), "max": lambda e: max(d, e)}.get(scaling)
    out = []
    for w, x in score.items():
        e = len(h.nets[w])
        by = scale(e) if scale else d + e - len(set(h.nets[v]) & set(h.nets[w]))
        out.append((x / by, w))
    return sorted(out, key=lambda y: (-round(y[0], 12), len(h.nets[y[1]]), y[1]))


def path_matching(h: Hyper, max_weight: float, scaling: str = "min") -> list[int]:
    """Path growing: from each free vertex along best free neighbours; the best matching of the path's edges by dynamic
    programming; what stays free is matched greedily. Returns a group number per vertex (pairs at most)."""
    n = len(h.weight)
    unused, partner = [True] * n, [-1] * n
    order = sorted(range(n), key=lambda v: (-h.weight[v], v))
    for start in order:
        if not unused[start]:
            continue
        path, scores, v = [start], [], start
        unused[start] = False
        while True:
            step = next(((s, w) for s, w in inner_products(h, v, unused, scaling) if h.weight[v] + h.weight[w] <= max_weight), None)
            if step is None:
                break
            scores.append(step[0])
            v = step[1]
            path.append(v)
            unused[v] = False
        take, skip = [0.0], [0.0]  # best up to edge k with and without it
        for s in scores:
            take.append(skip[-1] + s)
            skip.append(max(take[-2], skip[-1]))
        k = len(scores)
        while k > 0:
            if take[k] >= skip[k]:
                a, b = path[k - 1], path[k]
                partner[a], partner[b] = b, a
                k -= 2
            else:
                k -= 1
    free = [p < 0 for p in partner]
    for v in order:
        if free[v]:
            free[v] = False
            step = next(((s, w) for s, w in inner_products(h, v, free, scaling) if h.weight[v] + h.weight[w] <= max_weight), None)
            if step:
                partner[v], partner[step[1]] = step[1], v
                free[step[1]] = False
    group, out = 0, [-1] * n
    for v in range(n):
        if out[v] < 0:
            out[v] = group
            if partner[v] >= 0:
                out[partner[v]] = group
            group += 1
    return out


def contracted(h: Hyper, group: list[int]) -> Hyper:
    size = max(group) + 1
    weight, nets = [0] * size, [set() for _ in range(size)]
    for v, g in enumerate(group):
        weight[g] += h.weight[v]
        nets[g].update(h.nets[v])
    alive: dict[int, int] = {}
    seen = defaultdict(int)
    for x in nets:
        for k in x:
            seen[k] += 1
    return Hyper([sorted(alive.setdefault(k, len(alive)) for k in sorted(x) if seen[k] > 1) for x in nets], weight)


def multilevel(h: Hyper, caps: tuple[int, int], *, seed: int = 99, coarsest: int = 200, levels: int = 128, restarts: int = 8, stop_ratio: float = 0.05, scaling: str = "min", passes: int = 25, no_gain: int = 200) -> tuple[list[int], int]:
    """Side per vertex and cut: coarsen by matching, partition the coarsest with restarts, refine on the way back."""
    rng = np.random.default_rng(seed)
    stack = [h]
    maps: list[list[int]] = []
    while len(stack[-1].weight) > coarsest and len(maps) < levels:
        group = path_matching(stack[-1], 0.2 * h.total, scaling)
        small = contracted(stack[-1], group)
        if len(maps) >= 2 and len(small.weight) > (1 - stop_ratio) * len(stack[-1].weight) or len(small.weight) == len(stack[-1].weight):
            break
        maps.append(group)
        stack.append(small)
    best = None
    for _ in range(restarts):
        side = initial_side(stack[-1], caps, rng)
        cut = refine(stack[-1], side, caps, passes=passes, no_gain=no_gain)
        load = sum(w for w, s in zip(stack[-1].weight, side, strict=True) if s)
        key = (max(load - caps[1], 0) + max(stack[-1].total - load - caps[0], 0), cut)
        if best is None or key < best[0]:
            best = (key, side)
    side = best[1]
    for group, fine in zip(reversed(maps), reversed(stack[:-1]), strict=True):
        side = [side[g] for g in group]
        refine(fine, side, caps, passes=passes, no_gain=no_gain)
    return side, h.cut(side)


def subset_sum(weights: list[int], caps: tuple[int, int]) -> list[int] | None:
    """A bin 0 or 1 per item with sums within ``caps``; None if none is found. Up to 16 items exactly, else by differencing."""
    n, total = len(weights), sum(weights)
    if total > caps[0] + caps[1]:
        return None
    if n <= 16:
        sums = {0: 0}
        for k, w in enumerate(weights):
            for s, mask in list(sums.items()):
                if s + w <= caps[0]:
                    sums.setdefault(s + w, mask | 1 << k)
        good = [s for s in sums if total - s <= caps[1]]
        if not good:
            return None
        mask = sums[min(good, key=lambda s: (abs(s - total * caps[0] / max(caps[0] + caps[1], 1)), s))]
        return [0 if mask >> k & 1 else 1 for k in range(n)]
    # Differencing: an extra item makes up for unequal targets; each step sets the two largest against each other.
    target = total * caps[0] // max(caps[0] + caps[1], 1)
    dummy = abs(total - 2 * target)
    heap = [(-w, k) for k, w in enumerate([*weights, dummy])]
    heapq.heapify(heap)
    against: list[list[int]] = [[] for _ in range(n + 1)]
    while len(heap) > 1:
        a, x = heapq.heappop(heap)
        b, y = heapq.heappop(heap)
        against[x].append(y)
        against[y].append(x)
        heapq.heappush(heap, (a - b, x))
    color = {heap[0][1]: 0}
    todo = [heap[0][1]]
    while todo:
        x = todo.pop()
        for y in against[x]:
            if y not in color:
                color[y] = 1 - color[x]
                todo.append(y)
    # The extra item fills up the side with the smaller target.
    light = 0 if 2 * target < total else 1
    side = [light if color[k] == color[n] else 1 - light for k in range(n)]
    load = sum(w for w, s in zip(weights, side, strict=True) if s == 0)
    for s, x in ((side, load), ([1 - v for v in side], total - load)):
        if x <= caps[0] and total - x <= caps[1]:
            return s
    return None


def upper_bound_parts(counts: list[int], p: int) -> list[list[tuple[int, int]]]:
    """Per line (part, entries) pieces: whole lines in order to the lightest part, then parts over ceil(nz / p) give the end
    of their last lines to parts below it. At most p - 1 lines more than once, so the volume is bounded."""
    limit = -(-sum(counts) // p)
    load = [(0, q) for q in range(p)]
    heapq.heapify(load)
    whole: list[list[int]] = [[] for _ in range(p)]
    for k, c in enumerate(counts):
        w, q = heapq.heappop(load)
        whole[q].append(k)
        heapq.heappush(load, (w + c, q))
    weight = dict((q, w) for w, q in load)
    pieces = {k: [[q, counts[k]]] for q in range(p) for k in whole[q]}
    room = [[q, limit - weight[q]] for q in range(p) if weight[q] < limit]
    for q in range(p):
        extra = weight[q] - limit
        for k in reversed(whole[q]):
            while extra > 0 and pieces[k][0][1] > 0 and room:
                take = min(extra, pieces[k][0][1], room[-1][1])
                pieces[k][0][1] -= take
                pieces[k].append([room[-1][0], take])
                room[-1][1] -= take
                extra -= take
                if not room[-1][1]:
                    room.pop()
    return [[(q, c) for q, c in pieces[k] if c] for k in range(len(counts))]


def exact_bipartition(rows: list[int], cols: list[int], cap: int, best: int | None = None, nodes: int = 2_000_000) -> tuple[list[int], int, bool]:
    """Least-volume split of a small matrix in two parts of at most ``cap`` entries: (part 0, 1 or 2 for free) per entry, the
    volume, and whether it is proven. Lines are set to 0, 1 or cut, longest first; an entry goes where its uncut line is."""
    names = [("r", x) for x in sorted(set(rows))] + [("c", x) for x in sorted(set(cols))]
    lines = [[k for k, x in enumerate(rows if a == "r" else cols) if x == b] for a, b in names]
    order = sorted(range(len(lines)), key=lambda k: (-len(lines[k]), k))
    of = [[-1, -1] for _ in rows]
    for k, line in enumerate(lines):
        for e in line:
            of[e][0 if names[k][0] == "r" else 1] = k
    best = best if best is not None else min(len(set(rows)), len(set(cols))) + 1
    state, owner, found, used = [-1] * len(lines), [-1] * len(rows), None, 0
    load = [0, 0]

    held, sides = [[0, 0] for _ in lines], [[k for k, (a, _) in enumerate(names) if a == axis] for axis in "rc"]

    def give(e: int, value: int, by: int) -> None:
        for k in of[e]:
            held[k][value] += by

    def bound() -> int:
        """Open lines that must be cut: those with entries of both parts, and of the rows, and of the columns, with one part those that don't fit into it."""
        more = 0
        for axis in sides:
            rest: tuple[list, list] = [], []
            for k in axis:
                if state[k] < 0 and (held[k][0] or held[k][1]):
                    if held[k][0] and held[k][1]:
                        more += 1
                    else:
                        rest[held[k][1] > 0].append(len(lines[k]) - held[k][0] - held[k][1])
            for value, wanted in enumerate(rest):
                room = cap - load[value]
                if sum(wanted) > room:
                    for n in sorted(wanted):
                        room -= n
                        more += room < 0
        return more

    def search(at: int, cuts: int) -> None:
        nonlocal best, found, used
        used += 1
        if used > nodes or cuts >= best or cuts + bound() >= best:
            return
        if at == len(order):
            free = sum(o < 0 for o in owner)
            if max(load) <= cap and sum(load) + free <= 2 * cap:
                best, found = cuts, list(owner)
            return
        k = order[at]
        for value in (0, 1, 2):
            if value == 1 and not any(s in (0, 1) for s in state):
                continue  # by symmetry the first uncut line is 0
            mine = [] if value == 2 else [e for e in lines[k] if owner[e] < 0]
            if value < 2 and (load[value] + len(mine) > cap or any(owner[e] == 1 - value for e in lines[k])):
                continue
            state[k] = value
            for e in mine:
                owner[e] = value
                give(e, value, 1)
            if value < 2:
                load[value] += len(mine)
            search(at + 1, cuts + (value == 2))
            if value < 2:
                load[value] -= len(mine)
            for e in mine:
                owner[e] = -1
                give(e, value, -1)
            state[k] = -1

    search(0, 0)
    done = used <= nodes
    return ([2 if o < 0 else o for o in found] if found is not None else []), best, done
