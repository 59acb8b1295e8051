"""Vector distribution kernels: ``lines`` is a list of part lists with two parts or more each; the answer an owner per line.

A line with owner q and parts S costs q one send to each other part of S and each of those one receive. The measure is the
maximum over parts of sends and of receives.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def costs(lines: list[list[int]], owner: list[int], p: int) -> tuple[list[int], list[int]]:
    """(sends, receives) of each part."""
    ns, nr = [0] * p, [0] * p
    for s, q in zip(lines, owner, strict=True):
        for x in s:
            if x != q:
                nr[x] += 1
                ns[q] += 1
    return ns, nr


def measure(lines, owner, p) -> int:
    ns, nr = costs(lines, owner, p)
    return max([0, *ns, *nr])


def by_sums(lines: list[list[int]], p: int, order: str = "decrease", seed: int = 99) -> list[int]:
    """Lines of more than two parts in order of size to the part with least sums; then pairs by least sends plus receives."""
    rng = np.random.default_rng(seed)
    sums, ns, nr, owner = [0] * p, [0] * p, [0] * p, [-1] * len(lines)
    many = [k for k, s in enumerate(lines) if len(s) > 2]
    many = [many[k] for k in rng.permutation(len(many))]
    if order != "random":
        many.sort(key=lambda k: -len(lines[k]) if order == "decrease" else len(lines[k]))

    def give(k: int, q: int) -> None:
        owner[k] = q
        ns[q] += len(lines[k]) - 1
        for x in lines[k]:
            nr[x] += x != q

    for k in many:
        q = min(lines[k], key=lambda x: (sums[x], x))
        sums[q] += len(lines[k]) - 1
        for x in lines[k]:
            sums[x] += x != q
        give(k, q)
    for k, s in enumerate(lines):
        if len(s) == 2:
            a, b = s
            x, y = ns[a] + nr[b], ns[b] + nr[a]
            give(k, a if x < y or (x == y and rng.random() < 0.5) else b)
    return owner


def by_local_bound(lines: list[list[int]], p: int) -> list[int]:
    """Always serves the part with the largest bound: it takes its smallest line while sends stay within receives."""
    owner, mine = [-1] * len(lines), defaultdict(list)
    for k in sorted(range(len(lines)), key=lambda k: (-len(lines[k]), k)):
        for x in lines[k]:
            mine[x].append(k)
    ns, nr = [0] * p, [len(mine[q]) for q in range(p)]  # all received at first
    active = {q for q in range(p) if mine[q]}
    while active:
        q = max(active, key=lambda x: (nr[x], -x))
        while mine[q] and owner[mine[q][-1]] >= 0:
            mine[q].pop()
        if not mine[q] or ns[q] + len(lines[mine[q][-1]]) - 1 > nr[q] - 1:
            active.discard(q)
            continue
        k = mine[q].pop()
        owner[k] = q
        ns[q] += len(lines[k]) - 1
        nr[q] -= 1
    for k, s in enumerate(lines):
        if owner[k] < 0:
            q = min(s, key=lambda x: (max(ns[x] + len(s) - 1, nr[x] - 1), x))
            owner[k] = q
            ns[q] += len(s) - 1
            nr[q] -= 1
    return owner


def improve(lines: list[list[int]], owner: list[int], p: int, factor: int = 10, seed: int = 99) -> list[int]:
    """Moves lines to another of their parts while the larger cost of the two parts strictly falls."""
    rng, owner = np.random.default_rng(seed), list(owner)
    ns, nr = costs(lines, owner, p)
    todo, tries = list(rng.permutation(len(lines))), factor * len(lines)
    while todo and tries > 0:
        k = int(todo.pop())
        tries -= 1
        s, q, d = lines[k], owner[k], len(lines[k]) - 1
        options = []
        for x in s:
            if x != q and max(ns[x] + d, nr[x] - 1, ns[q] - d, nr[q] + 1) < max(ns[x], nr[x], ns[q], nr[q]):
                options.append((ns[x], x))
        if options:
            x = min(options)[1]
            ns[q], nr[q], ns[x], nr[x], owner[k] = ns[q] - d, nr[q] + 1, ns[x] + d, nr[x] - 1, x
            todo = list(rng.permutation(len(lines)))
    return owner


def pairs_optimal(lines: list[list[int]], p: int) -> list[int]:
    """Exact for lines of two parts: half of each pair's lines go each way; the odd ones are directed along trails, so sends
    and receives of a part differ by one at most."""
    owner, shared = [-1] * len(lines), defaultdict(list)
    for k, s in enumerate(lines):
        if len(s) != 2:
            raise ValueError("every line must have two parts")
        shared[min(s), max(s)].append(k)
    odd: dict[int, dict[int, int]] = defaultdict(dict)
    for (a, b), ks in sorted(shared.items()):
        for n, k in enumerate(ks[: len(ks) // 2 * 2]):
            owner[k] = (a, b)[n % 2]
        if len(ks) % 2:
            odd[a][b] = odd[b][a] = ks[-1]
    for start in sorted(odd, key=lambda q: (len(odd[q]) % 2 == 0, q)):  # trails begin where the degree is odd
        while odd[start]:
            q = start
            while odd[q]:
                x = min(odd[q])
                owner[odd[q][x]] = q
                del odd[q][x], odd[x][q]
                q = x
            if len(odd[start]) % 2 == 0 and not odd[start]:
                break
    return owner


def equal_owners(u: list[list[int]], v: list[list[int]], p: int) -> list[int]:
    """One owner for row k and column k of a square matrix: a common part if there is one, the one with least sums."""
    sums, out = [0] * p, []
    order = sorted(range(len(u)), key=lambda k: (len(set(u[k]) & set(v[k])), k))
    owner = [-1] * len(u)
    for k in order:
        pick = sorted(set(u[k]) & set(v[k])) or sorted(set(u[k]) | set(v[k])) or list(range(p))
        q = min(pick, key=lambda x: (sums[x], x))
        owner[k] = q
        sums[q] += sum(x != q for x in set(u[k])) + sum(x != q for x in set(v[k]))
        out.append(q)
    return owner
