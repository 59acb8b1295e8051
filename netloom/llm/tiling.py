"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words of letters and digits. A benchmark item and a document are compared if they share a seed of
``SEED`` consecutive words. Tiles are then marked greedily: the longest common run of unmarked words first, found by hashing
runs of a search length in both (Karp-Rabin, rolling) that falls from long to the minimum; runs never overlap, so passages
in another order still count. A document is contaminated by an item of which tiles cover ``COVERAGE`` of the words.

The benchmark is a stated query set: it is split into blocks of at most ``BLOCK_WORDS`` words, and each block goes to all
documents. Documents never leave their partition, and no pair without a shared seed is looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_1, Memo, Roller, Shared, map_rows

SEED, COVERAGE, BLOCK_WORDS = 5, 0.75, 500_000
MARKS = ".,;:!?#*$%&|()[]\"'"
WORDS = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id sequences: (start in a, start in b, length), each word in one tile at most.

    ``a`` is the pattern. At equal length, the tile first in ``a``, then in ``b``, is marked first. Matches are searched at
    falling lengths; a match longer than twice the length restarts the search there, as Karp-Rabin tiling does.
    """
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    roll, tiles = Roller(BASE_1), []
    size = min(max(least, 20), len(a), len(b))
    if min(len(a), len(b)) < least:
        return tiles
    while True:
        hash_a, hash_b = roll(a.astype(np.uint64) + np.uint64(1), size), roll(b.astype(np.uint64) + np.uint64(1), size)
        ok_a, ok_b = (np.lib.stride_tricks.sliding_window_view(f, size).all(1) for f in (free_a, free_b))
        places = np.flatnonzero(ok_b & np.isin(hash_b, hash_a))
        places = places[np.argsort(hash_b[places], kind="stable")]
        starts = np.flatnonzero(np.diff(hash_b[places], prepend=~hash_b[places[:1]])) if len(places) else places
        where = dict(zip(hash_b[places[starts]].tolist(), np.split(places, starts[1:]), strict=True)) if len(places) else {}
        found, longest = [], 0
        for i in np.flatnonzero(ok_a).tolist() if where else ():
            there = where.get(int(hash_a[i]))
            if there is None:
                continue
            if i and free_a[i - 1]:  # what also matches one word before belongs to that longer run
                there = there[~((there > 0) & free_b[there - 1] & (b[there - 1] == a[i - 1]))]
            for j in there.tolist():
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n >= size:
                    found.append((-n, i, j))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        for n, i, j in sorted(found):
            # Only the longest are marked: what they take from others shows in the next search of the same length.
            if -n == longest and free_a[i : i - n].all() and free_b[j : j - n].all():
                free_a[i : i - n] = free_b[j : j - n] = False
                tiles.append((i, j, -n))
        if not found:
            if size == least:
                return tiles
            size = max(least, size // 2)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, n_item_words, n_covered, coverage, n_tiles``: one row per contaminated row of ``docs`` and item.

    Tiles are of ``seed`` words or more; an item with fewer words must be found whole, but items under 3 words (null and
    empty ones too) are ignored as they are no passage. Null and empty documents match nothing. Ids may be null or repeat
    and are passed through; other columns are ignored. An empty benchmark or document table gives no rows.
    """
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {kind}, item_id {item_kind}, n_item_words bigint, n_covered bigint, coverage double, n_tiles bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))):
        out = out.union(map_rows(docs, _matcher(Shared(docs.sparkSession, block), seed, coverage), schema))
    return out


def _blocks(items: DataFrame):
    """The items in blocks of at most BLOCK_WORDS words (one longer item is a block of its own), each in turn on the driver."""
    block, size = [], 0
    for r in items.toLocalIterator():
        words = tokens(r["text"])
        if len(words) < 3:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], words))
        size += len(words)
    if block:
        yield block


def _matcher(sent: Shared, seed: int, coverage: float):
    def make():
        block = sent.value
        ids: dict[str, int] = {}
        items = [np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int64) for _, words in block]
        # Seed hash -> items, by seed length (items shorter than a seed are a seed themselves).
        roll, seeds = Roller(BASE_1), defaultdict(lambda: defaultdict(set))
        for k, x in enumerate(items):
            n = min(seed, len(x))
            for h in roll(x.astype(np.uint64), n).tolist():
                seeds[n][h].add(k)
        sorted_seeds = {n: np.array(sorted(s), np.uint64) for n, s in seeds.items()}
        many: list[tuple[int, ...]] = []
        places: dict[tuple[int, ...], int] = {}  # chunks of several words with one of the block's: few, as ids repeat

        def code(chunk: str) -> int:
            """Of a chunk without white space: its word's id (0: not in the block), -1 if it has no word, else -3 less a place in ``many``."""
            word = chunk.lower().strip(MARKS)
            if word.isalnum():
                return ids.get(word, 0)
            found = [ids.get(w, 0) for w in tokens(chunk)]
            if len(found) == 1:
                return found[0]
            if not found:
                return -1
            if not any(found):
                return -2
            if (key := tuple(found)) not in places:
                places[key] = len(many)
                many.append(key)
            return -3 - places[key]

        codes = Memo(code, 200_000)

        def rows(row):
            chunks = (row["text"] or "").split()
            doc = np.fromiter(map(codes.__getitem__, chunks), np.int64, len(chunks))
            if len(doc) and doc.min() < 0:
                # A run of words outside the block matches nothing, however long it is: -2 may stand for one of them.
                doc = np.array([w for c in doc.tolist() if c != -1 for w in ((c,) if c >= 0 else (0,) if c == -2 else many[-3 - c])], np.int64)
            hits: set[int] = set()
            for n, known in sorted_seeds.items():
                if len(doc) < n:
                    continue
                h = roll(doc.astype(np.uint64), n)
                at = np.minimum(known.searchsorted(h), len(known) - 1)
                for x in set(h[known[at] == h].tolist()):
                    hits |= seeds[n][x]
            if not hits:
                return
            # Unknown words match nothing: each run of them shrinks to one.
            keep = np.ones(len(doc), bool)
            keep[1:] = (doc[1:] > 0) | (doc[:-1] > 0)
            doc = doc[keep]
            for k in sorted(hits):
                x = items[k]
                if np.isin(x, doc).sum() < coverage * len(x):  # tiles can't cover more than the words that occur at all
                    continue
                inside = np.isin(doc, x)
                part = np.where(inside, doc, 0)
                thin = np.ones(len(part), bool)
                thin[1:] = (part[1:] > 0) | (part[:-1] > 0)
                tiles = tile(x, part[thin], min(seed, len(x)))
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * len(x):
                    yield row["doc_id"], block[k][0], len(x), covered, covered / len(x), len(tiles)

        return rows

    return make
