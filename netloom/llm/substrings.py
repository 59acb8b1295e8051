"""Removal of word passages that an earlier document has, with a count-min prefilter.

A window is ``size`` consecutive words. Every window has an anchor: the smallest hash among its sub-windows of ``inner``
words, so equal windows have equal anchors and a text has one anchor for many windows. Three passes over the texts:

1. Each task counts anchors (once per document) in a count-min sketch of its own; the partitions' sketches are merged slice by
   slice, counting to two. An estimate is at least the true count, so a window whose anchor is estimated to occur in
   one document only can't be repeated, and nothing is lost by leaving it out.
2. The merged sketch, of bounded size, goes to all tasks, which send on the windows it takes for repeated. These are grouped
   exactly, by 128 bits of hash, to the smallest document that has them.
3. Each text drops the words under windows whose smallest document is a smaller one than its own.

Copies of a whole text are one document to steps 1 and 2 (the smallest), so large groups of copies cost one row each; a hot
passage is only ever aggregated by partial sums and minima, or joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_1, BASE_2, READ_ROWS, Kept, Roller, Shared, cut, hashed, if_small, map_rows, mix, signed, word_hashes, words_of

SIZE, INNER, DEPTH = 50, 12, 2
#: Characters of text for each cell of the sketch's rows (about eight cells an anchor), and the most cells of a row.
CHARS_PER_CELL, WIDEST = 16, 1 << 28
#: Cells of a slice, tasks whose slices are merged first, anchors that a task holds before it sends them on.
SLICE, FAN, HELD = 1 << 18, 64, 4_000_000
#: Rows up to which a table is broadcast.
SMALL = 200_000


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class Windows:
    """Hashes of a text's words, windows and anchors; the same in every pass."""

    def __init__(self, size: int, inner: int):
        self.size, self.inner = size, inner
        self.memo, self.one, self.two = word_hashes(), Roller(BASE_1), Roller(BASE_2)

    def words(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        words = words_of(text)
        return words, hashed(words, self.memo)

    def first(self, h: np.ndarray) -> np.ndarray:
        return self.one(h, self.size)

    def second(self, h: np.ndarray) -> np.ndarray:
        return self.two(mix(h), self.size)

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The anchor of each window."""
        return slide_min(self.two(h, self.inner), self.size - self.inner + 1) if len(h) >= self.size else np.empty(0, np.uint64)


def cells_of(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each anchor in a row of the sketch."""
    with np.errstate(over="ignore"):
        return mix(anchors + np.uint64(row + 1) * np.uint64(BASE_1)) & np.uint64(width - 1)


def merged_sketch(texts: DataFrame, size: int, inner: int, width: int) -> list[np.ndarray]:
    """Per row of the count-min sketch a packed bit for each cell: whether two or more documents of ``texts(text)`` fall there.

    Each task sends its sketch in slices of ``SLICE`` cells, as the cells in use and whether they hold more than one. Slices are
    merged by adding up to two, ``FAN`` tasks' at a time and then all, so a group's size doesn't follow the corpus.
    """
    schema = "row int, slice int, bunch int, cells binary, more binary"
    part = min(width, SLICE)

    def pieces(row: int, cells: np.ndarray, twice: np.ndarray, bunch: int):
        edges = np.searchsorted(cells, np.arange(0, width + 1, part, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            here = slice(edges[k], edges[k + 1])
            yield row, k, bunch, (cells[here] - np.uint64(k * part)).astype("<u4").tobytes(), np.packbits(twice[here]).tobytes()

    def sketch(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        w, bunch, held, n = Windows(size, inner), TaskContext.get().partitionId() // FAN, [], 0

        def flush():
            for row in range(DEPTH):
                cells, times = np.unique(cells_of(np.concatenate(held), row, width), return_counts=True)
                columns = zip(*pieces(row, cells, times > 1, bunch), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "slice", "bunch", "cells", "more"])
            held.clear()

        for batch in batches:
            for text in batch.column("text"):
                anchors = np.unique(w.anchors(w.words(text.as_py())[1]))
                if len(anchors):
                    held.append(anchors)
                    n += len(anchors)
                if n >= HELD:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def merge(pdf):
        import pandas as pd

        count = np.zeros(part, np.uint8)
        for cells, more in zip(pdf["cells"], pdf["more"], strict=True):
            at = np.frombuffer(cells, "<u4")
            count[at] = np.minimum(count[at] + 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)), 2)
        at = np.flatnonzero(count)
        return pd.DataFrame({"row": pdf["row"][:1], "slice": pdf["slice"][:1], "bunch": 0, "cells": [at.astype("<u4").tobytes()], "more": [np.packbits(count[at] > 1).tobytes()]})

    made = texts.select("text").mapInArrow(sketch, schema)
    made = made.groupBy("row", "slice", "bunch").applyInPandas(merge, schema).groupBy("row", "slice").applyInPandas(merge, schema)
    out = [np.zeros(width, bool) for _ in range(DEPTH)]
    for r in made.select("row", "slice", "cells", "more").toLocalIterator():  # at most DEPTH * WIDEST cells
        at = np.frombuffer(r["cells"], "<u4")
        out[r["row"]][r["slice"] * part + at] = np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(at)).astype(bool)
    return [np.packbits(x) for x in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, inner: int = INNER, width: int | None = None) -> DataFrame:
    """``doc_id, kept_text, n_words, n_removed``: kept words joined by one space.

    Null and empty texts have no words. Windows are judged on the input. Rows that share an id neither remove each other's
    words nor their own; a null id is neither smaller nor larger than any, so its row is kept whole. Texts shorter than a
    window are kept whole; long ones are read whole. Other columns are ignored. An empty table gives no rows. ``width`` is the
    sketch's, a power of two; by default it follows the corpus up to ``WIDEST``, and beyond that more windows are grouped.
    """
    if not 0 < inner <= size:
        raise ValueError("inner must be between 1 and size")
    kind, spark = dict(docs.dtypes)[id_col], docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    # Copies of a text with a smaller id go whole; they are known by their hash and take no part in what follows.
    same = docs.where("doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    docs = docs.join(if_small(cut(same), SMALL), ["k1", "k2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    fresh = docs.where(~F.col("copy") & F.col("doc_id").isNotNull())
    if width is None:
        chars = fresh.agg(F.sum(F.length("text"))).first()[0] or 0
        width = 1 << min(max(16, int(chars // CHARS_PER_CELL).bit_length()), WIDEST.bit_length() - 1)
    sent = Shared(spark, merged_sketch(fresh, size, inner, width))  # DEPTH * WIDEST bits at most

    def expand(batches):
        import pyarrow as pa

        w, sketch = Windows(size, inner), sent.value

        def heavy(row: int, anchors: np.ndarray) -> np.ndarray:
            cell = cells_of(anchors, row, width)
            return sketch[row][cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8) & np.uint8(1)

        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                found, part = [], batch.slice(at, READ_ROWS)
                for k, text in enumerate(part.column("text")):
                    _, h = w.words(text.as_py())
                    if len(h) >= size:
                        anchors = w.anchors(h)
                        hit = np.flatnonzero(heavy(0, anchors))
                        for row in range(1, DEPTH):
                            hit = hit[heavy(row, anchors[hit]) > 0]
                        if len(hit):
                            found.append((np.full(len(hit), k), hit, signed(w.first(h)[hit]), signed(w.second(h)[hit])))
                if found:
                    rows, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), part.column("k1").take(pa.array(rows)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], ["doc_id", "k1", "at", "w1", "w2"])

    windows = Kept(fresh.select("doc_id", "k1", "text").mapInArrow(expand, f"doc_id {kind}, k1 bigint, at int, w1 bigint, w2 bigint"))
    owner = windows.df.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("w1", "w2", "first_id")
    covered = windows.df.join(cut(owner), ["w1", "w2"]).where("first_id < doc_id").groupBy("doc_id", "k1").agg(F.collect_list("at").alias("covered"))
    covered = cut(covered)
    windows.drop()

    def apply():
        def rows(row):
            words = words_of(row["text"])
            n = len(words)
            if n >= size and row["copy"]:
                words = []
            elif n >= size and row["covered"]:
                edge, at = np.zeros(n + 1, np.int64), np.unique(row["covered"])
                edge[at] += 1
                edge[at + size] -= 1
                gone = np.cumsum(edge[:n]) > 0
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            yield row["doc_id"], b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words)

        return rows

    judged = docs.select("doc_id", "text", "k1", "copy").join(covered, ["doc_id", "k1"], "left").select("doc_id", "text", "copy", "covered")
    return map_rows(judged, apply, f"doc_id {kind}, kept_text string, n_words bigint, n_removed bigint")


#: DuckDB SQL for the query op2_substring_dedup.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 49, 0) + 1)) AS p FROM w),
h AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM win),
o AS (SELECT k, min(doc_id) AS first_id FROM h GROUP BY k),
c AS (SELECT h.doc_id, list(p) AS ps FROM h JOIN o USING (k) WHERE o.first_id < h.doc_id GROUP BY h.doc_id),
m AS (SELECT c.doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) AS gone FROM c),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
gone AS (SELECT doc_id, unnest(gone) AS i FROM m),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
