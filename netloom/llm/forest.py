"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated from labelled rows.

Statistics are taken once from the whole texts. Each tree is grown from a subsample of its own, which is what makes an
isolation forest: every row of the table draws its tree by a hash, and a tree takes the ``SUBSAMPLE`` rows with the smallest
hashes. A row's anomaly score is ``2 ** -(mean path length / c(subsample))``. All labelled rows calibrate: of the forests on
each choice of statistics, and of ``BINS`` thresholds, those are taken that catch most bad rows less good rows, losing a small
share of good rows at most; rows are counted by bin in Spark. So a statistic whose anomalies are harmless doesn't drown one whose anomalies are bad.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, cut, map_rows

TREES, SUBSAMPLE, BINS, SEED = 100, 256, 1 << 14, 11
#: Share of labelled good rows that the threshold may lose.
GOOD_LOST = 0.002
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
MIN_WORDS, MAX_REPEAT = 50, 50
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
#: Features: characters a word, symbols a character, duplicate lines a line, repeated words a word.
N_FEATURES = 4


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more in the text, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
    k = len(ids)
    pair = w[:-1] * k + w[1:]
    if k > 2_000_000:  # three ids no longer fit 63 bits: number the pairs first
        _, pair = np.unique(pair, return_inverse=True)
    _, inverse, times = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[inverse] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + 3] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    r"""Words are ``[^\x20\x09-\x0D]+``; null is an empty text; a line counts if it has a word and equals an earlier line."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    seen, lines = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += line in seen
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), lines, repeat_words(words)


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) -> np.ndarray:
    words, chars, lines = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    return np.column_stack([word_chars / words, n_symbols / chars, n_dup_lines / lines, n_repeat_words / words]).astype(np.float64)


def c_factor(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    """Trees as arrays: at node k go left if x[feature] < cut; leaves have feature -1 and hold their path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    unit: float
    threshold: float = np.inf
    gain: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                k = at[rows]
                at[rows] = np.where(x[rows, self.feature[k]] < self.cut[k], self.left[k], self.right[k])
            depth += self.length[at]
        return 2.0 ** -(depth / max(len(self.roots), 1) / self.unit)


def grow(subsamples: list[np.ndarray], *, use: tuple[int, ...] = tuple(range(N_FEATURES)), seed: int = SEED) -> Forest:
    """An isolation forest of the features ``use``, one tree a subsample; random features and cuts from ``seed``."""
    rng, nodes, roots = np.random.default_rng(seed), [], []
    size = max(map(len, subsamples), default=0)
    limit = int(np.ceil(np.log2(max(size, 2))))

    def build(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + c_factor(len(rows))])
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(N_FEATURES),) * 2
        wide = [f for f in use if high[f] > low[f]]
        if depth < limit and len(rows) > 1 and wide:
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            side = rows[:, f] < at
            nodes[me] = [f, at, build(rows[side], depth + 1), build(rows[~side], depth + 1), 0.0]
        return me

    for x in subsamples:
        roots.append(build(x, 0))
    a = np.array(nodes, np.float64).reshape(-1, 5)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), max(c_factor(size), 1.0))


def calibrate(good: np.ndarray, bad: np.ndarray, good_lost: float = GOOD_LOST) -> tuple[float, float]:
    """Of counts of good and bad rows by bin of the score: the threshold with the most bad rows over it less good rows over it (as
    shares), losing at most ``good_lost`` of the good, and that gain."""
    if not bad.sum() or not good.sum():
        return np.inf, 0.0
    caught, lost = np.cumsum(bad[::-1])[::-1] / bad.sum(), np.cumsum(good[::-1])[::-1] / good.sum()
    gain = np.where(lost <= good_lost, caught - lost, -np.inf)
    best = int(np.flatnonzero(gain == gain.max())[-1])
    return (float(np.nextafter(best / BINS, 0)), float(gain[best])) if np.isfinite(gain[best]) else (np.inf, 0.0)


def choices(subsamples: list[np.ndarray]) -> list[Forest]:
    """The forests on each choice of statistics, all of them first."""
    return [grow(subsamples, use=use) for size in range(N_FEATURES, 0, -1) for use in combinations(range(N_FEATURES), size)]


def chosen(forests: list[Forest], marked: DataFrame) -> Forest:
    """The forest and threshold that all of ``marked`` (statistics and ``bad``) choose; without labels of both kinds the first and no threshold."""
    sent = Shared(marked.sparkSession, forests)

    @F.pandas_udf("array<int>")
    def bins(n_words: pd.Series, word_chars: pd.Series, n_symbols: pd.Series, n_dup_lines: pd.Series, n_repeat_words: pd.Series, n_lines: pd.Series) -> pd.Series:
        x = features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)
        return pd.Series(list(np.column_stack([np.minimum(f.score(x) * BINS, BINS - 1).astype(np.int32) for f in sent.value])))

    found = marked.select("bad", F.posexplode(bins(*NUMBERS)).alias("forest", "bin")).groupBy("forest", "bin", "bad").agg(F.count("*").alias("k"))
    counts = np.zeros((len(forests), BINS, 2))
    for r in found.toLocalIterator():  # at most a count for each forest, bin and kind
        counts[r["forest"], r["bin"], r["bad"]] += r["k"]
    best = forests[0]
    for forest, n in zip(forests, counts, strict=True):
        forest.threshold, forest.gain = calibrate(n[:, 0], n[:, 1])
        if forest is best or forest.gain > best.gain:
            best = forest
    return best


def rule_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics and ``n_lines`` of every row. A null text counts as empty; texts are read whole; ids may be null or
    repeat; other columns are ignored; an empty table gives no rows."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, lambda: lambda r: [(r["doc_id"], *statistics_of(r["text"]), (r["text"] or "").count("\n") + 1)], f"doc_id {kind}, {STATS}, n_lines bigint")


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def subsamples(sound: DataFrame) -> list[np.ndarray]:
    """The features of each tree's rows: of those that hashes deal to the tree, the ``SUBSAMPLE`` with the smallest hashes.

    A row is dealt to one tree, in a table too small for that to as many as give each tree twice its rows (all, if need be).
    """
    times = max(1, min(TREES, -(-2 * TREES * SUBSAMPLE // max(1, sound.count()))))
    dealt = sound.select(F.xxhash64("doc_id", *NUMBERS, F.lit(SEED)).alias("h"), *NUMBERS).select("h", *NUMBERS, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("k"))
    dealt = dealt.select(F.pmod(F.pmod("h", F.lit(TREES)) + F.col("k"), F.lit(TREES)).cast("int").alias("tree"), F.shiftrightunsigned(F.xxhash64("h", "k"), 8).alias("draw"), *NUMBERS)
    # A tree's smallest hashes lie under twice its share, so few rows are sorted.
    share = dealt.groupBy("tree").agg(F.count("*").alias("rows"))
    under = F.when(F.col("rows") <= 4 * SUBSAMPLE, F.lit(1 << 56)).otherwise(F.floor(2.0 * SUBSAMPLE / F.col("rows") * (1 << 56)))
    few = dealt.join(F.broadcast(share), "tree").where(F.col("draw") < under)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("draw", *NUMBERS))
    rows = few.withColumn("rank", rank).where(F.col("rank") <= SUBSAMPLE).select("tree", "draw", *NUMBERS).collect()
    found: dict[int, list] = {}
    for r in sorted(rows):
        found.setdefault(r[0], []).append(tuple(map(float, r[2:])))
    return [features(*np.array(x).T) for _, x in sorted(found.items())]


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``anomaly`` and ``kept`` for every row.

    ``labels(doc_id, quality)`` with 1 for good; null and repeated labels are ignored but for the lowest of an id. Without
    labels of both kinds nothing but the base rules rejects. Null text is empty and fails the base rules. Ids may be null or
    repeat; other columns are ignored. An empty table gives no rows.
    """
    stats = cut(rule_statistics(docs, id_col=id_col, text_col=text_col))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    sound = stats.where(~failed)
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("bad"))
    forest = chosen(choices(subsamples(sound)), sound.join(known, "doc_id"))
    sent = Shared(stats.sparkSession, forest)  # at most TREES * 2 * SUBSAMPLE nodes

    @F.pandas_udf("double")
    def anomaly(n_words: pd.Series, word_chars: pd.Series, n_symbols: pd.Series, n_dup_lines: pd.Series, n_repeat_words: pd.Series, n_lines: pd.Series) -> pd.Series:
        forest = sent.value
        if not len(forest.roots):
            return pd.Series(np.zeros(len(n_words)))
        return pd.Series(forest.score(features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)))

    out = stats.withColumn("base_failed", failed).withColumn("anomaly", anomaly(*NUMBERS))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= float(forest.threshold)))
