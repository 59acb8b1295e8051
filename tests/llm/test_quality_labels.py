"""The threshold of the quality rules counts all labelled rows."""

import numpy as np

from netloom.llm import forest


def test_every_labelled_row_counts(spark):
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", "60L + id % 40 AS n_words", "(60L + id % 40) * (5 + id % 3) AS word_chars", "CASE WHEN id % 10 = 0 THEN 90L ELSE id % 4 END AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words", "5L AS n_lines", "CAST(id % 10 = 0 AS INT) AS bad"
    )
    trees = forest.subsamples(docs)
    assert len(trees) == forest.TREES and all(len(x) == forest.SUBSAMPLE for x in trees)
    seen, calibrate = [], forest.calibrate
    try:
        forest.calibrate = lambda good, bad: seen.append((good.sum(), bad.sum())) or calibrate(good, bad)
        best = forest.chosen(forest.choices(trees), docs)
    finally:
        forest.calibrate = calibrate
    assert set(seen) == {(27_000, 3_000)} and best.gain > 0.99


def test_threshold_lies_on_a_bin():
    good, bad = np.zeros(forest.BINS), np.zeros(forest.BINS)
    good[10], bad[20], good[30] = 999, 50, 1
    threshold, gain = forest.calibrate(good, bad)
    assert threshold < 20 / forest.BINS and abs(gain - (1 - 1 / 1000)) < 1e-12
