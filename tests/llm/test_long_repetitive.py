"""Long texts that repeat one word or line end in time linear in their length, with the results of short ones."""

import random
import time

import numpy as np
from pyspark.sql import functions as F
from test_llm import table

from netloom.llm import lines, tiling


def test_tiling_of_equal_words():
    start = time.perf_counter()
    assert tiling.tile(np.zeros(100, np.int64), np.zeros(20_000, np.int64), 5) == [(0, 0, 100)]
    assert tiling.tile(np.zeros(7, np.int64), np.zeros(20, np.int64), 8) == []
    a, b = np.array([1, 2, 3, 4, 1, 2, 3, 4]), np.array([9, 1, 2, 3, 4, 9, 1, 2, 3])
    assert tiling.tile(a, b, 3) == [(0, 1, 4), (4, 6, 3)]
    assert time.perf_counter() - start < 20


def test_many_equal_lines_in_one_text(spark):
    """The first line stays, among lines without words; one text has 60,000 of them."""
    text = "\n".join(["the same line of a few words", "--"] * 30_000)
    start = time.perf_counter()
    got = lines.drop_fuzzy_lines(table(spark, [text, "the same line of a few words\nanother thing altogether here", None])).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"]) for r in got] == [(60_000, 29_999), (2, 1), (0, 0)]
    assert got[0]["text"] == "\n".join(["the same line of a few words", "--"] + ["--"] * 29_999) and got[1]["text"] == "another thing altogether here" and got[2]["text"] is None
    assert time.perf_counter() - start < 120


def test_near_pairs_of_long_lines_need_no_full_distances(spark):
    """The bound that is linear in words accepts pairs with a few edits, also far apart, and never falls below the distance."""
    rng = random.Random(30)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))
    a = [word() for _ in range(6000)]
    b = a.copy()
    for _ in range(200):
        b[rng.randrange(len(b))] = word()
    c = a[:2000] + [word() for _ in range(150)] + a[2000:5000] + a[5100:]
    pairs = [(" ".join(x), " ".join(y)) for x, y in ((a, a), (a, b), (c, a), (a[:4000], a[5:4000]), (["la"] * 3000, ["la"] * 2900 + ["zu"]))]
    for n in (1, 2, 5, 12, 30):
        for _ in range(30):
            x = [word() for _ in range(n)]
            y = x.copy()
            for _ in range(rng.randint(0, 3)):
                y[rng.randrange(len(y))] = word()
            y = y[rng.randint(0, n // 3) :]
            pairs.append((" ".join(x), " ".join(y)))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(pairs)], "k int, p string, q string")
    got = df.select("k", "p", "q", lines.edits_at_most("p", "q").alias("bound")).orderBy("k").collect()
    share = [r["bound"] / max(len(r["p"]), len(r["q"])) for r in got[:5]]
    assert share[0] == 0 and max(share) <= 0.2, share
    short = df.where("k > 4").select((lines.edits_at_most("p", "q") - F.levenshtein("p", "q")).alias("over")).collect()
    assert len(short) == 150 and all(r["over"] >= 0 for r in short)


def test_bound_of_long_lines_of_few_words(spark):
    """Lines of 200 different words of which a passage is missing, and one that repeats itself: the bound stays close to the distance."""
    rng = random.Random(31)
    some = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(200)]
    a = rng.choices(some, k=2500)
    b = a[:900] + a[1150:]
    for _ in range(40):
        b[rng.randrange(len(b))] = rng.choice(some)
    c = ["aterth"] * 1200 + rng.choices(some, k=200) + ["aterth"] * 300
    d = c[60:700] + ["atrth"] + c[701:]
    pairs = [(" ".join(x), " ".join(y)) for x, y in ((a, b), (c, d))]
    df = spark.createDataFrame([(*x, max(map(len, x)) // 5) for x in pairs], "p string, q string, most int")
    bound = F.least(lines.edits_at_most("p", "q", "most"), lines.edits_at_most("q", "p", "most"))
    for r in df.select(bound.alias("bound"), F.levenshtein("p", "q").alias("edits"), "most").collect():
        assert r["edits"] <= r["bound"] <= r["most"] and r["bound"] <= 1.35 * r["edits"], r
