"""Importance resampling towards a target distribution, by hashed n-grams from a position table.

Words of each text are exploded with their positions; ``lead()`` over a text's positions adds the following words, so a row
holds the n-grams of every order that start there, as buckets of their CRC-32. Counts per bucket over the corpus and over the
target give each bucket's gain, joined back to the positions and averaged per text. Sampling without replacement by
Gumbel scores is then one sort.

Texts are shuffled once, by a number of their own, so a window finds its text's words together and no key is hot. The table of
positions is written once (two small integers a word); bucket counts and gains are aggregations over it.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept

ORDERS, BUCKETS, SEED, PERCENT, MIN_WORDS = 2, 10_000, 7, 25, 20
#: The characters that end a word are those below 0x80 other than letters and digits.
SEPARATORS = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits)


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    clean = F.translate(text, string.ascii_uppercase + SEPARATORS, string.ascii_lowercase + " " * len(SEPARATORS))
    return F.array_remove(F.split(clean, " "), "")


def positions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """One row per word of each text: ``row, doc_id`` and the buckets ``b1`` ... of the n-grams that start there (null at the text's end). A text without words has one row of nulls."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).repartition("row")
    table = rows.select("row", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    following = Window.partitionBy("row").orderBy("pos")
    table = table.select("row", "doc_id", *[(F.lead("word", k).over(following) if k else F.col("word")).alias(f"w{k}") for k in range(orders)])
    grams = [F.concat(*[c for k in range(order) for c in (F.lit(" "), F.col(f"w{k}"))][1:]) for order in range(1, orders + 1)]
    return table.select("row", "doc_id", *[F.pmod(F.crc32(g), F.lit(buckets)).cast("int").alias(f"b{k}") for k, g in enumerate(grams, 1)])


def bucket_counts(table: DataFrame, orders: int) -> DataFrame:
    """``(bucket, n)`` of all n-grams of a position table."""
    each = [table.groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count("*").alias("n")) for k in range(1, orders + 1)]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, gain)`` for every bucket: 1000 times the logarithm of the target's smoothed share over the corpus's, rounded down."""
    total = {name: counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for name, counts in (("s", corpus), ("t", target))}
    each = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    each = each.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return each.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def floored_mean(total: Column, n: Column) -> Column:
    """The mean of whole numbers rounded down, 0 for none."""
    n = F.when(n > 0, n)
    return F.coalesce(((total - F.pmod(total, n)) / n).cast("long"), F.lit(0).cast("long"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel draw that the id fixes, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


@dataclass
class Resampled:
    """All documents with ``n_words, n_features, weight, score`` and ``rank`` (null if not drawn), and the gain of each bucket."""

    documents: DataFrame
    gains: DataFrame


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS,
             seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> Resampled:
    """Draws ``percent`` of the documents with at least ``min_words`` words, likelier the more their n-grams are the target's.

    Null and empty texts have no features and weight 0 and are not drawn; texts of any length are whole. A null id draws
    as the empty string does and comes after other ids in ties. Repeated rows count and are ranked each; rows of one id and score come in order
    of their number of features. Other columns are ignored, so their names can't clash. An empty corpus gives no rows, an empty target leaves all its counts 0.
    """
    counted = {}
    tables = [Kept(positions(docs, id_col=id_col, text_col=text_col, orders=orders, buckets=buckets)), None]
    target = target.select(F.lit(0).alias("id"), F.col(target_col).alias("text"))
    tables[1] = Kept(positions(target, id_col="id", orders=orders, buckets=buckets))
    for name, table in zip(("s", "t"), tables, strict=True):
        counted[name] = Kept(bucket_counts(table.df, orders))
    found = Kept(gains(counted["s"].df, counted["t"].df, buckets).coalesce(1))
    gain, n = F.lit(0).cast("long"), F.lit(0).cast("long")
    scored = tables[0].df
    for k in range(1, orders + 1):  # one row per bucket, so the number of buckets bounds what is broadcast
        scored = scored.join(F.broadcast(found.df.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
        gain, n = gain + F.coalesce(F.col(f"g{k}"), F.lit(0)), n + F.col(f"b{k}").isNotNull().cast("long")
    scored = scored.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), F.sum(n).alias("n_features"), F.sum(gain).alias("gain"))
    weight = floored_mean(F.col("gain"), F.col("n_features"))
    scored = Kept(scored.select("row", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + gumbel(F.col("doc_id"), seed)).alias("score")))
    for table in (*tables, *counted.values()):
        table.drop()

    drawn = percent * scored.df.where(F.col("n_words") >= min_words).count() // 100
    order = [F.col("n_words") < min_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    # The id that Spark counts up holds the partition above bit 33 and the place within it below.
    placed = Kept(scored.df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    scored.drop()
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = placed.df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = placed.df.withColumn("part", part).join(F.broadcast(starts), "part")
    return Resampled(out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")), found.df)


#: DuckDB has no CRC-32: its table follows from the polynomial, and each distinct n-gram's bytes go through it one by one.
SQL = r"""
WITH crc AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(k))),
texts AS (
    SELECT 's' AS side, rowid AS row, doc_id, text FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
    UNION ALL SELECT 't', row_number() OVER (), 0, text FROM benchmark),
split AS (SELECT side, row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts),
grams AS (SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS g FROM split),
per AS (SELECT side, row, g, count(*) AS n FROM grams GROUP BY ALL),
coded AS (SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda k: ('0x' || h[k:k + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]::BIGINT))) % 10000 AS bucket FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM per)), crc),
counts AS (SELECT bucket, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM per JOIN coded USING (g) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(counts.t, 0) + 1)::DOUBLE * (totals.s + 10000)::DOUBLE) / ((coalesce(counts.s, 0) + 1)::DOUBLE * (totals.t + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, totals),
summed AS (SELECT row, sum(n * gain)::BIGINT AS gain, sum(n)::BIGINT AS n FROM per JOIN coded USING (g) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row),
weights AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || left(sha256('7:' || doc_id), 8))::BIGINT AS h FROM split LEFT JOIN summed USING (row) WHERE side = 's'),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ranks
"""
