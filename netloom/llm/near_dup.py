"""Near-duplicate documents by MinHash with tensored banding and exact verification.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets are one node (the smallest id),
so groups of copies cost one row. Two small collections of ``bands`` half-keys (each ``rows`` minhashes) are made per node;
a table key is a pair of half-keys, one of each collection, so ``bands ** 2`` tables need only ``2 * bands * rows``
minhashes. Within a table's bucket no pairs are listed: the member that meets most others is the hub, and all members
compare with it. Confirmed links give components; whatever in a bucket is still apart from the hub's component is then
compared with all of the bucket that is of other components, so each bucket's links are all found. That comparison first bounds the intersection by the shingles of either
text that any other text there has at all, exactly, and looks at sketches of ``BITS`` one-bit minhashes, both inside the
join: pairs that can't be links make no row. Copies that are too far from the hub for a link mostly are so by shingles of
their own, which rules them out against all other copies as well. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE_1, Roller, components, cut, hashed, if_small, map_rows, mix, signed, word_hashes

SHINGLE, SIMILARITY = 5, 75
#: A pair of similarity s is met in some table with 1 - (1 - (1 - (1 - s**ROWS)**BANDS)**2): 0.9999 at 0.75.
BANDS, ROWS = 12, 2
#: One-bit minhashes of a sketch, and how many standard deviations of chance a pair at the similarity is allowed: it is
#: missed with probability 1.3e-5 where only the sketches can find it.
BITS, SLACK = 768, 4.2


class Shingles:
    """text -> sorted distinct 64-bit hashes of its word shingles; ``lower`` folds A-Z only."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.memo, self.roll = size, word_hashes(), Roller(BASE_1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = hashed(words, self.memo)
        if len(h) >= self.size:
            return np.unique(self.roll(h, self.size))
        return mix(self.roll(h, len(h)) + np.uint64(len(h)))  # a short text is one shingle of its own kind


def minhashes(h: np.ndarray, n: int) -> np.ndarray:
    """``n`` minhashes of a set of mixed hashes; long sets go block by block."""
    rng = np.random.default_rng(20240229)
    add, mul = rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64), rng.integers(0, 1 << 62, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):
            np.minimum(least, ((h[None, at : at + 4096] ^ add) * mul).min(axis=1), out=least)
    return least


def sketch_bits(h: np.ndarray) -> np.ndarray:
    """``BITS`` one-bit minhashes of a set, as signed longs."""
    rng = np.random.default_rng(20240301)
    mul = rng.integers(0, 1 << 31, (BITS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, (BITS, 1), dtype=np.uint32)
    least, low = np.full(BITS, np.iinfo(np.uint32).max, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 1024):
            np.minimum(least, ((low[None, at : at + 1024] ^ add) * mul).min(axis=1), out=least)
    return np.packbits((mix(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Links: ``100 * intersection >= similarity * union`` of the sets. Null, empty and wordless texts have an empty set and
    no link: their component is their own id. Rows that share an id are one node. A null id is never linked: its component
    is null and it is kept. Of each component the smallest id is kept. Other columns are ignored. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def sketch():
        shingles = Shingles()

        def out(row):
            h = shingles(row["text"])
            if not len(h):
                yield row["doc_id"], 0, None, None, None, None
                return
            with np.errstate(over="ignore"):
                k1, k2 = np.array([mix(h).sum(dtype=np.uint64), mix(h ^ np.uint64(BASE_1)).sum(dtype=np.uint64)]).view(np.int64).tolist()
                low = minhashes(h, 2 * bands * rows).reshape(2 * bands, rows)
                half = low[:, 0].copy()
                for c in range(1, rows):
                    half = mix(half + np.uint64(BASE_1)) ^ low[:, c]
                half = signed(mix(half)).tolist()
            yield row["doc_id"], len(h), k1, k2, half[:bands], half[bands:]

        return out

    brief = cut(map_rows(docs, sketch, f"doc_id {kind}, n bigint, k1 bigint, k2 bigint, a array<bigint>, b array<bigint>"))
    full = brief.where("n > 0 AND doc_id IS NOT NULL")
    node = full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.first("a").alias("a"), F.first("b").alias("b"))

    # Nodes that share a half-key of the first collection and one of the second with anyone.
    for side in "ab":
        keyed = node.select("*", F.posexplode(side).alias("at", "half")).groupBy("at", "half").agg(F.count("*").alias("met")).where("met > 1").select("at", "half")
        node = node.join(node.select("node", F.posexplode(side).alias("at", "half")).join(keyed, ["at", "half"], "left_semi").select("node").distinct(), "node", "left_semi")
    node = cut(node)
    pair_key = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i, j, x, y))))
    tables = node.select("node", "n", F.posexplode(pair_key).alias("at", "key"))
    bucket = tables.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    member = cut(tables.join(bucket, "key"))
    degree = member.groupBy("node").agg(F.sum("met").alias("degree"))
    member = member.drop("met").join(degree, "node")

    # The full sets of all texts that are in some bucket, once per node.
    inside = if_small(cut(degree.select(F.col("node").alias("doc_id"))))

    def sets():
        shingles = Shingles()
        return lambda row: [(row["doc_id"], h.view(np.int64).tolist(), sketch_bits(h).tolist())] if len(h := shingles(row["text"])) else []

    full_set = map_rows(docs.join(inside, "doc_id", "left_semi"), sets, f"node {kind}, items array<bigint>, bits array<bigint>")
    full_set = cut(full_set.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.first("bits").alias("bits")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of distinct candidate pairs (x, y), those that are links."""
        near = pairs.join(full_set.select(F.col("node").alias("x"), F.col("items").alias("p")), "x").join(full_set.select(F.col("node").alias("y"), F.col("items").alias("q")), "y")
        near = near.withColumn("both", F.size(F.array_intersect("p", "q")).cast("long"))
        return near.where(100 * F.col("both") >= similarity * (F.size("p") + F.size("q") - F.col("both"))).select(F.col("x").alias("a"), F.col("y").alias("b"))

    fits = f"100 * least(n, n2) >= {similarity} * greatest(n, n2)"
    hub = member.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("hub"), F.count("*").alias("met"))
    star = member.join(hub, "key").select(F.col("node").alias("x"), "n", F.col("hub.node").alias("y"), F.col("hub.n").alias("n2")).where("x <> y").where(fits).distinct()
    links = cut(confirmed(star.select("x", "y")))
    group = cut(components(links))
    # What is still apart from its bucket's hub is compared with the rest of the bucket, each pair once: large groups of
    # copies are mostly the hub's, so few rows have anything to compare.
    owner = if_small(cut(group.where("node <> component")))
    of = lambda df, name, out: df.join(owner.select(F.col("node").alias(name), F.col("component").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))
    leader = of(hub.select("key", "met", F.col("hub.node").alias("hub")), "hub", "hub_component")
    apart = cut(of(member, "node", "component").join(leader, "key").where("met > 2").select("key", "at", "node", "n", "component", (F.col("component") != F.col("hub_component")).alias("minor")))  # of two, one is the hub
    apart = cut(apart.join(cut(apart.where("minor").select("key").distinct()), "key", "left_semi"))
    items = full_set.join(apart.select("node").distinct(), "node", "left_semi").select("node", F.explode("items").alias("item"))
    own = items.groupBy("item").agg(F.count("*").alias("texts"), F.min("node").alias("node")).where("texts = 1").groupBy("node").agg(F.count("*").alias("own"))
    facts = full_set.select("node", "bits").join(own, "node", "left").select("node", "bits", F.coalesce("own", F.lit(0)).alias("own"))
    apart = apart.join(facts, "node").withColumn("rest", F.col("n") - F.col("own")).where(100 * F.col("rest") >= similarity * F.col("n"))
    apart = cut(apart.drop("own").join(node.select("node", "a", "b"), "node"))
    minor, major = apart.where("minor").drop("minor"), apart.where("NOT minor").drop("minor")
    other = lambda df: df.drop("at").withColumnsRenamed({c: f"{c}2" for c in df.columns if c not in ("key", "at")})
    # A pair that meets in many tables counts in the first of them.
    first = [F.least(*[F.when(F.col(s)[k] == F.col(f"{s}2")[k], k) for k in range(bands)]) if bands > 1 else F.lit(0) for s in "ab"]
    same_bit = (1 + similarity / 100) / 2
    differ = int(BITS * (1 - same_bit) + SLACK * (BITS * same_bit * (1 - same_bit)) ** 0.5)
    alike = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(BITS // 64)), F.lit(0)) <= differ
    most = F.least("rest", "rest2")
    possible = 100 * most >= similarity * (F.col("n") + F.col("n2") - most)
    worth = lambda df: df.where(fits).where(possible).where(alike).where(first[0] * bands + first[1] == F.col("at")).select(F.col("node").alias("x"), F.col("node2").alias("y"))
    cross = worth(minor.join(other(minor), "key").where("component < component2")).union(worth(minor.join(other(major), "key"))).distinct()
    tried = star.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    cross = cross.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")}).join(tried, ["lo", "hi"], "left_anti").select("x", "y")
    links = links.union(confirmed(cross))

    # Rows that share an id, and ids that share a set, are one node each.
    named = full.select("doc_id", "k1", "k2", "n").join(full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")), ["k1", "k2", "n"]).select("doc_id", "node")
    twice = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).where("a <> b")
    links = links.union(named.join(twice.select("doc_id", "b"), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"))
    group = components(links)
    owner = named.groupBy("doc_id").agg(F.min("node").alias("node")).join(group, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    out = brief.select("doc_id", F.col("n").alias("n_shingles")).join(owner, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


#: DuckDB SQL for the query op10_minhash_near_dedup.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node WHERE r.low < e.b),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id
"""
