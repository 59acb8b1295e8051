"""Shared pieces: word splitting, hashing, Arrow row mapping, checkpoints, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch sent back by :func:`map_rows` holds at most, the bytes of text read before it is sent, and the rows taken from Arrow at once.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 2000, 8 << 20, 256
#: Words that a worker's hash table remembers at most; beyond it the older half is forgotten.
MEMO_WORDS = 400_000
#: Row limit under which a table of ids may be broadcast (16 bytes a row); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_M64 = (1 << 64) - 1
#: Odd multipliers of the rolling window hashes.
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


class Memo(dict):
    """A table filled on demand by ``make(key)`` that keeps between ``size`` and ``2 * size`` recent keys."""

    def __init__(self, make: Callable, size: int = MEMO_WORDS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 (bytes.split knows exactly these six separators)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes() -> Memo:
    """word -> 64-bit hash, with a bounded memory."""
    import xxhash

    return Memo(xxhash.xxh3_64_intdigest)


def hashed(words: list, memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Roller:
    """Hashes of all windows of ``size`` consecutive items in one vectorised pass, whatever the window's length."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.n = n
        up, down = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def __call__(self, items: np.ndarray, size: int) -> np.ndarray:
        n = len(items)
        if n < size:
            return np.empty(0, np.uint64)
        if n >= self.n:
            self._grow(2 * n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(items * self.up[:n], dtype=np.uint64, out=sums[1:])
            return mix((sums[size:] - sums[:-size]) * self.down[: n - size + 1])


class Shared:
    """A read-only object for the workers, as a broadcast that carries its classes along."""

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        import pickle

        return pickle.loads(self.sent.value)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's longs."""
    return x.view(np.int64)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str, *, chunks: bool = False) -> DataFrame:
    """Maps each row to zero or more rows in Python.

    ``make()`` is called once per task and gives ``rows(row: dict) -> iterable of tuples`` in the order of ``schema``; with
    ``chunks`` it gets a list of rows instead. Batches sent back are bounded by rows and by bytes of what was read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, rows, out, seen = to_arrow_schema(fields), make(), [], 0

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(at, READ_ROWS)
                read = [dict(zip(names, values, strict=True)) for values in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                for row in [read] if chunks else read:
                    seen += part.nbytes if chunks else sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
                    out.extend(rows(row))
                    if len(out) >= BATCH_ROWS or seen >= BATCH_BYTES:
                        yield flush()
                        out, seen = [], 0
        if out:
            yield flush()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset one of its own, on a local master only."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder.

    What the checkpoint no longer needs (shuffles, earlier checkpoints) is freed at once: Spark frees it when the driver
    collects its garbage, which a driver with little to do does too seldom.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    context._jvm.System.gc()
    return out


class Kept:
    """A table of its own in the shared folder of ``spark.checkpoint.dir``, compressed; ``drop()`` once nothing reads ``df`` any more."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a checkpointed table of ids for broadcast if it has at most ``limit`` rows; else leaves the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)`` per node of an edge, component = smallest node.

    Alternates large-star and small-star steps until every edge points at its root; each round is checkpointed. Work per
    round is one aggregation and one join on edges; no neighbourhood is collected.
    """
    if rounds < 1:
        raise ValueError("rounds must be positive")
    edge = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edge = cut(edge)
    seen = None
    for _ in range(rounds):
        state = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == tuple(state):
            return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edge.select("v", "v").distinct()).groupBy("node").agg(F.min("component").alias("component"))
        seen = tuple(state)
        both = edge.union(edge.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edge = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
