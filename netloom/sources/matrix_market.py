"""Matrix-Market text, plain and extended: reading and writing with Spark.

The few lines of metadata (banner, comments, sizes) are handled on the driver; entries are parsed by DataFrame functions.
Lines are numbered by partition counts and offsets, so a large file is read in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the banner and their codes.
OBJECTS = {"matrix": "M", "distributed-matrix": "D", "distributedmatrix": "D", "weighted-matrix": "W", "weightedmatrix": "W"}
FORMATS = {"coordinate": "C", "sparse": "C", "array": "A", "dense": "A"}
FIELDS = {"integer": "I", "real": "R", "complex": "C", "pattern": "P"}
SYMMETRIES = {"general": "G", "symmetric": "S", "skew-symmetric": "K", "skewsymmetric": "K", "hermitian": "H"}
VIEWS = ("original", "global", "local")
BANNERS = ("%%matrixmarket", "%%extended-matrixmarket")


@dataclass(frozen=True)
class MatrixMeta:
    """What a file says about its matrix beside the entries."""

    object: str = "M"
    format: str = "C"
    field: str = "R"
    symmetry: str = "G"
    view: str = "original"
    extended: bool = False
    m: int = 0
    n: int = 0
    nnz: int = 0
    nprocs: int = 0
    row_weights: bool = False
    col_weights: bool = False
    header: str = ""
    tail: str = ""


def parse_banner(line: str) -> MatrixMeta | None:
    """Type codes of a banner, in any case; None for any other line."""
    words = line.lower().split()
    if not words or words[0] not in BANNERS:
        return None
    meta = MatrixMeta(extended=words[0] == BANNERS[1])
    for w in words[1:]:
        for name, table in (("object", OBJECTS), ("format", FORMATS), ("field", FIELDS), ("symmetry", SYMMETRIES)):
            if w in table:
                meta = replace(meta, **{name: table[w]})
        if w in VIEWS:
            meta = replace(meta, view=w)
    if meta.format == "A":
        raise ValueError("dense bodies are not supported")
    return meta


def banner(meta: MatrixMeta) -> str:
    back = lambda table, code: next(k for k, v in table.items() if v == code)
    words = [back(OBJECTS, meta.object), "coordinate", back(FIELDS, meta.field), back(SYMMETRIES, meta.symmetry)]
    return " ".join(["%%Extended-MatrixMarket", *words, meta.view] if meta.extended else ["%%MatrixMarket", *words])


def parse_header(lines: list[str]) -> tuple[MatrixMeta, int]:
    """(meta, number of lines up to the size line). Leading blank lines and a missing banner are allowed."""
    meta, header, at = None, [], 0
    for at, line in enumerate(lines):
        s = line.strip()
        if not s:
            continue
        if meta is None and (found := parse_banner(s)):
            meta = found
        elif s.startswith("%"):
            header.append(line)
        else:
            break
    else:
        raise ValueError("no size line")
    size = [int(x) for x in lines[at].split()]
    meta = replace(meta or MatrixMeta(), header="\n".join(header))
    if len(size) < 3 or min(size[:3]) < 1:
        raise ValueError("sizes must be positive")
    extra = size[3] if len(size) > 3 else 0
    meta = replace(meta, m=size[0], n=size[1], nnz=size[2], nprocs=extra if meta.object == "D" else 0)
    if meta.object == "W":
        if extra not in (0, 1, 2, 3):
            raise ValueError("the weight flag is 0, 1, 2 or 3")
        meta = replace(meta, row_weights=bool(extra & 1), col_weights=bool(extra & 2))
    return meta, at + 1


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` of one text file, lines from 0."""
    raw = spark.read.text(path).withColumns({"p": F.spark_partition_id(), "k": F.monotonically_increasing_id()})
    counts = raw.groupBy("p").agg(F.count("*").alias("c"), F.min("k").alias("k0"))
    start = counts.withColumn("start", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return raw.join(F.broadcast(start), "p").select((F.col("start") + F.col("k") - F.col("k0")).alias("line"), "value")  # a row per partition


@dataclass(frozen=True)
class Matrix:
    meta: MatrixMeta
    nz: DataFrame
    row_weight: DataFrame | None = None
    col_weight: DataFrame | None = None


def read(spark: SparkSession, path: str) -> Matrix:
    """A matrix with ``nz(t, i, j[, re[, im]][, part])``, 0-based; entries out of bounds or in the wrong triangle raise."""
    lines = numbered(spark, path)
    # The size line is the first that is neither blank nor a comment; what stands above it is read, however long.
    size_at = lines.where("trim(value) <> '' AND NOT startswith(trim(value), '%')").agg(F.min("line")).first()[0]
    top = [r["value"] for r in lines.where(F.col("line") <= F.lit(size_at)).orderBy("line").collect()]
    meta, at = parse_header(top)
    starts: list[int] = []
    if meta.object == "D":
        starts = [int(r["value"]) for r in lines.where((F.col("line") >= at) & (F.col("line") <= at + meta.nprocs)).orderBy("line").collect()]
        starts = [s - 1 for s in starts] if meta.extended else starts
        if starts[0] != 0 or starts[-1] != meta.nnz:
            raise ValueError("part boundaries do not span the entries")
        at += meta.nprocs + 1
    token = F.split(F.trim("value"), r"\s+")
    value = {"P": [], "I": ["re"], "R": ["re"], "C": ["re", "im"]}[meta.field]
    body = lines.where((F.col("line") >= at) & (F.col("line") < at + meta.nnz)).withColumn("x", token)
    nz = body.select(
        (F.col("line") - at).alias("t"), (F.get("x", F.lit(0)).try_cast("long") - 1).alias("i"), (F.get("x", F.lit(1)).try_cast("long") - 1).alias("j"), *[F.get("x", F.lit(2 + k)).try_cast("double").alias(c) for k, c in enumerate(value)]
    )
    wrong = (F.col("i") < 0) | (F.col("i") >= meta.m) | (F.col("j") < 0) | (F.col("j") >= meta.n)
    wrong |= {"G": F.lit(False), "K": F.col("i") <= F.col("j")}.get(meta.symmetry, F.col("i") < F.col("j"))
    count, bad = nz.agg(F.count("*"), F.count_if(F.coalesce(wrong, F.lit(True)) | reduce(or_, [F.col(c).isNull() for c in ("i", "j", *value)]))).first()
    if count != meta.nnz or bad:
        raise ValueError(f"{meta.nnz} entries declared, {count} found, {bad} out of bounds")
    if starts:
        parts = spark.createDataFrame([(q, starts[q], starts[q + 1]) for q in range(meta.nprocs)], "part int, lo long, hi long")
        nz = nz.join(F.broadcast(parts), (F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi"))).drop("lo", "hi")  # a row per part
    at += meta.nnz
    weights = []
    for has, size in ((meta.row_weights, meta.m), (meta.col_weights, meta.n)):
        weights.append(lines.where((F.col("line") >= at) & (F.col("line") < at + size)).select((F.col("line") - at).alias("idx"), F.trim("value").try_cast("long").alias("w")) if has else None)
        at += size * has
    tail = "\n".join(r["value"] for r in lines.where(F.col("line") >= at).where("trim(value) LIKE '\\%%'").orderBy("line").collect())
    return Matrix(replace(meta, tail=tail), nz, *weights)


def entry_lines(nz: DataFrame, meta: MatrixMeta, compat: bool = False) -> DataFrame:
    """``line`` per entry, 1-based; real values in full, or to 6 significant digits with ``compat``; integers rounded away from 0."""
    if meta.field == "I":
        value = [F.round("re").cast("long").cast("string")]
    else:
        value = [F.format_string("%.6g", c) if compat else F.col(c).cast("string") for c in {"P": [], "R": ["re"], "C": ["re", "im"]}[meta.field]]
    return nz.withColumn("line", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *value))


def write(matrix: Matrix, path: str, *, compat: bool = False) -> None:
    """One ordered text file (in a folder of Spark's making) that :func:`read` takes back."""
    spark, meta = matrix.nz.sparkSession, matrix.meta
    head = [banner(meta), *([meta.header] if meta.header else [])]
    size = [meta.m, meta.n, meta.nnz, *([meta.nprocs] if meta.object == "D" else []), *([meta.row_weights + 2 * meta.col_weights] if meta.object == "W" else [])]
    head.append(" ".join(map(str, size)))
    if meta.object == "D":
        have = {r["part"]: r["n"] for r in matrix.nz.groupBy("part").agg(F.count("*").alias("n")).collect()}
        at = int(meta.extended)
        head.append(str(at))
        for q in range(meta.nprocs):
            at += have.get(q, 0)
            head.append(str(at))
    rows = [spark.createDataFrame([(0, k, k, x) for k, x in enumerate(head)], "s int, a long, b long, line string")]
    order = F.col("part").cast("long") if meta.object == "D" else F.lit(0).cast("long")
    rows.append(entry_lines(matrix.nz, meta, compat).select(F.lit(1).alias("s"), order.alias("a"), F.col("t").cast("long").alias("b"), "line"))
    for k, w in ((2, matrix.row_weight), (3, matrix.col_weight)):
        if w is not None:
            rows.append(w.select(F.lit(k).alias("s"), F.col("idx").alias("a"), F.lit(0).cast("long").alias("b"), F.col("w").cast("string").alias("line")))
    if meta.tail:
        rows.append(spark.createDataFrame([(4, 0, 0, meta.tail)], "s int, a long, b long, line string"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    out.orderBy("s", "a", "b").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_vector(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """(length, parts, ``owner(idx, part)``) of a vector distribution; comment lines begin with %."""
    rows = numbered(spark, path).where("trim(value) <> '' AND trim(value) NOT LIKE '\\%%'")
    x = F.split(F.trim("value"), r"\s+")
    first = rows.orderBy("line").limit(1).collect()[0]
    length, parts = (int(v) for v in first["value"].split()[:2])
    owner = rows.where(F.col("line") > first["line"]).select((F.get(x, F.lit(0)).try_cast("long") - 1).alias("idx"), (F.get(x, F.lit(1)).try_cast("int") - 1).alias("part"))
    wrong = (F.col("idx") < 0) | (F.col("idx") >= length) | (F.col("part") < 0) | (F.col("part") >= parts)
    if owner.agg(F.count_if(F.coalesce(wrong, F.lit(True)))).first()[0]:
        raise ValueError("index or part out of range")
    return length, parts, owner


def vector_lines(owner: DataFrame, length: int, p: int) -> DataFrame:
    """``pos, line`` of a vector distribution file; unowned components have part 0."""
    head = owner.sparkSession.createDataFrame([(-1, f"{length} {p}")], "pos long, line string")
    return head.union(owner.select(F.col("idx").alias("pos"), F.concat_ws(" ", F.col("idx") + 1, F.coalesce(F.col("part") + 1, F.lit(0)))))


def svg(nz: DataFrame, m: int, n: int, colours: tuple[str, ...] = ("red", "blue", "green", "orange", "purple", "teal", "brown", "gray", "olive", "navy", "pink", "gold")) -> DataFrame:
    """``line``: rectangles of 10 pixels an entry, coloured by part; at most as many parts as colours."""
    if nz.agg(F.max("part")).first()[0] >= len(colours):
        raise ValueError("too many parts for a drawing")
    colour = F.element_at(F.array(*map(F.lit, colours)), F.col("part") + 1)
    return nz.select(F.format_string('<rect x="%d" y="%d" width="10" height="10" fill="%s"/>', F.col("j") * 10, F.col("i") * 10, colour).alias("line"))


def raster(nz: DataFrame, m: int, n: int, side: int = 512) -> DataFrame:
    """``y, x, part``: a picture of ``side`` pixels, each with its most frequent part (ties: the smallest)."""
    px = nz.select(F.floor(F.col("i") * side / m).alias("y"), F.floor(F.col("j") * side / n).alias("x"), "part")
    return px.groupBy("y", "x", "part").agg(F.count("*").alias("k")).groupBy("y", "x").agg(F.max_by("part", F.struct("k", -F.col("part"))).alias("part"))
