"""Matrix-Market text as a data source: ``spark.read.format("mtx")`` and ``df.write.format("mtx")``.

A matrix is one file, or a folder whose files, taken in order of name, are one text. It is read by byte ranges in parallel; a line belongs
to the range that it begins in. Line numbers need the number of lines of the ranges before, so ranges are counted first: by
Spark in :func:`load`, or, for texts up to ``PLAN_BYTES``, when a plain ``spark.read`` plans its partitions.

Tasks write parts under names of their own attempt; the commit writes the head (banner, sizes, part boundaries from the tasks' counts)
and a list of the parts that count, an abort removes them. Head, parts and tail have names in the text's order, so the files in
that order are one Matrix-Market file, and nothing is gathered in one task.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .matrix_market import Matrix, MatrixMeta, banner, parse_header

RANGE_BYTES, PLAN_BYTES, CHUNK = 32 << 20, 256 << 20, 4 << 20
LIST = "_parts.json"
VALUES = {"P": [], "I": ["re"], "R": ["re"], "C": ["re", "im"]}


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def texts(uri: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a text in order. Of a written folder only what its commit lists counts."""
    from pyarrow import fs

    system, path = opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = {f.base_name: f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File}
    if LIST in found:
        with system.open_input_stream(f"{path}/{LIST}") as f:
            names = json.loads(f.read())
    else:
        names = sorted(n for n in found if n[0] not in "_.")
    if not names:
        raise FileNotFoundError(f"{uri} has no files")
    return [(found[n].path, found[n].size) for n in names]


def head_of(uri: str) -> tuple[MatrixMeta, int, list[int]]:
    """What the text says before its entries: the meta, the number of its lines above the entries, the part boundaries."""
    system, _ = opened(uri)
    lines, rest, need = [], b"", None
    for path, _ in texts(uri):
        with system.open_input_stream(path) as f:
            while data := f.read(CHUNK):
                *whole, rest = (rest + data).split(b"\n")
                lines += [x.decode() for x in whole]
                if need is None and any(x.strip() and not x.strip().startswith("%") for x in lines):
                    meta, at = parse_header(lines)
                    need = at + (meta.nprocs + 1 if meta.object == "D" else 0)
                if need is not None and len(lines) >= need:
                    starts = [int(x) - meta.extended for x in lines[at:need]]
                    if starts and (starts[0] or starts[-1] != meta.nnz):
                        raise ValueError("part boundaries do not span the entries")
                    return meta, need, starts
    raise ValueError("no size line")


@dataclass
class Range(InputPartition):
    number: int
    path: str
    low: int
    high: int
    size: int
    start: int = 0


def ranges(uri: str, size: int) -> list[Range]:
    out: list[Range] = []
    for path, total in texts(uri):
        out += [Range(len(out) + k, path, at, min(at + size, total), total) for k, at in enumerate(range(0, total, size))]
    return out


def lines_of(system, part: Range) -> Iterator[list[bytes]]:
    """The lines that begin in a range, some at a time."""
    with system.open_input_file(part.path) as f:
        at, rest, skip = max(part.low - 1, 0), b"", part.low > 0
        f.seek(at)
        while at < part.size:
            data = f.read(min(CHUNK, part.size - at))
            inside = max(0, part.high - 1 - at)  # a line begins in the range if the end of the one before lies in [low - 1, high - 1)
            at += len(data)
            if at >= part.high and (end := data.find(b"\n", inside)) >= 0:
                data, at = data[: end + 1], part.size
            *whole, rest = (rest + data).split(b"\n")
            if skip and whole:
                whole, skip = whole[1:], False
            if whole:
                yield whole
        if rest and not skip:
            yield [rest]


def count_lines(system, part: Range) -> int:
    """How many lines begin in a range."""
    n, at, end = int(part.low == 0), max(part.low - 1, 0), part.high - 1
    with system.open_input_file(part.path) as f:
        f.seek(at)
        while at < end:
            data = f.read(min(CHUNK, end - at))
            n, at = n + data.count(b"\n"), at + len(data)
    return n


class MtxReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.section = options["path"], options.get("section", "entries")
        self.range_bytes, self.counts = int(options.get("rangebytes", RANGE_BYTES)), options.get("counts")
        self.meta, self.above, self.starts = head_of(self.uri)

    def partitions(self) -> list[Range]:
        found = ranges(self.uri, self.range_bytes)
        if self.section == "counts":
            return found
        if self.counts is None:
            if sum(r.high - r.low for r in found) > PLAN_BYTES:
                raise ValueError("a text of this size is read by load(), whose tasks count its lines")
            system, _ = opened(self.uri)
            counts = [count_lines(system, r) for r in found]
        else:
            counts = json.loads(self.counts)
        at = 0
        for r, n in zip(found, counts, strict=True):
            r.start, at = at, at + n
        low, high = self._span()
        return [r for r, n in zip(found, counts, strict=True) if r.start < high and r.start + n > low] or found[:1]

    def _span(self) -> tuple[int, int]:
        """The lines of the section."""
        m = self.meta
        after = self.above + m.nnz
        weights = after + m.m * m.row_weights
        ends = {"entries": (self.above, after), "row_weights": (after, weights), "col_weights": (weights, weights + m.n * m.col_weights), "tail": (weights + m.n * m.col_weights, 1 << 62)}
        return ends[self.section]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.uri)
        if self.section == "counts":
            yield pa.RecordBatch.from_arrays([pa.array([partition.number], pa.int64()), pa.array([count_lines(system, partition)], pa.int64())], names=["number", "n"])
            return
        low, high = self._span()
        at = partition.start
        for lines in lines_of(system, partition):
            first, last = max(low - at, 0), min(high - at, len(lines))
            if first < last:
                yield self._batch(lines[first:last], at + first - low)
            at += len(lines)
            if at >= high:
                return

    def _batch(self, lines: list[bytes], place: int) -> pa.RecordBatch:
        if self.section == "tail":
            return pa.RecordBatch.from_arrays([pa.array(range(place, place + len(lines)), pa.int64()), pa.array([x.decode() for x in lines], pa.string())], names=["idx", "line"])
        columns = VALUES[self.meta.field] if self.section == "entries" else []
        width = 2 + len(columns) if self.section == "entries" else 1
        tokens = b" ".join(lines).split()
        if len(tokens) != width * len(lines) or any(len(x.split()) != width for x in lines):
            bad = next(k for k, x in enumerate(lines) if len(x.split()) != width)
            raise ValueError(f"entry {place + bad} is not {width} numbers: {lines[bad][:80]!r}")
        number = lambda k, kind: np.array(tokens[k::width], "S").astype(kind)
        t = np.arange(place, place + len(lines))
        if self.section != "entries":
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(number(0, np.int64))], names=["idx", "w"])
        i, j, m = number(0, np.int64) - 1, number(1, np.int64) - 1, self.meta
        wrong = (i < 0) | (i >= m.m) | (j < 0) | (j >= m.n) | {"G": np.zeros(len(i), bool), "K": i <= j}.get(m.symmetry, i < j)
        if wrong.any():
            raise ValueError(f"entry {place + int(wrong.argmax())} is out of bounds: {lines[int(wrong.argmax())][:80]!r}")
        found = {"t": t, "i": i, "j": j} | {c: number(2 + k, np.float64) for k, c in enumerate(columns)}
        if self.starts:
            found["part"] = (np.searchsorted(self.starts, t, side="right") - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], names=list(found))


@dataclass
class Written(WriterCommitMessage):
    task: int
    name: str
    n: int
    parts: dict


class MtxWriter(DataSourceArrowWriter):
    """Writes entries ``i, j[, re[, im]][, part]``, 0-based, in the order of partitions and rows. Options: ``m``, ``n`` and the other fields of a MatrixMeta, and ``compat`` for 6 significant digits."""

    def __init__(self, options, schema, overwrite: bool):
        self.uri, self.overwrite, self.compat = options["path"], overwrite, options.get("compat") == "yes"
        kinds = {"m": int, "n": int, "nprocs": int, "extended": lambda v: v == "true"}
        known = {k: kinds.get(k, str)(v) for k, v in options.items() if k in MatrixMeta.__dataclass_fields__}
        if not {"m", "n"} <= set(known):
            raise ValueError("writing needs the sizes m and n")
        self.meta = MatrixMeta(**known)
        need = {"i", "j", *VALUES[self.meta.field], *(["part"] if self.meta.object == "D" else [])}
        if missing := need - set(schema.names):
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        name, n, parts = f"part-{task:06d}-{uuid.uuid4().hex}.mtx", 0, {}
        system, path = opened(self.uri)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}") as f:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                f.write(self._text(batch))
                n += batch.num_rows
                if self.meta.object == "D":
                    for x in pc.value_counts(batch.column("part")).to_pylist():
                        parts[x["values"]] = parts.get(x["values"], 0) + x["counts"]
        return Written(task, name, n, parts)

    def _text(self, batch: pa.RecordBatch) -> bytes:
        line = [pc.cast(pc.add(batch.column(c).cast(pa.int64()), 1), pa.string()) for c in "ij"]
        for c in VALUES[self.meta.field]:
            value = batch.column(c)
            if self.meta.field == "I":
                line.append(pc.cast(pc.cast(pc.round(value.cast(pa.float64()), round_mode="half_towards_infinity"), pa.int64()), pa.string()))
            elif self.compat:
                line.append(pa.array(["%.6g" % v for v in value.to_pylist()]))
            else:
                line.append(pa.array(list(map(repr, value.cast(pa.float64()).to_pylist()))))
        return ("\n".join(pc.binary_join_element_wise(*line, " ").to_pylist()) + "\n").encode()

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.task)
        system, path = opened(self.uri)
        system.create_dir(path, recursive=True)
        meta = replace(self.meta, nnz=sum(m.n for m in done))
        size = [meta.m, meta.n, meta.nnz, *([meta.nprocs] if meta.object == "D" else [])]
        head = [banner(meta), *([meta.header] if meta.header else []), " ".join(map(str, size))]
        if meta.object == "D":
            order = [q for m in done for q in sorted(m.parts)]
            if order != sorted(order) or any(len(m.parts) > 1 for m in done) and order != sorted(set(order)) and not self._nested(done):
                raise ValueError("entries of a distributed matrix are written in order of part")
            at = int(meta.extended)
            head.append(str(at))
            for q in range(meta.nprocs):
                at += sum(m.parts.get(q, 0) for m in done)
                head.append(str(at))
        names = [f"head-{uuid.uuid4().hex}.mtx", *(m.name for m in done), *(["tail.mtx"] if meta.tail else [])]
        for name, text in ((names[0], "\n".join(head)), *([("tail.mtx", meta.tail)] if meta.tail else [])):
            with system.open_output_stream(f"{path}/{name}") as f:
                f.write(f"{text}\n".encode())
        with system.open_output_stream(f"{path}/{LIST}") as f:
            f.write(json.dumps(names).encode())
        self._remove(keep={*names, LIST})

    def _nested(self, done: list[Written]) -> bool:
        """Whether each task's parts follow those of the task before."""
        spans = [(min(m.parts), max(m.parts)) for m in done]
        return all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))

    def _remove(self, keep: set[str]) -> None:
        from pyarrow import fs

        system, path = opened(self.uri)
        for f in system.get_file_info(fs.FileSelector(path)):
            if f.type == fs.FileType.File and f.base_name not in keep and re.fullmatch(r"(head|part)-.*\.mtx|tail\.mtx", f.base_name):
                system.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.uri)
        for m in messages:
            if m is not None:
                system.delete_file(f"{path}/{m.name}")


class MtxSource(DataSource):
    """``format("mtx")``: entries ``t, i, j[, re[, im]][, part]``, 0-based, or another ``section`` (row_weights, col_weights, tail, counts)."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        section = self.options.get("section", "entries")
        if section != "entries":
            return {"counts": "number long, n long", "tail": "idx long, line string"}.get(section, "idx long, w long")
        meta, _, starts = head_of(self.options["path"])
        return ", ".join(["t long", "i long", "j long", *(f"{c} double" for c in VALUES[meta.field]), *(["part int"] if starts else [])])

    def reader(self, schema: StructType) -> MtxReader:
        return MtxReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MtxWriter:
        return MtxWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MtxSource)


def located(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark resolves it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def load(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> Matrix:
    """A matrix with its weights, of any size: one job counts the lines of each range, the others read what they need."""
    register(spark)
    path = located(spark, path)
    part = spark.read.format("mtx").option("rangebytes", str(range_bytes))
    rows = part.option("section", "counts").load(path).collect()  # a row per range
    part = part.option("counts", json.dumps([r["n"] for r in sorted(rows, key=lambda r: r["number"])]))
    meta, _, _ = head_of(path)
    weights = [part.option("section", name).load(path) if has else None for name, has in (("row_weights", meta.row_weights), ("col_weights", meta.col_weights))]
    tail = part.option("section", "tail").load(path).where("ltrim(line) LIKE '\\%%'").orderBy("idx").collect()
    return Matrix(replace(meta, tail="\n".join(r["line"] for r in tail)), part.option("section", "entries").load(path), *weights)


def save(nz: DataFrame, path: str, meta: MatrixMeta, *, compat: bool = False) -> None:
    """Writes ``nz(t, i, j, ...)`` in order of part and ``t``, by ranges: as many files as ranges, none gathered in one task."""
    spark = nz.sparkSession
    register(spark)
    order = ["part", "t"] if meta.object == "D" else ["t"]
    rows = nz.repartitionByRange(*order).sortWithinPartitions(*order).select("i", "j", *VALUES[meta.field], *(["part"] if meta.object == "D" else []))
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in asdict(meta).items() if k not in ("nnz", "row_weights", "col_weights")}
    rows.write.format("mtx").options(**options, compat="yes" if compat else "no").mode("overwrite").save(located(spark, path))
