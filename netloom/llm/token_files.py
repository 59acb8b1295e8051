"""Token ids in binary files of patched frame-of-reference blocks, written and read back by Spark tasks.

A file holds the ids of a run of documents in ascending order of doc_id, as blocks of ``BLOCK`` ids (the last is shorter):

    header     magic, version, ids a block
    blocks     minimum (u32), width (u8), number of exceptions (u16); each id less the minimum in ``width`` bits, 0 for an
               exception; places of the exceptions in the block (u16); their values less the minimum (u32)
    index      byte offset of every block and of the end (u64), so any id is found with one seek
    documents  doc_id (i64), whether it is not null (u8), start within the file (u64), and the end of the last
    footer     offsets of index and documents, numbers of blocks, documents and ids, magic

All numbers are little-endian. A block's width is that of one of ``PERCENTILES`` of its values: the one whose block is shortest.

Tasks write below a folder that all executors share, under names of their own attempt; the manifest, a Parquet table written
by Spark's own commit, lists those that count, so a repeated or lost task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, map_rows
from .packing import _byte_letters

MAGIC, VERSION, BLOCK, TOKENIZER, END_ID = b"NLTF", 1, 4096, "byte_bpe_50k.json", 0
HEAD, BLOCK_HEAD, FOOT = "<4sII", "<IBH", "<QQQQQ4s"
#: Shares of a block's values that may set its width; the rest are exceptions.
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 1.0)
#: Widths whose bits are numbers of numpy's.
WHOLE_BYTES = {8: "u1", 16: "<u2", 32: "<u4"}
#: Blocks packed at once, ids of a run of documents that one reading task takes at least, bytes of text encoded at once.
AT_ONCE, SECTION_IDS, CHUNK_BYTES = 16, 1 << 20, 8 << 20
#: Words whose ids a worker remembers, and the longest that it does.
MEMO_WORDS, LONG_WORD = 600_000, 48
#: Marks that may end a word: letters and such marks are two pre-tokens.
CLOSING = string.punctuation.replace("'", "")


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value below 2 ** 32."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a matrix of 32-bit ids, one a row."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = ids.shape[1]
    low = ids.min(axis=1)
    rest = ids - low[:, None]
    at = sorted({max(0, int(np.ceil(p * n)) - 1) for p in PERCENTILES})
    choices = widths(np.partition(rest, at, axis=1)[:, at])
    sizes = np.stack([n * w + 48 * (rest >= (np.uint64(1) << w.astype(np.uint64))[:, None]).sum(axis=1) for w in choices.T], axis=1)
    chosen = choices[np.arange(len(ids)), sizes.argmin(axis=1)]
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == width)
        values = rest[rows]
        over = values >> np.uint32(width) != 0 if width < 32 else np.zeros(values.shape, bool)
        low_bits = np.where(over, 0, values)
        if width in WHOLE_BYTES:
            packed = low_bits.astype(WHOLE_BYTES[width])
        else:
            bits = np.unpackbits(low_bits.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little") if width else np.empty(0, np.uint8)
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for k, row in enumerate(rows.tolist()):
            places = np.flatnonzero(over[k])
            out[row] = struct.pack(BLOCK_HEAD, low[row], width, len(places)) + packed[k].tobytes() + places.astype("<u2").tobytes() + values[k, places].astype("<u4").tobytes()
    return out


def unpack_block(data: memoryview, n: int) -> np.ndarray:
    """The ``n`` ids of one block."""
    low, width, over = struct.unpack_from(BLOCK_HEAD, data)
    at, size = struct.calcsize(BLOCK_HEAD), (n * width + 7) // 8
    out = np.zeros((n, 4), np.uint8)
    if width in WHOLE_BYTES:
        out = np.frombuffer(data, WHOLE_BYTES[width], n, at).astype("<u4")
    elif width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        whole = np.zeros((n, 8 * -(-width // 8)), np.uint8)
        whole[:, :width] = bits
        out[:, : whole.shape[1] // 8] = np.packbits(whole, axis=1, bitorder="little")
    ids = out.view("<u4").reshape(n)
    if over:
        ids[np.frombuffer(data, "<u2", over, at + size)] = np.frombuffer(data, "<u4", over, at + size + 2 * over)
    return ids + np.uint32(low)


class Writer:
    """Writes one file, block by block; holds a few blocks and the table of documents."""

    def __init__(self, sink, block: int = BLOCK):
        self.sink, self.block, self.at, self.waiting, self.n_waiting = sink, block, 0, [], 0
        self.index, self.ids, self.valid, self.starts, self.n = array("Q"), array("q"), bytearray(), array("Q"), 0
        self._put(struct.pack(HEAD, MAGIC, VERSION, block))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        whole = len(ids) // self.block * self.block
        for k in range(0, whole, AT_ONCE * self.block):
            self._some(ids[k : min(whole, k + AT_ONCE * self.block)].reshape(-1, self.block))
        if last and len(ids) > whole:
            self._some(ids[whole:].reshape(1, -1))
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _some(self, rows: np.ndarray) -> None:
        blocks = pack_blocks(rows)
        for b in blocks:
            self.index.append(self.at)
            self.at += len(b)
        self.sink.write(b"".join(blocks))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.starts.append(self.n)
        self.n += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= AT_ONCE * self.block:
            self._blocks(False)

    def close(self) -> None:
        self._blocks(True)
        self.index.append(self.at)
        self.starts.append(self.n)
        index = self.at
        self._put(np.asarray(self.index, "<u8").tobytes())
        documents = self.at
        self._put(np.asarray(self.ids, "<i8").tobytes() + bytes(self.valid) + np.asarray(self.starts, "<u8").tobytes())
        self._put(struct.pack(FOOT, index, documents, len(self.index) - 1, len(self.ids), self.n, MAGIC))


class Reader:
    """Random access to one file's ids and documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, version, self.block = struct.unpack(HEAD, source.read_at(struct.calcsize(HEAD), 0))
        self.index_at, self.documents_at, self.n_blocks, self.n_docs, self.n, tail = struct.unpack(FOOT, source.read_at(struct.calcsize(FOOT), size - struct.calcsize(FOOT)))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError("not a whole file of token ids")

    def _array(self, kind: str, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at(n * np.dtype(kind).itemsize, at), kind)

    def documents(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, which of them are not null, and the ``n + 1`` starts of documents from number ``first``."""
        at = self.documents_at
        return self._array("<i8", n, at + 8 * first), self._array("u1", n, at + 8 * self.n_docs + first), self._array("<u8", n + 1, at + 9 * self.n_docs + 8 * first)

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids at places ``start`` to ``end`` of the file."""
        first, last = start // self.block, -(-end // self.block)
        if start >= end:
            return np.empty(0, "<u4")
        offsets = self._array("<u8", last - first + 1, self.index_at + 8 * first).tolist()
        data = memoryview(self.source.read_at(offsets[-1] - offsets[0], offsets[0]))
        ids = [unpack_block(data[a - offsets[0] : b - offsets[0]], min(self.block, self.n - (first + k) * self.block)) for k, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False))]
        return np.concatenate(ids)[start - first * self.block : end - first * self.block]


#: What is white space beside the blank; a word that is empty or has some within isn't in the usual case.
SPACE = "\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNEVEN = f"(?s)^[\r\n]?$|^[{SPACE.replace(chr(10), '').replace(chr(13), '')}]|.[{SPACE}]"


class Words(dict):
    """word -> ids of ``lead + word``, filled on demand; emptied when it is full, and long words aren't kept."""

    def __init__(self, lead: str, whole: Callable[[str], bytes], pre_token: Callable[[str], bytes], marks: dict):
        super().__init__()
        self.lead, self.whole, self.pre_token, self.marks = lead, whole, pre_token, marks
        self.plain = re.compile("[!-~¡-¬®-įı-ɏ]+").fullmatch

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG_WORD:
            return self.whole(self.lead + word)
        stem = word.rstrip(CLOSING)
        if not (stem.isalpha() and (stem.isascii() or self.plain(stem))):
            ids = self.whole(self.lead + word)
        elif len(stem) < len(word):  # letters, then marks: two pre-tokens
            ids = self[stem] + self.marks[word[len(stem) :]]
        else:
            ids = self.pre_token(self.lead + word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Texts -> their ids, many texts at once.

    The tokenizer's pre-tokens never run over a white space between other characters except at their start: of a run of
    white space the last character, if it is a blank, leads the next word, and what precedes it is a pre-token. So the ids of
    a text are those of its words and runs. Where each white space is a blank or line end between two words, the usual case, Arrow
    splits a batch of texts and finds its distinct words, and numpy lays their ids out. A text with a special token, or with a character that
    libraries don't agree to be white space, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else ("<u4", "I")
        self.doubtful = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u180e", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.odd = ["\r", *self.doubtful]
        self.runs, self.letters, self.model = re.compile(r"\s+|\S+").findall, _byte_letters(), self.tokenizer.model
        marks = Memo(self.pre_token, MEMO_WORDS // 4)
        self.inner, self.first = (Words(lead, self.whole, self.pre_token, marks) for lead in (" ", ""))
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def pre_token(self, piece: str) -> bytes:
        piece = piece.replace(" ", self.letters[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return struct.pack(f"<{len(found := self.model.tokenize(piece))}{self.code}", *[t.id for t in found])

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit numbers."""
        out: list = [None] * len(texts)
        rows = [k for k, text in enumerate(texts) if text and not any(x in text for x in self.odd)]
        if rows:
            words = pc.split_pattern(pa.array(["\r" + texts[k].replace("\n", " \n") for k in rows], pa.large_string()), " ")
            coded = words.flatten().dictionary_encode()
            uneven = pc.match_substring_regex(coded.dictionary, UNEVEN).to_numpy(zero_copy_only=False)
            each = [b"" if odd else self._of(key) for key, odd in zip(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), uneven.tolist(), strict=True)]
            ids, sizes = np.frombuffer(b"".join(each), self.kind), np.fromiter(map(len, each), np.int64, len(each)) // int(self.kind[-1])
            index = coded.indices.to_numpy()
            n, offsets = sizes[index], words.offsets.to_numpy()
            ends = np.cumsum(n)
            ids = ids[np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - n), n) + np.arange(ends[-1])].astype("<u4")
            at, odd = (np.concatenate([[0], x])[offsets] for x in (ends, np.cumsum(uneven[index])))
            at, odd = at.tolist(), np.diff(odd).tolist()
            for k, row in enumerate(rows):
                if not odd[k]:
                    out[row] = ids[at[k] : at[k + 1]]
        return [np.frombuffer(self._uneven(text), self.kind).astype("<u4") if found is None else found for found, text in zip(out, texts, strict=True)]

    def _of(self, key: str) -> bytes:
        """A word after a blank; with \\r before it one that begins a text, with \\n one that begins a line."""
        return self.first[key[1:]] if key[0] == "\r" else self.newline + self.first[key[1:]] if key[0] == "\n" else self.inner[key]

    def _uneven(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.doubtful):
            return self.whole(text)
        out, blank, pieces = [], False, self.runs(text)
        for k, piece in enumerate(pieces):
            if not piece.isspace():
                out.append(self.inner[piece] if blank else self.first[piece])
                continue
            blank = piece[-1] == " " and k + 1 < len(pieces)
            if k + 1 == len(pieces):
                out.append(self.first[piece])
            elif len(piece) > 1:
                out.append(self.first[piece[:-1]])
            if k + 1 < len(pieces) and not blank:
                out.append(self.first[piece[-1]])
        return b"".join(out)


def _opened(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as Spark resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts, so many at once that their texts have about ``CHUNK_BYTES``."""
    for batch in batches:
        at = 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES)))
            some = batch.slice(at, end - at)
            yield some.column(0).to_pylist(), some.column(1).to_pylist()
            at = end


def write_ids(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, block: int = BLOCK) -> None:
    """Encodes every whole text, appends ``end_id`` and writes all ids below the new ``folder`` in ascending order of id.

    Ids of documents are integers. A null text is empty (the end id alone), a null id comes first, rows of one id come in an
    order that their texts fix, repeated rows are written each; long texts are one document like others; other columns are
    ignored, so their names can't clash. An empty table gives a manifest without rows. Texts, not ids, are shuffled, by ranges of (id, hash of
    the text, number of the row), so that no id has to fit into one file.
    """
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if not 1 <= block <= 1 << 16:
        raise ValueError("a block has 1 to 65536 ids")
    files = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, part, name, writer, sections = Encoder(path), np.array([end_id], "<u4"), TaskContext.get().partitionId(), "", None, []
        for ids, texts in in_chunks(batches):
            if writer is None:
                name = f"{part:06d}-{uuid.uuid4().hex}.ids"
                system, place = _opened(files)
                system.create_dir(place, recursive=True)
                sink = system.open_output_stream(f"{place}/{name}")
                writer = Writer(sink, block)
            for doc_id, found in zip(ids, encode(texts), strict=True):
                if not sections or sections[-1][-1] >= SECTION_IDS:
                    sections.append([part, name, len(writer.ids), 0, writer.n, 0])
                writer.add(doc_id, np.concatenate([found, end]))
                sections[-1][3] += 1
                sections[-1][5] += len(found) + 1
        if writer is not None:
            writer.close()
            sink.close()
            columns = list(zip(*sections, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["file", "name", "first", "n_docs", "start", "n_ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("row"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    sorted_rows.mapInArrow(run, "file long, name string, first long, n_docs long, start long, n_ids long").write.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a folder: ``doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, binary)``."""
    files, sections = qualified(spark, folder), spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = sections.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    todo = sections.drop("start", "n_ids").join(bases, "file")
    n = sections.count()

    def make():
        opened = {}

        def rows(row):
            if row["name"] not in opened:
                system, place = _opened(files)
                opened.clear()
                opened[row["name"]] = Reader(system.open_input_file(f"{place}/{row['name']}"))
            reader = opened[row["name"]]
            ids, valid, starts = reader.documents(row["first"], row["n_docs"])
            low = int(starts[0])
            data = reader.read(low, int(starts[-1])).tobytes()
            ids, valid, starts = ids.tolist(), valid.tolist(), starts.tolist()
            for k in range(len(ids)):
                a, b = starts[k], starts[k + 1]
                yield ids[k] if valid[k] else None, row["base"] + a, b - a, data[4 * (a - low) : 4 * (b - low)]

        return rows

    return map_rows(todo.repartition(max(1, min(n, 10_000))), make, "doc_id long, start long, n_tokens long, ids binary")
