"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two, largest first, at most ``max_len``. A piece is a
sequence of its own, so no sequence crosses documents and none is padded; sequences of one length form a bucket, which a
writer can lay out with ``partitionBy("bucket")`` and a trainer can batch without padding. One map over the documents,
no shuffle: sequence ids are made of the bucket, the input partition and a counter within it.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_rows

MAX_LEN, END_ID, TOKENIZER = 4096, 2, "word_bpe_49k.json"
#: Chunks of text whose ids a worker remembers, at least (twice that at most).
MEMO_CHUNKS = 500_000

#: The pre-tokeniser's pattern of word_bpe_49k.json.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def chunk_encoder(path: str):
    """chunk of bytes without ASCII white space -> its ids as little-endian unsigned 32-bit bytes.

    White space always ends a pre-token, so a text's ids are its chunks' ids in a row. Chunks of plain Latin text go
    straight to the merge model; all others (other scripts, combining marks, special tokens) through the whole tokenizer.
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, pieces = tokenizer.model, regex.compile(PRE_TOKENS).findall
    plain = re.compile("[!-~¡-¬®-įı-ɏ]+").fullmatch
    letters = _byte_letters()

    closing = ".,;:!?#*$%&"

    def ids_of(piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(letters)
        return struct.pack(f"<{len(tokens := model.tokenize(piece))}I", *[t.id for t in tokens])

    memo = Memo(ids_of, MEMO_CHUNKS // 4)

    def make(chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "surrogatepass")
        if "<|" in text or not plain(text):
            return b"".join([i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids])
        text = text.lower()
        if text.isalpha():
            return memo[text]
        word = text.rstrip(closing)
        if word.isalpha():  # letters, then marks: two pre-tokens
            return memo[word] + memo[text[len(word) :]]
        return b"".join([memo[p] for p in pieces(text)])

    return make


def pieces_of(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole sequences first, then the binary digits of the rest."""
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if n % max_len >> b & 1]


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset, bucket``.

    Null and empty texts have the end id alone; repeated rows are packed each; a null id stays null; other columns are
    ignored, so their names can't clash. ``max_len`` must be a power of two. An empty table gives no rows.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)

    def make():
        memo, end = Memo(chunk_encoder(path), MEMO_CHUNKS), end_id.to_bytes(4, "little")

        def rows(row):
            text = row["text"]
            chunks = text.encode("utf-8", "surrogatepass").split() if text else ()
            data = b"".join([memo[c] for c in chunks]) + end
            start, total = 0, len(data) // 4
            for n in pieces_of(total, max_len):
                yield row["doc_id"], start, n, data[4 * start : 4 * (start + n)], total
                start += n

        return rows

    kind = dict(docs.dtypes)[id_col]
    rows = map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    # monotonically_increasing_id() is the partition in the bits from 33 and a counter below; the length's power goes on top.
    number = F.monotonically_increasing_id() + F.shiftleft(F.round(F.log2("length")).cast("long"), 57)
    return rows.select("*", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"))
