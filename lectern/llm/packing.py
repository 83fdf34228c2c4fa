"""Packing by power-of-two decomposition.

A document of n tokens (its ids and the end id) is cut into pieces whose lengths are powers of two: as many of the largest
length as fit, then the binary digits of the rest. Every piece is a sequence of its own, so no sequence crosses documents,
none needs padding, and equal lengths form a bucket that batches without waste. Nothing is shuffled: pieces are numbered by
partition and row of the scan, so the numbers hold for one result: write it, or they may differ where its input is dealt anew.

Ids are those of the tokenizers library with its default settings: the string of an added token in a text is that token.

Defined results: a null text counts as empty, so that its document is the end id alone. Rows that repeat are packed each. A text of
any length is one row of a task; its pieces go on in batches of bounded size. An empty table gives no pieces. Columns other than
the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship

LENGTH, END_ID = 2048, 1
#: Bytes of ids, and pieces, after which a batch of pieces goes on.
BATCH_BYTES, BATCH_PIECES = 4_000_000, 20_000


def cuts(n: int, length: int = LENGTH) -> list[int]:
    """The lengths of the pieces of n tokens: the largest power of two up to length, repeated, then the binary digits of the rest."""
    top = 1 << (length.bit_length() - 1)
    rest = n % top
    return [top] * (n // top) + [1 << b for b in range(top.bit_length() - 2, -1, -1) if rest >> b & 1]


class ByteBpe:
    """The ids of a byte-level BPE file of the tokenizers library.

    The same vocabulary is read by tiktoken where its ranks lie beside the file, as that is several times faster; the ids
    are the same (a test compares them with the named library).
    """

    def __init__(self, path: str):
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
            self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
            self.encode = lambda text: self.bpe.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            self.encode = lambda text: tok.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return np.asarray(self.encode(text), dtype="<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit; left out unless with_ids), ids_crc32, doc_tokens, sequence_id, offset, bucket of every piece.

    bucket is the binary logarithm of the length.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens", "bucket"]
    types = {"doc_id": pa.int64(), "ids": pa.binary(), "bucket": pa.int32()}
    schema = pa.schema([(c, types.get(c, pa.int64())) for c in names])

    @lean
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, text = doc.as_py(), text.as_py()
                ids = memoryview((bpe.ids(text) if text else b"") + end)
                n, start = len(ids) // 4, 0
                for size in cuts(n, length):
                    piece = ids[4 * start : 4 * (start + size)]
                    own = (bytes(piece),) if with_ids else ()
                    rows.append((doc, start, size, *own, zlib.crc32(piece), n, size.bit_length() - 1))
                    start += size
                    held += 4 * size * with_ids
                    if held > BATCH_BYTES or len(rows) >= BATCH_PIECES:
                        yield packed(rows)
                        rows, held = [], 0
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = {"ids": "binary", "bucket": "int"}
    cut_up = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))
    return cut_up.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).select(*[c for c in names if c != "bucket"], "sequence_id", "offset", "bucket")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a trainer reads batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
