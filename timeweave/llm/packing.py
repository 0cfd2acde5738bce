"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the binary digits of n:
as many of ``longest`` (a power of two) as fit, then one for each digit below.
Every piece is a sequence of its own, so no sequence crosses documents and none
has padding.  Sequences of one length form a bucket, from which batches of one
shape are drawn.

Nothing is exchanged: a task numbers the sequences of each bucket in its
partition, and the sequence id has bucket, partition and number side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.tokens import AT_A_TIME, default_path, encoder
from timeweave.llm.workspace import batches, table, tidied

LONGEST = 4096


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces' lengths, from the document's start: whole sequences, then falling powers of two."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, ids``.

    ``bucket`` is the binary logarithm of the length; ``ids`` is left out unless
    ``with_ids``.  A null or empty text has the end id alone and makes one piece
    of length 1.  Null ids and repeated rows are packed like any other row, each
    with pieces of its own.  An empty table gives no rows; other columns are
    ignored.  Sequence ids are unique, and those of a bucket are one range; they
    follow the input's partitions.
    """
    if longest < 1 or longest & (longest - 1) or longest > 1 << 15:
        raise ValueError("longest must be a power of two up to 32768")
    path = tokenizer or default_path()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        counts = [0] * 17
        for b in batches(it, AT_A_TIME):
            row, start, length, crc, total, seq, bucket, pieces = [], [], [], [], [], [], [], []
            for r, ids in enumerate(code.encode(b.column("text"))):
                data = memoryview(ids.astype("<u4").tobytes())
                at, n = 0, len(ids)
                for m in binary_lengths(n, longest):
                    k = m.bit_length() - 1
                    row.append(r)
                    start.append(at)
                    length.append(m)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + m)]))
                    total.append(n)
                    seq.append(k << 59 | part << 34 | counts[k])
                    bucket.append(k)
                    counts[k] += 1
                    if with_ids:
                        pieces.append(ids[at : at + m].astype(np.int32))
                    at += m
            doc = b.column("doc_id").take(pa.array(row, pa.int64()))
            columns = [doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, total, seq)), pa.array(np.zeros(len(row), dtype=np.int64)), pa.array(bucket, pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                ends = np.cumsum([0, *length]).astype(np.int32)
                flat = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        code.forget()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + ", ids array<int>" * with_ids
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    packed.select("sequence_id", "doc_id", "start", "ids", F.col("bucket")).write.partitionBy("bucket").parquet(path)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents")).drop("ids")
