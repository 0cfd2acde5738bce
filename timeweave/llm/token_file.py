"""Token-id files in patched frame-of-reference blocks.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK`` ids
regardless of documents:

    magic | blocks | block table | document table | footer

Each block has its minimum as the frame of reference.  The rest of every id is
packed at one width per block: the one that holds ``PERCENTILE`` % of the
block's ids.  What is wider leaves its low bits there and goes on the block's
exception list, as position and high bits.  A block's bytes are

    packed ids (BLOCK * width / 8) | exception positions (u2 each) | high bits (u4 each)

The block table gives minimum (u4), width (u1), number of exceptions (u2) and
start (u8) of each block, so any id is reached by one seek.  The document table
gives id (i8), whether it is null (u1) and number of ids (u8) of each document.
The footer has the numbers of blocks, documents and ids and the tables' start.
All numbers are little-endian.  The last block is filled up with its last id.

Documents are range-partitioned and sorted by id; each task writes one file to
a name of its own in the shared folder, and the list of files that counts is a
Parquet table, so of repeated task attempts just one is ever read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.tokens import AT_A_TIME, default_path, encoder
from timeweave.llm.workspace import batches, file_system, fresh_path, table

MAGIC, BLOCK, PERCENTILE = b"TWPFOR1\n", 256, 90
#: Blocks encoded or decoded at once.
RUN = 2048
_FOOTER = struct.Struct("<QQQQ8s")
_BLOCKS = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u8")])
_DOCS = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n", "<u8")])


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits of each number under 2^32 (exact in doubles)."""
    return np.frexp(x.astype(np.float64))[1]


def pack_bits(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers under 2^width as rows of bytes, lowest bits first."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(x.astype(f"<u{width // 8}")).view(np.uint8).reshape(len(x), -1)
    size = 2 if width < 16 else 4
    bits = np.unpackbits(np.ascontiguousarray(x.astype(f"<u{size}")).view(np.uint8).reshape(len(x), BLOCK, size), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(x), -1), axis=1, bitorder="little")


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(data), BLOCK), dtype=np.uint32)
    if width in (8, 16, 32):
        return np.ascontiguousarray(data).view(f"<u{width // 8}").astype(np.uint32)
    size = 2 if width < 16 else 4
    bits = np.zeros((len(data), BLOCK, 8 * size), dtype=np.uint8)
    bits[:, :, :width] = np.unpackbits(data, axis=1, count=BLOCK * width, bitorder="little").reshape(len(data), BLOCK, width)
    return np.packbits(bits, axis=2, bitorder="little").view(f"<u{size}").reshape(len(data), BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray, start: int) -> tuple[bytes, np.ndarray]:
    """Whole blocks (rows of BLOCK ids) to bytes, and their table from offset ``start`` on."""
    low = ids.min(axis=1)
    rest = (ids - low[:, None]).astype(np.uint32)
    at = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    width = bit_lengths(np.partition(rest, at, axis=1)[:, at])
    over = rest >> width[:, None].astype(np.uint32)
    row, column = np.nonzero(over)
    n = np.bincount(row, minlength=len(ids))
    data: list[bytes] = [b""] * len(ids)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = pack_bits(rest[rows] & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(rows), 0), dtype=np.uint8)
        for r, line in zip(rows.tolist(), packed, strict=True):
            data[r] = line.tobytes()
    where, high = column.astype("<u2").tobytes(), over[row, column].astype("<u4").tobytes()
    stops = np.cumsum(n).tolist()
    for r, (a, b) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
        if a < b:
            data[r] += where[2 * a : 2 * b] + high[4 * a : 4 * b]
    out = np.zeros(len(ids), dtype=_BLOCKS)
    out["minimum"], out["width"], out["exceptions"] = low, width, n
    sizes = np.array([len(d) for d in data], dtype=np.uint64)
    out["start"] = start + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(data) else start
    return b"".join(data), out


def decode_blocks(data: np.ndarray, blocks: np.ndarray, base: int) -> np.ndarray:
    """The ids of some blocks, whose bytes are ``data`` from file offset ``base`` on."""
    out = np.zeros((len(blocks), BLOCK), dtype=np.uint32)
    start = blocks["start"].astype(np.int64) - base
    for w in np.unique(blocks["width"]):
        rows = np.flatnonzero(blocks["width"] == w)
        size = BLOCK * int(w) // 8
        out[rows] = unpack_bits(data[start[rows][:, None] + np.arange(size)], int(w))
    n = blocks["exceptions"].astype(np.int64)
    row = np.repeat(np.arange(len(blocks)), n)
    if len(row):
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)  # number within the block's list
        width = blocks["width"].astype(np.int64)
        lists = (start + BLOCK * width // 8)[row]
        where = np.ascontiguousarray(data[(lists + 2 * k)[:, None] + np.arange(2)]).view("<u2").ravel()
        high = np.ascontiguousarray(data[(lists + 2 * n[row] + 4 * k)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[row, where] |= high << width[row].astype(np.uint32)
    return out + blocks["minimum"][:, None]


class Writer:
    """Streams documents into one file."""

    def __init__(self, out):
        self.out, self.at, self.ids, self.rest = out, len(MAGIC), 0, np.zeros(0, dtype=np.uint32)
        self.blocks: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        out.write(MAGIC)

    def _blocks(self, ids: np.ndarray) -> None:
        for a in range(0, len(ids), RUN * BLOCK):
            data, index = encode_blocks(ids[a : a + RUN * BLOCK].reshape(-1, BLOCK), self.at)
            self.out.write(data)
            self.at += len(data)
            self.blocks.append(index)

    def add(self, doc_ids: list[int | None], documents: list[np.ndarray]) -> None:
        index = np.zeros(len(doc_ids), dtype=_DOCS)
        index["doc_id"] = [d or 0 for d in doc_ids]
        index["is_null"] = [d is None for d in doc_ids]
        index["n"] = [len(x) for x in documents]
        self.docs.append(index)
        ids = np.concatenate([self.rest, *documents]).astype(np.uint32)
        self.ids += len(ids) - len(self.rest)
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._blocks(np.pad(self.rest, (0, BLOCK - len(self.rest)), mode="edge"))
        blocks = np.concatenate([*self.blocks, np.zeros(0, dtype=_BLOCKS)])
        docs = np.concatenate([*self.docs, np.zeros(0, dtype=_DOCS)])
        self.out.write(blocks.tobytes() + docs.tobytes() + _FOOTER.pack(len(blocks), len(docs), self.ids, self.at, MAGIC))


class Reader:
    """Reads a file by parts; ``f`` is a seekable binary file of ``size`` bytes."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - _FOOTER.size)
        n_blocks, n_docs, self.n_ids, self.tables, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        f.seek(self.tables)
        self.blocks = np.frombuffer(f.read(n_blocks * _BLOCKS.itemsize), dtype=_BLOCKS)
        self.docs = np.frombuffer(f.read(n_docs * _DOCS.itemsize), dtype=_DOCS)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop`` of the whole file."""
        a, b = start // BLOCK, min(-(-stop // BLOCK), len(self.blocks))
        if a >= b:
            return np.zeros(0, dtype=np.uint32)
        base = int(self.blocks["start"][a])
        end = int(self.blocks["start"][b]) if b < len(self.blocks) else self.tables
        self.f.seek(base)
        data = np.frombuffer(self.f.read(end - base), dtype=np.uint8)
        return decode_blocks(data, self.blocks[a:b], base).ravel()[start - a * BLOCK : stop - a * BLOCK]

    def _parts(self, start: int, stop: int, most: int) -> Iterator[np.ndarray]:
        for a in range(start, stop, most):
            yield self.ids(a, min(stop, a + most))

    def documents(self, most: int = RUN * BLOCK) -> Iterator[tuple[int | None, int, Iterable[np.ndarray]]]:
        """(id, number of ids, the ids in parts of up to ``most``), in the file's order.

        Ids are decoded ahead for many short documents, and a long document
        comes in several parts, so memory doesn't follow a document's length.
        """
        held, first, at = np.zeros(0, dtype=np.uint32), 0, 0
        for d, null, n in self.docs.tolist():
            if at + n <= first + len(held):
                yield None if null else d, n, [held[at - first : at - first + n]]
            elif n <= most:
                first = at
                held = self.ids(at, min(self.n_ids, at + most))
                yield None if null else d, n, [held[:n]]
            else:
                yield None if null else d, n, self._parts(at, at + n, most)
            at += n


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes the files into ``path`` and gives their list, one row per file:
    ``part, file, bytes, n_docs, n_ids, start`` in ascending order of documents.

    ``start`` counts the ids of all documents in earlier files.  ``path`` must be
    in a store that the executors share.
    """
    name = tokenizer or default_path()
    spark = docs.sparkSession

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(name), TaskContext.get().partitionId()
        store, folder = file_system(path)
        store.create_dir(folder, recursive=True)
        file = f"part-{part:07d}-{uuid.uuid4().hex}.ids"
        n = 0
        with store.open_output_stream(f"{folder}/{file}") as out:
            w = Writer(out)
            for b in batches(it, AT_A_TIME, tidy=False):
                w.add(b.column("doc_id").to_pylist(), code.encode(b.column("text")))
                n += b.num_rows
            w.close()
            size = out.tell()
        if n:
            row = [pa.array([part], pa.int32()), pa.array([file]), *(pa.array([x], pa.int64()) for x in (size, n, w.ids))]
            yield pa.RecordBatch.from_arrays(row, ["part", "file", "bytes", "n_docs", "n_ids"])

    # a null id sorts last; rows of one id lie in the order of their texts
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_last()
    ranged = rows.repartitionByRange(n, order).sortWithinPartitions(order, "text")
    # one row per file: as many as partitions, whatever the documents
    found = sorted(ranged.mapInArrow(run, "part int, file string, bytes long, n_docs long, n_ids long").collect())
    starts = np.cumsum([0, *(r["n_ids"] for r in found)])[:-1].tolist()
    columns = {k: [r[k] for r in found] for k in ("part", "file", "bytes", "n_docs", "n_ids")} | {"start": starts}
    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
    return spark.createDataFrame(pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds, strict=True)}))


def read_token_files(files: DataFrame, path: str) -> DataFrame:
    """From the list of files, one row per document: ``doc_id, start, n_tokens, ids_crc32``.

    Everything but a file's name and start comes from the file itself.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for b in it:
            for file, size, start in zip(*(b.column(k).to_pylist() for k in ("file", "bytes", "start")), strict=True):
                with store.open_input_file(f"{folder}/{file}") as f:
                    doc, at, count, crc = [], [], [], []
                    for d, m, parts in Reader(f, size).documents():
                        c = 0
                        for ids in parts:
                            c = zlib.crc32(ids.astype("<u4").tobytes(), c)
                        doc.append(d)
                        at.append(start)
                        count.append(m)
                        crc.append(c)
                        start += m
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, at, count, crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = files.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).select("file", "bytes", "start")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes all documents as token files and gives what reading them back yields.

    One row per input row.  A null or empty text has the end id alone; null ids
    come last and stay null; rows of one id stand next to each other in the
    order of their texts; an empty table writes no documents and gives no rows;
    other columns are ignored.
    """
    path = path or fresh_path(docs.sparkSession, "ids")
    return read_token_files(write_token_files(docs, path, id_col, text_col, tokenizer), path)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"))
