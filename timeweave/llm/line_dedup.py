"""Line deduplication by range-partitioned hashes.

1. Each document is split into lines.  Every different key of a document that is
   long enough becomes one row: two 64-bit halves of its hash, the document, and
   the line where the key first stands.
2. The rows are exchanged by ranges of the hash and sorted in their partition by
   hash, document and position.  Hashes are uniform, so the ranges are of equal
   width and need no sample; but before the exchange each batch keeps only the
   smallest document of every hash, as any other is beaten already.  So a line
   that stands everywhere arrives once per batch, not once per document, and no
   range is hot.
3. A stream over the sorted rows knows of each row whether it is the first of
   its hash; all later ones are drops.
4. The drops of a document are gathered into one compressed bitmap of the lines
   to keep.

Texts are never exchanged.  A row is addressed by its file and its number there,
which don't depend on how a scan is cut into tasks; bitmaps are written to the
shared folder in parts by address, and a second scan of the same files fetches
those of the rows it reads.  Tables that aren't plain scans of Parquet files are
written first.

Equal 128-bit hashes count as equal keys.  A key is the line without blanks
``[\x20\x09-\x0D]`` at its ends and with A-Z lower-cased.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.workspace import BLANKS, batches, file_system, fresh_path, release, stored, table, tidied

LEAST = 10
_BLANKS = BLANKS.encode()


def line_keys(text: str, least: int = LEAST) -> list[bytes | None]:
    """The key of each line, None for lines whose key is too short to count."""
    out: list[bytes | None] = []
    for line in text.encode().lower().split(b"\n"):  # bytes.lower() touches A-Z alone
        key = line.strip(_BLANKS)
        n = len(key)
        out.append(key if n >= least and (n >= 4 * least or key.isascii() or len(key.decode()) >= least) else None)
    return out


def pack_bitmap(n: int, dropped: list[int]) -> bytes:
    keep = np.ones(n, dtype=bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack_bitmap(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), dtype=np.uint8), count=n, bitorder="little").astype(bool)


_ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("no_id", pa.bool_()), ("file", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("n_lines", pa.int32()), ("drops", pa.binary())])
#: Where a row's document and address lie in it.
_OWNER = ["doc", "no_id", "file", "row"]


def line_rows(least: int):
    """Documents to candidate rows, and one row per document with what its batch has settled.

    A document's row (``drops`` not null) has the lines already known to go; it
    is sent by a hash of its address.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            counts, hashes, lines, owners = [], [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                keys = line_keys(text or "", least)
                seen: set[bytes] = set()
                for i, key in enumerate(keys):
                    if key is not None and key not in seen:
                        seen.add(key)
                        hashes.append(xxhash.xxh3_128_digest(key))
                        lines.append(i)
                        owners.append(r)
                counts.append(len(keys))
            doc, no_id, file, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in _OWNER)
            n_lines = np.array(counts, dtype=np.int32)
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            owner, line = np.array(owners, dtype=np.int64), np.array(lines, dtype=np.int32)
            order = np.lexsort((line, doc[owner], no_id[owner], h[:, 1], h[:, 0]))
            h, owner, line = h[order], owner[order], line[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]).any(axis=1)
            best = owner[new][np.cumsum(new) - 1]
            beaten = (doc[owner] != doc[best]) | (no_id[owner] != no_id[best])
            left = owner[~beaten]
            yield _table(h[~beaten], [x[left] for x in (doc, no_id, file, row)], line[~beaten], n_lines[left], None)
            gone: list[list[int]] = [[] for _ in counts]
            for r, i in zip(owner[beaten].tolist(), line[beaten].tolist(), strict=True):
                gone[r].append(i)
            drops = [np.array(sorted(g), dtype="<i4").tobytes() for g in gone]
            own = np.stack([file ^ (row * 0x9E3779B97F4A7C1), row], axis=1)
            yield _table(own, [doc, no_id, file, row], np.zeros(len(doc), dtype=np.int32), n_lines, drops)

    return run


def _table(h, owner, line, n_lines, drops) -> pa.RecordBatch:
    data = pa.nulls(len(line), pa.binary()) if drops is None else pa.array(drops, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), *map(pa.array, owner), pa.array(line), pa.array(n_lines), data], schema=_ROWS)


def later_ones(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h1, h2, no_id, doc, line): documents' rows as they are, and of
    each hash the rows of all documents but its first, across batches."""
    last = (None,) * 4  # hash and first document of the group that a batch ends in
    for batch in it:
        whole = np.asarray(batch.column("drops").is_valid())
        lines = batch.filter(pa.array(~whole))
        keep = [batch.filter(pa.array(whole))]
        if lines.num_rows:
            h1, h2, doc, no_id = (lines.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "doc", "no_id"))
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            group = np.cumsum(new) - 1
            first, first_no_id = doc[new][group], no_id[new][group]
            if last[:2] == (h1[0], h2[0]):
                n = int(new[1:].argmax()) + 1 if new[1:].any() else len(new)
                first[:n], first_no_id[:n] = last[2:]
            last = (h1[-1], h2[-1], first[-1], first_no_id[-1])
            keep.append(lines.filter(pa.array((doc != first) | (no_id != first_no_id))))
        for part in keep:
            if part.num_rows:
                yield part.select(["file", "row", "line", "n_lines", "drops"])


_MAPS = "file long, row long, n_lines int, n_dropped int, keep binary"


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``file, row, n_lines, n_dropped, keep`` for the rows ``doc, no_id, file, row, text``.

    ``keep`` is a zlib-compressed little-endian bitmap over the document's lines
    in which the first of several equal keys of a document stands for all of them.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*_OWNER, "text").mapInArrow(tidied(line_rows(least)), "h1 long, h2 long, doc long, no_id boolean, file long, row long, line int, n_lines int, drops binary")
    # range r of n equal ones over the 64 bits of h1
    at = F.floor((F.shiftright("h1", 32) + F.lit(2**31)) * n / F.lit(2**32)).cast("int")
    ranged = rows.repartitionById(n, at).sortWithinPartitions("h1", "h2", "no_id", "doc", "line")
    found = ranged.mapInArrow(tidied(later_ones), "file long, row long, line int, n_lines int, drops binary")
    gathered = found.groupBy("file", "row").agg(
        F.max("n_lines").alias("n_lines"),
        F.collect_list(F.when(F.col("drops").isNull(), F.col("line"))).alias("lines"),
        F.max("drops").alias("drops"),
    )

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out, counts = [], []
            for n_lines, lines, drops in zip(*(b.column(k).to_pylist() for k in ("n_lines", "lines", "drops")), strict=True):
                gone = sorted({*lines, *np.frombuffer(drops or b"", dtype="<i4").tolist()})
                out.append(pack_bitmap(n_lines, gone))
                counts.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("row"), b.column("n_lines"), pa.array(counts, pa.int32()), pa.array(out, pa.binary())], ["file", "row", "n_lines", "n_dropped", "keep"])

    return gathered.mapInArrow(tidied(pack), _MAPS)


def kept_lines(text: str, keep: np.ndarray, least: int = LEAST) -> tuple[list[str], int]:
    """The lines that stay and the number of lines."""
    lines = text.split("\n")
    if keep.all():
        return lines, len(lines)
    keys = line_keys(text, least)
    gone = {keys[i] for i in np.flatnonzero(~keep).tolist()}
    return [line for line, key in zip(lines, keys, strict=True) if key is None or key not in gone], len(lines)


def _scans_files(docs: DataFrame) -> bool:
    """Whether every row is one row of a Parquet file, so that the file's numbers tell rows apart."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if not node.nodeName().startswith("LogicalRelation"):
        return False
    try:
        return bool(docs.select(docs.metadataColumn("_metadata").getField("row_index")).schema)
    except AnalysisException:  # another format, or a column of this name in between
        return False


def addressed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs``, written to files if it doesn't come from some, and its rows as ``doc, no_id, file, row, text``."""
    if not _scans_files(docs):
        docs = stored(docs, "documents")
    return docs, docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("doc"), docs[id_col].isNull().alias("no_id"), *_address(docs), docs[text_col].alias("text"))


def _address(docs: DataFrame) -> list[Column]:
    where = docs.metadataColumn("_metadata")
    return [F.xxhash64(where.getField("file_path")).alias("file"), where.getField("row_index").alias("row")]


class Bitmaps:
    """The bitmaps of documents that lose lines, in files of the shared folder.

    ``names`` are the files by part; a part holds whole chunks of ``CHUNK``
    consecutive rows of an input file, sorted by address.
    """

    CHUNK = 1 << 16

    def __init__(self, names: dict[int, str], folder: str, parts: int):
        self.names, self.folder, self.parts = names, folder, parts

    @classmethod
    def write(cls, maps: DataFrame) -> Bitmaps:
        spark = maps.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder = fresh_path(spark, "bitmaps")

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            store, path = file_system(folder)
            store.create_dir(path, recursive=True)
            name, writer = f"part-{part:07d}-{uuid.uuid4().hex}.parquet", None
            for b in it:
                if writer is None:
                    writer = pq.ParquetWriter(f"{path}/{name}", b.schema, filesystem=store)
                writer.write_batch(b)
            if writer is not None:
                writer.close()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name])], ["part", "name"])

        chunk = F.shiftright("row", cls.CHUNK.bit_length() - 1)
        slim = maps.filter("n_dropped > 0").select("file", chunk.alias("chunk"), "row", "keep")
        dealt = slim.repartitionById(parts, F.pmod(F.xxhash64("file", "chunk"), F.lit(parts)).cast("int")).sortWithinPartitions("file", "chunk", "row")
        names = {r["part"]: r["name"] for r in dealt.mapInArrow(tidied(run), "part int, name string").collect()}  # a row per part
        return cls(names, folder, parts)

    def of(self, files: np.ndarray, rows: np.ndarray) -> list[np.ndarray | None]:
        """The packed bitmap of each row, or None."""
        chunks = rows >> (self.CHUNK.bit_length() - 1)
        found: list[bytes | None] = [None] * len(rows)
        for file, chunk in np.unique(np.stack([files, chunks], axis=1), axis=0).tolist():
            kept = _chunk(self.folder, self.names.get(_part(file, chunk, self.parts)), file, chunk)
            if kept:
                for i in np.flatnonzero((files == file) & (chunks == chunk)).tolist():
                    found[i] = kept.get(int(rows[i]))
        return found


def _part(file: int, chunk: int, parts: int) -> int:
    """As Spark's pmod(xxhash64(file, chunk), parts), which hashes column by column from seed 42."""
    h = xxhash.xxh64_intdigest(file.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(chunk.to_bytes(8, "little", signed=True), h)
    return (h - 2**64 if h >= 2**63 else h) % parts


@functools.lru_cache(maxsize=4)
def _chunk(folder: str, name: str | None, file: int, chunk: int) -> dict[int, bytes]:
    """Bitmaps by row number of one chunk; a worker keeps the last few."""
    if name is None:
        return {}
    store, path = file_system(folder)
    t = pq.read_table(f"{path}/{name}", columns=["row", "keep"], filters=[("file", "=", file), ("chunk", "=", chunk)], filesystem=store)
    return dict(zip(t.column("row").to_pylist(), t.column("keep").to_pylist(), strict=True))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: ``doc_id, text`` (lines that stay), ``n_lines, n_dropped``.

    A key found in two or more documents loses its lines except in the document
    of the smallest id; shorter keys stay everywhere.  A null text is one empty
    line.  Rows of one id are one document: none of them loses a line to
    another.  Null ids count as one document that comes after all others.  An
    empty table gives no rows; other columns are ignored.
    """
    docs, rows = addressed(docs, id_col, text_col)
    maps = Bitmaps.write(keep_bitmaps(rows, least))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts, n, gone = [], [], []
            for text, keep in zip(b.column("text").to_pylist(), maps.of(np.asarray(b.column("file")), np.asarray(b.column("row"))), strict=True):
                text = text or ""
                count = text.count("\n") + 1
                stay = [text] if keep is None else kept_lines(text, unpack_bitmap(keep, count), least)[0]
                texts.append("\n".join(stay))
                n.append(count)
                gone.append(0 if keep is None else count - len(stay))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    again = docs.select(docs[id_col].cast("long").alias("doc_id"), *_address(docs), docs[text_col].alias("text"))
    return again.mapInArrow(tidied(run), "doc_id long, text string, n_lines long, n_dropped long")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the lines dropped from its texts, and all its other columns as they are.

    The same rules as :func:`dedup_lines`; a null text stays null.
    """
    docs, rows = addressed(docs, id_col, text_col)
    maps = Bitmaps.write(keep_bitmaps(rows, least))

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, file: pa.Array, row: pa.Array) -> pa.Array:
        out = []
        for text, keep in zip(texts.to_pylist(), maps.of(np.asarray(file), np.asarray(row)), strict=True):
            out.append(text if text is None or keep is None else "\n".join(kept_lines(text, unpack_bitmap(keep, text.count("\n") + 1), least)[0]))
        release()
        return pa.array(out, pa.string())

    own = {c: docs["`" + c.replace("`", "``") + "`"] for c in docs.columns}
    return docs.select(*(own | {text_col: shortened(docs[text_col], *_address(docs)).alias(text_col)}).values())


def query(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k),
j AS (SELECT l.doc_id, i, line, first_doc IS NULL OR first_doc = l.doc_id AS stays FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
