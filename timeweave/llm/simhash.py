"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two halves.  Two fingerprints that differ in
three bits or fewer differ in one bit or none in one of the halves, so each half
is searched at distance 1:

* anchors are the words of the perfect Hamming code [31, 26] over 31 bits of the
  half; it covers the space with radius 1;
* a fingerprint is sent to every anchor within covering radius plus threshold,
  1 + 1 = 2 bits: its own word's, and 15 more (none more if it is a code word);
* for a pair within distance 1, the anchor that covers one of them is within 2
  of the other, so both arrive there; at an anchor those it covers are compared
  with all that came, and pairs that differ in at most three of all 64 bits link.

There are 2 x 2^26 anchors, and 31 copies of a fingerprint on average, whatever
the corpus.  Equal fingerprints are one row from the start.  At an anchor only a
spanning forest of the links leaves, so a large group gives as many rows as
members.  Anchors with many members are not compared pair by pair: in 4 x 16
bits at least one block of a linked pair agrees, so only members with an equal
block meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.components import components
from timeweave.llm.workspace import batches, stored, table

SHINGLE, MOST_BITS, SEED = 3, 3, 42
#: Up to so many members an anchor compares all of them with those it covers.
PAIRWISE = 2048
_CHUNK = 1 << 15
_ONE = np.uint64(1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 hashes."""
    words = text.encode().lower().split()  # ASCII white space and A-Z alone, as these are bytes
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1
    n = max(1, len(words) - shingle + 1)
    hash_ = xxhash.xxh64_intdigest
    bits = np.zeros(64, dtype=np.int64)
    last = (ends[-n:] - 1).tolist()
    first = starts[:n].tolist()
    for at in range(0, n, _CHUNK):
        h = np.array([hash_(line[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)], dtype=">u8")
        bits += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes made elsewhere: bit b is set if it is set in over half of them."""
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK].astype(">u8")
        bits += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc, f`` (the fingerprint as a signed long), one row per input row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            f = np.array([fingerprint(t or "", shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(f.view(np.int64))], ["doc", "f"])

    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc long, f long")


def _pairs(n: int = 31) -> list[np.ndarray]:
    """For each syndrome, the masks that lead to code words at distance 0 to 2.

    Bit i of a word (from 1 to 31) has the check column i; a word is in the code
    if the columns of its set bits sum to zero.
    """
    out = []
    for s in range(n + 1):
        if s == 0:
            masks = [0]
        else:
            masks = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, n + 1) if i != s and i < i ^ s]
        out.append(np.array(masks, dtype=np.uint64))
    return out


_MASKS = _pairs()


def syndromes(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), dtype=np.int64)
    for i in range(31):
        s ^= np.where((x >> np.uint64(i)) & _ONE, i + 1, 0)
    return s


def halves(f: np.ndarray) -> list[np.ndarray]:
    """31 bits of each half; the half's top bit takes no part in the code."""
    low = np.uint64(2**31 - 1)
    return [f & low, (f >> np.uint64(32)) & low]


def anchors(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, row of f): anchors are code words with the half's number above."""
    where, rows = [], []
    for k, x in enumerate(halves(f)):
        s = syndromes(x)
        for value in np.unique(s):
            at = np.flatnonzero(s == value)
            masks = _MASKS[value]
            where.append(((x[at][:, None] ^ masks[None, :]) | np.uint64(k << 32)).ravel())
            rows.append(np.repeat(at, len(masks)))
    return np.concatenate(where), np.concatenate(rows)


def covered(anchor: int, f: np.ndarray) -> np.ndarray:
    """Which fingerprints lie within the covering radius of the anchor."""
    x = halves(f)[anchor >> 32]
    return np.bitwise_count(x ^ np.uint64(anchor & (2**32 - 1))) <= 1


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that join different trees, in order."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def linked(f: np.ndarray, home: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, of one in ``home`` and any other, within ``most`` bits; in blocks."""

    def compare(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, (1 << 20) // max(1, len(b)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(f[a[at : at + step]][:, None] ^ f[b][None, :]) <= most)
            i, j = a[at + i], b[j]
            yield i[i != j], j[i != j]

    every = np.arange(len(f))
    if len(f) <= PAIRWISE or most > 3:
        yield from compare(every[home], every)
        return
    for k in range(4):
        block = (f >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        order = np.argsort(block, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(run) > 1 and home[run].any():
                yield from compare(run[home[run]], run)


def links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``a, b``: for the distinct fingerprints ``f`` enough links to join all that are linked."""
    if not 0 <= most <= 3:
        raise ValueError("the covering is laid out for 0 to 3 bits")

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, _CHUNK):
                f = np.asarray(batch.slice(at, _CHUNK).column("f")).view(np.uint64)
                if len(f):
                    where, rows = anchors(f)
                    yield pa.RecordBatch.from_arrays([pa.array(where.view(np.int64)), pa.array(f[rows].view(np.int64))], ["anchor", "f"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(anchor: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            ends = np.append(new[1:], len(anchor))
            a, b = [], []
            # groups of two, by far the most, at once: at an anchor both come from within 2 bits
            two = new[ends - new == 2]
            near = np.bitwise_count(f[two] ^ f[two + 1]) <= most
            a.append(f[two[near]])
            b.append(f[two[near] + 1])
            for i, j in zip(new[ends - new > 2].tolist(), ends[ends - new > 2].tolist(), strict=True):
                g = f[i:j]
                found = _forest(len(g), linked(g, covered(int(anchor[i]), g), most))
                if found:
                    x = np.array(found)
                    a.append(g[x[:, 0]])
                    b.append(g[x[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the anchor that may go on in the next batch
        for batch in it:
            if not batch.num_rows:
                continue
            anchor, f = np.asarray(batch.column("anchor")).view(np.uint64), np.asarray(batch.column("f")).view(np.uint64)
            if anchor[0] != anchor[-1] or held and held[0][0][0] != anchor[0]:
                cut = int(np.searchsorted(anchor, anchor[-1]))
                done = [*held, (anchor[:cut], f[:cut])]
                yield settle(np.concatenate([x for x, _ in done]), np.concatenate([y for _, y in done]))
                held = []
                anchor, f = anchor[cut:], f[cut:]
            held.append((anchor, f))
        if held:
            yield settle(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = prints.select("f").mapInArrow(spread, "anchor long, f long").repartition(n, "anchor").sortWithinPartitions("anchor")
    return sent.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Fingerprints that differ in at most ``most`` bits link; ``component_id`` is
    the smallest id in the linked group.  A null or blank text has fingerprint
    zero, a text of fewer words than a shingle is one shingle, both link like
    any other.  A null id is larger than all others, so a group has the null
    component only if it has no other id; rows of one id stand side by side.  An empty table gives no rows; other columns
    are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    unique = stored(prints.groupBy("f").agg(F.min("doc").alias("first")), "unique-fingerprints")  # min passes over nulls
    stars = components(links(unique, most))
    group = unique.join(stars.select(F.col("a").alias("f"), "b"), "f", "left").select("f", F.coalesce("b", "f").alias("g"), "first")
    group = stored(group, "groups")
    least = group.groupBy("g").agg(F.min("first").alias("least"))
    named = group.join(least, "g").select("f", "least")
    # copies make a fingerprint frequent: its documents are the large side, which AQE splits
    return prints.join(named, "f").select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
