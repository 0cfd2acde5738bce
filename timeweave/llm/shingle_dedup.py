"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

A text is the set of its five-word shingles (as XXH64 hashes), its fingerprint
the SimHash of that set.  The anchors of ``simhash`` find the fingerprints that
differ in few bits; what they link is compared by whole sets before it counts.

Sets of similarity 4/5 differ in about ten bits of 64, beyond any covering that
pays, so prefix filtering does the rest: the pairs that SimHash has not joined.
Put in one order for all texts, two sets of similarity 4/5 or more share a
shingle among the first ``n - ceil(4 n / 5) + 1`` of each, so the pairs that meet
at such a shingle hold every pair that is asked for, in any order (Chaudhuri et
al. 2006).  The order here begins with the shingles that a sample of the texts
doesn't show twice, so few texts meet; it decides about the work alone, never
about the result.

1. Texts of equal sets are one key from the start.
2. Keys whose fingerprints SimHash links are compared, and joined if they are
   alike.
3. At each shared shingle keys are compared with the least one, but for those
   of its component.  What links is joined, so a large group of near copies is
   one component by then.
4. Keys of different components that share a shingle are compared: pair by pair
   where ``FEW`` share it, so pairs grow with the keys; else they meet in blocks
   of bounded size inside a task, which only possible pairs leave.

Possible means by a parity bitmap: each shingle of a set flips one of at least
``2 n`` bits, so two bitmaps differ in no more bits than the sets differ in
shingles.  What is left is compared by whole sets: nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm import simhash
from timeweave.llm.components import components
from timeweave.llm.workspace import batches, stored, tidied

#: Similarity LIKE / OF or more links.
SHINGLE, LIKE, OF, SEED = 5, 4, 5, 42
#: Share of the texts that the order of shingles is learned from, and shingles it holds at most.
SAMPLE, MOST_COMMON = 0.1, 1 << 19
#: Texts of the sample in which a shingle is heavy: its keys are dealt over tasks, so many of the sample for each.
HEAVY = 1024
#: Keys of a shingle that are paired one by one, at most.
FEW = 32
#: A bitmap has so many bits at most; longer sets share them, which only weakens the bound.
MOST_BITS = 1 << 16
#: Members of a shingle that meet in one block; more are dealt over pairs of blocks.
BLOCK = 2048
#: A key with over 1 / HOT of all pairs is dealt over several tasks; there are HOT of them at most.
HOT = 1024
#: Bytes of text that a worker has in hand.
AT_A_TIME = 4 << 20
#: Words of bitmaps compared at once.
_AT_ONCE = 1 << 21


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of hashes, sorted; words are lower-cased (A-Z) and cut at ASCII white space.

    Fewer words than a shingle are one shingle, no words are the shingle zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, dtype=np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    hash_ = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(line[a:b], SEED) for a, b in zip((ends - lengths)[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype=np.uint64))


def prefix(n: int) -> int:
    """So many of a set's n shingles are sent out; sets too small to be like a different one send none."""
    return n - -(-LIKE * n // OF) + 1 if n * (OF - LIKE) >= LIKE else 0


def _like(na: Column, nb: Column, common: Column) -> Column:
    return (LIKE + OF) * common >= LIKE * (na + nb)


def _mapped(docs: DataFrame, make, schema: pa.Schema, once: bool = False) -> DataFrame:
    """``make(row, set)`` gives the columns, arrays of one length, for each text of ``docs(row, text)``.

    With ``once`` a task leaves out the sets that it has seen, so copies are few before any exchange.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches(it, AT_A_TIME):
            parts = []
            for r, t in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(t)
                if once:
                    if (key := int(_key(s)[0])) in seen:
                        continue
                    seen.add(key)
                parts.append(make(r, s))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], schema=schema)

    return docs.select("row", "text").mapInArrow(tidied(run), ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema))


def _key(s: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED)], dtype=np.uint64).view(np.int64)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in more than one text of a sample, sorted, and in how many."""
    sent = _mapped(docs.sample(fraction=SAMPLE, seed=SEED), lambda _, s: (s.view(np.int64),), pa.schema([("token", pa.int64())]))
    counted = stored(sent.groupBy("token").count().filter("count > 1"), "shingle-counts")
    # the least power of two that few enough shingles reach
    kinds = {r["bits"]: r["n"] for r in counted.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    bits, n = max(kinds, default=0) + 1, 0
    while bits > 1 and n + kinds.get(bits - 1, 0) <= MOST_COMMON:
        bits -= 1
        n += kinds.get(bits, 0)
    top = counted.filter(F.col("count") >= F.lit(1 << (bits - 1)).cast("long")).toArrow()
    token, count = np.asarray(top.column("token")).astype(np.int64).view(np.uint64), np.asarray(top.column("count")).astype(np.int64)
    order = np.argsort(token)
    return token[order], count[order]


def _possible(pairs: DataFrame) -> DataFrame:
    """Those ``a, b, na, nb`` that can be alike, from the rows ``x`` and ``y`` of each shingle that both have sent.

    All shingles that two sets have in common up to the last one that meets lie
    in both prefixes; behind it none lies in the prefix that ends first.
    """
    ends = lambda n: F.floor(F.col(n) - (F.col(n) - F.ceil(F.col(n) * LIKE / OF) + 1))
    sized = pairs.filter(_like(F.col("x.n"), F.col("y.n"), F.least("x.n", "y.n")))
    met = sized.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(
        F.count(F.lit(1)).alias("c"), F.max("x.at").alias("i"), F.max("y.at").alias("j")
    )
    rest = F.least(F.col("na") - F.col("i") - 1, F.col("nb") - F.col("j") - 1, F.greatest(ends("na"), ends("nb")))
    return met.filter(_like(F.col("na"), F.col("nb"), F.col("c") + rest)).select("a", "b", "na", "nb")


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits; a power of two of bits, at least two for each shingle."""
    size = min(MOST_BITS, max(64, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possibly_alike(n: np.ndarray, bits: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sets of ``n`` shingles whose bitmaps leave it possible that they are alike.

    Sets that are alike have bitmaps of one size or of neighbouring sizes; of
    those the larger is folded to the smaller.
    """
    width = np.array([len(b) for b in bits], dtype=np.int64)
    rows = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    words = {w: np.frombuffer(b"".join([bits[i] for i in at.tolist()]), dtype="<u8").reshape(len(at), w // 8) for w, at in rows.items()}

    def compare(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, _AT_ONCE // max(1, y.size))
        for at in range(0, len(a), step):
            left, n_left, n_right = a[at : at + step], n[a[at : at + step]][:, None], n[b][None, :]
            sized = OF * np.minimum(n_left, n_right) >= LIKE * np.maximum(n_left, n_right)
            if same:
                sized &= np.arange(at, at + len(left))[:, None] < np.arange(len(b))[None, :]
            if not sized.any():
                continue
            # one word of the bitmaps at a time, so that memory follows the pairs alone
            apart = np.zeros(sized.shape, dtype=np.int32)
            for k in range(x.shape[1]):
                apart += np.bitwise_count(x[at : at + step, k][:, None] ^ y[:, k][None, :])
            i, j = np.nonzero(sized & ((LIKE + OF) * apart <= (OF - LIKE) * (n_left + n_right)))
            if len(i):
                yield left[i], b[j]

    for w, at in rows.items():
        yield from compare(at, words[w], at, words[w], True)
        if 2 * w in rows:
            half = words[2 * w].shape[1] // 2
            yield from compare(at, words[w], rows[2 * w], words[2 * w][:, :half] ^ words[2 * w][:, half:], False)


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the larger folded to the smaller."""
    x, y = sorted((np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _near(pairs: DataFrame, unique: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b, na, nb)`` whose bitmaps leave it possible that they are alike, as ``a, b``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = np.asarray(batch.column("na")).astype(np.int64) + np.asarray(batch.column("nb"))
            apart = np.array([_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((LIKE + OF) * apart <= (OF - LIKE) * n))

    side = lambda c, bits: unique.select(F.col("key").alias(c), F.col("bits").alias(bits))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(tidied(run), "a long, b long")


def _whole_groups(it: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """From sorted batches, tables that hold groups of equal ``by`` whole."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in by]
        last = [c[-1] for c in columns]
        cut = batch.num_rows - int(np.logical_and.reduce([c == x for c, x in zip(columns, last, strict=True)]).sum())
        if held and (cut or [held[0].column(c)[0].as_py() for c in by] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _met(rows: DataFrame) -> DataFrame:
    """``a, b``: pairs of different components at one shingle that may be alike, in blocks.

    ``rows(token, key, g, n, bits)``.  A shingle of more than ``BLOCK`` members is
    dealt over all pairs of blocks of them, so no task holds it whole.
    """
    many = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(many, "token").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cell = lambda k: F.greatest("own", k) * F.col("blocks") + F.least("own", k)
    dealt = placed.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(it, ["token", "cell"]):
            token, cell, key, g, n, own = (np.asarray(table.column(c)) for c in ("token", "cell", "key", "g", "n", "own"))
            bits = table.column("bits").to_pylist()
            new = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
            found = [np.zeros((0, 2), dtype=np.int64)]
            for at, end in zip(new.tolist(), [*new[1:].tolist(), len(token)], strict=True):
                across = own[at:end].min() != own[at:end].max()
                for i, j in possibly_alike(n[at:end].astype(np.int64), bits[at:end]):
                    i, j = i + at, j + at
                    good = g[i] != g[j]
                    if across:  # pairs within a block meet in the cell of that block
                        good &= own[i] != own[j]
                    found.append(np.sort(np.stack([key[i[good]], key[j[good]]], axis=1), axis=1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["token", "cell", "key", "g", "n", "own", "bits"]
    return dealt.select(*columns).repartition(parts, "token", "cell").sortWithinPartitions("token", "cell").mapInArrow(tidied(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are alike.

    ``b`` may be the one that a large group is compared with: Misra-Gries names
    such keys, and their pairs and sets are dealt over several tasks.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            good = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(OF * both >= LIKE * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    often = pairs.stat.freqItems(["b"], 1 / HOT).select(F.explode("b_freqItems").alias("b"))
    counted = pairs.join(F.broadcast(often), "b", "left_semi").groupBy("b").count()  # HOT rows at most
    share = max(1, pairs.count() // HOT)
    hot = stored(counted.filter(F.col("count") > share).select("b", F.ceil(F.col("count") / share).cast("int").alias("parts")), "hot-keys")
    dealt = pairs.join(F.broadcast(hot), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).drop("parts")
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("sb")).join(F.broadcast(hot), "b", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    return dealt.join(left, "a").join(right, ["b", "part"]).select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def _neighbours(unique: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``a, b, na, nb``: the keys of ``unique(key, f, n)`` whose fingerprints are equal or linked.

    The least key of a fingerprint stands for it at the anchors, and is the one
    that its other keys are held against.
    """
    least = stored(unique.groupBy("f").agg(F.min(F.struct("key", "n")).alias("c")).select("f", "c.*"), "unique-fingerprints")
    end = lambda f, key, n: least.select(F.col("f").alias(f), F.col("key").alias(key), F.col("n").alias(n))
    equal = unique.select(F.col("f").alias("fb"), F.col("key").alias("a"), F.col("n").alias("na")).join(end("fb", "b", "nb"), "fb").filter("a <> b")
    near = links(least.select("f")).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(end("fa", "a", "na"), "fa").join(end("fb", "b", "nb"), "fb")
    columns = ["a", "b", "na", "nb"]
    return near.select(columns).unionByName(equal.select(columns)).filter(_like(F.col("na"), F.col("nb"), F.least("na", "nb")))


def near_copies(docs: DataFrame, links: Callable[[DataFrame], DataFrame] = simhash.links) -> DataFrame:
    """``row, component`` for each row of ``docs(row, text)``: rows linked by similarity have one component.

    ``row`` is a stored, unique number.  Texts of similarity 4/5 or more link; the
    blank and null ones are alike.  ``component`` is a number without a meaning.
    ``links`` gives the pairs ``a, b`` of the distinct fingerprints ``f`` that are
    compared first.
    """
    spark = docs.sparkSession

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, AT_A_TIME):
            keys, prints, sizes, bits = [np.zeros(0, dtype=np.int64)], [], [], []
            for s in map(shingles, b.column("text").to_pylist()):
                keys.append(_key(s))
                prints.append(simhash.majority(s))
                sizes.append(len(s))
                bits.append(bitmap(s))
            f = np.array(prints, dtype=np.uint64).view(np.int64)
            columns = [b.column("row"), pa.array(np.concatenate(keys)), pa.array(f), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "key", "f", "n", "bits"])

    described = stored(docs.select("row", "text").mapInArrow(tidied(describe), "row long, key long, f long, n int, bits binary"), "shingle-keys")
    first = [F.min("row").alias("row"), *[F.min_by(c, "row").alias(c) for c in ("f", "n", "bits")]]
    unique = stored(described.groupBy("key").agg(*first), "shingle-bitmaps")
    token, count = _common(docs)

    def send(_: int, s: np.ndarray) -> tuple[np.ndarray, ...]:
        n, m = len(s), prefix(len(s))
        seen = np.zeros(n, dtype=np.int64)
        if len(token):
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            seen = np.where(token[at] == s, count[at], 0)
        at = np.lexsort((s, seen))[:m]
        key = _key(s)
        # a heavy shingle's keys go to several cells, each key to one
        cells = (seen[at] // HEAVY + 1).astype(np.uint64)
        return s[at].view(np.int64), np.repeat(key, m), np.full(m, n, dtype=np.int32), np.arange(m, dtype=np.int32), np.where(cells > 1, key.view(np.uint64) % cells + np.uint64(1), 0).astype(np.int32)

    schema = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("cell", pa.int32())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = _mapped(docs, send, schema, once=True).repartition(parts, "token", "cell").dropDuplicates(["token", "cell", "key"])
    met = sent.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token", "cell")))
    # shingles of one key go, but for heavy ones, where that key would pair with none
    shared = stored(met.filter("m > 1 or cell > 0").drop("m", "cell"), "shared-shingles")

    def to_binary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, AT_A_TIME):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["key", "tokens"])

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "shingle-pairs")
        keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        least = unique.select("key", "row").join(keys, "key", "left_semi")
        sets = stored(docs.join(least, "row").select("key", "text").mapInArrow(tidied(to_binary), "key long, tokens binary"), "shingle-sets")
        return stored(_verified(pairs, sets), "shingle-links")

    def named(linked: DataFrame) -> DataFrame:
        known = components(linked).select(F.col("a").alias("key"), "b")
        return stored(shared.join(known, "key", "left").withColumn("g", F.coalesce("b", "key")).drop("b"), "named-shingles")

    known = verified(_near(_neighbours(unique, links), unique))
    keyed = named(known)
    centre = keyed.groupBy("token").agg(F.min(F.struct("key", "n", "at", "g")).alias("c")).select("token", "c.*")
    pairs = keyed.alias("x").join(centre.alias("y"), "token").filter(F.col("x.g") != F.col("y.g"))
    known = known.unionByName(verified(_near(_possible(pairs), unique)))

    keyed = named(known)
    mixed = keyed.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("m")).filter("low <> high").select("token", "m")
    keyed = keyed.join(mixed, "token")
    few, many = keyed.filter(F.col("m") <= FEW), keyed.filter(F.col("m") > FEW)
    pairs = few.alias("x").join(few.alias("y"), "token").filter((F.col("x.key") < F.col("y.key")) & (F.col("x.g") != F.col("y.g")))
    more = _near(_possible(pairs), unique).unionByName(_met(many.select("token", "key", "g", "n").join(unique.select("key", "bits"), "key"))).distinct()
    more = verified(more)

    stars = components(known.unionByName(more)).select(F.col("a").alias("key"), "b")
    # copies make a key frequent: the rows are the large side, which AQE splits
    return described.select("row", "key").join(stars, "key", "left").select("row", F.coalesce("b", "key").alias("component"))
