"""Exact, near and line deduplication against plain versions, and their edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from timeweave.llm import components, exact_dedup, line_dedup, shingle_dedup, simhash

DOCS = "doc_id long, text string, source string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
EDGES = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "same text here and there", "b"), (None, None, "b"), (7, "same  text here\nand there", "b"), (8, LONG, "c"), (8, LONG, "c"), (9, LONG + "!", None)]


def frame(spark, rows):
    """With columns that clash with names the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    for c in ("rank", "sha", "n", "rid", "h1", "f", "doc", "text_hash", "keep", "part", "key", "size", "row", "words", "hash"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def random_texts(seed, n=300):
    r = random.Random(seed)
    pool = [" ".join(r.choice("alpha beta gamma delta eps".split()) for _ in range(r.randint(0, 12))) for _ in range(40)]
    return [(i, r.choice(pool).replace(" ", r.choice([" ", "  ", "\n", " "])), r.choice("xyz")) for i in range(n)]


def test_exact_against_plain(spark):
    rows = random_texts(1) + [(1000 + i, "hot copy", "x") for i in range(200)]
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert got[i] == (keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest())


def test_exact_edges(spark):
    out = exact_dedup.exact_duplicates(frame(spark, EDGES)).collect()
    assert len(out) == len(EDGES)
    by = {}
    for r in out:
        by.setdefault(r["text_sha256"], []).append(r)
    for rows in by.values():
        assert sum(r["kept"] for r in rows) == 1 and {r["group_size"] for r in rows} == {len(rows)} and len({r["keep_id"] for r in rows}) == 1
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert len(blank) == 4 and blank[0]["keep_id"] == 3
    assert {r["keep_id"] for r in by[hashlib.sha256(b"sametexthereandthere").hexdigest()]} == {7}
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    plan = exact_dedup.exact_duplicates(frame(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan  # no group is gathered, however the support is set


def test_exact_with_one_text_under_the_support(spark):
    rows = [(i, "one text", "x") for i in range(300)] + [(1000 + i, f"text {i}", "x") for i in range(50)]
    for support in (1 / 1024, 0.99):  # at 0.99 nothing is frequent: the large group goes the ordinary way
        out = exact_dedup.exact_duplicates(frame(spark, rows), support=support)
        assert {(r["keep_id"], r["group_size"]) for r in out.filter("doc_id < 300").collect()} == {(0, 300)} and out.filter("kept").count() == 51


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(prints, most=3):
    """(id, fingerprint) pairs to the smallest id of each one's group."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, f), (j, g) in itertools.combinations(prints, 2):
        if bin(f ^ g).count("1") <= most:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def test_fingerprint_is_the_plain_one(spark):
    texts = ["", None, "One", "a B", "É À ß a b c", "x y z\x0bw", LONG, "a b c a b c a b c"]
    assert [simhash.fingerprint(t or "") for t in texts] == [plain_fingerprint(t) for t in texts]
    native = spark.createDataFrame([("One two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest("One two three", 42)


def test_near_against_plain(spark):
    r = random.Random(3)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(r.randint(30, 400))] for _ in range(25)]
    rows = []
    for i in range(250):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = f"new{r.randint(0, 9)}"
        rows.append((i * 7 % 251, " ".join(words), "x"))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    want = plain_components(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in prints}
    assert len(set(want.values())) < len(set(f for _, f in prints))  # some links are between different fingerprints


def test_covering_finds_every_pair_within_three_bits():
    rng = np.random.default_rng(5)
    f = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for flips in (1, 2, 3):
        for _ in range(20):
            g = f.copy()
            for k in range(len(g)):
                for b in rng.choice(64, flips, replace=False):
                    g[k] ^= np.uint64(1) << np.uint64(b)
            both = np.concatenate([f, g])
            where, rows = simhash.anchors(both)
            sent = {}
            for a, r in zip(where.tolist(), rows.tolist(), strict=True):
                sent.setdefault(r, set()).add(a)
            for k in range(len(f)):
                shared = sent[k] & sent[k + len(f)]
                assert any(simhash.covered(a, both[[k, k + len(f)]]).any() for a in shared)


def test_large_anchor_is_compared_by_blocks():
    rng = np.random.default_rng(6)
    f = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)) ^ (rng.integers(0, 4, 4000, dtype=np.uint64) << np.uint64(60)))
    home = np.ones(len(f), dtype=bool)
    assert len(f) > simhash.PAIRWISE
    got = {(min(i, j), max(i, j)) for a, b in simhash.linked(f, home) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    assert got == {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j}


def test_near_edges(spark):
    out = simhash.near_duplicates(frame(spark, EDGES)).collect()
    assert len(out) == len(EDGES)
    zero = [r for r in out if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in out if r["fingerprint"] == f"{plain_fingerprint('same text here and there'):016x}"} == {7}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(None, "a b c d", "x")])).first()["component_id"] is None
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "f long"), most=4)


def test_components_of_chains_stars_and_rings(spark):
    r = random.Random(9)
    names = list(range(300))
    r.shuffle(names)
    pairs = [(names[i], names[i + 1]) for i in range(120)] + [(names[130], names[i]) for i in range(131, 200)] + [(names[200 + i], names[200 + (i + 1) % 40]) for i in range(40)] + [(5, 5)]
    got = {x["a"]: x["b"] for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    for part in (names[:121], names[130:200], names[200:240]):
        low = min(part)
        assert all(got.get(i, i) == low for i in part)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(rows, least=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_lines_against_plain(spark):
    r = random.Random(11)
    pool = ["short", "a line of some length", " A Line of some length\t", "éèê éèê é", "éèêéèêéèê", "ten chars!", "nine char", "x" * 50, "", " spaced out line "] + [f"own line number {i}" for i in range(60)]
    rows = [(i * 13 % 401, "\n".join(r.choice(pool) for _ in range(r.randint(0, 15))), "x") for i in range(400)]
    df = frame(spark, rows).repartition(7)
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["text"]) for x in line_dedup.dedup_lines(df).collect()}
    want = plain_lines(rows)
    assert got == want
    whole = line_dedup.drop_repeated_lines(df)
    assert whole.columns == df.columns
    assert {x["doc_id"]: x["text"] for x in whole.collect()} == {i: t for i, (_, _, t) in want.items()}


def test_keep_bitmaps(spark):
    rows = [(1, "first long line\nshort\nsecond long line", "x"), (2, "second long line\nthird long line", "x")]
    _, docs = line_dedup.addressed(frame(spark, rows), "doc_id", "text")
    maps = line_dedup.keep_bitmaps(docs).join(docs.select("doc", "file", "row"), ["file", "row"])
    got = {r["doc"]: line_dedup.unpack_bitmap(r["keep"], r["n_lines"]).tolist() for r in maps.collect()}
    assert got == {1: [True, True, True], 2: [False, True]}


def test_line_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "a repeated long line", "b"), (None, "a repeated long line", "b"), (5, "a repeated long line\n", "c"), (5, "A REPEATED LONG LINE\nand one more of them", "c"), (6, LONG, None)]
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=repr)
    want = [(1, "", 1, 0), (2, "", 1, 0), (None, "", 1, 1), (None, "", 1, 1), (5, "a repeated long line\n", 2, 0), (5, "A REPEATED LONG LINE\nand one more of them", 2, 0), (6, LONG, 1, 0)]
    assert got == sorted(want, key=repr)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_addresses(spark, tmp_path):
    """Files in several splits, filtered, renamed and joined tables, a column named like Spark's own, and chunks of few rows."""
    r = random.Random(12)
    rows = [(i, "\n".join(f"a line of number {r.randint(0, 300)}" for _ in range(r.randint(0, 9))), "x") for i in range(900)]
    want = {i: t for i, (_, _, t) in plain_lines(rows).items()}
    frame(spark, rows).repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    assert line_dedup._scans_files(files) and line_dedup._scans_files(files.filter("doc_id >= 0").select("doc_id", "text"))
    others = spark.createDataFrame([(i,) for i in range(900)], "doc_id long")
    for df in (files, files.filter("doc_id >= 0").withColumnRenamed("source", "_metadata"), files.join(others, "doc_id"), files.unionByName(files.limit(0))):
        whole = line_dedup.drop_repeated_lines(df)
        assert whole.columns == df.columns
        assert {x["doc_id"]: x["text"] for x in whole.collect()} == want
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_come_back_by_address(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.Bitmaps, "CHUNK", 4)
    maps = [(f, i, 3, i % 3, bytes([f % 7, i])) for f in (-5, 11, 2**62) for i in range(30)]
    kept = line_dedup.Bitmaps.write(spark.createDataFrame(maps, "file long, row long, n_lines int, n_dropped int, keep binary"))
    kept.CHUNK = 4
    got = kept.of(np.array([m[0] for m in maps]), np.array([m[1] for m in maps]))
    assert got == [m[4] if m[3] else None for m in maps]


def test_largest_id_is_no_null(spark):
    top = 2**63 - 1
    rows = [(top, "one line that is long\nmore of it", "a"), (None, "one line that is long\nother of it", "a"), (None, "other of it!", "a")]
    got = sorted(((x["doc_id"], x["n_dropped"]) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(top, 0), (None, 1), (None, 0)], key=repr)
    near = sorted(((x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(frame(spark, [(top, "a b c d", "x"), (None, "a b c d", "x"), (None, "e f g h", "x")])).collect()), key=repr)
    assert near == sorted([(top, top), (None, top), (None, None)], key=repr)


def test_first_occurrences_across_batches():
    import pyarrow as pa

    h = [(1, 1), (1, 1), (1, 1), (1, 2), (2, 2), (2, 2)]
    doc = [5, 5, 6, 7, 8, 9]
    doc = np.array(doc)
    table = line_dedup._table(np.array(h), [doc, np.zeros(6, dtype=bool), doc * 10, doc], np.arange(6, dtype=np.int32), np.full(6, 9, dtype=np.int32), None)
    for size in range(1, 7):
        out = [x for b in line_dedup.later_ones(iter([table.slice(i, size) for i in range(0, 6, size)])) for x in b.column("row").to_pylist()]
        assert out == [6, 9], size
    assert isinstance(table, pa.RecordBatch)


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard_components(texts):
    """Indices to the smallest index of each one's group, all pairs compared."""
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in root]


def edited_texts(seed):
    """Copies with zero to many edits: a large group, small ones, one passage in all, short and blank texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 3000)}"
    passage = [word() for _ in range(12)]
    base = [[word() for _ in range(r.choice([5, 8, 9, 12, 30, 120, 300]))] for _ in range(40)]
    texts = [None, "", " \n", "One", "one", "A b c d", "a b c d", "a b c d e"]
    for k in range(420):
        words = list(base[0] * 3 if k < 120 else r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 1)] = [word() for _ in range(r.randint(0, 2))]
        texts.append(r.choice([" ", "\n ", "\t"]).join([w.upper() if r.random() < 0.1 else w for w in words + passage * (k % 3 == 0)]))
    return texts


def test_similar_texts_against_all_pairs(spark, monkeypatch):
    texts = edited_texts(11)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    want = jaccard_components(texts)
    assert 20 < len(set(want)) < len({frozenset(plain_shingles(t)) for t in texts})
    for most in (shingle_dedup.MOST_COMMON, 1):  # the order of the shingles has no part in the result
        monkeypatch.setattr(shingle_dedup, "MOST_COMMON", most)
        groups = {}
        for r in shingle_dedup.near_copies(docs).collect():
            groups.setdefault(r["component"], []).append(r["row"])
        assert {i: min(g) for g in groups.values() for i in g} == dict(enumerate(want))
    assert shingle_dedup.near_copies(docs.limit(0)).count() == 0


def test_similar_texts_in_small_blocks(spark, monkeypatch):
    """Shingles dealt over blocks and cells, and hot keys over tasks, give the same groups."""
    monkeypatch.setattr(shingle_dedup, "SAMPLE", 0.5)
    monkeypatch.setattr(shingle_dedup, "HEAVY", 2)
    monkeypatch.setattr(shingle_dedup, "FEW", 2)
    monkeypatch.setattr(shingle_dedup, "BLOCK", 5)
    monkeypatch.setattr(shingle_dedup, "HOT", 4)
    monkeypatch.setattr(shingle_dedup, "MOST_BITS", 256)
    texts = edited_texts(13)
    groups = {}
    for r in shingle_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect():
        groups.setdefault(r["component"], []).append(r["row"])
    assert {i: min(g) for g in groups.values() for i in g} == dict(enumerate(jaccard_components(texts)))


def test_bitmaps_lose_no_similar_pair():
    rng = np.random.default_rng(8)
    sets = []
    for n in (3, 9, 31, 33, 70, 127, 129, 500, 900):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.2, 0.3, 0.6):
            k = int(n * share)
            sets.append(np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)])))
    got = {(min(i, j), max(i, j)) for a, b in shingle_dedup.possibly_alike(np.array([len(s) for s in sets]), [shingle_dedup.bitmap(s) for s in sets]) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    alike = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    assert alike <= got and len(got) < 2 * len(alike)


def test_pipeline_stage_drops_all_similar_texts(spark):
    import corpus_pipeline as p

    texts = edited_texts(12)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in p.dedup_near(spark, docs, "").collect()} == set(jaccard_components(texts))


def test_pipeline_stage_goes_through_simhash(spark, monkeypatch):
    """With prefix filtering off, what SimHash's fingerprints bring together is linked, and only if it is alike."""
    import corpus_pipeline as p

    print_of = lambda t: simhash.majority(shingle_dedup.shingles(t))
    r = random.Random(15)
    word = lambda: f"w{r.randint(0, 3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        for k in range(8):
            at = r.randrange(400)
            texts.append(" ".join(base[:at] + [word()] * (k > 0) + base[at + 1 :]))
    head = [word() for _ in range(13)]
    tails = [" ".join(head + [word(), word(), word()]) for _ in range(500)]  # 9 of 15 shingles in common
    prints = [print_of(t) for t in tails]
    close = [(i, j) for i, j in itertools.combinations(range(len(tails)), 2) if 0 < (prints[i] ^ prints[j]).bit_count() <= 3]
    texts += [tails[i] for i in close[0]]
    groups = plain_components([(i, print_of(t)) for i, t in enumerate(texts)])
    assert groups[len(texts) - 1] == len(texts) - 2 and 12 < len(set(groups.values())) < len(texts) - 24
    groups[len(texts) - 1] = len(texts) - 1
    monkeypatch.setattr(shingle_dedup, "prefix", lambda n: 0)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in p.dedup_near(spark, docs, "").collect()} == set(groups.values())


def test_pipeline_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as p

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, a), (None, b), (4, b), (9, b), (7, c), (7, c), (None, "alone in the whole wide world")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in p.dedup_near(spark, docs, "").collect()), key=lambda x: x[1])
    assert got == [(None, a), (None, "alone in the whole wide world"), (4, b), (7, c)]


def test_drop_duplicates_keeps_one_row_of_each_text(spark):
    docs = frame(spark, [*EDGES, (None, "a text of its own", "d")]).withColumns({"__row": F.lit("mine"), "rid": F.lit("mine"), "row": F.lit("mine")})
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns and got.filter("__row = 'mine' and rid = 'mine' and row = 'mine'").count() == got.count()
    rows = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=lambda x: x[1])
    assert rows == sorted([(3, " \n\t"), (7, "same  text here\nand there"), (8, LONG), (9, LONG + "!"), (None, "a text of its own")], key=lambda x: x[1])
