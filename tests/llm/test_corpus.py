"""Mixing, sharding, the registry and the pipeline."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import mixing, registry, sharding

DOCS = "doc_id long, text string, source string"
FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("s", "size", "n", "part", "hash", "row", "copies", "rank", "key", "shard", "slot", "first")})


def corpus(seed=1, n=600):
    rng = np.random.default_rng(seed)
    sources = ["b", "a", "é", None, "ａ", "Z"]
    return [(int(i), " ".join(["w"] * int(rng.lognormal(4, 1.2))), sources[int(min(5, rng.exponential(1.5)))]) for i in rng.permutation(n)]


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([1000, 10, 10], [3, 1, 2]) == pytest.approx([1490, 20, 20])
    assert mixing.targets([0, 0], [3, 1]) == [0, 0] and mixing.targets([], []) == []
    for sizes in ([5, 900, 3, 77], [0, 10, 10, 10]):
        t = mixing.targets(sizes, [3, 1, 2, 3])
        assert math.fsum(t) == pytest.approx(1.5 * sum(sizes)) and all(a <= 2 * b + 1e-9 for a, b in zip(t, sizes, strict=True))


def test_mix_is_the_tilted_solution(spark):
    rows = corpus()
    df = frame(spark, rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size[i] for i, _, x in rows if x == s) for s in order}
    goals = dict(zip(order, mixing.targets([words[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))]), strict=True))
    for s in order:
        mine = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in mine} == {words[s]} and {round(r["target"], 6) for r in mine} == {round(goals[s], 6)}
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(goals[s], rel=1e-6)
        assert abs(sum(r["taken"] for r in mine) - goals[s]) <= max(2 * min(r["size"] for r in mine) + 5, 0.01 * goals[s])
        # rates below the bound are exponential in the size
        inner = [(r["size"], math.log(r["rate"])) for r in mine if 0 < r["rate"] < 2 and r["size"]]
        slopes = [b / a for a, b in inner]
        assert not slopes or max(slopes) - min(slopes) < 1e-6
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] and math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in out)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}


def test_mix_with_hot_cells_and_edges(spark):
    rows = [(i, "the same ten words in this text here for all", "x") for i in range(400)] + [(1000 + i, None, None) for i in range(5)] + [(2000, "", "y"), (None, "no id", "y"), (7, "w " * 30_000, "z"), (7, "w " * 30_000, "z")]
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for r in out:
        assert abs(taken[r["source"]] - r["target"]) <= max(10, 0.02 * r["target"]) or r["source"] in ("y", "z")
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}


def test_matrix_has_exact_margins_and_the_right_law():
    rng = np.random.default_rng(0)
    for _ in range(30):
        rows = rng.integers(0, 50, 6)
        sizes = rng.multinomial(rows.sum(), [1 / 4] * 4)
        m = sharding.communication_matrix(rows, sizes, int(rng.integers(1e9)))
        assert (m.sum(axis=1) == rows).all() and (m.sum(axis=0) == sizes).all() and (m >= 0).all()
    cells = np.array([sharding.communication_matrix(np.array([6, 4]), np.array([5, 5]), s)[0, 0] for s in range(4000)])
    want = [math.comb(5, k) * math.comb(5, 6 - k) / math.comb(10, 6) for k in range(7)]
    assert np.abs(np.bincount(cells, minlength=7) / 4000 - want).max() < 0.03
    big = [sharding.draw(np.random.default_rng(s), 3 * 10**9, 10**9, 10**6) for s in range(300)]
    assert abs(np.mean(big) - 750_000) < 100 and 350 < np.std(big) < 520


def check_shards(rows, out, n):
    assert len(out) == len(rows) and {r["law"] for r in out} <= {"rows"}
    counts = [sum(r["shard"] == s for r in out) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    for s in range(n):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))


def test_shards(spark):
    rows = corpus(5, 1003)
    df = frame(spark, rows)
    out = sharding.shard_rows(df).collect()
    check_shards(rows, out, 16)
    texts = {i: t for i, t, _ in rows}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]].encode())) for r in out)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(df.repartition(9)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in out}
    # neighbours in the input are spread like any two rows
    near = np.mean([again[i][0] == again[i + 1][0] for i in range(1002)])
    assert abs(near - 1 / 16) < 0.035


def test_shard_edges(spark):
    rows = [(None, None, None)] * 40 + [(1, "é", "a"), (1, "é", "a"), (2, "x" * 100_000, "b")]
    out = sharding.shard_rows(frame(spark, rows), 4).collect()
    check_shards(rows, out, 4)
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] is None} == {(1, 0)}
    assert {r["size"] for r in out if r["doc_id"] == 1} == {3}
    assert sharding.shard_rows(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(frame(spark, []), 0)


def test_shards_of_rows_without_ids_follow_their_texts(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(60)] + [(5, "alike")] * 300, "doc_id long, text string")
    seen = [sorted(tuple(r) for r in sharding.shard_rows(df.repartition(n)).select("text_crc32", "shard", "slot").collect()) for n in (1, 3, 7)]
    assert seen[0] == seen[1] == seen[2]


def test_equal_rows_are_spread(spark, monkeypatch):
    """On a table of one value no partition, range or cell has more than a few times its share."""
    assert sharding.parts_and_cells(100, 16) == (1024, 64)
    parts, cells = sharding.parts_and_cells(10**10, 16)
    assert 10**10 / parts <= 250_000 and 10**10 / 16 / cells <= 250_000 and parts * 4096 <= 2**28
    assert sharding.parts_and_cells(10**10, 4096)[0] == 1024
    df = spark.createDataFrame([(5, "alike", "a")] * 2000, DOCS).repartition(4)
    out = sharding.shard_rows(df).collect()
    check_shards([None] * 2000, out, 16)
    groups = []
    real = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda rows, shards, seed: groups.append(rows) or real(rows, shards, seed))
    sharding.shard_rows(df)
    assert groups[0].sum() == 2000 and groups[0].max() <= 12
    taken = [r["taken"] for r in mixing.mix(df).collect()]
    assert len(taken) == 2000 and sum(taken) == 3000  # words of one text; 150 % of all
    slim = mixing.occurrence(df.withColumn("row", F.monotonically_increasing_id()), ["doc_id"], "row", "nth")
    part = slim.groupBy(F.pmod(F.xxhash64(F.lit(7), "doc_id", F.lit(1), "nth"), F.lit(64)).alias("p")).count()
    assert part.agg(F.max("count")).first()[0] <= 80


LARGER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")


@tables
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    got = registry.QUERIES[name](spark, LARGER)
    con = duckdb.connect()
    for f in os.listdir(LARGER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{LARGER}/{f}')")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@tables
def test_near_duplicates_of_the_whole_table(spark):
    from tests.llm.test_dedup import plain_components, plain_fingerprint

    prints = [(i, plain_fingerprint(r["text"])) for i, r in sorted(documents(spark).items())]
    groups = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op2_simhash_near_dedup"](spark, LARGER).collect()}
    assert got == {i: (f"{f:016x}", groups[i]) for i, f in prints}


def whole_ids(docs):
    from tokenizers import Tokenizer

    from timeweave.llm.tokens import END_ID, default_path

    order = sorted(docs)
    found = Tokenizer.from_file(default_path()).encode_batch([docs[i]["text"] or "" for i in order], add_special_tokens=False)
    return {i: np.array([*e.ids, END_ID], dtype="<u4") for i, e in zip(order, found, strict=True)}


@tables
def test_packed_pieces_and_token_files_of_the_whole_table(spark):
    ids = whole_ids(documents(spark))
    want = []
    for i, x in ids.items():
        at = 0
        while at < len(x):  # the largest power of two that is left, 4096 at most
            n = 1 << (min(4096, len(x) - at).bit_length() - 1)
            want.append((i, at, n, zlib.crc32(x[at : at + n].tobytes()), len(x), 0))
            at += n
    got = registry.QUERIES["op4_power_of_two_packing"](spark, LARGER).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) == len(got)
    start, files = 0, []
    for i, x in ids.items():
        files.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in registry.QUERIES["op5_pfor_token_files"](spark, LARGER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == files


@tables
def test_mix_of_the_whole_table(spark):
    docs = documents(spark)
    got = registry.QUERIES["op7_entropy_balancing"](spark, LARGER).collect()
    size = {i: n_words(r["text"]) for i, r in docs.items()}
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(docs)
    order = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size[i] for i, r in docs.items() if r["source"] == s) for s in order}
    # water level by bisection, another way than the operator's
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 2.0 * sum(words.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], 2 * words[s]) for s in order) < 1.5 * sum(words.values()) else (low, level)
    target = {s: min(high * weight[s], 2 * words[s]) for s in order}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        taken[s] += r["taken"]
        assert r["source_size"] == words[s] and r["target"] == pytest.approx(target[s], rel=1e-9) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in order)


@tables
def test_shards_of_the_whole_table(spark):
    docs = documents(spark)
    got = registry.QUERIES["op10_hypergeometric_sharding"](spark, LARGER).collect()
    check_shards(list(docs), got, 16)
    text = {i: (r["text"] or "").encode() for i, r in docs.items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["grown_shard"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t), None) for i, t in text.items()}
    # a uniform shuffle: slots say nothing about ids (rank correlation of 1000 rows)
    ranks = np.argsort(np.argsort([r["doc_id"] for r in got]))
    place = np.argsort(np.argsort([r["slot"] * 16 + r["shard"] for r in got]))
    assert abs(np.corrcoef(ranks, place)[0, 1]) < 0.12


@tables
def test_classifier_over_the_whole_table(spark):
    """Scores of all rows from weights fitted here, without Spark, on the same rows: all of them are drawn."""
    from timeweave.llm import quality_classifier as qc

    docs = documents(spark)
    facts = {i: qc.facts(r["text"] or "") for i, r in docs.items()}
    codes = np.array([qc.votes(f) for f in facts.values()], dtype=np.int64)
    kinds, n = np.unique(codes, return_counts=True)
    labels = qc.fit_labels(qc.unpack_votes(kinds), n.astype(float))
    rows = sorted(((qc.votes(f), *qc.features(f)) for f in facts.values()), key=lambda x: (x[0], x[1].tobytes()))
    weights = qc.fit_scorer([(i, v) for _, i, v in rows], labels.bad(qc.unpack_votes(np.array([c for c, _, _ in rows]))))
    model = qc.Classifier(labels, weights)
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_quality_classifier"](spark, LARGER).collect()}
    assert set(got) == set(docs)
    sure = {i: model.bad(f) for i, f in facts.items()}
    assert all(got[i]["score_bad"] == pytest.approx(s, abs=0.02) for i, s in sure.items())
    assert all(got[i]["kept"] == (s <= qc.THRESHOLD) for i, s in sure.items() if abs(s - qc.THRESHOLD) > 0.02)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline_stages_do_what_they_say(spark):
    import corpus_pipeline as p
    from tests.llm.test_dedup import jaccard_components

    docs = p.table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES:
        before = docs
        docs = p.stored(stage(spark, docs, FOLDER), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
    good = p.quality_classifier.classify(seen["quality classifier"][0]).filter("kept")
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in seen["quality classifier"][1].select("doc_id").collect()}
    before, after = seen["line dedup"]
    assert {(r["doc_id"], r["text"]) for r in p.line_dedup.dedup_lines(before).collect()} == {(r["doc_id"], r["text"]) for r in after.collect()}
    assert after.filter("n_chars <> length(text)").count() == 0
    before, after = seen["simhash near-dedup"]
    rows = before.orderBy("doc_id").collect()
    assert {r["doc_id"] for r in after.collect()} == {rows[i]["doc_id"] for i in jaccard_components([r["text"] for r in rows])}
    before, after = seen["mixing sources"]
    copies = {r["doc_id"]: r["copies"] for r in p.mixing.mix(before).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()} == copies
    before, after = seen["packing"]
    assert after.filter("start = 0").count() == before.count()
    assert after.agg(F.sum("length")).first()[0] == after.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert p.run(spark, FOLDER).count() == after.count()


def test_pipeline_edges(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "a", 0), (3, "Some words of a text that is here.\nAnother line of the text.", "en", "a", 9)] * 2):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES:
            docs = p.stored(stage(spark, docs, FOLDER), "edges")
        docs.count()


def test_pipeline_leaves_columns_of_any_name_alone(spark):
    import corpus_pipeline as p

    names = ["row", "__row", "doc", "component", "copies", "__copies", "first", "file", "key", "size", "taken", "a.b", "_metadata"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    for name, stage in p.STAGES[:-1]:
        out = p.stored(stage(spark, docs := p.stored(docs, "named"), FOLDER), "named")
        assert out.columns == docs.columns and 0 < out.count(), name
        assert out.filter(" or ".join(f"not `{n}` <=> concat('{n}', doc_id)" for n in names)).count() == 0, name
    assert p.pack_sequences(spark, docs, FOLDER).filter("start = 0").count() == 150


def test_pipeline_mixes_row_by_row(spark):
    import corpus_pipeline as p

    rows = [(i if i is None or i % 3 else None, t, "en", s, k) for k, (i, t, s) in enumerate(corpus(3) + [(7, "w " * n, "a") for n in range(40)])]
    docs = p.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "rows")
    out = p.mix_sources(spark, docs, FOLDER)
    assert out.columns == docs.columns
    taken, most = {}, {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
        most[r["n_chars"]] = most.get(r["n_chars"], 0) + 1
    assert max(most.values()) <= mixing.MOST_COPIES
    want = {}
    for r in mixing.mix(docs).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert taken == {s: n for s, n in want.items() if n}


def test_pipeline_ends_in_token_ids(spark, tmp_path):
    import corpus_pipeline as p

    code = p.packing.encoder(p.packing.default_path())
    texts = ["Some words, and more of them.", "", None, "a longer text " * 2000]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    packed = p.stored(p.pack_sequences(spark, docs, FOLDER), "packed")
    whole = {}
    for r in packed.orderBy("doc_id", "start").collect():
        assert r["length"] == len(r["ids"]) == 1 << r["bucket"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        whole.setdefault(r["doc_id"], []).extend(r["ids"])
    assert whole == {i: ids.tolist() for i, ids in enumerate(code.encode([t or "" for t in texts]))}
    p.packing.write_buckets(packed, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    key = lambda r: (r["sequence_id"], r["doc_id"], r["start"], tuple(r["ids"]), r["bucket"])
    assert sorted(map(key, back.collect())) == sorted(map(key, packed.collect()))
    for folder in (tmp_path / "buckets").glob("bucket=*"):
        assert {len(r["ids"]) for r in spark.read.parquet(str(folder)).collect()} == {1 << int(folder.name.split("=")[1])}
