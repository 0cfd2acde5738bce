"""Encoding, packing and token files."""

import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timeweave.llm import packing, token_file, tokens

DOCS = "doc_id long, text string, source string"
ODD = ["", " ", "Å İ J̌ ΣΑΣ don't it's a's9b <|endoftext|>x É́ 日本語 ÀB,'s x y z a.b.c it'll, \x1c\x85 ª² ½", "Ünï\x00 ſ ŉ", "The the THE, the. (the) the's", "ß straße STRASSE", "a" * 500, "1234 12a a12 ١٢"]
LONG = " ".join(f"word{i % 977} Ünïcode." for i in range(20_000))
ODD += ["“The” Ünïcode, ÜNÏCODE… THE The’s É É… ÀB" + LONG[:200].upper()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def want(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_word_memory_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 5)
    code = tokens.Encoder(tokens.default_path())
    for texts in ([LONG], ODD, ODD[::-1], [x + " the end" for x in ODD], [LONG[:3000]]):
        assert [x.tolist() for x in code.encode(texts)] == [want(tokenizer, t) for t in texts]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("ids", "start", "bucket", "n_tokens", "part")})


ROWS = [(3, LONG, "a"), (1, None, None), (2, "", "b"), (None, "no id", "b"), (7, "twice", "c"), (7, "twice", "c"), *[(10 + i, t, "d") for i, t in enumerate(ODD)]]


def test_pieces(spark, tokenizer):
    out = packing.pack(frame(spark, ROWS)).collect()
    assert len({r["sequence_id"] for r in out}) == len(out)
    texts = sorted(repr((i, want(tokenizer, t))) for i, t, _ in ROWS)
    docs, at = [], {}
    for r in sorted(out, key=lambda r: (r["start"], r["sequence_id"])):
        assert r["length"] == 1 << r["bucket"] == len(r["ids"]) <= 4096 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        at.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (i, n), pieces in at.items():
        copies = sum(p["start"] == 0 for p in pieces)
        for c in range(copies):
            ids = [x for p in pieces[c::copies] for x in p["ids"]]
            assert len(ids) == n
            docs.append(repr((i, ids)))
    assert sorted(docs) == texts
    assert packing.pack(frame(spark, [])).count() == 0


def test_binary_lengths():
    for n in [*range(1, 300), 4095, 4096, 4097, 12_345]:
        x = packing.binary_lengths(n)
        assert sum(x) == n and x == sorted(x, reverse=True) and all(m & (m - 1) == 0 for m in x)
        assert len([m for m in x if m < 4096]) == bin(n % 4096).count("1")
    with pytest.raises(ValueError):
        packing.pack(None, longest=1000)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
def test_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_000).astype(np.uint32)
    ids[::90] = rng.integers(0, 2**32 - 1, len(ids[::90]), dtype=np.uint32)
    docs = np.split(ids, sorted(rng.integers(0, n + 1, 4)))
    f = io.BytesIO()
    w = token_file.Writer(f)
    w.add([1, 2], docs[:2])
    w.add([None, 4, 5], docs[2:])
    w.close()
    r = token_file.Reader(f, f.tell())
    got = [(i, m, np.concatenate([np.zeros(0, dtype=np.uint32), *parts])) for i, m, parts in r.documents(1000)]
    assert [(i, m) for i, m, _ in got] == list(zip([1, 2, None, 4, 5], map(len, docs), strict=True))
    assert all(np.array_equal(a, b) for (_, _, a), b in zip(got, docs, strict=True))
    for a, b in ((0, n), (n // 3, n // 2), (n, n)):
        assert np.array_equal(r.ids(a, b), ids[a:b])


def test_blocks_patch_their_outliers():
    ids = np.tile(np.arange(256, dtype=np.uint32) % 16 + 1000, (3, 1))
    ids[1, 7] = 3_000_000_000
    data, index = token_file.encode_blocks(ids, 8)
    assert index["minimum"].tolist() == [1000] * 3 and index["width"].tolist() == [4] * 3 and index["exceptions"].tolist() == [0, 1, 0]
    assert index["start"].tolist() == [8, 8 + 128, 8 + 2 * 128 + 6]
    assert np.array_equal(token_file.decode_blocks(np.frombuffer(data, dtype=np.uint8), index, 8), ids)


def test_wrong_file():
    with pytest.raises(ValueError):
        token_file.Reader(io.BytesIO(b"x" * 100), 100)


def test_documents_round_trip(spark, tokenizer):
    got = [tuple(r) for r in token_file.round_trip(frame(spark, ROWS)).collect()]
    expected, at = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = want(tokenizer, t)
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert token_file.round_trip(frame(spark, [])).count() == 0


def test_random_texts_and_slices(monkeypatch):
    """Capitals, marks that compose with small letters alone, odd white space, added tokens; small caches."""
    import pyarrow as pa

    from timeweave.llm import tokens

    monkeypatch.setattr(tokens, "MOST_KEPT", 500)
    code = tokens.Encoder(tokens.default_path())
    rng = np.random.default_rng(3)
    pool = [*"aAbBjJhHtTwWyYzZéÉßİıſKÅσΣς", "̌", "̱", "̈", "̊", "́", *"  \n\t\x0b\x0c\r", " ", " ", "\x1c", "\x85", ".", ",", "!?", '"', "(", ")", "12", "the", "THE", "'s", "don't", "-", "_", "<|endoftext|>", "日", "😀", "ﬁ"]
    texts = ["".join(rng.choice(pool, int(rng.integers(0, 40)))) for _ in range(3000)]
    texts += [f"a{c}.{c}b! {c}{c}, {c}" for c in map(chr, range(1, 384))]
    plain = lambda xs: [[*x.ids, 2] for x in code.tokenizer.encode_batch(xs, add_special_tokens=False)]
    assert [x.tolist() for x in code.encode(texts)] == plain(texts)
    some = pa.array([None, "x", *texts[:50], None, ""]).slice(1, 52)
    assert [x.tolist() for x in code.encode(some)] == plain([t or "" for t in some.to_pylist()])
    assert code.encode([]) == [] and [x.tolist() for x in code.encode([""], None)] == [[]]
