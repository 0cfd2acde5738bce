"""Quality classifier from weak labels.

1. Heuristic labellers vote good, bad or nothing on every document.  Only the
   number of documents of each vote pattern leaves the executors: at most
   3 ^ (number of labellers) rows, whatever the corpus.
2. Expectation-maximisation on these counts estimates how often each labeller
   is right, without any true label.  The labellers overlap and contradict each
   other, so a pattern's posterior weighs them against each other.
3. Posteriors are the soft labels from which a logistic scorer on hashed
   features is fitted: words, shapes of words, and coarse statistics.  The fit
   takes a sample of about ``TRAIN_ROWS`` rows, drawn row by row over the whole
   table; everything else covers all rows.
4. The scorer, one vector of fixed size, judges every document.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.workspace import batches, release, table, tidied

TRAIN_ROWS, SEED = 8192, 5
BITS, EPOCHS, BATCH, RATE, DECAY = 18, 12, 128, 0.3, 1e-6
THRESHOLD = 0.5
NONE, GOOD, BAD = 0, 1, 2

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>~^=_\\{}[]@"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_SHAPE = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 48 if 48 <= c < 58 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


@dataclass
class Facts:
    """What labellers and features need of one document; shares lie in 0..1."""

    n: int
    symbols: float
    capitals: float
    stutter: float
    variety: float
    letterless: float
    length: float
    windows: float
    lines: float
    words: Counter
    shapes: Counter


def facts(text: str) -> Facts:
    data = text.encode()
    lower = data.lower()
    words = lower.split()
    n = len(words)
    counts = Counter(words)
    letters = len(data) - len(data.translate(None, _LETTERS)) + len(text) - len(text.encode("ascii", "ignore"))
    folded = text.lower()
    capitals = sum(map(str.isupper, text)) if len(folded) != len(text) else _differing(text, folded)
    blocks = [words[i : i + 200] for i in range(0, n, 200)]
    lines = [x for x in lower.split(b"\n") if x.strip()]
    return Facts(
        n=n,
        symbols=(len(data) - len(data.translate(None, _SYMBOLS))) / max(1, n),
        capitals=capitals / max(1, letters),
        stutter=sum(map(eq, words, words[1:])) / max(1, n),
        variety=sum(len(set(b)) for b in blocks) / max(1, n),
        letterless=sum(c for w, c in counts.items() if not _LETTER.search(w)) / max(1, n),
        length=(len(text) - n) / max(1, n),
        windows=_recurring(words) / max(1, n),
        lines=1 - len(set(lines)) / max(1, len(lines)),
        words=counts,
        shapes=Counter(data.translate(_SHAPE).split()),
    )


def _differing(a: str, b: str) -> int:
    return int((np.frombuffer(a.encode("utf-32-le"), dtype="<u4") != np.frombuffer(b.encode("utf-32-le"), dtype="<u4")).sum())


def _recurring(words: list[bytes], size: int = 5) -> int:
    """Windows of five words that occur before."""
    if len(words) <= size:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - size + 1 + k]
    return len(mixed) - len(np.unique(mixed))


def _plain(f: Facts) -> bool:
    return f.symbols < 0.1 and f.capitals < 0.2 and f.letterless < 0.2


def _varied(f: Facts) -> bool:
    return _plain(f) and f.variety > 0.6 and f.stutter < 0.1 and f.windows < 0.15


def _prose(f: Facts) -> bool:
    return _plain(f) and 3.5 <= f.length <= 6.8 and f.lines < 0.4 and f.stutter < 0.1


def _finds(fault):
    return lambda f: BAD if fault(f) else NONE


def _both(n: int, good):
    return lambda f: NONE if f.n < n else GOOD if good(f) else BAD


#: The first eight know one fault each and are silent otherwise; the last three judge
#: the whole, and overlap with each other and with the former.
LABELLERS = (
    ("symbols", _finds(lambda f: f.symbols > 0.2)),
    ("capitals", _finds(lambda f: f.n >= 5 and f.capitals > 0.35)),
    ("stutter", _finds(lambda f: f.n >= 5 and f.stutter > 0.2)),
    ("monotony", _finds(lambda f: f.n >= 10 and f.variety < 0.4)),
    ("letterless", _finds(lambda f: f.n >= 5 and f.letterless > 0.3)),
    ("odd lengths", _finds(lambda f: f.n >= 10 and not 2.5 <= f.length <= 12)),
    ("repeated windows", _finds(lambda f: f.n >= 10 and f.windows > 0.35)),
    ("repeated lines", _finds(lambda f: f.lines > 0.6)),
    ("plain", _both(10, _plain)),
    ("varied", _both(20, _varied)),
    ("prose", _both(20, _prose)),
)


def votes(f: Facts) -> int:
    """All votes as one number to base 3."""
    out = 0
    for _, labeller in reversed(LABELLERS):
        out = 3 * out + labeller(f)
    return out


def unpack_votes(codes: np.ndarray) -> np.ndarray:
    """A row per code, a column per labeller."""
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """``right[j]``: how often labeller j is right when it votes."""

    prior_bad: float
    right: np.ndarray

    def bad(self, pattern: np.ndarray) -> np.ndarray:
        """Posterior of bad for rows of votes."""
        sign = np.where(pattern == BAD, 1, np.where(pattern == GOOD, -1, 0))
        odds = np.log(self.prior_bad / (1 - self.prior_bad)) + sign @ np.log(self.right / (1 - self.right))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_labels(pattern: np.ndarray, n: np.ndarray, steps: int = 200, tolerance: float = 1e-7) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    A labeller that doesn't vote says nothing.  The start takes any vote of bad
    as a sign of it, which settles which class is which.  No accuracy leaves
    [0.05, 0.999], so no labeller overrules all others.
    """
    bad = np.where((pattern == BAD).any(axis=1), 0.9, 0.01)
    prior, right = 0.5, np.full(pattern.shape[1], 0.5)
    for _ in range(steps):
        before = right
        agrees = np.where(pattern == BAD, bad[:, None], 1 - bad[:, None])
        voted = n[:, None] * (pattern != NONE)
        right = np.clip(((voted * agrees).sum(axis=0) + 1) / (voted.sum(axis=0) + 2), 0.05, 0.999)
        prior = float(np.clip(((n * bad).sum() + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6))
        bad = LabelModel(prior, right).bad(pattern)
        if np.abs(right - before).max() < tolerance:
            break
    return LabelModel(prior, right)


@functools.lru_cache(maxsize=1 << 16)
def _shape_index(shape: bytes) -> int:
    return zlib.crc32(b"shape " + _RUNS.sub(rb"\1", shape)) & ((1 << BITS) - 1)


def features(f: Facts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and values; a number may come more than once.

    Words and shapes each have unit length; each statistic sets one of ten boxes.
    """
    mask = (1 << BITS) - 1
    crc = zlib.crc32
    words = np.fromiter((crc(w) & mask for w in f.words), dtype=np.int32, count=len(f.words))
    tf = np.sqrt(np.fromiter(f.words.values(), dtype=np.float32, count=len(f.words)))
    shapes = np.fromiter(map(_shape_index, f.shapes), dtype=np.int32, count=len(f.shapes))
    sf = np.fromiter(f.shapes.values(), dtype=np.float32, count=len(f.shapes)) / max(1, f.n)
    shares = {"symbols": f.symbols, "capitals": f.capitals, "stutter": f.stutter, "variety": f.variety, "letterless": f.letterless, "windows": f.windows, "lines": f.lines, "length": f.length / 15, "n": np.log2(f.n + 1) / 20}
    boxes = np.array([crc(f"{k} {min(9, int(v * 10))}".encode()) & mask for k, v in shares.items()], dtype=np.int32)
    scale = 0.3 / max(1e-6, float(np.sqrt((tf * tf).sum())))
    return np.concatenate([words, shapes, boxes]), np.concatenate([tf * scale, sf, np.full(len(boxes), 0.5, dtype=np.float32)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Logistic weights (the last is the bias) on soft labels, by AdaGrad in fixed order.

    Both classes weigh the same in sum, at most by a factor of 20.
    """
    w = np.zeros((1 << BITS) + 1, dtype=np.float64)
    square = np.full_like(w, 1e-8)
    if not len(rows):
        return w.astype(np.float32)
    share = float(np.clip(bad.mean(), 1e-3, 1 - 1e-3))
    weight = bad * min(20.0, 0.5 / share) + (1 - bad) * min(20.0, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            take = order[at : at + BATCH]
            sizes = [len(rows[i][0]) for i in take]
            idx = np.concatenate([rows[i][0] for i in take])
            val = np.concatenate([rows[i][1] for i in take]).astype(np.float64)
            owner = np.repeat(np.arange(len(take)), sizes)
            z = np.bincount(owner, weights=w[idx] * val, minlength=len(take)) + w[-1]
            gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad[take]) * weight[take] / len(take)
            used, where = np.unique(idx, return_inverse=True)
            g = np.bincount(where, weights=gap[owner] * val) + DECAY * w[used]
            square[used] += g * g
            w[used] -= RATE * g / np.sqrt(square[used])
            b = gap.sum()
            square[-1] += b * b
            w[-1] -= RATE * b / np.sqrt(square[-1])
    return w.astype(np.float32)


@dataclass
class Classifier:
    """Without weights (no row was drawn) the label model's posterior is the score."""

    labels: LabelModel
    weights: np.ndarray | None

    def bad(self, f: Facts) -> float:
        if self.weights is None:
            return float(self.labels.bad(unpack_votes(np.array([votes(f)], dtype=np.int64)))[0])
        idx, val = features(f)
        z = float(self.weights[idx].astype(np.float64) @ val) + float(self.weights[-1])
        return 1 / (1 + float(np.exp(-np.clip(z, -50, 50))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Classifier:
    """Votes over all rows, label model, and the scorer from a bounded sample.

    The sample comes to the driver as hashed vectors, at most 2 ** BITS numbers a
    row.  It follows the order of the stored rows, so it is the same on every run
    over the same files.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield pa.RecordBatch.from_arrays([pa.array([votes(facts(t)) for t in b.column("text").to_pylist()], pa.int32())], ["votes"])

    counted = rows.select("text").mapInArrow(tidied(vote), "votes int").groupBy("votes").count().collect()  # 3 ^ labellers at most
    counted.sort(key=lambda r: r["votes"])
    codes, n = np.array([r["votes"] for r in counted], dtype=np.int64), np.array([r["count"] for r in counted], dtype=np.float64)
    if not len(codes):
        return Classifier(LabelModel(0.5, np.full(len(LABELLERS), 0.5)), None)
    model = fit_labels(unpack_votes(codes), n)

    # each row has a draw of its own, however many are alike: a binomial number of mean train_rows at most
    number = F.xxhash64(F.lit(SEED), F.monotonically_increasing_id(), "doc_id", F.length("text"))
    drawn = rows.withColumn("draw", F.pmod(number, F.lit(1 << 40))).filter(F.col("draw") < int(min(1.0, train_rows / n.sum()) * (1 << 40)))

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [facts(t) for t in b.column("text").to_pylist()]
            vectors = [features(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([votes(f) for f in found], pa.int32()), pa.array([i.tobytes() for i, _ in vectors], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in vectors], pa.binary())], ["votes", "idx", "val"])

    sample = drawn.select("text").mapInArrow(tidied(describe), "votes int, idx binary, val binary").collect()
    if not sample:
        return Classifier(model, None)
    # one order makes the fit the same on every run
    sample.sort(key=lambda r: (r["votes"], bytes(r["idx"])))
    bad = model.bad(unpack_votes(np.array([r["votes"] for r in sample], dtype=np.int64).reshape(-1)))
    vectors = [(np.frombuffer(r["idx"], dtype=np.int32), np.frombuffer(r["val"], dtype=np.float32)) for r in sample]
    return Classifier(model, fit_scorer(vectors, bad))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, n_words, label_bad`` (the label model's
    posterior), ``score_bad`` (the scorer's), ``kept`` (score at most ``threshold``).

    A null text counts as empty; empty and very short texts get few votes, so
    the scorer decides.  Null ids and repeated rows are judged like any other.
    An empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, train_rows))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches(it):
            found = [facts(t or "") for t in b.column("text").to_pylist()]
            score = np.array([m.bad(f) for f in found], dtype=np.float64)
            label = m.labels.bad(unpack_votes(np.array([votes(f) for f in found], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f.n for f in found], pa.int64()), pa.array(label), pa.array(score), pa.array(score <= threshold)], ["doc_id", "n_words", "label_bad", "score_bad", "kept"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_words long, label_bad double, score_bad double, kept boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        stays = pa.array([model.value.bad(facts(t or "")) <= threshold for t in texts.to_pylist()], pa.bool_())
        release()
        return stays

    return docs.filter(good(docs[text_col]))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"))
