"""Quality rules as a short-circuit cascade (DataFrame operations only).

Every rule rejects a document by one condition.  On a Bernoulli sample of about
``SAMPLE_ROWS`` rows, written once to the shared folder, each rule is run alone:
its share of rejected rows is its selectivity, its time over that of a run
without any rule is its cost.  The rules then form one CASE expression in
falling order of rejections per cost.  Spark evaluates a CASE branch by branch,
so a document pays for no rule after the one that rejects it.  The order changes
the time and the name of the rejecting rule, never which documents stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.workspace import BLANKS, columns_of, stored, table, without_blanks

WINDOW = 5
SAMPLE_ROWS, SAMPLE_SEED, RUNS = 2000, 11, 2


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[], Column]


def _stutters() -> Column:
    words = F.col("words")
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))) * 5 > F.col("n_words")


def _letterless() -> Column:
    return F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))) * 2 > F.col("n_words")


#: The base metrics of a document are at hand; what else a rule needs it computes itself.
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 10),
    Rule("repeated_windows", lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20)),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 2 > F.col("n_lines")),
    Rule("capitals", lambda: F.regexp_count("text", F.lit(r"\p{Lu}")) * 2 > F.col("word_chars")),
    Rule("stutter", _stutters),
    Rule("letterless", _letterless),
)
BASE = ("few_words", "repeated_windows")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, words, n_lines`` and the base metrics, one row per input row."""
    df = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    spaced = F.translate("text", BLANKS[1:], " " * len(BLANKS[1:]))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(without_blanks(x)) > 0)
    df = df.select("doc_id", "text", F.array_remove(F.split(spaced, " "), "").alias("words"), lines.alias("lines"))
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    df = df.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(without_blanks(F.col("text"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window)).alias("hashes"),
    )
    df = df.withColumn("recurs", F.coalesce(F.size("hashes") > F.size(F.array_distinct("hashes")), F.lit(False)))
    df = df.withColumn("n_repeat_words", F.when(F.col("recurs"), repeat_words()).otherwise(F.lit(0)).cast("long")).drop("hashes", "recurs")
    # one row out for one in: no later filter passes below this, to compute the arrays again for each of their elements
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def repeat_words() -> Column:
    """Words in windows that occur twice or more, for documents with a recurring window hash.

    Sorting (hash, position) brings windows of one hash together; those that
    share it with a neighbour are sorted again with their words, so that a
    window counts only if its words recur.  The covered words are then the
    union of intervals of five from the sorted starts.
    """

    def shared(pairs: Column, same: Callable[[Column, Column], Column]) -> Column:
        def keep(x: Column, i: Column) -> Column:
            return F.coalesce((i > 0) & same(x, F.get(pairs, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(pairs, i + 1)), F.lit(False))

        return F.filter(pairs, keep)

    # each step is bound to a lambda's variable, so that it is computed once
    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    numbered = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # word by word, as taking a slice would copy the whole array every time
    spell = lambda x: F.struct(*[F.get("words", x["i"] + k).alias(f"w{k}") for k in range(WINDOW)])
    spelled = lambda x: F.struct(x["h"].alias("h"), spell(x).alias("w"), x["i"].alias("i"))
    gap = lambda starts: lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW)))
    return let(
        numbered,
        lambda a: let(
            F.sort_array(F.transform(shared(a, lambda x, y: x["h"] == y["h"]), spelled)),
            lambda b: let(
                F.sort_array(F.transform(shared(b, lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"])), lambda x: x["i"])),
                lambda starts: F.aggregate(F.transform(starts, gap(starts)), F.lit(0), lambda s, x: s + x),
            ),
        ),
    )


def ordered(docs: DataFrame, rules: Sequence[Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules by rejections per cost, with both: (rule, share rejected, seconds).

    The sample is of ``sample_rows`` rows in the mean, drawn over the whole
    table before anything is measured; it settles the order only.
    """
    rows = docs.count()
    if rows == 0:
        return [(r, 0.0, 0.0) for r in rules]
    drawn = docs.select(id_col, text_col).sample(fraction=min(1.0, sample_rows / rows), seed=SAMPLE_SEED)
    sample = stored(measured(stored(drawn, "rule-texts"), id_col, text_col), "rule-sample")

    def run(condition: Column) -> tuple[float, float]:
        took, found = [], 0.0
        for _ in range(RUNS):
            began = time.perf_counter()
            # the sum of lengths makes every run read the same columns
            r = sample.agg(F.avg(condition.cast("int")).alias("x"), F.sum(F.length("text") + F.size("words"))).first()
            took.append(time.perf_counter() - began)
            found = r["x"] or 0.0
        return min(took), found

    empty, _ = run(F.lit(False))
    out = []
    for rule in rules:
        seconds, share = run(rule.rejects())
        out.append((rule, share, max(seconds - empty, 1e-4)))
    return sorted(out, key=lambda x: (-x[1] / x[2], x[0].name))


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null for documents that stay."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base metrics, ``base_failed``, ``rejected_by`` and ``kept``.

    Null texts have no words and fail ``few_words``; null ids and repeated rows
    are judged like any other; an empty table gives no rows; other columns are
    ignored.
    """
    frame = measured(docs, id_col, text_col)
    order = [r for r, _, _ in ordered(docs, rules, id_col, text_col)]
    base = {r.name: r for r in RULES if r.name in BASE}
    return frame.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (base["few_words"].rejects() | base["repeated_windows"].rejects()).alias("base_failed"),
        cascade(order).alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def query(spark: SparkSession, folder: str) -> DataFrame:
    return apply_rules(table(spark, folder, "documents")).drop("rejected_by")


SQL = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, i, words[i:i + 4] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM a WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS t(k) GROUP BY doc_id),
m AS (
  SELECT a.doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * n_dup_lines > n_lines
            OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > word_chars
            OR 5 * len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > n_words
            OR 2 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > n_words) AS kept
FROM b
"""
