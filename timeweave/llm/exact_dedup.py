"""Exact deduplication with a heavy-hitter split (DataFrame operations only).

One pass over the texts reduces every row to a digest.  On the digests:

1. a Misra-Gries summary (Spark's ``freqItems``, the same counter scheme of
   Karp, Papadimitriou and Shenker) names every digest that may hold at least
   ``support`` of the rows: at most ``1 / support`` candidates by construction;
2. the candidates are counted exactly, and for those that are frequent indeed
   the row that stays is found by an aggregation that combines on the map side;
3. this table of at most ``1 / support`` rows is broadcast and decides the rows
   of frequent digests where they lie, without moving them;
4. the remaining digests, none of which has ``support`` of the rows, are shuffled
   as usual: an aggregation that combines on the map side finds their winners, and
   a join brings them back.  No group is ever gathered or sorted, so the join may
   split what is still large for a task.

The digest is SHA-256 of the text without white space, so equal digests are
equal texts for every practical purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.workspace import columns_of, numbered, stored, table, without_blanks

SUPPORT = 1 / 1024


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space.  Of equal texts the row
    with the most code points stays, then the smallest id; a null id comes after
    all others, and of rows alike in all this an arbitrary single one stays.
    Null texts count as empty, an empty table gives no rows, and other columns
    are ignored.
    """
    rows = columns_of(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return _decided(rows.withColumn("rid", F.monotonically_increasing_id()), support).drop("rid")


def _decided(rows: DataFrame, support: float) -> DataFrame:
    """The columns of ``exact_duplicates`` and ``rid`` for ``rows(doc_id, text, rid)`` without null texts."""
    digests = stored(
        rows.select("doc_id", F.length("text").alias("n"), F.sha2(without_blanks(F.col("text")), 256).alias("sha"), "rid"),
        "digests",
    )
    # the smallest of these structs belongs to the row that stays
    digests = digests.select("doc_id", "sha", "rid", F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid").alias("rank"))

    candidates = digests.stat.freqItems(["sha"], support).select(F.explode("sha_freqItems").alias("sha"))
    least = support * digests.count()
    winners = stored(
        digests.join(F.broadcast(candidates), "sha", "left_semi").groupBy("sha").agg(F.min("rank").alias("best"), F.count("*").alias("size")).filter(F.col("size") >= least),
        "winners",
    )
    frequent = digests.join(F.broadcast(winners), "sha")
    rest = digests.join(F.broadcast(winners.select("sha")), "sha", "left_anti")
    others = rest.join(rest.groupBy("sha").agg(F.min("rank").alias("best"), F.count("*").alias("size")), "sha")
    out = ["doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"), "rid"]
    return frequent.select(*out).unionByName(others.select(*out))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of each group, whatever its id."""
    rows = numbered(docs)
    texts = rows.select(F.col("doc")[id_col].alias("doc_id"), F.coalesce(F.col("doc")[text_col], F.lit("")).alias("text"), F.col("row").alias("rid"))
    kept = _decided(texts, SUPPORT).filter("kept").select(F.col("rid").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha AS text_sha256
FROM d
WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
"""
