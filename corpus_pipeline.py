"""From raw documents to packed training sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``documents``; what a stage returns is written as Parquet and read
again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm import line_dedup, mixing, packing, quality_classifier, shingle_dedup, simhash
from timeweave.llm.workspace import numbered, stored, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return quality_classifier.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document go; ``n_chars`` follows the text."""
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by similarity the document of the smallest id stays.

    Texts link whose sets of five-word shingles have a Jaccard similarity of 0.8
    or more: SimHash's anchors find the close ones, each link is checked by whole
    sets, and prefix filtering finds those whose fingerprints are too far apart
    for a covering.  One row of each group stays; a null id comes after all
    others, and of rows of one id the first in the stored order stays.
    """
    rows = numbered(docs)
    texts = rows.select("row", "doc.doc_id", "doc.text")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = texts.select("row", "doc_id").join(shingle_dedup.near_copies(texts, simhash.links), "row")
    stays = groups.groupBy("component").agg(F.min(rank).alias("first")).select("first.row")
    return rows.join(stays, "row", "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice.

    Copies are decided for each row, whatever ids the rows have.
    """
    rows = numbered(docs)
    taken = mixing.mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), row_col="row").filter("copies > 0")
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return rows.join(taken.select("row", "copies"), "row").select("doc", F.explode(copies)).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence, with its ids; a document taken twice has its pieces twice."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Expectation-maximisation, Newton steps and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
