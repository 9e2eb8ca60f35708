"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents, and
any others that docs has. An empty table gives an empty one. Rows are kept or dropped as rows:
ids need not be unique.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.llm import quality as quality_field
from quarrybed.llm.common import written
from quarrybed.llm.exact_dedup import without_copies
from quarrybed.llm.near_copies import without_near_copies
from quarrybed.llm.packing import pack_documents
from quarrybed.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, learned from the labelled ones, doesn't reject.

    Each row is judged by its own text (null: empty), so repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality_field.fit(docs, labels)
    return quality_field.score(docs, field, carry=tuple(docs.columns)).where("predicted = 1").select("carried.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest id, a null id least; one row, where rows repeat that id and text."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the smallest id (a null id last); one row, where rows repeat an id and text.

    Texts without words are linked to each other. Candidates are within 14 bits by SimHashes of five-word shingles; a link has a Jaccard similarity of 0.8 or more.
    """
    return without_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat; a text of which nothing is left goes, an empty or null one stays.

    Rows repeated with id and text are one document, and all of them stay. Bytes of a character that was cut through are left out. n_chars follows the text.
    """
    cut = suffix_dedup(docs, with_text=True, carry=tuple(docs.columns)).drop("kept")
    whole = cut.where("n_removed = 0 OR n_bytes > n_removed")
    changed = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("carried.text"))
    out = whole.select(*[changed.alias("text") if c == "text" else F.col(f"carried.{c}").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 4096; a null text is its end id alone, repeated rows are packed as often."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("suffix-array dedup", passages),
    ("packing", packed),
]

#: The classifier, the fingerprints and the packing are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
