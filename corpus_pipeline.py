"""A training corpus from ``documents``: quality rules, near-duplicates, repeated strings, source mix, packing.

Each stage takes what the one before kept. All but the last return the columns of ``documents``; after the mix a document's
rows are its copies. Every stage's rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm import mixing, near_dups, packing, quality, suffixes
from fleetlens.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are near-duplicates from this similarity of their five-word shingles on, in percent.
SIMILAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.apply_rules(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest doc_id, and one row of it for each of its texts. Of the rows
    without doc_id, which belong to no group, one stays for each text."""
    kept = near_dups.near_duplicates(docs, SIMILAR).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi").select(*COLUMNS)
    one = Window.partitionBy("doc_id", F.md5(F.col("text").cast("string"))).orderBy("lang", "source", "n_chars")
    return rows.withColumn("_row", F.row_number().over(one)).where("_row = 1").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes and more that a document of smaller doc_id has."""
    return suffixes.without_repeats(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, shuffled."""
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches."""
    return packing.pack(docs).select(
        "doc_id", "source", "chunk", "start_token", "n_tokens", "bucket", "bucket_tokens", "batch", "batch_row", "padding", "sequence_text"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The determinant search, the sketches and the parse have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
