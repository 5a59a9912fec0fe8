"""Helpers shared by the operators: scratch tables in the shared folder, draws from hashes, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these characters (inside a character class).
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``, or one beside the warehouse if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/")


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read back.

    The planner then knows its real size, so a small table is broadcast under
    the session's threshold and a large one is not, and a lost executor costs
    a read instead of the work before it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text as string, null as empty."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit(""))


def draw_52(seed: str, *parts: str | Column) -> Column:
    """A uniform integer in [0, 2**52), fixed by the seed and the parts (null counts as empty)."""
    cols = [text_of(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *cols)), 1, 13), 16, 10).cast("long")


def word_count(column: str | Column) -> Column:
    """Number of words of a text; null and white space alone have none."""
    trimmed = F.regexp_replace(text_of(column), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"[{SPACE}]+"))).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
