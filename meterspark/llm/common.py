"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see. Only
    where it is unset (tests, local runs), a folder beside the warehouse."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    found = found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder, so that later steps neither
    compute them again nor depend on the executors that made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def known_id(col: str = "doc_id") -> Column:
    """The document id as a join key: a null id counts as the least one."""
    return F.coalesce(F.col(col).cast("bigint"), F.lit(-(2**63)))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` is the quick way where a text has only ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(batch, size: int = 1024):
    """Parts of an Arrow batch, so that no more than ``size`` texts are Python objects at once."""
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)
