"""What the training-data operators share: column hygiene, shared-folder tables, byte classes.

Inputs keep whatever extra columns they have; operators pick their own columns by position in a
``select`` that renames them to ``_``-prefixed names first, so a clashing extra column cannot be
picked up by accident.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: the white space that separates words, as bytes.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a temporary one, in local mode alone:
    on a cluster the executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns ``doc_id`` and ``text`` (null text as the empty text)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def without(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` without columns of the names that an operator adds (as Spark compares names): its own replace them."""
    taken = {x.lower() for x in added}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
