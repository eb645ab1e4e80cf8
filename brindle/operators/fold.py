"""The log fold: the last operation of each id in (seq, pos) order decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_operations(log: DataFrame, first: int | None = None, end: int | None = None) -> DataFrame:
    """The last row of each id with ``first <= seq < end``. The limit on row numbers is applied before the shuffle too."""
    if first is not None:
        log = log.where(F.col("seq") >= first)
    if end is not None:
        log = log.where(F.col("seq") < end)
    order = Window.partitionBy("id").orderBy(F.desc("seq"), F.desc("pos"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def live(log: DataFrame, first: int | None = None, end: int | None = None) -> DataFrame:
    return last_operations(log, first, end).where("not deleted")


def deleted(log: DataFrame, first: int | None = None, end: int | None = None) -> DataFrame:
    """Ids whose last operation is a tombstone, live before or not."""
    return last_operations(log, first, end).where("deleted").select("id")


def view(runs: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """Log ranges [first, end) of several prefixes as one log; sequence numbers are shared along a branch."""
    parts = [log.where((F.col("seq") >= first) & (F.col("seq") < end)) for log, first, end in runs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
