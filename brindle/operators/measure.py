"""Latency percentiles by nearest rank, and recall of approximate rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENTILES = (0.5, 0.9, 0.99, 0.999)


def latencies(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank percentiles, mean and count of each operation."""
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias("p" + f"{p * 100:g}".replace(".", "_")) for p in PERCENTILES]
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *ranks)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``query, hits, recall`` of found (query, id) against exact (query, id); queries without a hit have 0."""
    hit = found.select("query", "id", F.lit(1).alias("hit"))
    return exact.select("query", "id").join(hit, ["query", "id"], "left").groupBy("query").agg(
        F.count("hit").alias("hits"), (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )
