"""Workloads on synthetic rows whose figures depend on no machine: ``python -m brindle.plans.workloads hybrid|quantizer|filters``."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import COSINE, L2, choose_k
from ..operators import attrs, ivf, quant, rank
from ..operators._arrow import matrix
from ..sources import generate

#: Parameters: shortlists that recall is told at, and the shares of documents of the bands of a filter.
SHORTLISTS = (1, 2, 5, 10, 20, 50)
BANDS = {"rare": 0.01, "narrow": 0.04, "mid": 0.25, "broad": 0.7}


def hybrid_recall(spark: SparkSession, n: int = 100, dim: int = 32, seed: int = 7) -> DataFrame:
    """``leg, recall``: how often the planted answer is first by vectors, by text and by both."""
    docs, asked = generate.hybrid(spark, n, dim, seed)
    stats, window = rank.corpus_stats(docs).first(), rank.TOP_K * rank.WIDEN
    near = rank.batch_top_vectors(docs, asked, window, COSINE)
    told = rank.batch_top_texts(rank.index_rows(docs), asked, stats["n"], stats["avgdl"], window)
    legs = {"vector": near, "text": told, "hybrid": rank.batch_fuse(near, told)}
    first = [ranked.where("rank = 1").select("query", "id", F.lit(leg).alias("leg")) for leg, ranked in legs.items()]
    found = first[0].unionByName(first[1]).unionByName(first[2])
    return found.join(asked.select("query", "answer"), "query").groupBy("leg").agg((F.sum((F.col("id") == F.col("answer")).cast("int")) / n).alias("recall"))


def quantizer_recall(spark: SparkSession, n: int = 800, dim: int = 64, queries: int = 50, seed: int = 7) -> DataFrame:
    """``scorer, shortlist, recall``: how often the nearest vector (L2) is among the first ones by rotated one-bit codes with
    their estimate, and by plain residual signs. All clusters are probed; ``queries`` is a parameter and travels with the function."""
    rows = generate.documents(spark, n, dim, seed, normal=True).select("id", "vector")
    centroids = ivf.kmeans(rows, choose_k(n), L2)
    asked = generate.documents(spark, queries, dim, seed + 1, normal=True).select(F.col("id").alias("query"), F.col("vector").alias("q"))
    points = {r["query"]: np.array(r["q"], float) for r in asked.collect()}
    p, centres = quant.rotation(dim), {c: np.array(v, np.float32) for c, v in centroids.items()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, clusters = matrix(batch.column(1))[0], batch.column(2).to_numpy()
            for c in np.unique(clusters).tolist():
                own = np.flatnonzero(clusters == c)
                ids, bits = batch.column(0).take(pa.array(own)), quant.encode(vectors[own], centres[c], p)
                signs = vectors[own] >= centres[c]
                for name, q in points.items():
                    codes = quant.estimate_distance(L2, *bits, quant.encode_query(q, centres[c], p))
                    plain = (signs != (q >= centres[c])).sum(1).astype(float)
                    for scorer, got in (("codes", codes), ("signs", plain)):
                        yield pa.RecordBatch.from_arrays([pa.array([scorer] * len(own)), pa.array([name] * len(own)), ids, pa.array(got)], ["scorer", "query", "id", "est"])

    placed = ivf.assign(rows, centroids, L2).select("id", "vector", "cluster")
    scored = placed.mapInArrow(score, "scorer string, query string, id string, est double")
    order = Window.partitionBy("scorer", "query").orderBy("est", "id")
    short = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(SHORTLISTS))
    true = rank.batch_top_vectors(rows, asked, 1, L2).select("query", "id")
    hits = short.join(true, ["query", "id"]).select("scorer", "place")
    told = hits.select("scorer", F.explode(F.array(*(F.when(F.col("place") <= s, s) for s in SHORTLISTS))).alias("shortlist")).where("shortlist is not null")
    return told.groupBy("scorer", "shortlist").agg((F.count(F.lit(1)) / queries).alias("recall"))


def filter_plans(spark: SparkSession, n: int = 2000, dim: int = 32, seed: int = 1) -> DataFrame:
    """``band, total, hits, filter_first``: how a filter of each selectivity is planned."""
    rows = generate.banded(spark, n, dim, BANDS, seed)
    plans = [(band, attrs.plan(rows, F.col("band") == band)) for band in BANDS]
    return spark.createDataFrame([(b, x["total"], x["hits"], x["filter_first"]) for b, x in plans], "band string, total long, hits long, filter_first boolean")


MODES = {"hybrid": hybrid_recall, "quantizer": quantizer_recall, "filters": filter_plans}


def main(argv: list[str]) -> int:
    if len(argv) != 1 or argv[0] not in MODES:
        print(f"one of {', '.join(MODES)}", file=sys.stderr)
        return 2
    for row in MODES[argv[0]](SparkSession.builder.appName("brindle").getOrCreate()).toJSON().collect():
        print(json.dumps(json.loads(row), sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
