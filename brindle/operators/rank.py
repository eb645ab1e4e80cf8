"""Rankings: exact vectors, BM25 over live or indexed statistics, reciprocal rank fusion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idf, idf_column, query_terms, term_score, tokens
from ..functions.vector import COSINE, L2, distance
from ._arrow import matrix

#: Results, fusion constant, window of each leg per result asked for.
TOP_K, RRF_K, WIDEN = 10, 60, 5
#: Rows and queries of the blocks that batches of queries are ranked in.
ROWS, ASKED = 4096, 512


def top_vectors(rows: DataFrame, query: Sequence[float], k: int = TOP_K, metric: str = COSINE, where: Column | None = None) -> DataFrame:
    """``rows`` (id, vector, ...) with ``dist``, the k nearest; ties by id. The filter goes first and down to the scan."""
    kept = rows.where("vector is not null")
    kept = kept if where is None else kept.where(where)
    return kept.withColumn("dist", distance(metric, F.col("vector"), query)).orderBy("dist", "id").limit(k or TOP_K)


def _blocks(rows: DataFrame, name: str, values: str, extra: str, size: int) -> DataFrame:
    """``rows`` in blocks of at most ``size`` vectors, each one row of ``names``, ``flat`` components and ``more`` (``extra``)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                points, _ = matrix(part.column(1))
                flat = pa.array([points.ravel().astype(np.float32)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([_listed(part.column(0)), flat, _listed(part.column(2))], ["names", "flat", "more"])

    kinds = [f"array<{rows.schema[c].dataType.simpleString()}>" for c in (name, extra)]
    whole = rows.where(F.col(values).isNotNull()).select(name, values, extra)
    return whole.mapInArrow(pack, f"names {kinds[0]}, flat array<float>, more {kinds[1]}")


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _near(metric: str, points: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, float]:
    """Distances of all points (rows) to all asked (columns) up to rounding, which the second value bounds."""
    size, wanted = np.sqrt(np.einsum("ij,ij->i", points, points)), np.sqrt(np.einsum("ij,ij->i", asked, asked))
    with np.errstate(all="ignore"):
        if metric == COSINE:
            scale = np.outer(size, wanted)
            return np.where(scale == 0, 1.0, 1.0 - np.fmax(-1.0, np.fmin(1.0, points @ asked.T / scale))), 1e-9
        squares = size[:, None] ** 2 + wanted[None, :] ** 2
        return np.maximum(squares - 2.0 * (points @ asked.T), 0.0), 1e-9 * float(np.nanmax(squares, initial=0.0))


def _exactly(metric: str, points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances to one query, row by row: equal vectors get equal distances wherever they stand."""
    with np.errstate(all="ignore"):
        if metric == COSINE:
            scale = np.sqrt(np.einsum("ij,ij->i", points, points)) * np.sqrt(q @ q)
            return np.where(scale == 0, 1.0, 1.0 - np.fmax(-1.0, np.fmin(1.0, (points * q).sum(1) / scale)))
        return np.sqrt(((points - q) ** 2).sum(1))


def batch_top_vectors(rows: DataFrame, queries: DataFrame, k: int = TOP_K, metric: str = COSINE, probed: bool = False) -> DataFrame:
    """The k nearest rows (id, vector) of each of any number of queries (query, q): ``query, id, dist, rank``; ties by id.

    Rows and queries meet in blocks, one matrix product a pair of blocks, and a pair sends at most k rows a query onwards. A task
    holds one pair at a time (ROWS x ASKED distances), so neither many queries nor many equal vectors need more memory. With
    ``probed``, rows carry their ``cluster`` and queries the ``clusters`` they look into; other rows are no candidates. Which side
    is broadcast, if one is small enough, is Spark's choice by size. Vectors of several lengths are an error."""
    if metric not in (COSINE, L2):
        raise ValueError(f"unknown metric {metric!r}: expected {COSINE!r} or {L2!r}")
    extra = ("cluster", "clusters") if probed else ("_none", "_none")
    if not probed:
        rows, queries = rows.withColumn("_none", F.lit(0)), queries.withColumn("_none", F.lit(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, points, own, names, asked, wanted = (batch.column(c)[at].values for c in range(6))
                points, asked = (x.to_numpy(zero_copy_only=False).astype(float).reshape(len(n), -1) for x, n in ((points, ids), (asked, names)))
                if points.shape[1] != asked.shape[1]:
                    raise ValueError(f"vectors of {points.shape[1]} components and queries of {asked.shape[1]}")
                near, margin = _near(metric, points, asked)
                near[np.isnan(near)] = np.inf
                allowed = np.ones(near.shape, bool)
                if probed:
                    clusters = own.to_numpy(zero_copy_only=False)
                    allowed = np.stack([np.isin(clusters, w) for w in wanted.to_pylist()], 1)
                    near[~allowed] = np.inf
                last = np.partition(near, min(k, len(ids)) - 1, axis=0)[min(k, len(ids)) - 1]
                got_query, got_id, got_dist = [], [], []
                for j in range(len(names)):
                    short = np.flatnonzero((near[:, j] <= last[j] + margin) & allowed[:, j])
                    dist = _exactly(metric, points[short], asked[j])
                    for _, d, name in nsmallest(k, ((x != x, x, n) for x, n in zip(dist.tolist(), ids.take(pa.array(short)).to_pylist()))):
                        got_query.append(j), got_id.append(name), got_dist.append(d)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(got_query, pa.int64())), pa.array(got_id, ids.type), pa.array(got_dist, pa.float64())], ["query", "id", "dist"])

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "query"), (rows, "id"))]
    left, right = _blocks(rows, "id", "vector", extra[0], ROWS), _blocks(queries, "query", "q", extra[1], ASKED)
    pairs = left.crossJoin(right.toDF("_names", "_flat", "_more"))
    order = Window.partitionBy("query").orderBy("dist", "id")
    return pairs.mapInArrow(score, f"query {kinds[0]}, id {kinds[1]}, dist double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tokenised(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_w``, the tokens of ``text``. They are a generator's output, which the optimizer does not copy into
    every expression that uses it: each text is split once, however many terms are counted."""
    return docs.select("*", F.explode(F.array(tokens(F.col("text")))).alias("_w"))


def postings(docs: DataFrame) -> DataFrame:
    """``term, id, tf`` of ``docs`` (id, text)."""
    return docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.size(tokens(F.col("text"))).alias("dl"))


def index_rows(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (id, text): ``term, id, tf, dl``, from one pass over the texts; a document's length goes along with its terms."""
    words = tokenised(docs.select("id", "text")).select("id", F.size("_w").alias("dl"), F.explode("_w").alias("term"))
    return words.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "dl")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """``n, avgdl`` over all documents, those without text too."""
    return doc_lengths(docs).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


class Stats:
    """What BM25 takes from an index: documents, mean length, and the query terms' document frequencies."""

    def __init__(self, n: int = 0, avgdl: float = 0.0, df: dict[str, int] | None = None):
        self.n, self.avgdl, self.df = n, avgdl, df or {}

    @classmethod
    def of(cls, docs: DataFrame, terms: Sequence[str]) -> Stats:
        """One pass over the texts; as many numbers as there are terms reach the driver."""
        own = sorted(set(terms))
        words = tokenised(docs.select("text"))
        row = words.agg(F.count(F.lit(1)), F.avg(F.size("_w")), *(F.sum(F.array_contains("_w", t).cast("long")) for t in own)).first()
        return cls(row[0], row[1] or 0.0, {t: x or 0 for t, x in zip(own, row[2:])})


def bm25_scores(docs: DataFrame, query: str, stats: Stats) -> DataFrame:
    """``docs`` (id, text, ...) with ``score``, those above 0. A term counts as often as the query has it.

    Scores come row by row from the text: no shuffle, whatever the corpus."""
    terms = Counter(query_terms(query))
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).where(F.lit(False))
    tf = lambda t: F.size(F.filter("_w", lambda w: w == t)).cast("double")
    parts = [n * term_score(F.lit(idf(stats.n, stats.df.get(t, 0))), tf(t), F.size("_w"), stats.avgdl) for t, n in sorted(terms.items())]
    # every weight is positive: a score is above 0 where a term occurs
    hits = tokenised(docs).where(F.arrays_overlap("_w", F.array(*map(F.lit, sorted(terms)))))
    return hits.withColumn("score", reduce(Column.__add__, parts)).drop("_w")


def top_texts(docs: DataFrame, query: str, stats: Stats, k: int = TOP_K, where: Column | None = None) -> DataFrame:
    kept = docs if where is None else docs.where(where)
    return bm25_scores(kept, query, stats).orderBy(F.desc("score"), "id").limit(k or TOP_K)


def live_top_texts(docs: DataFrame, query: str, k: int = TOP_K, where: Column | None = None) -> DataFrame:
    """``id, score`` of the k best of ``docs`` (id, text, ...) by the statistics of all of them, the filter's own or not; no job runs before.

    Each text is split once: its length and its count of each query term (a few numbers a document) go through one exchange, which
    both the statistics and the scores read. Statistics are one row."""
    terms = Counter(query_terms(query))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    asked = sorted(terms)
    times = lambda t: F.size(F.filter("_w", lambda w: w == t)).cast("double")
    tf = [times(t).alias(f"_tf{j}") for j, t in enumerate(asked)]
    kept = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    counted = tokenised(docs.withColumn("_kept", kept)).select("id", "_kept", F.size("_w").alias("_dl"), *tf).repartition("id")
    df = [F.sum((F.col(f"_tf{j}") > 0).cast("long")).alias(f"_df{j}") for j in range(len(asked))]
    # the statistics read the filter's column too, and the filter is decided beside them: so both sides need the same exchange
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), F.bool_or("_kept").alias("_any"), *df)
    parts = [terms[t] * term_score(idf_column(F.col("_n"), F.col(f"_df{j}")), F.col(f"_tf{j}"), F.col("_dl"), F.col("_avg")) for j, t in enumerate(asked)]
    score = F.when(F.col("_kept") & F.col("_any"), reduce(Column.__add__, parts))
    scored = counted.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
    return scored.where(F.col("score") > 0).orderBy(F.desc("score"), "id").limit(k or TOP_K).select("id", "score")


def indexed_scores(index: DataFrame, query: str, stats: Stats) -> DataFrame:
    """``id, score`` from an index of ``term, id, tf, dl``; only the rows of the query's terms are read."""
    terms = Counter(query_terms(query))
    hits = index.where(F.col("term").isin(*terms))
    weight = F.coalesce(*(F.when(F.col("term") == t, F.lit(n * idf(stats.n, stats.df.get(t, 0)))) for t, n in terms.items()), F.lit(0.0))
    return hits.groupBy("id").agg(F.sum(term_score(weight, F.col("tf").cast("double"), F.col("dl"), stats.avgdl)).alias("score"))


def batch_top_texts(index: DataFrame, queries: DataFrame, n: int, avgdl: float, k: int = TOP_K) -> DataFrame:
    """The k best documents of each of any number of queries (query, text): ``query, id, score, rank``, ties by id.

    ``index`` is of ``term, id, tf, dl`` and ``n`` documents of mean length ``avgdl``. Only postings of terms asked for are joined,
    and a posting list is split where it is long, as AQE splits any skewed side; a document sends its score per query, summed before the exchange."""
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("_asked"))
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weighted = asked.join(df, "term").select("query", "term", (F.col("_asked") * idf_column(F.lit(n), F.col("_df"))).alias("_weight"))
    part = term_score(F.col("_weight"), F.col("tf").cast("double"), F.col("dl"), avgdl)
    scored = index.join(weighted, "term").groupBy("query", "id").agg(F.sum(part).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batch_fuse(vectors: DataFrame, texts: DataFrame, k: int = TOP_K, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two batches (query, id, rank, and dist or score): ``query, id, dist, score, rrf, rank``."""
    v, t = vectors.select("query", "id", "dist", F.col("rank").alias("_v")), texts.select("query", "id", "score", F.col("rank").alias("_t"))
    part = lambda rank: F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))
    both = v.join(t, ["query", "id"], "full_outer").select("query", "id", "dist", "score", (part("_v") + part("_t")).alias("rrf"))
    order = Window.partitionBy("query").orderBy(F.desc("rrf"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(vectors: DataFrame, texts: DataFrame, k: int = TOP_K, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two top lists (id, dist) and (id, score): ``id, dist, score, rrf``.

    Both sides hold a query's window of rows, so numbering them in one task is bounded."""
    v = vectors.select("id", "dist", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dist", "id")).alias("_v"))
    t = texts.select("id", "score", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")).alias("_t"))
    part = lambda rank: F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))
    return v.join(t, "id", "full_outer").select("id", "dist", "score", (part("_v") + part("_t")).alias("rrf")).orderBy(F.desc("rrf"), "id").limit(k or TOP_K)


def overlay(indexed: DataFrame, tail: DataFrame) -> DataFrame:
    """The tail's rows (id, deleted, ...) in place of indexed rows of their ids; deleted ones vanish."""
    live = tail.where("not deleted").drop("deleted")
    return indexed.join(tail.select("id"), "id", "left_anti").unionByName(live, allowMissingColumns=True)
