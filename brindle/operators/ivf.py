"""Inverted-file clustering: assignment, Lloyd passes, probing, maintenance.

Centroids number about the root of the vectors; they are held on the driver and travel with the functions that use them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import COSINE, choose_k, distance
from ._arrow import matrix

#: Lloyd passes at most, fan-out of the routing tree, rows exactly scored per result of a shortlist, and nodes
#: of a level that are followed per cluster asked for.
PASSES, FANOUT, RERANK, BEAM = 25, 8, 4, 4
#: Parameter: the share of clusters, or of the rows in them, that is searched unless a number of clusters is given.
SHARE = 0.75
#: Numbers that the distances of a block of vectors to all centroids take.
BLOCK = 1 << 22


def means(rows: DataFrame, by: str) -> DataFrame:
    """``by, pos, mean``: component means in double, to be rounded to 32 bits. A batch sends one sum a group and component."""
    kind = rows.schema[by].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, valid = matrix(batch.column(1))
            names = batch.column(0).filter(pa.array(valid)).dictionary_encode("encode")
            n = len(names.dictionary)
            total, to = np.zeros((n, points.shape[1])), names.indices.to_numpy()
            np.add.at(total, to, points)
            yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(np.bincount(to, minlength=n).astype(np.int64)), pa.array(list(total), pa.list_(pa.float64()))], ["by", "n", "sums"])

    parts = rows.select(F.col(by).alias("by"), "vector").mapInArrow(sums, f"by {kind}, n long, sums array<double>")
    parts = parts.select(F.col("by").alias(by), "n", F.posexplode("sums").alias("pos", "x"))
    return parts.groupBy(by, "pos").agg((F.sum("x") / F.sum("n")).cast("float").alias("mean"))


def centroids_of(rows: DataFrame, by: str) -> dict[int, list[float]]:
    found: dict[int, dict[int, float]] = {}
    for r in means(rows, by).collect():  # clusters times dimensions
        found.setdefault(r[by], {})[r["pos"]] = r["mean"]
    return {c: [v[p] for p in sorted(v)] for c, v in sorted(found.items())}


def nearest(rows: DataFrame, centroids: dict[int, Sequence[float]], metric: str = COSINE) -> DataFrame:
    """Adds ``cluster`` and ``dist`` of the nearest centroid, ties to the lower cluster; null without a vector.

    The centroids travel with the function, once an executor and in 32 bits, not as literals of the plan; a batch is compared
    with them in blocks, so a task holds BLOCK numbers besides its rows."""
    names = np.array(sorted(centroids), np.int32)
    centres = np.array([centroids[c] for c in names.tolist()], np.float32)
    at = rows.columns.index("vector")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, valid = matrix(batch.column(at))
            cluster, dist = np.zeros(len(points), np.int32), np.zeros(len(points))
            step = max(1, BLOCK // max(1, centres.size))
            for k in range(0, len(points), step):
                d = np_distance(metric, points[k : k + step, None], centres[None])
                cluster[k : k + step], dist[k : k + step] = names[d.argmin(1)], d.min(1)
            where = pa.array(np.where(valid, np.cumsum(valid) - 1, 0), mask=~valid)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster).take(where), pa.array(dist).take(where)], [*batch.schema.names, "cluster", "dist"])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.mapInArrow(place, f"{kinds}, cluster int, dist double")


def assign(rows: DataFrame, centroids: dict[int, Sequence[float]], metric: str = COSINE) -> DataFrame:
    """Adds ``cluster``; no shuffle."""
    return nearest(rows, centroids, metric).drop("dist")


def np_distance(metric: str, points: np.ndarray, q: np.ndarray) -> np.ndarray:
    points, q = np.asarray(points, float), np.asarray(q, float)
    if metric != COSINE:
        return np.sqrt(((points - q) ** 2).sum(-1))
    scale = np.linalg.norm(points, axis=-1) * np.linalg.norm(q, axis=-1)
    return np.where(scale == 0, 1.0, 1 - np.clip((points * q).sum(-1) / np.where(scale == 0, 1, scale), -1, 1))


def probe(centroids: dict[int, Sequence[float]], query: Sequence[float], n: int = 0, metric: str = COSINE) -> list[int]:
    """The n nearest clusters, or SHARE of them; ties to the lower one."""
    names = sorted(centroids)
    d = np_distance(metric, np.array([centroids[c] for c in names], np.float32), np.array(query, np.float32))
    return [names[i] for i in np.lexsort((names, d))[: min(len(names), n or ceil(SHARE * len(names)))]]


def enough(order: Sequence[int], sizes: dict[int, int], k: int) -> list[int]:
    """The shortest start of ``order`` whose clusters hold SHARE of the rows counted in ``sizes``, and k of them if there are as many."""
    want, held = max(min(k, sum(sizes.values())), ceil(SHARE * sum(sizes.values()))), 0
    for at, c in enumerate(order):
        if held >= want:
            return list(order[:at])
        held += sizes.get(c, 0)
    return list(order)


def nearest_clusters(vector: Column, centroids: dict[int, Sequence[float]], n: int, metric: str = COSINE) -> Column:
    """``probe`` as a column, for many queries: the n nearest clusters, ties to the lower one."""
    table = F.array(*(F.struct(F.lit(c).alias("cluster"), F.lit([float(x) for x in v]).cast("array<float>").alias("centre")) for c, v in sorted(centroids.items())))
    near = F.array_sort(F.transform(table, lambda t: F.struct(distance(metric, vector, t["centre"]).alias("dist"), t["cluster"].alias("cluster"))))
    return F.transform(F.slice(near, 1, n), lambda x: x["cluster"])


def reseed(centroids: dict[int, list[float]], rows: DataFrame, missing: list[int], metric: str) -> None:
    """Empty clusters take the points farthest from their centres."""
    far = nearest(rows.where("vector is not null").select("vector", "id"), {c: v for c, v in centroids.items() if c not in missing}, metric)
    for c, r in zip(missing, far.orderBy(F.desc("dist"), "id").limit(len(missing)).collect()):
        centroids[c] = list(r["vector"])


def kmeans(rows: DataFrame, k: int, metric: str = COSINE, passes: int = PASSES) -> dict[int, list[float]]:
    """Lloyd from the first k points in id order. A pass is one scan with map-side partial means; it ends when
    no centroid moves. Empty clusters are reseeded."""
    centroids = {c: list(r["vector"]) for c, r in enumerate(rows.where("vector is not null").orderBy("id").limit(k).collect())}
    for _ in range(passes):
        moved = centroids_of(assign(rows, centroids, metric), "cluster")
        empty = [c for c in centroids if c not in moved]
        new = {c: moved.get(c, centroids[c]) for c in centroids}
        if empty:
            reseed(new, rows, empty, metric)
        if new == centroids:
            break
        centroids = new
    return centroids


def tree(centroids: dict[int, Sequence[float]], fanout: int = FANOUT, metric: str = COSINE) -> dict:
    """A routing tree over the centroids by nested k-means; leaves are single clusters."""
    names = sorted(centroids)
    points = np.array([centroids[c] for c in names], np.float32)
    centre = points.mean(0, dtype=float).tolist() if names else []
    if len(names) <= 1:
        return {"centre": centre, "cluster": names[0] if names else None, "children": []}
    k = min(fanout, len(names))
    seeds = points[:k].astype(float)
    for _ in range(PASSES):
        to = np.stack([np_distance(metric, points, s) for s in seeds]).argmin(0)
        seeds = np.stack([points[to == c].mean(0, dtype=float) if (to == c).any() else seeds[c] for c in range(k)])
    parts = [[names[i] for i in np.flatnonzero(to == c)] for c in range(k)]
    if max(map(len, parts)) == len(names):  # equal points: cut by number
        parts = [names[i::k] for i in range(k)]
    return {"centre": centre, "cluster": None, "children": [tree({c: centroids[c] for c in p}, fanout, metric) for p in parts if p]}


def route(centroids: dict[int, Sequence[float]], root: dict | None, query: Sequence[float], n: int, metric: str = COSINE) -> tuple[list[int], int]:
    """The n clusters to probe and the comparisons it took: by the tree where there is one and it can save any, else by all centroids."""
    if root is None or n >= len(centroids):
        return probe(centroids, query, n, metric), len(centroids)
    return descend(root, query, n, min(BEAM * n, len(centroids)), metric)


def descend(root: dict, query: Sequence[float], n: int, beam: int, metric: str = COSINE) -> tuple[list[int], int]:
    """Clusters by a beam search down the tree, and the comparisons it took."""
    level, leaves, compared = [root], [], 0
    while level:
        found = [c for node in level for c in (node["children"] or [])]
        leaves += [node for node in level if not node["children"] and node["cluster"] is not None]
        if not found:
            break
        d = np_distance(metric, np.array([c["centre"] for c in found], np.float32), np.array(query, np.float32))
        compared += len(found)
        level = [found[i] for i in np.argsort(d, kind="stable")[:beam]]
    d = np_distance(metric, np.array([x["centre"] for x in leaves], np.float32), np.array(query, np.float32))
    order = np.lexsort(([x["cluster"] for x in leaves], d))
    return list(dict.fromkeys(leaves[i]["cluster"] for i in order))[:n], compared


def maintain(rows: DataFrame, centroids: dict[int, list[float]], metric: str = COSINE, passes: int = 3) -> dict[int, list[float]]:
    """Incremental upkeep for changed vectors: reassign all (one scan), merge clusters under half the mean size,
    split those over twice it, until sizes settle; then number the clusters densely.

    A global reassignment is a scan here, and leaves every vector at its nearest centre."""
    centroids = dict(centroids)
    for _ in range(passes):
        placed = assign(rows, centroids, metric)
        sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}
        average = sum(sizes.values()) // max(1, len(sizes))
        large = [c for c in centroids if sizes.get(c, 0) > max(1, 2 * average)]
        small = [c for c in centroids if sizes.get(c, 0) < max(1, average // 2)]
        for c in small[: max(0, len(centroids) - 1)]:
            del centroids[c]
        for c in large:
            if c in centroids:
                halves = kmeans(placed.where(F.col("cluster") == c).drop("cluster"), 2, metric)
                if len(halves) == 2 and halves[0] != halves[1]:
                    centroids[c], centroids[max(centroids) + 1] = halves[0], halves[1]
        centroids = centroids_of(assign(rows, centroids, metric), "cluster")  # without those that nothing is nearest to
        if not large and not small:
            break
    return {n: centroids[c] for n, c in enumerate(sorted(centroids))}


def full_cluster(rows: DataFrame, n: int, metric: str = COSINE) -> dict[int, list[float]]:
    return kmeans(rows, choose_k(n), metric)
