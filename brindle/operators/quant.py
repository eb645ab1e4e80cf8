"""One-bit quantization: a random rotation, the signs of a rotated unit residual and the estimate from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SEED, QUERY_BITS = 1, 4


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthonormal matrix, the signs fixed by the diagonal of R."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def encode(vectors: np.ndarray, centre: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (rows of 0/1), residual norms, and the inner products of code and residual. A zero residual: all ones, 0, 0."""
    residual = np.asarray(vectors, float) - np.asarray(centre, float)
    size = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(size == 0, 1, size)[:, None]
    turned = unit @ p
    bits = (turned >= 0).astype(np.uint8)
    align = (np.abs(turned)).sum(1) / np.sqrt(vectors.shape[1])
    bits[size == 0], align[size == 0] = 1, 0.0
    return bits, size, align


def encode_query(query: np.ndarray, centre: np.ndarray, p: np.ndarray, seed: int = SEED) -> dict:
    """The rotated unit residual of the query in 4 bits a component, rounded at random."""
    residual = np.asarray(query, float) - np.asarray(centre, float)
    size = float(np.linalg.norm(residual))
    turned = (residual / size if size else residual) @ p
    low, high = float(turned.min()), float(turned.max())
    width = (high - low) / (2**QUERY_BITS - 1)
    levels = np.zeros(len(turned)) if not width else np.clip(np.floor((turned - low) / width + np.random.default_rng(seed).random(len(turned))), 0, 2**QUERY_BITS - 1)
    return {"norm": size, "low": low, "width": width, "levels": levels}


def estimate_inner(bits: np.ndarray, align: np.ndarray, q: dict) -> np.ndarray:
    """The inner product of unit residuals, estimated from the code; 0 where the code has no alignment."""
    d = bits.shape[1]
    raw = (2 * q["width"] * (bits @ q["levels"]) + 2 * q["low"] * bits.sum(1) - q["width"] * q["levels"].sum() - q["low"] * d) / np.sqrt(d)
    return np.where(align == 0, 0.0, raw / np.where(align == 0, 1, align))


def estimate_distance(metric: str, bits: np.ndarray, norms: np.ndarray, align: np.ndarray, q: dict) -> np.ndarray:
    """For L2 the distance; for cosine one minus the inner product, a proxy that only shortlists."""
    inner = estimate_inner(bits, align, q)
    return 1 - inner if metric == "cosine" else np.sqrt(np.maximum(0, norms**2 + q["norm"] ** 2 - 2 * norms * q["norm"] * inner))


def encode_rows(rows: DataFrame, centroids: dict, dim: int) -> DataFrame:
    """Adds ``rq_bits`` (packed bytes), ``rq_norm`` and ``rq_align`` to rows with ``vector, cluster``, batch by batch."""
    p, centres = rotation(dim), {c: np.array(v, np.float32) for c, v in centroids.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["rq_bits"], f["rq_norm"], f["rq_align"] = None, 0.0, 0.0
            for c, own in f.groupby("cluster"):
                bits, size, align = encode(np.stack(own["vector"].to_numpy()), centres[c], p)
                f.loc[own.index, "rq_bits"] = pd.Series([b.tobytes() for b in np.packbits(bits, axis=1)], own.index, dtype=object)
                f.loc[own.index, "rq_norm"], f.loc[own.index, "rq_align"] = size, align
            yield f

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, rq_bits binary, rq_norm double, rq_align double")


def estimates(rows: DataFrame, centroids: dict, query: np.ndarray, metric: str, dim: int) -> DataFrame:
    """``id, cluster, est`` for encoded rows."""
    p = rotation(dim)
    asked = {c: encode_query(query, np.array(v, np.float32), p) for c, v in centroids.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c, own in f.groupby("cluster"):
                bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in own["rq_bits"]]), axis=1)[:, :dim]
                est = estimate_distance(metric, bits, own["rq_norm"].to_numpy(), own["rq_align"].to_numpy(), asked[c])
                yield pd.DataFrame({"id": own["id"], "cluster": own["cluster"], "est": est})

    return rows.select("id", "cluster", "rq_bits", "rq_norm", "rq_align").mapInPandas(run, "id string, cluster int, est double")
