"""Contiguous groups of sorted Arrow batches, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written


#: Rows whose texts, words and sets a worker holds as Python objects at a time.
SLICE = 1024


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most SLICE of them at a time."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), SLICE):
            yield batch.slice(at, SLICE)


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from the row's before."""
    if batch.num_rows < 2:
        return np.zeros(0, np.int64)
    differs = np.zeros(batch.num_rows - 1, bool)
    for key in keys:
        column = batch.column(key)
        if pa.types.is_integer(column.type):
            values = column.to_numpy(zero_copy_only=False)
            differs |= values[1:] != values[:-1]
        else:
            values = column.to_pylist()
            differs |= np.fromiter((a != b for a, b in zip(values, values[1:])), bool, len(values) - 1)
    return np.flatnonzero(differs) + 1


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of equal keys, which follow each other in the batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = [0, *_changes(batch, keys).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield _joined(held)
                held = []
            held.append(part)
            if b < batch.num_rows:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Union:
    """Union-find with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_pairs(rows: DataFrame, blocks: Column, by: Column) -> DataFrame:
    """Deals the rows of each group to blocks and each block to the tasks (lo, hi) of the block pairs it is in.

    Groups of one block, nearly all, keep one row each; a group of b blocks makes b(b+1)/2 tasks of two
    blocks, so that no task holds more and every pair of its rows meets in one task at least."""
    own = rows.withColumn("_blocks", blocks.cast("int")).withColumn("block", F.pmod(by, F.col("_blocks")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other", "_blocks")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) for the nodes of ``edges`` (``a, b``): alternating stars.

    Each round links nodes to the smallest one they see and is written to the shared folder; the rounds
    grow with the logarithm of the nodes. Per round a count and a checksum go to the driver. An edge leads from
    the larger node ``a`` to the smaller ``b``, so a hub is many edges of one ``b``: those are joined with a table
    that is read, of one row a node, and AQE splits the hub's partition of that join."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = mark
        least = written(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        large = edges.join(least, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(lower, F.col("a") == F.col("n"))
        step = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        edges = written(step, "edges")
