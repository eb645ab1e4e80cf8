"""Line dedup: repeated lines are removed from all documents but the last that holds them.

Lines are normalised and hashed (128 bits), each document sends each of its hashes once, distinct
documents are counted per hash, and every document is put together again by line position without the
lines whose hash is over the threshold.

Defined cases: a null or empty text is one empty line; a line that a document repeats counts once for
it; rows that share a ``doc_id`` count as one document (and all keep a line if that id is the largest);
rows with a null ``doc_id`` come back unchanged and count for nothing; an empty table gives an empty
result; extra columns are carried along, but for ones named ``n_lines`` or ``n_dropped``, which the counts replace.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, without, written

#: Fixed values of the contract.
MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of the normalised line; None if it is too short to count."""
    line = line.strip(ASCII_SPACE)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return blake2b(line.lower(), digest_size=16).digest()  # bytes.lower() knows A-Z only


def _raw(column: pa.Array) -> Iterator[bytes]:
    return ((t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist())


def _keys(min_chars: int):
    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _raw(batch.column(1))):
                own = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                ids += [doc_id] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.binary())], ["doc_id", "key"])

    return keys


def _rebuild(min_chars: int, text_at: int):
    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(_raw(batch.column(text_at)), batch.column("_drops").to_pylist()):
                lines = text.split(b"\n")
                drops = frozenset(drops or ())
                kept = [x for x in lines if line_key(x, min_chars) not in drops] if drops else lines
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "_drops"]
            columns[text_at] = pa.array(texts, pa.string())
            names = [name for name in batch.schema.names if name != "_drops"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "_n_lines", "_n_dropped"])

    return rebuild


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, drops``: for each document that loses lines, their hashes.

    Pairs of hash and document are made distinct by a shuffle on both, which no hash can make uneven; the
    count per hash then adds up one partial row a task. They are written once, for the counts and for the way
    back; so are the hashes over the threshold, with which the pairs then join as two tables read: the side of the
    pairs may be skewed, and AQE splits such partitions of a join that shares no exchange with an aggregation.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(_keys(min_chars), f"doc_id {kind}, key binary").distinct()
    pairs = written(pairs, "lines")
    spread = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    spread = written(spread.select("key", "last"), "spread")
    return (
        pairs.join(spread, "key")
        .where(F.col("doc_id") < F.col("last"))
        .groupBy("doc_id")
        .agg(F.collect_list("key").alias("drops"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the remaining text, and ``n_lines`` and ``n_dropped`` as two last columns."""
    docs = without(docs, "n_lines", "n_dropped")
    names = docs.columns
    plain = docs.select(*(F.col(f"`{old}`").alias(f"_c{k}") for k, old in enumerate(names)))
    doc_id, text_at = f"_c{names.index(id_col)}", names.index(text_col)
    drops = dropped_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_chars, min_docs)
    joined = plain.join(drops.select(F.col("doc_id").alias("_id"), F.col("drops").alias("_drops")), F.col(doc_id) == F.col("_id"), "left").drop("_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = joined.mapInArrow(_rebuild(min_chars, text_at), f"{fields}, _n_lines long, _n_dropped long")
    return out.select(*(F.col(f"_c{k}").alias(old) for k, old in enumerate(names)), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
