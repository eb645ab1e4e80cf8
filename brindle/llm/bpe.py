"""Byte-level BPE encoding and decoding of whole texts.

A text longer than a chunk is cut into chunks that overlap; the chunks are pre-tokenised on their own,
in parallel. Two chunks have resynchronised at a boundary which both find in their overlap: from there on
both see the same pre-tokens. There the text is cut into pieces, which are encoded in parallel; the ids of
the pieces follow each other. Two chunks without such a boundary in their overlap (inside a pre-token longer
than it) are one piece, and with them no others. Decoding concatenates the bytes of the ids.

A boundary counts only where the kinds of the two code points at it (letter, number, space, other) decide it
for this pattern, whatever stands before and after, and only between code points of which all versions of
Unicode since 3.2 say the same kind. So it is one for whoever reads the text, from wherever, and a missed
overlap says nothing about the next.

Defined cases: null text is empty and has no ids; rows that share an id and differ in text are separate
documents; equal rows each give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import id_and_text, written

#: Parameters, in characters.
CHUNK, OVERLAP = 16_384, 512
#: White space that is not of a category Z, and what some readers alone take for white space.
CONTROL_SPACES, DOUBTFUL = "\t\n\x0b\x0c\r\x85", "\x1c\x1d\x1e\x1f"
#: Code points of each kind that a pattern is tried with.
SAMPLES = {"letter": "as字", "number": "1٣", "space": " \n\u3000", "other": "'!。"}


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    by_id = ranks(path)
    table = [b""] * (max(by_id.values(), default=-1) + 1)
    for token, number in by_id.items():
        table[number] = token
    return table


@lru_cache(None)
def kind(c: str) -> str:
    """Letter, number, space or other; nothing where versions of Unicode disagree or the code point is not assigned."""
    if c in DOUBTFUL:
        return ""
    if c in CONTROL_SPACES:
        return "space"
    now, then = (tables.category(c) for tables in (unicodedata, unicodedata.ucd_3_2_0))
    kinds = {"" if x in ("Cn", "Cs") else {"L": "letter", "N": "number", "Z": "space"}.get(x[0], "other") for x in (now, then)}
    return kinds.pop() if len(kinds) == 1 else ""


@lru_cache(4)
def decided(pattern: str) -> frozenset[tuple[str, str]]:
    """The kinds of neighbours between which the pattern always starts a match: those between which it does in every
    context of samples, of up to two code points before and one after."""
    find = regex.compile(pattern).finditer
    single = [c for own in SAMPLES.values() for c in own]
    before, after = ["", *single, *(a + b for a in single for b in single)], ["", *single]
    splits = lambda x, y: all(any(m.start() == len(a) + 1 for m in find(a + x + y + b)) for a in before for b in after)
    return frozenset((one, two) for one, xs in SAMPLES.items() for two, ys in SAMPLES.items() if all(splits(x, y) for x in xs for y in ys))


def boundaries(text: str, pattern: str, pairs: frozenset[tuple[str, str]]) -> np.ndarray:
    """Where pre-tokens start that may be cut at, whatever stands before and after the text."""
    found = (m.start() for m in regex.compile(pattern).finditer(text))
    return np.array([b for b in found if b and (kind(text[b - 1]), kind(text[b])) in pairs], np.int32)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))


def _encode(path: str, pattern: str, text_at: int):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = _lists([enc.encode_to_numpy(t, disallowed_special=()) for t in part.column(text_at).to_pylist()])
                names = [*part.schema.names[:text_at], "ids", *part.schema.names[text_at + 1 :]]
                yield pa.RecordBatch.from_arrays([*part.columns[:text_at], ids, *part.columns[text_at + 1 :]], names)

    return encode


def _chunks(chunk: int, overlap: int):
    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist()):
                key = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                starts = range(0, max(1, len(text) - overlap), chunk)
                for at in range(0, len(starts), 64):
                    some = starts[at : at + 64]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id.as_py()] * n, doc_id.type), pa.array([key] * n, pa.binary()), pa.array(range(at, at + n), pa.int32()), pa.array([text[x : x + chunk + overlap] for x in some], pa.string())],
                        ["doc_id", "text_key", "chunk", "text"],
                    )

    return chunks


def _zones(pattern: str, chunk: int, overlap: int):
    pairs = decided(pattern)

    def zones(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for text in batch.column("text").to_pylist():
                found = boundaries(text, pattern, pairs)
                left.append(found[found < overlap])
                right.append(found[found >= chunk] - chunk)
            keys = [batch.column(x) for x in ("doc_id", "text_key", "chunk")]
            yield pa.RecordBatch.from_arrays([*keys, _lists(left), _lists(right)], ["doc_id", "text_key", "chunk", "left", "right"])

    return zones


def pieces_of(long_docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``doc_id, text_key, piece, copies, text``: long texts cut where overlapping chunks resynchronise."""
    kind = long_docs.schema["doc_id"].dataType.simpleString()
    chunks = written(long_docs.mapInArrow(_chunks(chunk, overlap), f"doc_id {kind}, text_key binary, chunk int, text string"), "chunks")
    key = ["doc_id", "text_key"]
    shape = f"doc_id {kind}, text_key binary, chunk int, left array<int>, right array<int>"
    zones = chunks.mapInArrow(_zones(pattern, chunk, overlap), shape).distinct()  # equal rows have equal chunks
    order = Window.partitionBy(*key).orderBy("chunk")
    cut = F.array_min(F.array_intersect(F.lag("right").over(order), F.col("left")))
    cuts = zones.withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(cut))
    piece = F.max(F.when(F.col("cut").isNotNull(), F.col("chunk"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = cuts.withColumn("piece", piece).withColumn("next_cut", F.lead("cut").over(order)).withColumn("end", F.lead("chunk").over(order).isNull())
    joins = F.col("cut").isNull() | F.coalesce(F.lead("piece").over(order) == F.col("piece"), F.lit(False))
    cuts = cuts.select(*(F.col(c).alias(f"_{c}") for c in (*key, "chunk")), "cut", "next_cut", "end", "piece", joins.alias("joins"))
    joined = chunks.join(cuts, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")) & (F.col("chunk") == F.col("_chunk")))
    first = F.coalesce("cut", F.lit(0))
    last = F.when(F.col("end"), F.length("text")).otherwise(chunk + F.coalesce("next_cut", F.lit(0)))
    parts = joined.select(*key, "chunk", "piece", "joins", F.substr("text", first + 1, F.greatest(last - first, F.lit(0))).alias("text"))
    # a chunk that resynchronised is a piece as it stands; only what follows a chunk that did not is put together
    plain = parts.where("not joins").select(*key, "piece", F.lit(1).cast("long").alias("copies"), "text")
    grouped = parts.where("joins").groupBy(*key, "piece").agg(F.sort_array(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
    once = F.array_distinct("parts")
    joint = grouped.select(*key, "piece", (F.size("parts") / F.size(once)).cast("long").alias("copies"), F.array_join(F.transform(once, lambda x: x["text"]), "").alias("text"))
    return plain.unionByName(joint)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids`` (array of int), a row per input row. Texts of one chunk need no shuffle."""
    if overlap < 8 or chunk < 2 * overlap:
        raise ValueError("a chunk holds two overlaps at least, an overlap 8 characters")
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    is_long = F.length("text") > chunk + overlap
    short = rows.where(~is_long).mapInArrow(_encode(ranks_path, pattern, 1), f"doc_id {kind}, ids array<int>")
    pieces = pieces_of(rows.where(is_long), pattern, chunk, overlap)
    coded = pieces.mapInArrow(_encode(ranks_path, pattern, 4), f"doc_id {kind}, text_key binary, piece int, copies long, ids array<int>")
    whole = coded.groupBy("doc_id", "text_key").agg(F.sum("copies").alias("copies"), F.sort_array(F.collect_set(F.struct("piece", "ids"))).alias("parts"))
    copies = F.array_repeat(F.lit(0), (F.col("copies") / F.size("parts")).cast("int"))
    whole = whole.select("doc_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), F.explode(copies).alias("_copy")).drop("_copy")
    return short.unionByName(whole)


def _decode(path: str):
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [b"".join(map(table.__getitem__, ids or ())) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return decode


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary) to ``doc_id, ids``; null ids decode to nothing."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(_decode(ranks_path), f"doc_id {kind}, ids array<int>, decoded binary")
