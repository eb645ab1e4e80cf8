"""Cost-balanced packing of documents into token sequences.

A document is its ids and one end id, cut into parts of at most ``capacity``. Parts are dealt to groups of
bounded size by a hash; in each group they go in descending order to the sequence of the lowest estimated
cost (linear plus quadratic in the length of each part) that has room, and what doesn't fit goes back.
The sequences of a group hold exactly its tokens: as many full ones as there are, and for the rest one for
each power of two in it, so nothing is padded where a power of two may stay as it is.

Defined cases: null text is empty and has its end id alone; repeated rows are packed each; a null id is
carried; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import id_and_text

#: Fixed values of the contract.
CAPACITY, END_ID = 2048, 1
#: Parameters: cost of a token and of a pair of tokens; bytes of text in a group.
LINEAR, QUADRATIC, GROUP_BYTES = 1.0, 1.0 / 1024, 8_000_000


@lru_cache(4)
def encoder(path: str, pattern: str, added: bool = True) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file, whose ids are in the order of its merges.

    It gives the ids of that library (a test holds them together) in a quarter of the time. The file's added tokens get
    their ids where a text contains them, as that library does by default; without ``added`` they are plain text, as with
    its ``encode_special_tokens``."""
    with open(path, encoding="utf-8") as file:
        vocabulary, special = (spec := json.load(file))["model"]["vocab"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level BPE writes as they are
    letter = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    known = {bytes(letter[c] for c in token): number for token, number in vocabulary.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens=special if added else {})


def _parts(path: str, pattern: str, capacity: int, end_id: int, added: bool):
    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, added)
        end = np.array([end_id])
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = batch.slice(at, 128)
                picked, starts, totals, found, copies = [], [], [], [], []
                for k, (doc_id, text) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())):
                    row = blake2b(f"{doc_id!r} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    ids = np.concatenate([enc.encode_to_numpy(text, allowed_special=enc.special_tokens_set, disallowed_special=()), end])
                    ids = ids.astype("<u2" if enc.n_vocab < 65_536 else "<u4")
                    cuts = range(0, len(ids), capacity)
                    copies += [seen[row]] * len(cuts)
                    seen[row] += 1
                    picked += [k] * len(cuts)
                    starts += cuts
                    totals += [len(ids)] * len(cuts)
                    found += [ids[x : x + capacity].tobytes() for x in cuts]
                doc_ids = rows.column(0).take(pa.array(picked, pa.int64()))
                width = 2 if enc.n_vocab < 65_536 else 4
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array([width] * len(starts), pa.int32()), pa.array(found, pa.binary()), pa.array([task] * len(starts), pa.int32()), pa.array(copies, pa.int64())], ["doc_id", "start", "doc_tokens", "width", "ids", "task", "copy"])

    return parts


def capacities(total: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold exactly ``total`` tokens: full ones, then powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """``(part, start, length, sequence, offset)``; parts are cut where the cheapest sequence ends."""
    room = capacities(sum(lengths), capacity)
    sequences = [(0.0, k) for k in range(len(room))]  # a heap as it stands
    used = [0] * len(room)
    parts = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(parts)
    out = []
    while parts:
        negative, part, start = heapq.heappop(parts)
        cost, at = heapq.heappop(sequences)
        length = min(-negative, room[at] - used[at])
        out.append((part, start, length, at, used[at]))
        used[at] += length
        if used[at] < room[at]:
            heapq.heappush(sequences, (cost + linear * length + quadratic * length * length, at))
        if length < -negative:
            heapq.heappush(parts, (negative + length, part, start + length))
    return out


def _pack_group(capacity: int, linear: float, quadratic: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")]).combine_chunks()
        ids, width = group.column("ids").to_pylist(), group.column("width")[0].as_py()
        rows = pack([len(x) // width for x in ids], capacity, linear, quadratic)
        rows.sort(key=lambda r: (r[3], r[4]))
        part, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*rows))
        cut = [np.frombuffer(ids[p], f"<u{width}")[s : s + n].astype("<u4").tobytes() for p, s, n, _, _ in rows]
        number = group.column("group")[0].as_py()
        return pa.table(
            {
                "doc_id": group.column("doc_id").take(pa.array(part)), "start": pa.array(start + group.column("start").to_numpy()[part]), "length": length, "ids": pa.array(cut, pa.binary()),
                "doc_tokens": group.column("doc_tokens").take(pa.array(part)), "sequence_id": pa.array(sequence + (number << 32)), "offset": offset,
            }
        )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, group_bytes: int = GROUP_BYTES, added: bool = True) -> DataFrame:
    """``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset`` of each piece.

    The number of groups follows the bytes of text; parts, not documents, are dealt, by a hash of themselves, the task that
    reads them and how often that task has met the document: so a long document spreads over groups, a row that is repeated
    often does too, and every group stays near ``group_bytes``. A task that runs again deals the same."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(_parts(tokenizer_path, pattern, capacity, end_id, added), f"doc_id {kind}, start long, doc_tokens long, width int, ids binary, task int, copy long")
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids", "task", "copy"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(
        _pack_group(capacity, linear, quadratic), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
