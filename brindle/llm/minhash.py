"""MinHash near-dedup with b-bit signatures and an exact confirmation.

Documents are sets of hashed 5-word shingles (64 bits made of a blake2b hash of each word). Equal sets are one class from the start. Of each class 128
minima are taken; bands of four give candidate buckets, and the low four bits of each minimum make a packed
signature of 64 bytes. In a bucket every pair is compared by counting equal lanes, corrected for the
lanes that agree by chance; pairs estimated at ``estimate`` or more tie their classes into a clump. In a
clump all full sets are compared exactly, and the links make the components.

Nothing is dropped from large buckets or clumps: they are dealt to blocks and every pair of blocks is
compared in a task of its own. Only edges that join something are passed on, so rows grow with documents,
not with pairs. What can be missed is a pair at 0.75 or more that no band catches (0.684 ** 32, 5 in a
million) or whose estimate is five deviations low. What can be linked by mistake are sets of which that many
64-bit hashes agree by chance, since sets are compared by the hashes of their shingles, not by their words.

Defined cases: null or blank text has an empty set, 0 shingles, and is its own component; with fewer than
five words the whole sequence is the one shingle; rows that share a ``doc_id`` are one document with the
links of all of them, each row with its own ``n_shingles``; a null ``doc_id`` is linked with nothing,
has a null component and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import Union, block_pairs, connected_components, groups, sliced
from ._hashing import BASE, WordHashes, mixed
from ._shared import id_and_text, written

#: Fixed values of the contract: words in a shingle, and 100 * intersection >= 75 * union.
WORDS, PERCENT = 5, 75

#: Parameters of the method.
MINIMA, ROWS_IN_BAND, BITS, ESTIMATE = 128, 4, 4, 0.55
#: Classes of a bucket, and shingles of a clump, that one block holds.
BUCKET_BLOCK, CLUMP_BLOCK = 1024, 4_000_000

_U = np.uint64
_WORDS = WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = _WORDS.of(text.lower().split())  # bytes split at exactly the six ASCII white-space characters, and lower A-Z alone
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    span = min(n, WORDS)
    out = np.full(n - span + 1, _U(span), _U)
    for k in range(span):
        out = mixed(out * _U(0xD6E8FEB86659FD93) + words[k : n - span + 1 + k])
    return np.unique(out)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    a = mixed(np.arange(1, MINIMA + 1, dtype=_U) * BASE) | _U(1)
    return a, mixed(np.arange(1, MINIMA + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each of the MINIMA hash functions."""
    a, b = _seeds()
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 2048):  # bounded memory for any set
        part = hashes[at : at + 2048, None]
        least = np.minimum(least, ((part * a + b) >> _U(32)).astype(np.uint32).min(0))
    return least


def packed(least: np.ndarray) -> bytes:
    """The low BITS bits of the minima, in lanes of BITS."""
    lanes = (least & ((1 << BITS) - 1)).astype(np.uint8)
    return (lanes[0::2] | lanes[1::2] << 4).tobytes()


def similarity(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard from packed signatures (rows of 64-bit words): the share of equal lanes, less those by chance."""
    x = own ^ others
    x |= x >> _U(2)
    x |= x >> _U(1)
    unequal = np.bitwise_count(x & _U(0x1111111111111111)).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((MINIMA - unequal) / MINIMA - chance) / (1 - chance)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(-1, ROWS_IN_BAND).astype(_U)
    keys = mixed(np.arange(1, len(rows) + 1, dtype=_U))
    for k in range(ROWS_IN_BAND):
        keys = mixed(keys * _U(0xD6E8FEB86659FD93) + rows[:, k])
    return keys.view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        counts, keys, signatures, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingles(text.encode("utf-8", "surrogatepass"))
            counts.append(len(hashes))
            least = minima(hashes) if len(hashes) else None
            keys.append(None if least is None else set_key(hashes))
            signatures.append(None if least is None else packed(least))
            bands.append(None if least is None else band_keys(least))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "class", "signature", "bands"],
        )


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket (or pair of its blocks) the edges of a forest over the pairs of high estimate."""
    a, b = [], []
    for group in groups(batches, ["key", "lo", "hi"]):
        if group.num_rows < 2:
            continue
        names, block = group.column("class").to_pylist(), group.column("block").to_numpy()
        signatures, union = _rows_of(group.column("signature"), MINIMA * BITS // 64), Union(group.num_rows)
        across = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        for k in range(group.num_rows - 1):
            close = similarity(signatures[k], signatures[k + 1 :]) >= ESTIMATE
            if across:
                close &= block[k + 1 :] != block[k]
            for x in np.flatnonzero(close).tolist():
                if union.join(k, k + 1 + x):
                    a.append(names[k])
                    b.append(names[k + 1 + x])
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets; of rows that share an id only those of the class asked for."""
    for batch in sliced(batches):
        sets = [shingles(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        right = pa.array([set_key(s) == c for s, c in zip(sets, batch.column("class").to_pylist())], pa.bool_())
        names = [n for n in batch.schema.names if n != "text"]
        out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "hashes"])
        yield out.filter(right)


def links(sets: list[np.ndarray], sides: np.ndarray | None, union: Union) -> Iterator[tuple[int, int]]:
    """A forest over all pairs with 100 * intersection >= 75 * union, by an inverted index over the shared hashes.

    ``sides``: if given, only pairs of different sides count."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    ends = np.append(starts[1:], len(flat))
    number = np.empty(len(flat), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), ends - starts)  # of each set's hashes, the posting
    at = 0
    for k in range(len(sets)):
        postings, at = number[at : at + sizes[k]], at + sizes[k]
        postings = postings[ends[postings] - starts[postings] > 1]
        if not len(postings):
            continue
        shared = np.zeros(len(sets), np.int64)
        for part in np.array_split(postings, 1 + int((ends[postings] - starts[postings]).sum()) // 4_000_000):
            n = ends[part] - starts[part]
            where = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared += np.bincount(owner[where], minlength=len(sets))
        linked = (100 + PERCENT) * shared >= PERCENT * (sizes + sizes[k])
        linked[: k + 1] = False
        if sides is not None:
            linked &= sides != sides[k]
        for x in np.flatnonzero(linked).tolist():
            if union.join(k, x):
                yield k, x


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each clump (or pair of its blocks) a forest of confirmed links between representatives."""
    for group in groups(batches, ["clump", "lo", "hi"]):
        if group.num_rows < 2:
            continue
        sets = [np.frombuffer(x, _U) for x in group.column("hashes").to_pylist()]
        across = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        found = list(links(sets, group.column("block").to_numpy() if across else None, Union(len(sets))))
        ids = group.column("rep")
        yield pa.RecordBatch.from_arrays([ids.take(pa.array([x[k] for x in found], pa.int64())) for k in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per input row."""
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketch = rows.mapInArrow(_sketch, f"doc_id {kind}, n_shingles long, class binary, signature binary, bands array<long>")
    sketch = written(sketch, "sketch")
    named = sketch.where("doc_id is not null and class is not null")
    classes = named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")

    banded = classes.select("class", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucketed = banded.join(shared, "key").join(classes.select("class", "signature"), "class")
    dealt = block_pairs(bucketed, F.ceil(F.col("n") / BUCKET_BLOCK), F.xxhash64("class")).select("key", "lo", "hi", "block", "class", "signature")
    edges = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_similar, "a binary, b binary")
    clumps = connected_components(edges).select(F.col("node").alias("class"), F.col("component").alias("clump"))

    members = written(clumps.join(classes.select("class", "rep", "n"), "class"), "members")
    sizes = members.groupBy(F.col("clump").alias("_clump")).agg(F.sum("n").alias("_total"))
    # by a shuffle at any size: what the few members of a small corpus would save there, a large one does not
    texts = rows.join(members.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id").withColumnRenamed("doc_id", "rep")
    full = texts.select("text", "class", "clump", "rep").mapInArrow(_sets, f"class binary, clump binary, rep {kind}, hashes binary")
    blocks = full.join(sizes, F.col("clump") == F.col("_clump"))
    dealt = block_pairs(blocks, F.ceil(F.col("_total") / CLUMP_BLOCK), F.xxhash64("class")).select("clump", "lo", "hi", "block", "rep", "hashes")
    confirmed = dealt.repartition("clump", "lo", "hi").sortWithinPartitions("clump", "lo", "hi").mapInArrow(_confirm, f"a {kind}, b {kind}")

    reps = classes.select("class", "rep")
    own = named.select("doc_id", "class").join(reps, "class")
    several = own.groupBy("doc_id").agg(F.min("rep").alias("m"), F.max("rep").alias("x")).where("m < x").select(F.col("doc_id").alias("_id"), "m")
    several = own.join(several, F.col("doc_id") == F.col("_id")).select(F.col("rep").alias("a"), F.col("m").alias("b"))
    components = connected_components(confirmed.unionByName(several))
    of_class = reps.join(components, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
