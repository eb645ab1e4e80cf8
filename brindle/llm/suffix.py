"""Suffix-array dedup: every byte that lies in a repeated string of ``window`` bytes is removed.

All windows of all texts are dealt out by their minimizer, the least hash of the 64-byte strings in them:
equal windows have equal minimizers, and neighbouring windows mostly share one, so a run of them travels as
one segment. Equal segments are counted. A segment that occurs twice repeats as a whole; where different
segments share a minimizer, one of each kind is put into a suffix array, and the neighbours there that agree
on ``window`` bytes show the repeated windows. The spans go back to all documents that hold the segment.

A minimizer of many different segments is dealt finer, by the strings around the minimizer of which any shared
window contains one, and where many segments hold such a string too, every pair of their blocks has a suffix
array of its own: no task holds more than two blocks at a time, and no pair is left out.

The suffix array is built by grouping, without recursion or renaming: the groups of suffixes, which share a
Lyndon prefix when they are done, are processed in descending order; each looks for the previous smaller
suffix of its members and moves these up to a group of their own, and a last pass emits each group in order.

Nothing depends on hashes but the dealing and the equality of segments: 64 bits of blake2b among those of one
minimizer.

Defined cases: null text is empty; a text below ``window`` bytes loses nothing; rows that share a ``doc_id``
are separate texts (32 bits of a text hash tell them apart), and equal rows repeat each other; a null
``doc_id`` is a document like others; an empty table gives an empty result; extra columns are carried, but for ones
named ``n_bytes``, ``n_removed`` or ``spans``, which the operator's replace.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._groups import block_pairs, groups
from ._hashing import POWERS, mixed, prefix_hash
from ._shared import without, written

#: Fixed value of the contract.
WINDOW = 200
#: Parameters: bytes of the strings that minimizers are chosen from, and bytes that one suffix array takes together, and the
#: precision in bytes to which segments are known to differ before that.
GRAM, TOGETHER, STEP = 64, 32_768, 17
#: Different segments of a minimizer, or of a string around it, that are compared together; more are dealt finer.
BLOCK = 4096
#: Bytes of segments that are handed on at a time, and of texts that are hashed together.
HANDED, HASHED = 16_000_000, 32_768

_U = np.uint64


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in order. ``text`` holds small non-negative numbers; a text is smaller than its extensions."""
    n = len(text)
    if not n:
        return []
    # groups by the first number: each is an interval of ``order``
    size = [0] * (max(text) + 1)
    for c in text:
        size[c] += 1
    begin, at = [], 0
    for k in size:
        begin.append(at)
        at += k
    group, fill, order, place = list(text), begin.copy(), [0] * n, [0] * n
    for i, c in enumerate(text):
        place[i] = fill[c]
        order[fill[c]] = i
        fill[c] += 1
    before = [-1] * n  # the previous smaller suffix, once the group is done
    last = n - 1
    while last >= 0:
        g = group[order[last]]
        first = begin[g]
        members = order[first : last + 1]
        if first < last:
            members.sort()
        # how many members have each previous smaller suffix
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and begin[group[j]] >= first:  # this group or a higher one: its pointer is known
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            by.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(by, reverse=True):
            for h, moved in by[k].items():
                if len(moved) == size[h]:
                    continue  # all of the group: it stays where it is
                new = len(begin)
                end = begin[h] + size[h]
                for j in moved:
                    end -= 1
                    x, p = order[end], place[j]
                    order[p], place[x] = x, p
                    order[end], place[j] = j, end
                    group[j] = new
                size[h] -= len(moved)
                begin.append(end)
                size.append(len(moved))
        last = first - 1
    # emit: the suffixes whose next smaller suffix is the one just met come next in their groups
    fill, out, done = begin.copy(), [-1] * n, bytearray(n)
    j = n - 1
    while j >= 0:  # those that only the end of the text is smaller than
        out[fill[group[j]]] = j
        fill[group[j]] += 1
        done[j] = 1
        j = before[j]
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            out[fill[group[j]]] = j
            fill[group[j]] += 1
            done[j] = 1
            j = before[j]
    return out


def repeated_starts(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For each segment the starts in it of windows that start elsewhere in these segments too."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    offsets = np.cumsum(sizes) - sizes
    room = np.repeat(offsets + sizes, sizes) - np.arange(len(raw))  # bytes up to the segment's end
    order = np.array(suffix_array(raw.tolist()), np.int64)
    # suffixes that agree on a window are neighbours, if those too short for one are left out
    long = order[room[order] >= window]
    a, b = long[:-1], long[1:]
    pair = np.arange(len(a))
    width = 8 if window % 8 == 0 else 1
    words = np.lib.stride_tricks.sliding_window_view(raw, width) if len(raw) >= width else raw.reshape(-1, 1)[:0]
    for k in range(0, window, width):
        pair = pair[(words[a[pair] + k] == words[b[pair] + k]).all(1)]
    hit = np.zeros(len(raw), bool)
    hit[a[pair]] = hit[b[pair]] = True
    return [np.flatnonzero(hit[o : o + s]) for o, s in zip(offsets, sizes)]


def runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Sorted numbers as half-open runs."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    return [(int(p[0]), int(p[-1]) + 1) for p in np.split(at, cuts)]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minima of all windows of ``width``."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - width + have], x[width - have :])


def segments(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Text, minimizer, content hash, first window and number of windows of each segment of some texts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5
    sizes = np.array([len(t) for t in texts])
    past = np.cumsum(sizes)
    sums = prefix_hash(raw)
    _, down = POWERS.to(len(raw) + 1)
    gram = min(GRAM, window)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    least = sliding_least(grams, window - gram + 1)
    # a window whose least string is its first is the last of its segment, so a segment holds its minimizer once
    new = np.ones(n + 1, bool)
    new[1:n] = (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])
    # a text's windows end where it does: what would start behind lies in two texts
    enough = sizes >= window
    new[(past - sizes)[enough]] = new[past[enough] - window + 1] = True
    starts = np.flatnonzero(new)
    counts = np.diff(starts)
    starts = starts[:-1]
    owner = np.searchsorted(past, starts, "right")
    inside = starts + window <= past[owner]
    starts, counts, owner = starts[inside], counts[inside], owner[inside]
    ends = starts + counts + window - 1
    whole = raw.tobytes()
    content = b"".join([blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return owner, least[starts].view(np.int64), np.frombuffer(content, "<i8"), starts - (past - sizes)[owner], counts


def _bytes(column: pa.Array) -> list[bytes]:
    """Texts as the bytes that Arrow holds anyway."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def minimizers_at(contents: list[bytes], window: int) -> list[int]:
    """Where in each segment its minimizer stands: at the first least string of its first window."""
    gram = min(GRAM, window)
    up, down = POWERS.to(window + 1)
    out: list[int] = []
    for k in range(0, len(contents), 256):
        raw = np.frombuffer(b"".join(c[:window] for c in contents[k : k + 256]), np.uint8).reshape(-1, window)
        sums = np.zeros((len(raw), window + 1), _U)
        np.cumsum((raw.astype(_U) + _U(1)) * up[:window], 1, out=sums[:, 1:])
        out += mixed((sums[:, gram:] - sums[:, :-gram]) * down[: window - gram + 1]).argmin(1).tolist()
    return out


def around(segment: bytes, at: int, window: int, step: int = STEP) -> list[tuple[int, bytes]]:
    """Strings around the minimizer at ``at``, of which each window of the segment contains one.

    By where the minimizer stands in a window, in steps of some bytes: the windows that start ``left`` to
    ``left + step - 1`` bytes before it all contain the string given with ``left``."""
    gram = min(GRAM, window)
    rest = window - gram
    out = []
    for left in range(0, rest + 1, step):
        a, b = at - left, at + gram + max(0, rest - left - step + 1)
        if a >= 0 and b <= len(segment):
            out.append((left, segment[a:b]))
    return out


def parts(segment: bytes, at: int, window: int) -> list[int]:
    """The one or two groups of a finer deal that a segment is in: hashes, never 0, of long strings around its minimizer."""
    held = around(segment, at, window, (window - min(GRAM, window)) // 2 + 1)
    return [int.from_bytes(blake2b(b"%d " % left + text, digest_size=8).digest(), "little", signed=True) | 1 for left, text in held]


def may_match(contents: list[bytes], places: list[int], single: list[bool], window: int) -> list[int]:
    """The segments of one minimizer that may share a window with another, one of the two occurring once only:
    both hold a string around the minimizer that such a window contains."""
    holders: dict[tuple[int, bytes], list[int]] = {}
    for k, (text, at) in enumerate(zip(contents, places)):
        for held in around(text, at, window):
            holders.setdefault(held, []).append(k)
    return sorted({k for own in holders.values() if len(own) > 1 and any(single[x] for x in own) for k in own})


def _kinds(window: int):
    """Per batch each kind of segment once, with its number and one place."""

    def kinds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _placed(window)(batches):
            keys, kind = (found.column(k).to_numpy() for k in ("key", "kind"))
            order = np.lexsort((kind, keys))
            new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (kind[order][1:] != kind[order][:-1])])[: len(order)]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([*found.take(pa.array(order[first])).columns, pa.array(n, pa.int64())], [*found.schema.names, "n"])

    return kinds


def _placed(window: int):
    """The segments: ``doc_id, tag`` (of the text), ``key`` (minimizer), ``kind`` (content), ``start, windows``."""

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size, first = [], 0, 0
            for some in _together(_bytes(batch.column(1))):
                owner, *own = segments(some, window)
                tags = np.array([crc32(t) - 2**31 for t in some], np.int32)
                found.append((owner + first, tags[owner], *own))
                first += len(some)
                size += len(owner)
                if size > 1_000_000:
                    yield _batch(batch, found)
                    found, size = [], 0
            if size:
                yield _batch(batch, found)

    return placed


def _together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of about HASHED bytes; a longer text is alone."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > HASHED:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def _batch(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    owner, tag, key, kind, start, windows = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(owner)), pa.array(tag), pa.array(key), pa.array(kind), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int16))],
        ["doc_id", "tag", "key", "kind", "start", "windows"],
    )


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists, and how many each list has; a null list has none."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _contents(window: int):
    """The bytes of the segments asked for, in part 0 of their minimizer or in the parts of the finer deal."""

    def batch_of(keys: list, kinds: list, single: list, dealt: list, found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int64()), pa.array(single, pa.bool_()), pa.array(dealt, pa.int64()), pa.array(found, pa.binary())], ["key", "kind", "single", "part", "content"])

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, size = ([], [], [], [], []), 0
            asked, per_row = _flat(batch.column("asked"))
            keys, kinds, ns, starts, ends, many = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("key", "kind", "n", "start", "windows", "many"))
            single, ends = ns == 1, starts + ends.astype(np.int64) + window - 1
            past = np.cumsum(per_row)
            for text, tag, a, b in zip(_bytes(batch.column("text")), batch.column("tag").to_pylist(), (past - per_row).tolist(), past.tolist()):
                if crc32(text) - 2**31 != tag:
                    continue
                found = [text[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                where = np.arange(a, b)
                dealt: list[int] = [0] * (b - a)
                if many[a:b].any():
                    places = minimizers_at(found, window)
                    fine = [parts(c, at, window) if m else [0] for c, at, m in zip(found, places, many[a:b].tolist())]
                    found, where, dealt = [c for c, p in zip(found, fine) for _ in p], np.repeat(where, [len(p) for p in fine]), [x for p in fine for x in p]
                for column, value in zip(columns, (keys[where], kinds[where], single[where], dealt, found)):
                    column.extend(value)
                size += sum(map(len, found))
                if size > HANDED:
                    yield batch_of(*columns)
                    columns, size = ([], [], [], [], []), 0
            yield batch_of(*columns)

    return contents


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _arrays(window: int):
    """Suffix arrays over the segments of one or more minimizers, and from them the runs of repeated windows of those that occur once."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        found = repeated_starts(rows.column("content").to_pylist(), window)
        spans = pa.array([[{"a": a, "b": b} for a, b in runs(x)] for x in found], _RUNS)
        out = pa.RecordBatch.from_arrays([rows.column("key").combine_chunks(), rows.column("kind").combine_chunks(), spans], ["key", "kind", "spans"])
        return out.filter(pc.and_(pa.array([len(x) > 0 for x in found], pa.bool_()), rows.column("single").combine_chunks()))

    def arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        placed = (b.append_column("at", pa.array(minimizers_at(b.column("content").to_pylist(), window), pa.int16())) for b in batches)
        for group in groups(placed, ["key", "part", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            contents = group.column("content").to_pylist()
            picked = may_match(contents, group.column("at").to_pylist(), group.column("single").to_pylist(), window)
            if not picked:
                continue
            group = group.take(pa.array(picked))
            own = sum(len(contents[k]) for k in picked)
            # groups of one minimizer share segments, which must not meet themselves
            if held and (size + own > TOGETHER or held[-1].column("key")[0] == group.column("key")[0]):
                yield solve(held)
                held, size = [], 0
            held.append(group)
            size += own
        if held:
            yield solve(held)

    return arrays


def covered(rows: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the byte runs under the windows that start in the given runs of each row, in order."""
    base = rows.astype(np.int64) << 32  # no run reaches into the next row
    order = np.argsort(base + a, kind="stable")
    begins, ends = (base + a)[order], np.maximum.accumulate((base + b + (window - 1))[order])
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > ends[:-1]])[: len(begins)])
    last = np.append(new[1:], len(begins))[: len(new)] - 1
    return begins[new] >> 32, begins[new] & 0xFFFFFFFF, ends[last] & 0xFFFFFFFF


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends, so that what remains is valid UTF-8."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _remove(window: int, text_at: int, exact: bool):
    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(text_at))
            places, per_row = _flat(batch.column("_places"))
            spans, per_place = _flat(places.field("spans"))
            row = np.repeat(np.repeat(np.arange(len(texts)), per_row), per_place)
            start = np.repeat(places.field("start").to_numpy(zero_copy_only=False), per_place)
            row, begins, ends = covered(row, *(start + spans.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b")), window)
            offsets = np.searchsorted(row, np.arange(len(texts) + 1))
            n_removed = np.bincount(row, ends - begins, len(texts)).astype(np.int64)
            kept = list(texts)
            for k in np.unique(row).tolist():
                text, own = texts[k], slice(offsets[k], offsets[k + 1])
                cuts = list(zip(begins[own].tolist(), ends[own].tolist()))
                cuts = cuts if exact else whole_characters(text, cuts)
                kept[k] = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]))
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n not in ("_tag", "_places")]
            names = [n for n in batch.schema.names if n not in ("_tag", "_places")]
            remains = pa.array(kept, pa.binary())
            columns[text_at] = remains if exact else remains.cast(pa.string())
            removed = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (begins, ends)], fields=list(_RUNS.value_type))
            removed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), removed)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed), removed], [*names, "_n_bytes", "_n_removed", "_spans"])

    return remove


def tag_of(text: Column) -> Column:
    return (F.crc32(F.coalesce(text, F.lit("")).cast("binary")) - F.lit(2**31)).cast("int")


def dealt(contents: DataFrame) -> DataFrame:
    """``contents`` by the tasks ``key, part, lo, hi`` that compare them, the rows of each following each other."""
    fine = contents.where("part <> 0")
    large = fine.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK).select(F.col("key").alias("_k"), F.col("part").alias("_p"), "rows")
    fine = fine.join(large, (F.col("key") == F.col("_k")) & (F.col("part") == F.col("_p")), "left")
    fine = block_pairs(fine, F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK), F.xxhash64("kind"))
    plain = contents.where("part = 0").withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    task = ["key", "part", "lo", "hi"]
    return plain.unionByName(fine.select(*plain.columns)).repartition(*task).sortWithinPartitions(*task)


def repeated_segments(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, tag, places``: for each text that repeats something, its segments (start, spans of repeated windows)."""
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_kind}, tag int, key long, kind long, start int, windows short"
    # counted per batch before the shuffle; grouping and window use the one exchange by minimizer
    kinds = rows.mapInArrow(_kinds(window), f"{shape}, n long").repartition("key").groupBy("key", "kind").agg(
        F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "tag", "start", "windows"))
    )
    own = Window.partitionBy("key")
    sums = kinds.withColumns({"kinds": F.count(F.lit(1)).over(own), "_total": F.sum("n").over(own)})
    hot = written(sums.where("_total > 1").drop("_total"), "repeated")

    asked = hot.where("kinds > 1").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("key", "kind", "n", "start", "windows", (F.col("kinds") > BLOCK).alias("many"))).alias("asked"))
    texts = rows.select(F.col("doc_id").alias("_id"), "text")
    contents = texts.join(asked, F.col("_id").eqNullSafe(F.col("doc_id"))).select("text", "tag", "asked")
    contents = written(contents.mapInArrow(_contents(window), "key long, kind long, single boolean, part long, content binary"), "contents")
    partial = dealt(contents).mapInArrow(_arrays(window), "key long, kind long, spans array<struct<a: int, b: int>>")
    partial = partial.groupBy("key", "kind").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").cast("int").alias("b")))
    # a kind is in one of the two; a union has no partitioning, so the join exchanges both its sides and can split a hot kind
    spans = hot.where("n > 1").select("key", "kind", whole.alias("spans")).unionByName(partial)

    placed = rows.mapInArrow(_placed(window), shape)
    at = placed.join(spans, ["key", "kind"]).select("doc_id", "tag", F.struct("start", "spans").alias("place"))
    return at.groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, exact: bool = False) -> DataFrame:
    """``docs`` with what remains of the text, and ``n_bytes, n_removed, spans`` (byte runs) as last columns.

    With ``exact`` the text column is binary, the remaining bytes as they are; without, spans are shrunk to
    whole characters in it, so that it stays text (the counts and spans are the exact ones)."""
    docs = without(docs, "n_bytes", "n_removed", "spans")
    names = docs.columns
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    places = repeated_segments(rows, window).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("places").alias("_places"))
    plain = docs.select(*(F.col(f"`{old}`").alias(f"_c{k}") for k, old in enumerate(names)))
    doc_id, text = (f"_c{names.index(c)}" for c in (id_col, text_col))
    joined = plain.join(places, F.col(doc_id).eqNullSafe(F.col("_id")) & (tag_of(F.col(text)) == F.col("_tag")), "left").drop("_id")
    fields = ", ".join(f"`{f.name}` {'binary' if exact and f.name == text else f.dataType.simpleString()}" for f in plain.schema.fields)
    out = joined.mapInArrow(_remove(window, names.index(text_col), exact), f"{fields}, _n_bytes long, _n_removed long, _spans array<struct<a: int, b: int>>")
    return out.select(*(F.col(f"_c{k}").alias(old) for k, old in enumerate(names)), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_spans").alias("spans"))
