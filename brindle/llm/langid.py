"""Language ID for mixed-language text.

Words are runs of letters (single characters in scripts written without spaces). Script ranges leave each
word the languages that write it; hashed character n-grams (1 to 3) give it a log-probability under each
of them; Viterbi over the words with a penalty for switching labels spans. The language of a document is
the one with most words, its score that language's share of the words.

Training takes the labelled documents of at most ``max_docs`` ids of each language (the first by a hash of the
id), whole texts, which are read where they lie and not shuffled; the model has at most ``2 ** bits`` cells a language, which bounds what is collected and
broadcast.

Defined cases: null text or text without a letter is ``und`` with score 0 and no spans; with nothing to
learn from, every text is ``und``; rows with a null id, text or language never train; ties go to the
language that sorts first; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameters of the method.
MAX_DOCS, BITS, SMOOTHING, SWITCH_PENALTY, SCRIPT_SHARE = 4000, 16, 0.5, 12.0, 0.01
#: Texts are taken in blocks of so many characters, their features in slices.
BLOCK_CHARS, SLICE_CHARS = 8_000_000, 1_000_000

#: The first and last code points of scripts; the last four are written without spaces.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("georgian", 0x10A0, 0x10FF), ("hangul", 0xAC00, 0xD7AF),
    ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
UNSPACED = [SCRIPT_NAMES.index(x) for x in ("thai", "kana", "han")]

_NO_LETTER = regex.compile(r"(?r)[^\p{L}\p{M}]")
LABEL = "_lang string, _cell int, _n long"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for letters (and marks, which only go on in a word), and the number of its script."""
    everything = "".join(map(chr, range(0xD800))) + "퟿" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    letters = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{L}\p{M}]+", everything):
        letters[m.start() : m.end()] = True
    letters[0xD800:0xE000] = False
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return letters, script


def _has_letter(text: str | None) -> bool:
    return bool(text) and regex.search(r"\p{L}", text) is not None


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words among code points, and their scripts."""
    letters, script = _tables()
    inside, of = letters[points], script[points]
    alone = inside & np.isin(of, UNSPACED)
    before = np.concatenate([[False], inside[:-1] & ~alone[:-1]])
    after = np.concatenate([inside[1:] & ~alone[1:], [False]])
    starts = np.flatnonzero(inside & (alone | ~before))
    ends = np.flatnonzero(inside & (alone | ~after)) + 1
    return starts, ends, of[starts]


def _cells(points: np.ndarray, inside: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each position the cells of the 1-, 2- and 3-grams that end there; before the first letter of a run spaces stand."""
    p = np.where(inside, points, 32).astype(np.uint64)
    b = np.concatenate([[np.uint64(32)], p[:-1]])
    a = np.where(b == 32, np.uint64(32), np.concatenate([[np.uint64(32)], b[:-1]]))
    mixed = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    return [mixed(p + np.uint64(1)), mixed((b << np.uint64(21)) + p + np.uint64(3)), mixed(((a << np.uint64(42)) + (b << np.uint64(21)) + p) * np.uint64(3) + np.uint64(7))]


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text between spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int8)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]).astype(bool)


def _slices(texts: list[str]) -> Iterator[str]:
    """The texts joined by spaces, in slices of about SLICE_CHARS cut where no letter is: no word is cut but one that
    fills a slice (in scripts without spaces: a run of words, whose next one then starts as after a space)."""
    joined = " ".join(texts)
    at = 0
    while at < len(joined):
        end = at + SLICE_CHARS
        if end < len(joined):
            cut = _NO_LETTER.search(joined, at + 1, end)
            end = cut.end() if cut else end
        yield joined[at:end]
        at = end


def _count(bits: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                n = np.zeros(2**bits + len(SCRIPT_NAMES), np.int64)
                for part in _slices(texts):
                    points = _points(part)
                    starts, ends, scripts = _words(points)
                    inside = _inside(len(points), starts, ends)
                    for cells in _cells(points, inside, bits):
                        n[: 2**bits] += np.bincount(cells[inside], minlength=2**bits)
                    n[2**bits :] += np.bincount(scripts, minlength=len(SCRIPT_NAMES))
                cells = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(n[cells])], ["_lang", "_cell", "_n"])

    return count


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _by_language(numbers: dict[str, int]) -> Column:
    """A number of each language as a column of ``_lang``."""
    known = [x for lang, number in sorted(numbers.items()) for x in (F.lit(lang), F.lit(number).cast("long"))]
    return F.create_map(*known)[F.col("_lang")] if known else F.lit(None).cast("long")


def _last_hashes(rows: DataFrame, max_docs: int) -> dict[str, int]:
    """By language the hash of the last id that trains: the ``max_docs``-th of its ids in order of their hashes.

    Only hashes below a share of their range that holds some more of them than that are ordered, so a task orders
    about that many whatever the size of a language. The driver gets two numbers a language."""
    hashed = rows.select("_lang", F.xxhash64("_id").alias("_h"))
    total = {r["_lang"]: r["n"] for r in hashed.groupBy("_lang").agg(F.approx_count_distinct("_h", 0.02).alias("n")).collect()}
    if not total:
        return {}
    wanted = 1.2 * max_docs + 8 * max_docs**0.5 + 8
    limit = {lang: 2**63 - 1 if n <= wanted else int(-(2**63) + 2**64 * wanted / n) for lang, n in total.items()}
    few = hashed.where(F.col("_h") <= _by_language(limit)).distinct()
    order = Window.partitionBy("_lang").orderBy("_h")
    numbered = few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max_docs)
    return {r["_lang"]: r["_last"] for r in numbered.groupBy("_lang").agg(F.max("_h").alias("_last")).collect()}


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, bits: int = BITS) -> dict:
    """The model: languages, log-probabilities by cell (float32) and the languages that write each script."""
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where("_id is not null and _lang is not null and _text is not null")
    last = _last_hashes(rows, max_docs)
    sample = rows.where(F.xxhash64("_id") <= _by_language(last)).select("_lang", "_text")
    counts = sample.mapInArrow(_count(bits), LABEL).groupBy("_lang", "_cell").agg(F.sum("_n").alias("_n")).toPandas()
    langs = sorted(counts["_lang"].unique())
    n = np.zeros((len(langs), 2**bits + len(SCRIPT_NAMES)))
    n[[langs.index(x) for x in counts["_lang"]], counts["_cell"]] = counts["_n"]
    cells, scripts = n[:, : 2**bits], n[:, 2**bits :]
    log_p = np.log((cells + SMOOTHING) / (cells.sum(1, keepdims=True) + SMOOTHING * 2**bits))
    writes = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    writes[:, ~writes.any(0)] = True
    return {"langs": langs, "log_p": log_p.T.astype(np.float32).copy(), "writes": writes.T.copy(), "bits": bits}


def word_scores(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of all words (words x languages), and the number of words of each text."""
    scores, counts = [], []
    for text in texts:
        own = 0
        for part in _slices([text]):
            points = _points(part)
            starts, ends, scripts = _words(points)
            own += len(starts)
            if len(starts):
                grams = sum(model["log_p"][c] for c in _cells(points, _inside(len(points), starts, ends), model["bits"]))
                total = np.concatenate([np.zeros((1, grams.shape[1])), np.cumsum(grams, 0, dtype=np.float64)])
                scores.append(np.where(model["writes"][scripts], total[ends] - total[starts], -1e4))
        counts.append(own)
    return np.concatenate(scores) if scores else np.zeros((0, len(model["langs"]))), np.array(counts, np.int64)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. All texts go forward together, one word at a time."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    longest = counts[order]
    active = np.searchsorted(-longest, -np.arange(int(longest[0]) if len(longest) else 0), side="left")  # texts with more than t words
    came = np.zeros(scores.shape, bool)  # the path to this label switches here
    best_before = np.zeros(len(scores), np.int64)
    value = np.zeros((len(counts), scores.shape[1]))
    for t, n in enumerate(active):
        at, now = first[:n] + t, value[:n]
        if t:
            best = now.argmax(1)
            switched = now[np.arange(n), best][:, None] - penalty
            came[at] = switched > now
            best_before[at] = best
            now = np.maximum(now, switched)
        value[:n] = now + scores[at]
    label = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at, now = first[:n] + t, label[:n]
        labels[at] = now
        if t:
            label[:n] = np.where(came[at, now], best_before[at], now)
    return labels


def _predict(shared, penalty: float):
    def block(texts: list[str | None], model: dict) -> list[tuple[str, float, list[dict]]]:
        known = [t if model["langs"] and _has_letter(t) else "" for t in texts]
        scores, counts = word_scores(known, model)
        labels = viterbi(scores, counts, penalty)
        out, at = [], 0
        for n in counts:
            own, at = labels[at : at + n], at + n
            if not n:
                out.append(("und", 0.0, []))
                continue
            votes = np.bincount(own, minlength=len(model["langs"]))
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(n)]
            spans = [{"first": a, "last": b - 1, "lang": model["langs"][own[a]]} for a, b in zip(cuts, cuts[1:])]
            out.append((model["langs"][votes.argmax()], float(votes.max() / n), spans))
        return out

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < BLOCK_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                lang, score, found = zip(*block(texts[at:end], shared.value))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(lang), pa.array(score), pa.array(found, spans)], ["doc_id", "lang_pred", "score", "spans"])
                at = end

    return predict


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score`` and ``spans`` of word numbers with their language.

    The broadcast model has ``4 * 2 ** bits`` bytes a language, whatever the size of the corpus."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(_predict(shared, penalty), f"doc_id {kind}, lang_pred string, score double, spans array<struct<first: long, last: long, lang: string>>")
