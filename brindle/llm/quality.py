"""Quality rules with host-level verdicts.

Per document a handful of counts and rules; per host (``source``) the share of documents that fail any
rule, shrunk towards a beta prior fitted to all hosts; the host verdicts are joined back. The fit is the
beta-binomial one by moments: of the spread of the hosts' shares what the drawing of a host's few documents
explains is taken off, so that small hosts neither inflate the prior's spread nor escape it.

Verdict of a document that passes the base rules:

* host rate <= ``watch``: kept;
* ``watch`` < host rate <= ``bad``: kept if it passes the further rules (symbols, repeated lines) too;
* host rate > ``bad``: rejected.

Defined cases: a null or blank text has no words and fails the base rules; a null host is a host of its
own; every input row gives one output row, so repeated rows are judged and counted as often as they
occur; an empty table gives an empty result; extra columns are ignored, or carried by ``quality_filter``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._groups import sliced
from ._shared import written

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Parameters of the method.
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINE_SHARE = 0.1, 0.3
WATCH, BAD = 0.25, 0.6
#: The prior counts as so many documents at least and at most.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long"
COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 2_000_000:  # three ids don't fit 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:n] * len(seen) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        counts = np.array([text_counts(t.as_py()) for t in batch.column("_text")], np.int64).reshape(-1, len(COUNT_NAMES))
        columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "_text"]
        names = [name for name in batch.schema.names if name != "_text"]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[:, k]) for k in range(len(COUNT_NAMES)))], [*names, *COUNT_NAMES])


def count_words(docs: DataFrame, text_col: str, keep: dict[str, str]) -> DataFrame:
    """The columns ``keep`` (new name: old name) and the counts."""
    picked = docs.select(F.col(text_col).alias("_text"), *(F.col(f"`{old}`").alias(new) for new, old in keep.items()))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != "_text")
    return picked.mapInArrow(_count_batches, f"{kept}, {COUNTS}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def further_failed() -> Column:
    return (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_text_lines"))


def beta_prior(hosts: int, n: float | None, failed: float | None, squares: float | None, shares: float | None) -> tuple[float, float]:
    """Mean and strength (as so many documents) from the sums over hosts of n, failures, n * n and failures * failures / n.

    With m the mean and r the correlation of two documents of a host, the weighted squares of the hosts' shares about m
    are expected to be m (1 - m) (hosts - 1 + r (n - hosts + 1 - squares / n)); the strength is 1 / r - 1. Where r cannot
    be told or is not positive, the prior is the strongest."""
    mean = failed / n if n else 0.0
    noise, room = mean * (1 - mean), (n - hosts + 1 - squares / n) if n else 0.0
    if noise <= 0 or room <= 0:
        return mean, PRIOR_MOST
    r = ((shares - failed * failed / n) / noise - (hosts - 1)) / room
    return mean, min(PRIOR_MOST, max(PRIOR_LEAST, 1 / r - 1)) if r > 0 else PRIOR_MOST


def host_rates(counted: DataFrame, host_col: str) -> DataFrame:
    """``_host, _rate``: the shrunk share of failing documents of each host.

    Partial sums come before the shuffle, so a host with a third of all documents costs one row a task.
    Five numbers, sums over hosts, go to the driver.
    """
    hosts = counted.groupBy(F.col(host_col).alias("_host")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((base_failed() | further_failed()).cast("long")).alias("_failed")
    )
    hosts = written(hosts, "hosts")
    n, failed = F.col("_n").cast("double"), F.col("_failed").cast("double")
    mean, strength = beta_prior(*hosts.agg(F.count(F.lit(1)), F.sum(n), F.sum(failed), F.sum(n * n), F.sum(failed * failed / n)).first())
    return hosts.select("_host", ((F.col("_failed") + mean * strength) / (F.col("_n") + strength)).alias("_rate"))


def judge(counted: DataFrame, rates: DataFrame, host_col: str) -> DataFrame:
    """Adds ``base_failed`` and ``kept``. The host table is read from files, so Spark knows its size: it is
    broadcast below the session's threshold and else joined by a shuffle whose hot hosts AQE splits."""
    joined = counted.join(rates, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    passed = (F.col("_rate") <= WATCH) | ((F.col("_rate") <= BAD) & ~further_failed())
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passed).drop("_host", "_rate")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id``, ``host``, the counts, ``base_failed`` and ``kept``."""
    counted = written(count_words(docs, text_col, {"doc_id": id_col, "host": host_col}), "counts")
    return judge(counted, host_rates(counted, "host"), "host")


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The counts are made twice; the texts are not shuffled."""
    rates = host_rates(count_words(docs, text_col, {"_h": host_col}), "_h")
    fields = {f"_c{k}": name for k, name in enumerate(docs.columns)}
    counted = count_words(docs, text_col, fields)
    host = next(new for new, old in fields.items() if old == host_col)
    kept = judge(counted, rates, host).where("kept")
    return kept.select(*(F.col(new).alias(old) for new, old in fields.items()))
