"""Tokens and BM25 as Columns."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring formula.
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def query_terms(text: str) -> list[str]:
    """The same for a query on the driver."""
    return [w for w in re.split(r"[\W_]+", "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower())) if w]


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_column(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(weight: Column | float, tf: Column, length: Column, average: Column | float) -> Column:
    """An average of 0 (no index yet) counts as a length ratio of 0."""
    if isinstance(average, Column):
        ratio = F.coalesce(length / F.nullif(average, F.lit(0.0)), F.lit(0.0))
    else:
        ratio = length / average if average else F.lit(0.0)
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))
