"""Synthetic documents and labelled query sets as plans: a value is a hash of seed, row and place, so it depends on neither
partitions nor machines, and any number of rows is made where it is used."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the texts.
WORDS = "amber basin cedar delta ember fjord grove harbor island juniper kelp lagoon meadow nectar orchard prairie quartz river summit tundra".split()
#: How far an answer and the nearest decoy lie from their query, a component.
ANSWER, DECOY = 0.15, 0.02


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1), from the upper 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) / F.lit(float(1 << 53))


def vector(seed: int, row: Column, dim: int, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: (uniform(seed, row, j) * (high - low) + low).cast("float"))


def gaussian(seed: int, row: Column, dim: int) -> Column:
    """Independent standard normal components."""
    radius = lambda j: F.sqrt(-2.0 * F.log(1.0 - uniform(seed, row, j, F.lit("radius"))))
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: (radius(j) * F.cos(2 * pi * uniform(seed, row, j, F.lit("angle")))).cast("float"))


def words(seed: int, row: Column, n: int) -> Column:
    """``n`` words of WORDS, a space between."""
    table = F.array(*map(F.lit, WORDS))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.get(table, F.floor(uniform(seed, row, j, F.lit("word")) * len(WORDS)).cast("int"))), " ")


def _near(seed: int, row: Column, centre: Column, by: float) -> Column:
    return F.transform(centre, lambda x, j: (x + (uniform(seed, row, j, F.lit("near")) * 2 - 1) * by).cast("float"))


def documents(spark: SparkSession, n: int, dim: int, seed: int = 1, length: int = 8, normal: bool = False) -> DataFrame:
    """``id, vector, text, lang`` of n documents; vectors uniform in the unit cube, or normal."""
    row = F.col("id")
    made = gaussian(seed, row, dim) if normal else vector(seed, row, dim)
    return spark.range(n).select(F.format_string("doc-%d", row).alias("id"), made.alias("vector"), words(seed, row, length).alias("text"), F.lit("en").alias("lang"))


def banded(spark: SparkSession, n: int, dim: int, shares: dict[str, float], seed: int = 1) -> DataFrame:
    """``id, vector, band``: each band has its share of the rows, and its own region of the space."""
    row, place = F.col("id"), F.lit(len(shares) - 1)
    for k, share in reversed(list(enumerate(_sums(list(shares.values()))))):
        place = F.when(uniform(seed, row, F.lit("band")) < share, k).otherwise(place)
    named = spark.range(n).withColumn("k", place)
    centre = vector(seed + 1, F.col("k"), dim, 0.0, 10.0)
    return named.select(F.format_string("doc-%d", row).alias("id"), _near(seed, row, centre, 0.3).alias("vector"), F.get(F.array(*map(F.lit, shares)), F.col("k")).alias("band"))


def _sums(shares: Sequence[float]) -> list[float]:
    return [sum(shares[: k + 1]) for k in range(len(shares))]


def hybrid(spark: SparkSession, n: int, dim: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Documents (id, vector, text) and n queries (query, q, text, answer) that only both legs together answer: the answer is
    near and has one of two rare terms, a decoy is nearest without a term, another has both terms twice and lies anywhere."""
    row = F.col("id")
    terms = [F.format_string("term%d" + x, row) for x in "ab"]
    asked = spark.range(n).select(row.alias("row"), F.format_string("query-%d", row).alias("query"), vector(seed, row, dim).alias("q"), F.concat_ws(" ", *terms).alias("text"), F.format_string("answer-%d", row).alias("answer"))
    q, at = vector(seed, row, dim), lambda name: F.concat_ws("-", F.lit(name), row.cast("string"))
    made = F.array(
        F.struct(at("answer").alias("id"), _near(seed + 1, row, q, ANSWER).alias("vector"), F.concat_ws(" ", terms[0], words(seed, row, 6)).alias("text")),
        F.struct(at("near").alias("id"), _near(seed + 2, row, q, DECOY).alias("vector"), words(seed + 1, row, 8).alias("text")),
        F.struct(at("told").alias("id"), vector(seed + 3, row, dim).alias("vector"), F.concat_ws(" ", *terms, *terms).alias("text")),
    )
    return spark.range(n).select(F.inline(made)), asked.drop("row")
