"""The attribute index: (field, value) to documents, ordinals, and the plan for a filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import literal_key, value_key, variant_key

#: A field with more distinct values than this, and than half the documents, is not indexed; below
#: this share of documents a filter is looked up first.
MOST_VALUES, FILTER_FIRST = 64, 0.05


def entries(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``id, field, value_key`` of every present scalar."""
    keys = [(f, value_key(F.col(f"`{f}`"), docs.schema[f].dataType)) for f in fields]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), k.alias("value_key")) for f, k in keys if k is not None))
    return docs.select("id", F.explode(pairs).alias("e")).select("id", "e.field", "e.value_key").where("value_key is not null")


def variant_entries(docs: DataFrame, attributes: str, skip: str = "") -> DataFrame:
    """``id, field, value_key`` of every scalar among the attributes (JSON text) but the text field."""
    each = docs.select("id", F.explode(F.from_json(attributes, "map<string, variant>")).alias("field", "v"))
    return each.where(F.col("field") != skip).select("id", "field", variant_key(F.col("v")).alias("value_key")).where("value_key is not null")


def indexed_fields(found: DataFrame, n: int) -> DataFrame:
    """``field, values`` of the fields that are indexed."""
    counts = found.groupBy("field").agg(F.countDistinct("value_key").alias("values"))
    return counts.where(~((F.col("values") > MOST_VALUES) & (F.col("values") > n // 2)))


def attribute_index(docs: DataFrame, fields: list[str], n: int) -> DataFrame:
    """``id, field, value_key`` without fields of mostly distinct values."""
    found = entries(docs, fields)
    return found.join(indexed_fields(found, n).select("field"), "field", "left_semi")


def candidates(index: DataFrame, spec: dict | None, indexed: set[str], skipped: set[str]) -> DataFrame | None:
    """Ids that a filter leaves, from the index alone; None if any part of it cannot be answered from there.

    A field that is neither indexed nor skipped occurs in no document."""
    op = (spec or {}).get("op", "")
    none = index.select("id").where(F.lit(False))
    if op == "eq":
        key = literal_key(spec.get("value"))
        if spec["field"] in skipped or key is None:
            return None
        return index.where((F.col("field") == spec["field"]) & (F.col("value_key") == key)).select("id") if spec["field"] in indexed else none
    if op not in ("", "all", "and", "or"):
        return none
    parts = [candidates(index, s, indexed, skipped) for s in (spec or {}).get("sub") or []]
    if op in ("", "all") or any(p is None for p in parts) or op == "and" and not parts:
        return None
    if op == "and":
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), parts)
    return reduce(DataFrame.unionByName, parts, none).distinct()


def ordinals(docs: DataFrame) -> DataFrame:
    """``id, ord``: dense numbers in the order of ids.

    Ids are sorted by range over all tasks; each range's offset comes from counts, one row a range, so that no
    task holds them all."""
    ranged = docs.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("_p", F.spark_partition_id()).persist()
    sizes = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    starts, at = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(at).cast("long")]
        at += sizes[p]
    if not starts:
        return docs.select("id", F.lit(0).cast("long").alias("ord")).where(F.lit(False))
    offset = F.create_map(*starts)[F.col("_p")]
    return ranged.select("id", (offset + F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1).alias("ord"))


def plan(docs: DataFrame, where: Column) -> dict:
    """Whether a filter is looked up first: its matches are under FILTER_FIRST of all documents."""
    n, hits = docs.agg(F.count(F.lit(1)), F.sum(where.cast("long"))).first()
    return {"total": n, "hits": hits or 0, "filter_first": bool(n) and (hits or 0) < FILTER_FIRST * n}


def matching(index: DataFrame, field: str, key: str) -> DataFrame:
    return index.where((F.col("field") == field) & (F.col("value_key") == key)).select("id")
