"""Documents as JSON: an array in a file in, an array of results out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents as the log holds them; attributes are JSON text there and VARIANT when read.
DOCUMENT = "id string, vector array<float>, attributes string, deleted boolean"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A file with a JSON array of documents; attributes stay the text they are."""
    raw = spark.read.option("wholetext", True).text(path)
    items = raw.select(F.explode(F.from_json("value", "array<string>")).alias("d"))
    doc = F.from_json("d", "id string, vector array<float>, attributes string, deleted boolean")
    return items.select(doc.alias("d")).select("d.id", "d.vector", "d.attributes", F.coalesce("d.deleted", F.lit(False)).alias("deleted"))


def from_python(spark: SparkSession, documents: list[dict]) -> DataFrame:
    as_floats = lambda v: None if v is None else [float(x) for x in v]
    rows = [(d["id"], as_floats(d.get("vector")), json.dumps(d["attributes"]) if d.get("attributes") is not None else None, bool(d.get("deleted"))) for d in documents]
    return spark.createDataFrame(rows, DOCUMENT)


def results_json(results: DataFrame) -> str:
    """An indented JSON array; scores that a mode doesn't set are left out."""
    out = []
    for r in results.toJSON().collect():
        row = json.loads(r)
        out.append({{"dist": "$dist", "score": "$score", "rrf": "$rrf"}.get(k, k): v for k, v in row.items()})
    return json.dumps(out, indent=2)
