"""Namespaces: a log of documents, immutable index epochs, one manifest that is swapped, and ranked queries.

Rules: segments are put if absent; the manifest is never cached; an epoch covers the log as it was when the
build began; one swap publishes it; the last writer of an id wins everywhere.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.text import query_terms, tokens
from ..functions.vector import COSINE, L2, choose_k, distance
from ..operators import attrs, fold, ivf, quant, rank
from ..sources.documents import from_python
from ..sources.store import NotFound, PreconditionFailed
from .cache import Cache

READERS = 16
#: Attempts to claim a log position and to swap the manifest; branches on branches.
CLAIM_ATTEMPTS, SWAP_ATTEMPTS, MAX_DEPTH = 64, 10, 64


def text_value(attributes: Column, field: str) -> Column:
    """The text field of a VARIANT where it is a string; else null."""
    if not field:
        return F.lit(None).cast("string")
    value = F.try_variant_get(attributes, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


class QueryError(ValueError):
    """A query that the namespace cannot answer."""


@dataclass(frozen=True)
class Config:
    dimension: int
    metric: str = COSINE
    text_field: str = ""

    def __post_init__(self) -> None:
        if self.dimension <= 0:
            raise ValueError(f"dimension {self.dimension} is not positive")
        if self.metric not in (COSINE, L2):
            raise ValueError(f"unknown metric {self.metric!r}")


@dataclass(frozen=True)
class Manifest:
    dimension: int
    metric: str
    text_field: str
    version: int = 1
    wal_seq: int = 0
    indexed_up_to: int = 0
    epoch: int = 0
    doc_count: int = 0
    parent: str | None = None
    fork_seq: int = 0
    fork_indexed: int = 0
    fork_epoch: int = 0
    index_key: str = ""
    fork_key: str = ""


@dataclass(frozen=True)
class View:
    """Log ranges, oldest first, and the key of the epoch that covers the log up to ``covered``."""

    runs: list
    index: str | None
    covered: int
    end: int


@dataclass(frozen=True)
class Build:
    """An epoch that is written but not published: its key, what it covers, its documents."""

    key: str
    covers: int
    doc_count: int


class Namespace:
    """A handle; nothing is read until it is used. ``store`` holds manifests and segments, ``data`` is the folder of tables."""

    def __init__(self, spark: SparkSession, store, data: str, name: str, cache: Cache | None = None):
        self.spark, self.store, self.data, self.name = spark, store, data.rstrip("/"), name
        self.cache = cache or Cache()

    def _at(self, name: str) -> Namespace:
        return Namespace(self.spark, self.store, self.data, name, self.cache)

    # manifests

    def manifest(self) -> tuple[Manifest, str]:
        body, etag = self.store.get(f"{self.name}/manifest")
        return Manifest(**json.loads(body)), etag

    def _create(self, m: Manifest) -> None:
        try:
            self.store.put_if_absent(f"{self.name}/manifest", json.dumps(asdict(m)).encode())
        except PreconditionFailed as e:
            raise FileExistsError(f"namespace {self.name!r} already exists") from e

    def create(self, config: Config) -> None:
        self._create(Manifest(config.dimension, config.metric, config.text_field))

    def swap(self, change) -> Manifest:
        """Reads, changes and swaps the manifest, again if another writer was first."""
        for _ in range(SWAP_ATTEMPTS):
            m, etag = self.manifest()
            new = replace(change(m), version=m.version + 1)
            try:
                self.store.put_cas(f"{self.name}/manifest", json.dumps(asdict(new)).encode(), etag)
                return new
            except PreconditionFailed:
                continue
        raise TimeoutError(f"manifest of {self.name!r}: {SWAP_ATTEMPTS} swaps lost")

    def info(self) -> dict:
        m, _ = self.manifest()
        return asdict(m) | {"namespace": self.name, "unindexed": m.wal_seq - m.indexed_up_to}

    # writes

    def upsert(self, documents: DataFrame | list[dict]) -> int | None:
        """Appends a batch as one segment and returns its position; None for an empty batch.

        The rows go to Parquet first; the segment, a pointer to them, is what claims the position. A failure after
        that may still become visible with a later write."""
        if isinstance(documents, list):
            if not documents:
                return None
            documents = from_python(self.spark, documents)
        m, _ = self.manifest()
        self._validate(documents, m.dimension)
        batch = uuid.uuid4().hex
        rows = documents.select("id", "vector", "attributes", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        numbered = rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("batch", F.lit(batch))
        path = f"{self.data}/{self.name}/wal/{batch}"
        numbered.write.parquet(path)
        counts = self.spark.read.parquet(path).agg(F.count(F.lit(1)), F.sum(F.when(F.col("deleted"), -1).otherwise(1))).first()
        if not counts[0]:
            return None
        return self.commit(m.wal_seq, {"path": path, "batch": batch, "rows": counts[0]}, counts[1])

    def commit(self, hint: int, segment: dict, delta: int) -> int:
        """Claims the first free position from ``hint`` on, then moves the head past it."""
        for seq in range(hint, hint + CLAIM_ATTEMPTS):
            try:
                self.store.put_if_absent(f"{self.name}/wal/{seq:020d}", json.dumps(segment).encode())
            except PreconditionFailed:
                continue
            self.swap(lambda m: replace(m, wal_seq=max(m.wal_seq, seq + 1), doc_count=max(0, m.doc_count + delta)))  # noqa: B023
            return seq
        raise TimeoutError(f"log of {self.name!r}: {CLAIM_ATTEMPTS} positions taken")

    @staticmethod
    def _validate(documents: DataFrame, dimension: int) -> None:
        wrong = documents.where(F.col("vector").isNotNull() & (F.size("vector") != dimension)).select("id", F.size("vector").alias("n")).first()
        if wrong:
            raise ValueError(f"document {wrong['id']!r}: vector has {wrong['n']} components, the namespace {dimension}")
        odd = documents.where(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).select("id").first()
        if odd:
            raise ValueError(f"document {odd['id']!r}: vector has a component that is not a number")

    def delete(self, ids: list[str]) -> int | None:
        return self.upsert([{"id": i, "deleted": True} for i in ids])

    # the log

    def segments(self, first: int, end: int) -> list[dict]:
        """The segments of [first, end), READERS read at a time; a missing one is an error."""
        if end <= first:
            return []
        with ThreadPoolExecutor(READERS) as pool:
            return list(pool.map(lambda seq: json.loads(self.store.get(f"{self.name}/wal/{seq:020d}")[0]) | {"seq": seq}, range(first, end)))

    def log(self, first: int, end: int) -> DataFrame:
        """``seq, pos, id, vector, attributes (VARIANT), deleted``, from exactly the files of the segments."""
        found = self.segments(first, end)
        kinds = "id string, vector array<float>, attributes string, deleted boolean, pos long, batch string"
        if not found:
            rows = self.spark.createDataFrame([], f"{kinds}, seq long")
        else:
            numbers = self.spark.createDataFrame([(s["batch"], s["seq"]) for s in found], "batch string, seq long")
            rows = self.spark.read.schema(kinds).parquet(*(s["path"] for s in found)).join(numbers, "batch")
        return rows.select("seq", "pos", "id", "vector", F.parse_json("attributes").alias("attributes"), "deleted")

    # branches

    def branch(self, child: str) -> Namespace:
        """A copy-on-write fork: a manifest and no data."""
        if child == self.name:
            raise ValueError("a namespace cannot be branched onto itself")
        m, _ = self.manifest()
        new = self._at(child)
        covered = m.indexed_up_to if m.epoch else 0
        new._create(Manifest(m.dimension, m.metric, m.text_field, 1, m.wal_seq, covered, 0, m.doc_count, self.name, m.wal_seq, covered, m.epoch, fork_key=m.index_key))
        return new

    def view(self) -> View:
        """What a read sees. An ancestor's epoch is only used as it was recorded at the fork, so that nothing the
        ancestor wrote later shows; without a recorded one the log answers."""
        head, _ = self.manifest()
        runs, index, covered = [], head.index_key, head.indexed_up_to
        m, name, end = head, self.name, head.wal_seq
        for _ in range(MAX_DEPTH):
            if end > m.fork_seq:
                runs.insert(0, (name, m.fork_seq, end))
            if m.parent is None:
                break
            if not index and m.fork_key:
                index, covered = m.fork_key, min(m.fork_indexed, m.fork_seq)
            name, end = m.parent, min(end, m.fork_seq)
            m, _ = self._at(name).manifest()
        else:
            raise ValueError(f"more than {MAX_DEPTH} branches on branches")
        try:
            covered = min(covered, self._meta(index)["covers"]) if index else 0  # never more than what the epoch says itself
        except NotFound:
            index, covered = "", 0
        return View(runs, index or None, covered, head.wal_seq)

    def _log_of(self, view: View, first: int, end: int) -> DataFrame:
        parts = [self._at(name).log(max(a, first), max(a, first, min(b, end))) for name, a, b in view.runs]
        out = parts[0] if parts else self.log(0, 0)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def live(self) -> DataFrame:
        """All live documents: ``id, vector, attributes``."""
        v = self.view()
        return fold.live(self._log_of(v, 0, v.end)).select("id", "vector", "attributes")

    # the index

    def index(self) -> int:
        """Builds the next epoch over the log as it is now, publishes it, and returns the number of the published one."""
        return self.publish(self.build())

    def build(self) -> Build:
        """Writes an epoch under a key and a path of its own, which no other builder's can overwrite."""
        m, _ = self.manifest()
        up_to = m.wal_seq
        v = self.view()
        docs = fold.live(self._log_of(v, 0, up_to)).select("id", "vector", F.to_json("attributes").alias("attributes"), text_value(F.col("attributes"), m.text_field).alias("text"))
        own = uuid.uuid4().hex
        path = f"{self.data}/{self.name}/index/{own}"
        docs.write.parquet(f"{path}/docs")
        docs = self.spark.read.parquet(f"{path}/docs")
        vectors = docs.where("vector is not null").select("id", "vector")
        n_docs, n_vectors = docs.count(), vectors.count()
        centroids: dict = {}
        if n_vectors:
            centroids = self._clusters(m, vectors, n_vectors)
            placed = quant.encode_rows(ivf.assign(vectors, centroids, m.metric), centroids, m.dimension)
            placed.repartition("cluster").write.partitionBy("cluster").parquet(f"{path}/vectors")
        stats = {"n": n_docs, "avgdl": 0.0}
        if m.text_field:
            rank.index_rows(docs).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
            stats["avgdl"] = rank.corpus_stats(docs).first()["avgdl"]
        attrs.variant_entries(docs, "attributes", m.text_field).write.parquet(f"{path}/entries")
        found = self.spark.read.parquet(f"{path}/entries")
        fields = {r["field"] for r in attrs.indexed_fields(found, n_docs).collect()}
        skipped = {r["field"] for r in found.select("field").distinct().collect()} - fields
        kept = found.where(F.col("field").isin(*sorted(fields))) if fields else found.where(F.lit(False))
        kept.repartitionByRange("field", "value_key", "id").sortWithinPartitions("field", "value_key", "id").write.parquet(f"{path}/attrs")
        tree = ivf.tree({int(c): x for c, x in centroids.items()}, metric=m.metric) if len(centroids) > 1 else None
        meta = {"path": path, "centroids": centroids, "tree": tree, "stats": stats, "vectors": n_vectors, "covers": up_to, "fields": sorted(fields), "skipped": sorted(skipped)}
        key = f"{self.name}/epochs/{own}"
        self.store.put_if_absent(key, json.dumps(meta).encode())
        return Build(key, up_to, n_docs)

    def publish(self, build: Build) -> int:
        """One swap sets epoch, key and coverage together; a build that covers less than the published one is left aside."""

        def change(now: Manifest) -> Manifest:
            if now.index_key and now.indexed_up_to >= build.covers:
                return now
            return replace(now, epoch=now.epoch + 1, index_key=build.key, indexed_up_to=build.covers, doc_count=build.doc_count if now.wal_seq == build.covers else now.doc_count)

        now, _ = self.manifest()
        return now.epoch if change(now) is now else self.swap(change).epoch

    def _clusters(self, m: Manifest, vectors: DataFrame, n: int) -> dict:
        """The centroids of the epoch before, kept up; those of a full clustering where there is none or it cannot be read."""
        if m.index_key:
            try:
                before = {int(c): x for c, x in self._meta(m.index_key)["centroids"].items()}
            except (NotFound, ValueError, KeyError):
                before = {}
            if before:
                return ivf.maintain(vectors, before, m.metric)
        return ivf.full_cluster(vectors, n, m.metric)

    def _meta(self, key: str) -> dict:
        return json.loads(self.cache.get(key, lambda: self.store.get(key)[0]))

    # queries

    def query(self, vector: list[float] | None = None, text: str | None = None, top_k: int = 0, where: dict | None = None, approx: bool = False, n_probe: int = 0) -> DataFrame:
        """``id, dist, score, rrf, attributes`` (JSON text), best first. Exact unless ``approx`` asks for probed clusters."""
        if vector is None and not text:
            raise QueryError("no rank mode set: give a vector, a text or both")
        m, _ = self.manifest()
        if vector is not None and len(vector) != m.dimension:
            raise QueryError(f"query vector has {len(vector)} components, the namespace {m.dimension}")
        if text and not m.text_field:
            raise QueryError(f"namespace {self.name!r} has no text field")
        k = top_k if top_k > 0 else rank.TOP_K
        v = self.view()
        empty = [F.lit(None).cast("double").alias(c) for c in ("dist", "score", "rrf")]
        window = k * rank.WIDEN if vector is not None and text else k
        if vector is not None:
            near = self._by_vector(m, v, vector, window, where, approx, n_probe)
        if text:
            told = self._by_text(m, v, text, window, where)
        if vector is not None and text:
            known = near.select("id", "attributes").unionByName(told.select("id", "attributes")).dropDuplicates(["id"])
            return rank.fuse(near, told, k).join(known, "id").orderBy(F.desc("rrf"), "id")
        if text:
            return told.select("id", empty[0], "score", empty[2], "attributes").orderBy(F.desc("score"), "id")
        return near.select("id", "dist", *empty[1:], "attributes").orderBy("dist", "id")

    def _filter(self, spec: dict | None):
        return filters.compile_filter(spec, filters.variant_field(F.col("attributes")))

    def _rows(self, v: View) -> tuple[DataFrame | None, DataFrame, DataFrame]:
        """Indexed documents that the tail leaves alone, the tail's live documents, and the tail's ids."""
        tail = fold.last_operations(self._log_of(v, v.covered, v.end))
        live = tail.where("not deleted").select("id", "vector", "attributes")
        if v.index is None:
            return None, live, tail.select("id")
        docs = self.spark.read.parquet(f"{self._meta(v.index)['path']}/docs").withColumn("attributes", F.parse_json("attributes"))
        return docs.join(tail.select("id"), "id", "left_anti"), live, tail.select("id")

    def _by_vector(self, m: Manifest, v: View, q: list[float], k: int, spec: dict | None, approx: bool, n_probe: int) -> DataFrame:
        indexed, live, tail = self._rows(v)
        rows = live
        if indexed is not None:
            meta = self._meta(v.index)
            plan = self._plan(meta, spec)
            if plan["filter_first"]:
                indexed = indexed.join(plan["ids"], "id", "left_semi")
            elif approx and meta["vectors"]:
                indexed = indexed.join(self._shortlist(m, meta, q, k, indexed.where(self._filter(spec)).select("id"), n_probe), "id", "left_semi")
            rows = indexed.select("id", "vector", "attributes").unionByName(live)
        top = rank.top_vectors(rows, q, k, m.metric, self._filter(spec))
        return top.select("id", "dist", F.to_json("attributes").alias("attributes"))

    def _plan(self, meta: dict, spec: dict | None) -> dict:
        """Whether the attribute index answers the filter, how many documents it leaves, and whether those are looked up first."""
        plan = {"usable": False, "total": meta["stats"]["n"], "hits": None, "filter_first": False, "ids": None}
        index = self.spark.read.schema("id string, field string, value_key string").parquet(f"{meta['path']}/attrs")
        ids = attrs.candidates(index, spec, set(meta["fields"]), set(meta["skipped"]))
        if ids is None:
            return plan
        hits = ids.count()
        return plan | {"usable": True, "hits": hits, "filter_first": hits < attrs.FILTER_FIRST * plan["total"], "ids": ids}

    def plan(self, where: dict | None) -> dict:
        """The plan of a filter over the published epoch: ``usable, total, hits, filter_first``."""
        v = self.view()
        if v.index is None:
            return {"usable": False, "total": 0, "hits": None, "filter_first": False}
        found = self._plan(self._meta(v.index), where)
        return {k: x for k, x in found.items() if k != "ids"}

    def _shortlist(self, m: Manifest, meta: dict, q: list[float], k: int, allowed: DataFrame, n_probe: int) -> DataFrame:
        """Ids that the filter leaves in the nearest clusters: all of as many clusters as hold SHARE of them and k, so that
        the searched share doesn't shrink as clusters grow; of ``n_probe`` clusters, if given, those with the best estimates."""
        centroids = {int(c): x for c, x in meta["centroids"].items()}
        if not n_probe:
            placed = self.spark.read.parquet(f"{meta['path']}/vectors").select("id", "cluster").join(allowed, "id", "left_semi")
            sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}  # clusters
            return placed.where(F.col("cluster").isin(ivf.enough(ivf.probe(centroids, q, len(centroids), m.metric), sizes, k))).select("id")
        probes, _ = ivf.route(centroids, meta["tree"], q, n_probe, m.metric)
        codes = self.spark.read.parquet(f"{meta['path']}/vectors").where(F.col("cluster").isin(probes)).join(allowed, "id", "left_semi")
        est = quant.estimates(codes, {c: centroids[c] for c in probes}, np.array(q, np.float32), m.metric, m.dimension)
        return est.orderBy("est", "id").limit(ivf.RERANK * k).select("id")

    def _by_text(self, m: Manifest, v: View, text: str, k: int, spec: dict | None) -> DataFrame:
        """Statistics are the index's until the next build; the tail's texts are scored with them."""
        indexed, live, tail = self._rows(v)
        body = text_value(F.col("attributes"), m.text_field)
        terms = sorted(set(query_terms(text)))
        stats = rank.Stats()
        scored = None
        if indexed is not None and terms:
            meta = self._meta(v.index)
            posted = self.spark.read.parquet(f"{meta['path']}/postings").where(F.col("term").isin(terms))
            stats = rank.Stats(meta["stats"]["n"], meta["stats"]["avgdl"], {r["term"]: r["count"] for r in posted.groupBy("term").count().collect()})
            scored = rank.indexed_scores(posted, text, stats).join(indexed.select("id", "attributes"), "id")
        fresh = rank.bm25_scores(live.select("id", "attributes", body.alias("text")), text, stats).select("id", "score", "attributes")
        rows = fresh if scored is None else scored.select("id", "score", "attributes").unionByName(fresh)
        top = rows.where(self._filter(spec)).where("score > 0").orderBy(F.desc("score"), "id").limit(k)
        return top.select("id", "score", F.to_json("attributes").alias("attributes"))

    def prefilter_shortlist(self, q: list[float], limit: int, by: str = "estimate") -> list[str]:
        """For recall tests: the best ids by the quantized estimate, or by agreement of plain signs."""
        m, _ = self.manifest()
        v = self.view()
        meta = self._meta(v.index)
        centroids = {int(c): x for c, x in meta["centroids"].items()}
        rows = self.spark.read.parquet(f"{meta['path']}/vectors")
        if by == "estimate":
            est = quant.estimates(rows, centroids, np.array(q, np.float32), m.metric, m.dimension)
            return [r["id"] for r in est.orderBy("est", "id").limit(limit).collect()]
        from ..functions.vector import as_vector, residual_signs

        centre = F.get(F.array(*(F.lit(list(map(float, centroids[c]))) for c in sorted(centroids))), F.col("cluster"))
        same = F.aggregate(F.zip_with(residual_signs(F.col("vector"), centre), residual_signs(as_vector(q), centre), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
        return [r["id"] for r in rows.select("id", same.alias("s")).orderBy(F.desc("s"), "id").limit(limit).collect()]


__all__ = ["Build", "Config", "Manifest", "Namespace", "QueryError", "View", "choose_k", "distance", "tokens", "attrs"]
