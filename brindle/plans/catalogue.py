"""The registered queries of the engine: each runs an operator over whole tables.

Ids are strings, so that ties break bytewise; doubles are rounded to six places. A few rows name parameters
(query vectors, query texts): those are read by key, the tables they are ranked against are whole.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters, text, vector
from ..operators import attrs, fold, ivf, measure, quant, rank
from ..sources.store import MemoryStore
from ..streaming import queue
from .namespace import Config, Namespace, text_value

QUERIES: dict = {}

#: Parameters of the queries.
QUERY_TEXT, DUP_TEXT, TAIL_TEXT = "the and thonor", "the the of", "the and of"


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """With its schema given, so that no job reads file footers for it."""
    rows = spark.read.schema("vec_id long, embedding array<float>, label int").parquet(f"{sf}/embeddings.parquet")
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label", "vec_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang", "source", "n_chars", "doc_id")


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    row = vectors(spark, sf).where(F.col("vec_id") == vec_id).select("vector").first()
    return list(row["vector"])


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", r6("dist"))


@query
def vec_cosine_topk(spark, sf):
    return _ranked(rank.top_vectors(vectors(spark, sf), query_vector(spark, sf)))


@query
def vec_l2_topk(spark, sf):
    return _ranked(rank.top_vectors(vectors(spark, sf), query_vector(spark, sf), metric="l2"))


@query
def vec_zero_norm(spark, sf):
    zero = spark.createDataFrame([("zero", [0.0] * 64)], "id string, vector array<float>")
    rows = vectors(spark, sf).select("id", "vector").unionByName(zero)
    return rows.select("id", F.round(vector.cosine_distance(F.col("vector"), query_vector(spark, sf)), 6).alias("dist"))


@query
def vec_normalize_norms(spark, sf):
    scaled = F.transform("vector", lambda x: (x * F.lit(2.0)).cast("float"))
    unit = vector.as_vector(vector.normalize(scaled))
    return vectors(spark, sf).select("id", F.round(vector.norm(vector.as_vector(F.col("vector"))), 6).alias("norm"), F.round(vector.norm(unit), 5).alias("unit_norm"))


def _hundredth(spark, sf):
    """The queries of searches: every row whose id is divisible by 100."""
    return vectors(spark, sf).where(F.col("vec_id") % 100 == 0).select(F.col("id").alias("query"), F.col("vector").alias("q"))


@query
def vec_batch_topk(spark, sf):
    return rank.batch_top_vectors(vectors(spark, sf), _hundredth(spark, sf)).select("query", "id", "rank", r6("dist"))


def _filtered(spark, sf, spec):
    rows = vectors(spark, sf)
    where = filters.compile_filter(spec, filters.typed_field(rows))
    return rank.top_vectors(rows, query_vector(spark, sf), where=where).select("id", "label", r6("dist"))


def _eq(field, value):
    return {"op": "eq", "field": field, "value": value}


FILTERS = {
    "vec_filter_eq": _eq("label", 3),
    "vec_filter_and": {"op": "and", "sub": [_eq("label", 3), _eq("id", "13")]},
    "vec_filter_or": {"op": "or", "sub": [_eq("label", 3), _eq("label", 5.0)]},
    "vec_filter_nested": {"op": "and", "sub": [{"op": "or", "sub": [_eq("label", 1), _eq("label", 2)]}, {"op": "or", "sub": [_eq("label", 2), _eq("label", 4)]}]},
    "vec_filter_missing_field": {"op": "or", "sub": [_eq("nowhere", 1), _eq("label", "3")]},
    "vec_filter_unknown_op": {"op": "gte", "field": "label", "value": 3},
    "vec_filter_all": {"op": "all"},
}
for _name, _spec in FILTERS.items():
    QUERIES[_name] = lambda spark, sf, spec=_spec: _filtered(spark, sf, spec)


@query
def vec_group_mean(spark, sf):
    return ivf.means(vectors(spark, sf), "label").select("label", "pos", r6("mean"))


@query
def parse_vector(spark, sf):
    """N15 over all components."""
    rows = vectors(spark, sf)
    back = vector.parse_vector(F.array_join(F.col("vector").cast("array<string>"), " , "))
    return rows.select("id", F.size(back).cast("long").alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query
def refresh_changed(spark, sf):
    """Which members' vectors differ from the live ones; here every third one was written again, scaled."""
    old = vectors(spark, sf).select("id", "vec_id", "vector")
    again = F.when(F.col("vec_id") % 3 == 0, F.transform("vector", lambda x: (x * F.lit(2.0)).cast("float"))).otherwise(F.col("vector"))
    new = old.select("id", again.alias("now"))
    return old.join(new, "id").select("id", (~vector.same_vector(F.col("vector"), F.col("now"))).alias("changed"))


def _label_means(spark, sf):
    return ivf.centroids_of(vectors(spark, sf), "label")


@query
def ivf_assign(spark, sf):
    return ivf.assign(vectors(spark, sf), _label_means(spark, sf)).select("id", F.col("cluster").cast("long").alias("cluster"))


@query
def ivf_cluster_sizes(spark, sf):
    placed = ivf.assign(vectors(spark, sf), _label_means(spark, sf))
    return placed.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def _probed(spark, sf, n):
    centroids, q = _label_means(spark, sf), query_vector(spark, sf)
    placed = ivf.assign(vectors(spark, sf), centroids)
    return _ranked(rank.top_vectors(placed, q, where=F.col("cluster").isin(ivf.probe(centroids, q, n))))


@query
def ivf_probe_lossless(spark, sf):
    return _probed(spark, sf, 10**6)


@query
def ivf_probe_3(spark, sf):
    return _probed(spark, sf, 3)


@query
def lloyd_one_step(spark, sf):
    placed = ivf.assign(vectors(spark, sf), _label_means(spark, sf))
    return ivf.means(placed, "cluster").select(F.col("cluster").cast("long").alias("cluster"), "pos", r6("mean"))


def _centre(centroids):
    table_ = F.create_map(*(x for c, v in centroids.items() for x in (F.lit(c), F.lit(v).cast("array<float>"))))
    return table_[F.col("label")]


@query
def sign_code_hamming(spark, sf):
    """Agreement of packed residual signs of each vector and of the query, about the vector's label mean."""
    centroids, q = _label_means(spark, sf), query_vector(spark, sf)
    centre = _centre(centroids)
    own = vector.packed_signs(vector.residual_signs(F.col("vector"), centre), 64)
    asked = vector.packed_signs(vector.residual_signs(vector.as_vector(q), centre), 64)
    return vectors(spark, sf).select("id", vector.hamming(own, asked).cast("long").alias("hamming"), vector.agreement(own, asked, 64).cast("long").alias("agreement"))


@query
def sign_shortlist_rerank(spark, sf):
    centroids, q = _label_means(spark, sf), query_vector(spark, sf)
    centre = _centre(centroids)
    same = F.aggregate(F.zip_with(vector.residual_signs(F.col("vector"), centre), vector.residual_signs(vector.as_vector(q), centre), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    short = vectors(spark, sf).withColumn("s", same).orderBy(F.desc("s"), "id").limit(ivf.RERANK * rank.TOP_K)
    return _ranked(rank.top_vectors(short, q))


@query
def rabitq_shortlist_recall(spark, sf):
    """Recall of the quantized shortlist of 4 K against the exact top K; no SQL, a property test holds it."""
    rows = vectors(spark, sf)
    centroids, q = _label_means(spark, sf), query_vector(spark, sf)
    import numpy as np

    coded = quant.encode_rows(ivf.assign(rows.select("id", "vector"), centroids), centroids, 64)
    short = quant.estimates(coded, centroids, np.array(q, np.float32), "cosine", 64).orderBy("est", "id").limit(ivf.RERANK * rank.TOP_K)
    exact = rank.top_vectors(rows, q).select(F.lit("0").alias("query"), "id")
    return measure.recall(exact, short.select(F.lit("0").alias("query"), "id"))


@query
def filter_plan_decision(spark, sf):
    rows = vectors(spark, sf)
    plans = [(int(x), attrs.plan(rows, F.col("label") == x)) for x in range(10)]
    return spark.createDataFrame([(x, p["total"], p["hits"], p["filter_first"]) for x, p in plans], "label int, total long, hits long, filter_first boolean")


@query
def filter_first_topk(spark, sf):
    """The filter's documents come from the attribute index, and only they are scored."""
    rows = vectors(spark, sf)
    found = attrs.entries(rows, ["label"])
    return _ranked(rank.top_vectors(rows.join(attrs.matching(found, "label", "n:3.0"), "id", "left_semi"), query_vector(spark, sf)))


@query
def attr_index(spark, sf):
    found = attrs.entries(documents(spark, sf), ["lang", "source"])
    return found.groupBy("field", "value_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def attr_cardinality_skip(spark, sf):
    docs = documents(spark, sf)
    found = attrs.entries(docs, ["lang", "source", "n_chars", "text"])
    return attrs.indexed_fields(found, docs.count()).select("field", F.col("values").alias("n_values"))


@query
def ordinals(spark, sf):
    return attrs.ordinals(documents(spark, sf))


@query
def bitmap_and(spark, sf):
    found = attrs.attribute_index(documents(spark, sf), ["lang", "source"], 10**9)
    return attrs.matching(found, "lang", "s:en").join(attrs.matching(found, "source", "s:src0"), "id", "left_semi")


@query
def bitmap_or(spark, sf):
    found = attrs.attribute_index(documents(spark, sf), ["lang", "source"], 10**9)
    return attrs.matching(found, "lang", "s:fr").unionByName(attrs.matching(found, "source", "s:src0")).distinct()


@query
def missing_attribute(spark, sf):
    """A field that some documents lack equals nothing there."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    docs = documents(spark, sf).join(labels, "id", "left")
    return docs.where(filters.compile_filter(_eq("quality", 1), filters.typed_field(docs))).select("id", "quality")


@query
def variant_filter(spark, sf):
    """Filters over free-form attributes look at the value's own type."""
    rows = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.parse_json("props").alias("attributes"))
    spec = {"op": "or", "sub": [_eq("k", 7), _eq("k", "8")]}
    return rows.where(filters.compile_filter(spec, filters.variant_field(F.col("attributes")))).select("id")


@query
def tokenize_counts(spark, sf):
    return documents(spark, sf).select("id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(text.tokens(F.col("text")))).cast("long").alias("n_terms"))


@query
def postings(spark, sf):
    return rank.postings(documents(spark, sf)).select("term", "id", "tf")


@query
def doc_len(spark, sf):
    return rank.doc_lengths(documents(spark, sf)).select("id", F.col("dl").cast("long").alias("dl"))


@query
def corpus_stats(spark, sf):
    return rank.corpus_stats(documents(spark, sf)).select("n", r6("avgdl"))


def _term_df(spark, sf):
    return rank.postings(documents(spark, sf)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query
def term_df(spark, sf):
    return _term_df(spark, sf)


@query
def term_idf(spark, sf):
    n = documents(spark, sf).count()
    return _term_df(spark, sf).select("term", F.round(text.idf_column(F.lit(n), F.col("df")), 6).alias("idf"))


def _bm25(spark, sf, q, where=None):
    return rank.live_top_texts(documents(spark, sf), q, where=where).select("id", r6("score"))


@query
def bm25_topk(spark, sf):
    return _bm25(spark, sf, QUERY_TEXT)


@query
def bm25_dup_terms(spark, sf):
    return _bm25(spark, sf, DUP_TEXT)


@query
def bm25_filter(spark, sf):
    return _bm25(spark, sf, QUERY_TEXT, F.col("lang") == "de")


@query
def bm25_no_hits(spark, sf):
    return _bm25(spark, sf, "!!! zzzqqqxxx")


@query
def bm25_indexed(spark, sf):
    """The same ranking from an index of postings."""
    docs = documents(spark, sf)
    index = rank.index_rows(docs)
    scored = rank.indexed_scores(index, QUERY_TEXT, rank.Stats.of(docs, text.query_terms(QUERY_TEXT)))
    return scored.orderBy(F.desc("score"), "id").limit(rank.TOP_K).select("id", r6("score"))


@query
def bm25_tail_only(spark, sf):
    return rank.top_texts(documents(spark, sf), TAIL_TEXT, rank.Stats()).select("id", r6("score"))


@query
def hybrid_rrf_topk(spark, sf):
    docs, window = documents(spark, sf), rank.TOP_K * rank.WIDEN
    near = rank.top_vectors(vectors(spark, sf), query_vector(spark, sf), window)
    told = rank.live_top_texts(docs, QUERY_TEXT, window)
    return rank.fuse(near, told).select("id", r6("dist"), r6("score"), r6("rrf"))


def event_log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").alias("deleted"), "value", "event_id")


def _bounds(log):
    """Quarters of the log's range of positions."""
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    return [low + (high - low) * k // 4 for k in range(4)] + [high + 1]


@query
def wal_fold_live(spark, sf):
    return fold.live(event_log(spark, sf)).select("id", "event_id", r6("value"))


@query
def wal_fold_deleted(spark, sf):
    return fold.deleted(event_log(spark, sf))


@query
def wal_window(spark, sf):
    log = event_log(spark, sf)
    b = _bounds(log)
    return fold.live(log, b[1], b[3]).select("id", "event_id")


@query
def branch_view(spark, sf):
    """A child forked at half: the parent's first half and the child's last quarter; what the parent wrote between is not seen."""
    log = event_log(spark, sf)
    b = _bounds(log)
    return fold.live(fold.view([(log, b[0], b[2]), (log, b[3], b[4])])).select("id", "event_id")


@query
def branch_chain(spark, sf):
    log = event_log(spark, sf)
    b = _bounds(log)
    return fold.last_operations(fold.view([(log, b[0], b[1]), (log, b[1], b[2]), (log, b[3], b[4])])).select("id", "event_id", "deleted")


def _jobs(spark, sf):
    log = event_log(spark, sf)
    order = Window.partitionBy("id").orderBy("seq", "pos")
    first = log.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select(
        F.col("id").alias("namespace"), F.col("seq").alias("enqueued_at"), F.when(F.col("pos") % 2 == 0, "pending").otherwise("in_progress").alias("state"), F.lit(0).cast("long").alias("heartbeat_at")
    )


@query
def queue_pick_eligible(spark, sf):
    return queue.eligible(_jobs(spark, sf), queue.TIMEOUT_NS // 2).select("namespace", "enqueued_at", "state")


@query
def queue_snapshot(spark, sf):
    return _jobs(spark, sf).orderBy("enqueued_at", "namespace").select("namespace", "enqueued_at", "state")


@query
def latency_percentiles(spark, sf):
    found = measure.latencies(table(spark, sf, "events"), "event_type", "value")
    return found.select("event_type", "n", *(r6(c) for c in found.columns[2:]))


@query
def recall_at_k(spark, sf):
    """Recall at 10 of three probed clusters, for every row whose id is divisible by 100."""
    rows, centroids, asked = vectors(spark, sf), _label_means(spark, sf), _hundredth(spark, sf)
    probes = asked.withColumn("clusters", ivf.nearest_clusters(F.col("q"), centroids, 3))
    found = rank.batch_top_vectors(ivf.assign(rows, centroids), probes, probed=True)
    return measure.recall(rank.batch_top_vectors(rows, asked), found).select("query", "hits", r6("recall"))


def _half(spark, sf, name, key):
    """Ids below it are the indexed half, whatever the table's size; the others are the tail."""
    return ((table(spark, sf, name).agg(F.max(key)).first()[0] or 0) + 1) // 2


@query
def bm25_tail_overlay(spark, sf):
    """Statistics of the indexed half score the tail too."""
    docs = documents(spark, sf)
    stats = rank.Stats.of(docs.where(F.col("doc_id") < _half(spark, sf, "documents", "doc_id")), text.query_terms(QUERY_TEXT))
    return rank.top_texts(docs, QUERY_TEXT, stats).select("id", r6("score"))


def _overlay_half(spark, sf):
    """The indexed half under a tail that begins a fifth of it earlier."""
    rows, half = vectors(spark, sf), _half(spark, sf, "embeddings", "vec_id")
    tail = rows.where(F.col("vec_id") >= half - half // 5).withColumn("deleted", F.col("vec_id") % 7 == 0)
    return rank.overlay(rows.where(F.col("vec_id") < half), tail.withColumn("vector", F.when(F.col("vec_id") % 5 != 0, F.col("vector"))))


@query
def overlay_vec(spark, sf):
    return _ranked(rank.top_vectors(_overlay_half(spark, sf), query_vector(spark, sf)))


@query
def overlay_tombstone(spark, sf):
    return _overlay_half(spark, sf).select("id", F.col("vector").isNotNull().alias("has_vector"))


def _space(spark, config):
    """A new namespace whose tables lie in the shared folder of the session, in local mode alone in one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="brindle-")
    ns = Namespace(spark, MemoryStore(), f"{where.rstrip('/')}/namespaces-{uuid.uuid4().hex}", "ns")
    ns.create(config)
    return ns


def _vector_documents(rows):
    return rows.select("id", "vector", F.to_json(F.struct("label")).alias("attributes"), F.lit(False).alias("deleted"))


def _text_documents(docs):
    return docs.select("id", F.lit(None).cast("array<float>").alias("vector"), F.to_json(F.struct(F.col("text").alias("body"), "lang", "source")).alias("attributes"), F.lit(False).alias("deleted"))


def _tombstones(rows):
    return rows.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("attributes"), F.lit(True).alias("deleted"))


@query
def ns_upsert_delete(spark, sf):
    """Every third vector written again, scaled, then every seventh deleted; what lives."""
    rows, ns = vectors(spark, sf), _space(spark, Config(64))
    ns.upsert(_vector_documents(rows))
    ns.upsert(_vector_documents(rows.where("vec_id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: (x * F.lit(2.0)).cast("float")))))
    ns.upsert(_tombstones(rows.where("vec_id % 7 = 0")))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return ns.live().select("id", F.round(total, 5).alias("total"), F.try_variant_get("attributes", "$.label", "int").alias("label"))


@query
def ns_branch(spark, sf):
    """A fork sees what was there when it was made and its own deletions, not what the parent writes later."""
    rows, ns = vectors(spark, sf), _space(spark, Config(64))
    ns.upsert(_vector_documents(rows.where("vec_id % 2 = 0")))
    child = ns.branch("child")
    ns.upsert(_vector_documents(rows.where("vec_id % 2 = 1")))
    child.upsert(_tombstones(rows.where("vec_id % 7 = 0")))
    own = child.live().select("id", F.lit("child").alias("space"))
    return own.unionByName(ns.live().select("id", F.lit("parent").alias("space")))


def _half_indexed(spark, sf, config, rows, key, half, documents_of):
    """A namespace whose rows below ``half`` are indexed and whose others are the tail."""
    ns = _space(spark, config)
    ns.upsert(documents_of(rows.where(F.col(key) < half)))
    ns.index()
    ns.upsert(documents_of(rows.where(F.col(key) >= half)))
    return ns


@query
def ns_query_vector(spark, sf):
    """A vector query with a filter over an indexed half and its tail."""
    ns = _half_indexed(spark, sf, Config(64), vectors(spark, sf), "vec_id", _half(spark, sf, "embeddings", "vec_id"), _vector_documents)
    found = ns.query(vector=query_vector(spark, sf), where=_eq("label", 3))
    return found.select("id", F.get_json_object("attributes", "$.label").cast("int").alias("label"), r6("dist"))


@query
def ns_query_text(spark, sf):
    """A text query with a filter over an indexed half and its tail; all attributes come back."""
    ns = _half_indexed(spark, sf, Config(64, text_field="body"), documents(spark, sf), "doc_id", _half(spark, sf, "documents", "doc_id"), _text_documents)
    found = ns.query(text=QUERY_TEXT, where=_eq("lang", "de"))
    of = F.from_json("attributes", "body string, lang string, source string")
    return found.select("id", r6("score"), of["lang"].alias("lang"), of["source"].alias("source"), F.length(of["body"]).alias("body_chars"))


@query
def text_field_value(spark, sf):
    """The text field where it is a string, else the empty text; here some documents hold a number there, some nothing."""
    docs = documents(spark, sf)
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("n_chars").alias("body")))).when(F.col("doc_id") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.col("text").alias("body"))))
    return docs.select("id", F.length(F.coalesce(text_value(F.parse_json(body), "body"), F.lit(""))).cast("long").alias("chars"))


@query
def attr_filter_candidates(spark, sf):
    """Documents that a nested filter leaves, from the index of free-form attributes alone."""
    docs = documents(spark, sf).select("id", F.to_json(F.struct("lang", "source", "n_chars")).alias("attributes"))
    found = attrs.variant_entries(docs, "attributes")
    spec = {"op": "or", "sub": [{"op": "and", "sub": [_eq("lang", "en"), _eq("source", "src0")]}, _eq("source", "src1"), _eq("nowhere", 1)]}
    return attrs.candidates(found, spec, {"lang", "source"}, {"n_chars"})
