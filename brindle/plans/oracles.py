"""DuckDB SQL for the registered queries of the engine."""

from __future__ import annotations

import json

from ..functions.text import B, K1, query_terms
from ..operators.attrs import FILTER_FIRST, MOST_VALUES
from ..operators.rank import RRF_K, TOP_K, WIDEN
from ..streaming.queue import TIMEOUT_NS
from .catalogue import DUP_TEXT, QUERY_TEXT, TAIL_TEXT

_E = "(SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_D = "(SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, lang, source, n_chars FROM documents)"


def _cos(a: str, b: str) -> str:
    return f"CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 1.0 ELSE 1 - greatest(-1, least(1, list_cosine_similarity({a}, {b}))) END"


def _top(where: str = "true", dist: str = _cos("v", "q"), rows: str = _E, columns: str = "id, round(dist, 6) AS dist", k: int = TOP_K) -> str:
    return f"SELECT {columns} FROM (SELECT *, {dist} AS dist FROM (SELECT *, {_Q} AS q FROM {rows}) WHERE v IS NOT NULL AND ({where})) ORDER BY dist, id LIMIT {k}".replace("round(dist, 6)", "round(dist, 6)")


def _ordered_top(**parts) -> str:
    inner = _top(**(parts | {"columns": "*"}))
    return f"SELECT {parts.get('columns', 'id, round(dist, 6) AS dist')} FROM ({inner})"


_MEANS = "SELECT label, pos, avg(x)::FLOAT AS mean FROM (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM {e}) GROUP BY label, pos"
_MEANS = _MEANS.format(e=_E)
_CENTRES = f"SELECT label AS cluster, list(mean::DOUBLE ORDER BY pos) AS c FROM ({_MEANS}) GROUP BY label"
_ASSIGN = f"""SELECT id, label, vec_id, v, cluster FROM (
  SELECT e.*, c.cluster, row_number() OVER (PARTITION BY id ORDER BY {_cos("v", "c")}, c.cluster) AS n FROM {_E} e, ({_CENTRES}) c) WHERE n = 1"""
_SIGNS = f"""SELECT id, v, list_sum(list_transform(range(1, 65), lambda d: CASE WHEN (v[d] - c[d] >= 0) <> (q[d] - c[d] >= 0) THEN 1 ELSE 0 END)) AS hamming
  FROM (SELECT e.*, c.c, {_Q} AS q FROM {_E} e JOIN ({_CENTRES}) c ON c.cluster = e.label)"""


def _probed(n: int) -> str:
    near = f"SELECT cluster FROM (SELECT cluster, c, {_Q} AS q FROM ({_CENTRES})) ORDER BY {_cos('c', 'q')}, cluster LIMIT {n}"
    return _ordered_top(where=f"cluster IN ({near})", rows=f"({_ASSIGN})")


_W = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda w: w <> '')"
_TOKENS = f"(SELECT *, {_W} AS w FROM {_D})"
_POST = f"(SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM {_TOKENS}) GROUP BY term, id)"


def _scores(q: str, where: str = "true", indexed: str = "true") -> str:
    """``id, score`` with the statistics of the documents where ``indexed``."""
    terms: dict[str, int] = {}
    for t in query_terms(q):
        terms[t] = terms.get(t, 0) + 1
    asked = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""
      WITH d AS (SELECT *, len(w) AS dl FROM {_TOKENS}), i AS (SELECT * FROM d WHERE {indexed}),
      s AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM i), a(term, qtf) AS (VALUES {asked}),
      f AS (SELECT a.term, a.qtf, (SELECT count(*) FROM i WHERE list_contains(i.w, a.term)) AS df FROM a),
      h AS (SELECT d.id, d.dl, f.qtf, f.df, len(list_filter(d.w, lambda x: x = f.term)) AS tf FROM d, f WHERE {where})
      SELECT id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * CASE WHEN avgdl = 0 THEN 0 ELSE dl / avgdl END))) AS score
      FROM h, s WHERE tf > 0 GROUP BY id"""


def _top_text(q: str, k: int = TOP_K, **parts) -> str:
    return f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM ({_scores(q, **parts)}) ORDER BY score DESC, id LIMIT {k})"


_LOG = "(SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) AS seq, event_id AS pos, event_type = 'error' AS deleted, value, event_id FROM events)"


def _bound(k: int) -> str:
    return f"(SELECT min(seq) + (max(seq) - min(seq)) * {k} // 4 FROM {_LOG})"


def _fold(where: str, columns: str, kept: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, pos DESC) AS n FROM {_LOG} WHERE {where}) WHERE n = 1 AND {kept}"


# the indexed half, under a tail that begins a fifth of it earlier
_EARLY = "(SELECT (max(vec_id) + 1) // 2 - (max(vec_id) + 1) // 2 // 5 FROM embeddings)"
_HALF = "(SELECT (max(doc_id) + 1) // 2 FROM documents)"
_SUM = "list_sum(list_transform(v, lambda x: x))"
_TAIL = f"(SELECT id, vec_id, label, CASE WHEN vec_id % 5 <> 0 THEN v END AS v FROM {_E} WHERE vec_id >= {_EARLY} AND vec_id % 7 <> 0)"
_OVERLAY = f"(SELECT id, vec_id, label, v FROM {_E} WHERE vec_id < {_EARLY} UNION ALL SELECT * FROM {_TAIL})"
_JOBS = f"(SELECT id AS namespace, seq AS enqueued_at, CASE WHEN pos % 2 = 0 THEN 'pending' ELSE 'in_progress' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, pos) AS n FROM {_LOG}) WHERE n = 1)"
_ENTRIES = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {key} AS value_key FROM {_D} WHERE {f} IS NOT NULL" for f, key in (("lang", "'s:' || lang"), ("source", "'s:' || source"), ("n_chars", "'n:' || n_chars"), ("text", "'s:' || text")))
_L = "id, label, round(dist, 6) AS dist"
_HYBRID = f"""
  WITH near AS (SELECT id, dist, row_number() OVER (ORDER BY dist, id) AS r FROM ({_top(columns="id, dist", k=TOP_K * WIDEN)})),
  told AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM ({_scores(QUERY_TEXT)}) ORDER BY score DESC, id LIMIT {TOP_K * WIDEN})),
  fused AS (SELECT coalesce(near.id, told.id) AS id, dist, score, coalesce(1.0::DOUBLE / ({RRF_K} + near.r), 0) + coalesce(1.0::DOUBLE / ({RRF_K} + told.r), 0) AS rrf FROM near FULL JOIN told ON near.id = told.id)
  SELECT id, round(dist, 6) AS dist, round(score, 6) AS score, round(rrf, 6) AS rrf FROM (SELECT * FROM fused ORDER BY rrf DESC, id LIMIT {TOP_K})"""
_ZERO = json.dumps([0.0] * 64)
_RANKED = f"SELECT q.id AS query, e.id, {_cos('e.v', 'q.v')} AS dist FROM {_E} e, (SELECT * FROM {_E} WHERE vec_id % 100 = 0) q"
_EXACT = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, id) AS rank FROM ({_RANKED}))"
_PERCENTILES = ", ".join(f"round(quantile_disc(value, {p}), 6) AS {n}" for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p99_9")))

ORACLES = {
    "vec_cosine_topk": _ordered_top(),
    "vec_l2_topk": _ordered_top(dist="list_distance(v, q)"),
    "vec_zero_norm": f"SELECT id, round({_cos('v', 'q')}, 6) AS dist FROM (SELECT id, v, {_Q} AS q FROM {_E} UNION ALL SELECT 'zero', {_ZERO}::DOUBLE[], {_Q})",
    "vec_normalize_norms": f"SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, CASE WHEN list_dot_product(v, v) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS unit_norm FROM {_E}",
    "vec_batch_topk": f"SELECT query, id, rank::INT AS rank, round(dist, 6) AS dist FROM {_EXACT} WHERE rank <= {TOP_K}",
    "vec_filter_eq": _ordered_top(where="label = 3", columns=_L),
    "vec_filter_and": _ordered_top(where="label = 3 AND id = '13'", columns=_L),
    "vec_filter_or": _ordered_top(where="label = 3 OR label = 5", columns=_L),
    "vec_filter_nested": _ordered_top(where="label IN (1, 2) AND label IN (2, 4)", columns=_L),
    "vec_filter_missing_field": _ordered_top(where="false", columns=_L),
    "vec_filter_unknown_op": _ordered_top(where="false", columns=_L),
    "vec_filter_all": _ordered_top(columns=_L),
    "vec_group_mean": f"SELECT label, pos::INT AS pos, round(mean, 6) AS mean FROM ({_MEANS})",
    "parse_vector": f"SELECT id, len(v)::BIGINT AS n, round({_SUM}, 5) AS total FROM {_E}",
    "refresh_changed": f"SELECT id, vec_id % 3 = 0 AND list_dot_product(v, v) > 0 AS changed FROM {_E}",
    "ivf_assign": f"SELECT id, cluster::BIGINT AS cluster FROM ({_ASSIGN})",
    "ivf_cluster_sizes": f"SELECT cluster::BIGINT AS cluster, count(*) AS size FROM ({_ASSIGN}) GROUP BY cluster",
    "ivf_probe_lossless": _ordered_top(),
    "ivf_probe_3": _probed(3),
    "lloyd_one_step": f"SELECT cluster::BIGINT AS cluster, pos::INT AS pos, round(avg(x)::FLOAT, 6) AS mean FROM (SELECT cluster, unnest(range(64)) AS pos, unnest(v) AS x FROM ({_ASSIGN})) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY cluster, pos"),
    "sign_code_hamming": f"SELECT id, hamming::BIGINT AS hamming, (64 - hamming)::BIGINT AS agreement FROM ({_SIGNS})",
    "sign_shortlist_rerank": _ordered_top(rows=f"(SELECT * FROM ({_SIGNS}) ORDER BY hamming, id LIMIT {4 * TOP_K})"),
    "filter_plan_decision": f"SELECT l::INT AS label, t AS total, h AS hits, h < {FILTER_FIRST} * t AS filter_first FROM (SELECT l, (SELECT count(*) FROM embeddings) AS t, (SELECT count(*) FROM embeddings WHERE label = l) AS h FROM range(10) r(l))",
    "filter_first_topk": _ordered_top(where="label = 3"),
    "attr_index": f"SELECT field, value_key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ({_ENTRIES}) WHERE field IN ('lang', 'source') GROUP BY field, value_key",
    "attr_cardinality_skip": f"SELECT field, count(DISTINCT value_key) AS n_values FROM ({_ENTRIES}) GROUP BY field HAVING NOT (count(DISTINCT value_key) > {MOST_VALUES} AND count(DISTINCT value_key) > (SELECT count(*) FROM documents) // 2)",
    "ordinals": f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS ord FROM {_D}",
    "bitmap_and": f"SELECT id FROM {_D} WHERE lang = 'en' AND source = 'src0'",
    "bitmap_or": f"SELECT id FROM {_D} WHERE lang = 'fr' OR source = 'src0'",
    "missing_attribute": f"SELECT id, quality FROM {_D} JOIN labels USING (doc_id) WHERE quality = 1",
    "variant_filter": "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) = 7",
    "tokenize_counts": f"SELECT id, len(w) AS n_tokens, len(list_distinct(w)) AS n_terms FROM {_TOKENS}",
    "postings": f"SELECT term, id, tf FROM {_POST}",
    "doc_len": f"SELECT id, len(w) AS dl FROM {_TOKENS}",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM {_TOKENS}",
    "term_df": f"SELECT term, count(*) AS df FROM {_POST} GROUP BY term",
    "term_idf": f"SELECT term, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM (SELECT term, count(*) AS df FROM {_POST} GROUP BY term)",
    "bm25_topk": _top_text(QUERY_TEXT),
    "bm25_dup_terms": _top_text(DUP_TEXT),
    "bm25_filter": _top_text(QUERY_TEXT, where="d.lang = 'de'"),
    "bm25_no_hits": _top_text("zzzqqqxxx"),
    "bm25_indexed": _top_text(QUERY_TEXT),
    "bm25_tail_only": _top_text(TAIL_TEXT, indexed="false"),
    "bm25_tail_overlay": _top_text(QUERY_TEXT, indexed=f"doc_id < {_HALF}"),
    "hybrid_rrf_topk": _HYBRID,
    "wal_fold_live": _fold("true", "id, event_id, round(value, 6) AS value", "NOT deleted"),
    "wal_fold_deleted": _fold("true", "id", "deleted"),
    "wal_window": _fold(f"seq >= {_bound(1)} AND seq < {_bound(3)}", "id, event_id", "NOT deleted"),
    "branch_view": _fold(f"seq < {_bound(2)} OR seq >= {_bound(3)}", "id, event_id", "NOT deleted"),
    "branch_chain": _fold(f"seq < {_bound(2)} OR seq >= {_bound(3)}", "id, event_id, deleted", "true"),
    "overlay_vec": _ordered_top(rows=_OVERLAY),
    "overlay_tombstone": f"SELECT id, v IS NOT NULL AS has_vector FROM {_OVERLAY}",
    "queue_pick_eligible": f"SELECT * FROM {_JOBS} WHERE state = 'pending' OR {TIMEOUT_NS // 2} > {TIMEOUT_NS} ORDER BY enqueued_at, namespace LIMIT 1",
    "queue_snapshot": f"SELECT * FROM {_JOBS}",
    "latency_percentiles": f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, {_PERCENTILES} FROM events GROUP BY event_type",
    "recall_at_k": f"""
      WITH e AS (SELECT query, id FROM {_EXACT} WHERE rank <= 10),
      p AS (SELECT query, cluster FROM (SELECT q.id AS query, cluster, row_number() OVER (PARTITION BY q.id ORDER BY {_cos("c", "q.v")}, cluster) AS n FROM ({_CENTRES}), (SELECT * FROM {_E} WHERE vec_id % 100 = 0) q) WHERE n <= 3),
      f AS (SELECT query, id FROM (SELECT p.query, a.id, row_number() OVER (PARTITION BY p.query ORDER BY {_cos("a.v", "q.v")}, a.id) AS n FROM ({_ASSIGN}) a JOIN p ON p.cluster = a.cluster JOIN {_E} q ON q.id = p.query) WHERE n <= 10)
      SELECT e.query, count(f.id) AS hits, round(count(f.id) / count(*), 6) AS recall FROM e LEFT JOIN f ON e.query = f.query AND e.id = f.id GROUP BY e.query""",
    "ns_upsert_delete": f"SELECT id, round({_SUM} * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 5) AS total, label FROM {_E} WHERE vec_id % 7 <> 0",
    "ns_branch": f"SELECT id, 'child' AS space FROM {_E} WHERE vec_id % 2 = 0 AND vec_id % 7 <> 0 UNION ALL SELECT id, 'parent' FROM {_E}",
    "ns_query_vector": _ordered_top(where="label = 3", columns=_L),
    "ns_query_text": f"""SELECT s.id, round(s.score, 6) AS score, d.lang, d.source, length(d.text)::INT AS body_chars
      FROM (SELECT * FROM ({_scores(QUERY_TEXT, where="d.lang = 'de'", indexed=f"doc_id < {_HALF}")}) ORDER BY score DESC, id LIMIT {TOP_K}) s JOIN {_D} d ON d.id = s.id""",
    "text_field_value": f"SELECT id, (CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 0 ELSE length(coalesce(text, '')) END)::BIGINT AS chars FROM {_D}",
    "attr_filter_candidates": f"SELECT id FROM {_D} WHERE (lang = 'en' AND source = 'src0') OR source = 'src1'",
}
