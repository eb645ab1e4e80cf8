"""Generators, batched text ranking and fusion, the workloads, and the settings of an S3 store."""

import numpy as np
import pytest

from brindle.functions import text
from brindle.operators import rank
from brindle.plans import workloads
from brindle.sources import generate, store


def test_generated_rows_do_not_depend_on_partitions(spark):
    made = generate.documents(spark, 300, 6, 5)
    assert made.repartition(7).exceptAll(made.coalesce(1)).count() == 0 and made.select("id").distinct().count() == 300
    one = made.first()
    assert len(one["vector"]) == 6 and len(one["text"].split()) == 8 and set(one["text"].split()) <= set(generate.WORDS)
    assert made.exceptAll(generate.documents(spark, 300, 6, 6)).count() == 300


def test_generated_values_have_their_distributions(spark):
    flat = np.array([r["vector"] for r in generate.documents(spark, 2000, 8, 2, normal=True).collect()])
    assert abs(flat.mean()) < 0.05 and abs(flat.std() - 1) < 0.05 and abs(np.corrcoef(flat.T) - np.eye(8)).max() < 0.1
    cube = np.array([r["vector"] for r in generate.documents(spark, 2000, 8, 2).collect()])
    assert cube.min() >= 0 and cube.max() < 1 and abs(cube.mean() - 0.5) < 0.02
    bands = {r["band"]: r["count"] for r in generate.banded(spark, 2000, 4, workloads.BANDS).groupBy("band").count().collect()}
    assert all(abs(bands[b] / 2000 - share) < 0.03 for b, share in workloads.BANDS.items())


def test_batches_rank_texts_as_single_queries_do(spark):
    docs = generate.documents(spark, 200, 2, 9).unionByName(spark.createDataFrame([("none", [0.0, 0.0], None, "en")], "id string, vector array<float>, text string, lang string"))
    asked = [("a", "amber river"), ("b", "delta delta quartz"), ("c", "nowhere"), ("d", None), ("e", "TUNDRA!")]
    queries = spark.createDataFrame(asked, "query string, text string")
    stats = rank.corpus_stats(docs).first()
    got = {}
    for r in rank.batch_top_texts(rank.index_rows(docs), queries, stats["n"], stats["avgdl"], 12).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], round(r["score"], 9)))
    for name, q in asked:
        one = rank.top_texts(docs, q or "", rank.Stats.of(docs, text.query_terms(q or "")), 12).collect()
        assert got.get(name, []) == [(r["id"], round(r["score"], 9)) for r in one]


def test_batches_fuse_as_single_queries_do(spark):
    near = [("q", x, float(n), n) for n, x in enumerate("ABD", 1)] + [("r", "Z", 0.5, 1)]
    told = [("q", x, float(9 - n), n) for n, x in enumerate("CBXA", 1)]
    v, t = spark.createDataFrame(near, "query string, id string, dist double, rank int"), spark.createDataFrame(told, "query string, id string, score double, rank int")
    got = {(r["query"], r["rank"]): (r["id"], r["dist"], r["score"], round(r["rrf"], 12)) for r in rank.batch_fuse(v, t).collect()}
    one = rank.fuse(v.where("query = 'q'"), t).collect()
    assert [got["q", n] for n in range(1, len(one) + 1)] == [(r["id"], r["dist"], r["score"], round(r["rrf"], 12)) for r in one]
    assert got["r", 1] == ("Z", 0.5, None, round(1 / 61, 12)) and len(got) == len(one) + 1


def test_only_both_legs_find_the_planted_answer(spark):
    recall = {r["leg"]: r["recall"] for r in workloads.hybrid_recall(spark).collect()}
    assert recall["vector"] <= 0.05 and recall["text"] <= 0.05 and recall["hybrid"] >= 0.95, recall


def test_codes_need_shorter_lists_than_signs(spark):
    recall = {(r["scorer"], r["shortlist"]): r["recall"] for r in workloads.quantizer_recall(spark).collect()}
    codes, signs = ([recall.get((s, n), 0.0) for n in workloads.SHORTLISTS] for s in ("codes", "signs"))
    assert codes == sorted(codes) and codes[-1] >= 0.98 and codes[3] >= 0.75 and all(c >= s for c, s in zip(codes, signs)), recall


def test_only_rare_filters_go_first(spark):
    plans = {r["band"]: r["filter_first"] for r in workloads.filter_plans(spark).collect()}
    assert plans["rare"] and not plans["mid"] and not plans["broad"]
    assert workloads.main(["nothing"]) == 2


def test_all_missing_settings_are_named(spark):
    with pytest.raises(ValueError, match="BRINDLE_S3_ENDPOINT, BRINDLE_S3_ACCESS_KEY, BRINDLE_S3_SECRET_KEY"):
        store.s3_store(spark, {"BRINDLE_S3_BUCKET": "b", "BRINDLE_S3_SECRET_KEY": ""})


def test_live_ranking_splits_texts_once_and_filters_after_the_statistics(spark):
    from pyspark.sql import functions as F

    docs = generate.documents(spark, 120, 2, 4).withColumn("kind", F.when(F.col("id") != "doc-3", F.length("text") % 3))
    docs = docs.unionByName(spark.createDataFrame([("none", None, None, "en", 1)], "id string, vector array<float>, text string, lang string, kind int"))
    for q in ("amber river", "delta delta quartz", "nowhere", "", "TUNDRA kelp"):
        for where in (None, F.col("kind") == 1, F.lit(False)):
            got = [(r["id"], round(r["score"], 9)) for r in rank.live_top_texts(docs, q, 9, where).collect()]
            one = rank.top_texts(docs, q, rank.Stats.of(docs, text.query_terms(q)), 9, where).collect()
            assert got == [(r["id"], round(r["score"], 9)) for r in one]
    assert rank.live_top_texts(docs.limit(0), "amber").count() == 0
    ranked = rank.live_top_texts(docs, "amber river", 9, F.col("kind") == 1)
    ranked.collect()
    assert "ReusedExchange" in ranked._jdf.queryExecution().executedPlan().toString()
