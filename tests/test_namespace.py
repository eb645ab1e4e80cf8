import json
import random
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest

from brindle import cli
from brindle.operators import ivf, quant
from brindle.plans.cache import Cache
from brindle.plans.namespace import Config, Namespace, QueryError
from brindle.sources.store import FileStore, HadoopStore, MemoryStore, NotFound, PreconditionFailed
from brindle.serve import server
from brindle.streaming.broker import broker
from brindle.streaming.commit import Committer, CommitterClosed
from brindle.streaming.queue import TIMEOUT_NS, Heartbeat, Queue, enqueue_if_behind, serve_jobs, work


@pytest.fixture
def space(spark, tmp_path):
    def make(name="ns", config=Config(2, "l2", "body"), store=None):
        ns = Namespace(spark, store or MemoryStore(), str(tmp_path / "data"), name)
        ns.create(config)
        return ns

    return make


def doc(i, v=None, body=None, **attributes):
    return {"id": i, "vector": v, "attributes": attributes | ({"body": body} if body else {})}


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("kind", ["memory", "file", "hadoop"])
def test_store_contract(spark, tmp_path, kind):
    s = {"memory": MemoryStore, "file": lambda: FileStore(str(tmp_path)), "hadoop": lambda: HadoopStore(spark, f"file://{tmp_path}")}[kind]()
    with pytest.raises(NotFound):
        s.get("a/b")
    with pytest.raises(PreconditionFailed):
        s.put_cas("a/b", b"x", "1")
    tag = s.put_if_absent("a/b", b"1")
    with pytest.raises(PreconditionFailed):
        s.put_if_absent("a/b", b"2")
    new = s.put_cas("a/b", b"3", tag)
    with pytest.raises(PreconditionFailed):
        s.put_cas("a/b", b"4", tag)
    assert s.get("a/b") == (b"3", new)
    s.put("a/c", b"5")
    assert s.list("a/") == ["a/b", "a/c"]


def test_one_swap_wins(tmp_path):
    s = FileStore(str(tmp_path))
    tag, won = s.put_if_absent("k", b"0"), []

    def swap(n):
        try:
            s.put_cas("k", str(n).encode(), tag)
            won.append(n)
        except PreconditionFailed:
            pass

    threads = [threading.Thread(target=swap, args=(n,)) for n in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1


def test_lifecycle(space):
    ns = space()
    with pytest.raises(FileExistsError, match="already exists"):
        ns.create(Config(2))
    assert ns.upsert([]) is None
    ns.upsert([doc("a", [0, 0], "quick fox"), doc("b", [3, 4], "slow fox"), doc("a", [1, 0], "quick dog")])
    ns.upsert([doc("c", None, "only text", lang="en")])
    assert ids(ns.query(vector=[0, 0])) == ["a", "b"]
    assert [r["dist"] for r in ns.query(vector=[0, 0]).collect()] == [1.0, 5.0]
    assert ns.index() == 1
    assert ns.info()["doc_count"] == 3 and ns.info()["unindexed"] == 0
    ns.upsert([doc("d", [0.5, 0], "quick quick")])
    ns.delete(["b"])
    assert ids(ns.query(vector=[0, 0])) == ["d", "a"]
    assert ids(ns.query(vector=[0, 0], approx=True)) == ["d", "a"]
    assert ids(ns.query(text="fox")) == []
    assert set(ids(ns.query(text="quick"))) == {"a", "d"}
    assert ids(ns.query(text="!!!")) == []
    assert ids(ns.query(text="only", where={"op": "eq", "field": "lang", "value": "en"})) == ["c"]
    hybrid = ns.query(vector=[0, 0], text="quick").collect()
    assert hybrid[0]["id"] == "d" and hybrid[0]["rrf"] == pytest.approx(2 / 61)
    ns.upsert([doc("a", None, "no vector")])
    assert ids(ns.query(vector=[0, 0])) == ["d"]
    assert ns.index() == 2
    assert ids(ns.query(vector=[0, 0])) == ["d"]


def test_errors(space):
    ns = space("plain", Config(2))
    for call, words in (({}, "no rank mode"), ({"text": "x"}, "no text field"), ({"vector": [1]}, "1 components")):
        with pytest.raises(QueryError, match=words):
            ns.query(**call)
    with pytest.raises(ValueError, match="'x'.*3 components.*2"):
        ns.upsert([doc("x", [1, 2, 3])])
    with pytest.raises(NotFound):
        ns._at("nowhere").query(vector=[1, 2])
    with pytest.raises(NotFound):
        ns.segments(0, 1)


def test_branches_do_not_see_later_writes(space):
    a = space("a")
    a.upsert([doc("keep", [1, 0]), doc("drop", [2, 0])])
    b = a.branch("b")
    a.upsert([doc("later", [0, 0])])
    a.index()
    assert ids(b.query(vector=[0, 0])) == ["keep", "drop"]
    b.delete(["drop"])
    b.upsert([doc("keep", [9, 9])])
    c = b.branch("c")
    c.upsert([doc("own", [0, 1])])
    assert ids(c.query(vector=[0, 0])) == ["own", "keep"]
    assert ids(a.query(vector=[0, 0])) == ["later", "keep", "drop"]
    b.index()
    assert b.info()["doc_count"] == 1
    assert ids(c.query(vector=[0, 0])) == ["own", "keep"]
    d = a.branch("d")
    a.upsert([doc("latest", [0, 0])])
    assert ids(d.query(vector=[0, 0])) == ["later", "keep", "drop"]
    for child, kind in (("a", ValueError), ("b", FileExistsError)):
        with pytest.raises(kind):
            a.branch(child)


def test_approximate_is_exact_when_lossless(space):
    random.seed(3)
    ns = space("ivf", Config(4, "l2"))
    ns.upsert([doc(f"d{n}", [random.random() for _ in range(4)], tier=n % 3) for n in range(40)])
    ns.index()
    for where in (None, {"op": "eq", "field": "tier", "value": 1}):
        q = [random.random() for _ in range(4)]
        assert ids(ns.query(vector=q, where=where)) == ids(ns.query(vector=q, where=where, approx=True, n_probe=100))
    assert len(set(ns.prefilter_shortlist(q, 20)) & set(ids(ns.query(vector=q, top_k=5)))) >= 4


def test_default_approximate_recall(spark, space):
    """Recall at 10 against brute force, the rows whose id is divisible by 100 as queries; under a filter too."""
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    points = np.array([r["embedding"] for r in table], float)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    ns = space("recall", Config(len(points[0]), "cosine"))
    ns.upsert([doc(str(r["vec_id"]), list(r["embedding"]), label=r["label"]) for r in table])
    ns.index()
    hits = {None: [], 3: []}
    for n, r in enumerate(table):
        if r["vec_id"] % 100 == 0:
            for label, found in hits.items():
                if label is None or n < 200:
                    kept = [k for k in range(len(table)) if label is None or table[k]["label"] == label]
                    best = sorted(kept, key=lambda k: -(points[k] @ points[n]))[:10]  # noqa: B023
                    where = None if label is None else {"op": "eq", "field": "label", "value": label}
                    got = ids(ns.query(vector=list(r["embedding"]), where=where, approx=True))
                    assert len(got) == 10
                    found.append(len({str(table[k]["vec_id"]) for k in best} & set(got)) / 10)
    print({k: (len(v), sum(v) / len(v)) for k, v in hits.items()})
    assert len(hits[None]) == 5 and all(sum(v) / len(v) >= 0.9 for v in hits.values())


def test_scarce_matches_widen_the_search():
    assert ivf.enough([2, 0, 1], {2: 90, 0: 5, 1: 5}, 10) == [2]
    assert ivf.enough([2, 0, 1], {0: 3, 1: 4}, 10) == [2, 0, 1]
    assert ivf.enough([2, 0, 1], {2: 9, 0: 2, 1: 1}, 10) == [2, 0]
    assert len(ivf.probe({c: [float(c), 1.0] for c in range(40)}, [0.0, 1.0])) == 30


def test_queue():
    clock = [10]
    q = Queue(MemoryStore(), now=lambda: clock[0])
    assert q.jobs() == [] and q.claim("w") is None
    assert q.enqueue("old", 3) and not q.enqueue("old", 2)
    clock[0] = 20
    assert q.enqueue("young", 1) and q.enqueue("old", 5)
    assert q.claim("w1")["namespace"] == "old"
    assert q.claim("w2")["namespace"] == "young"
    assert q.claim("w3") is None
    with pytest.raises(PermissionError):
        q.complete("old", "w2")
    q.heartbeat("young", "w2")
    clock[0] += TIMEOUT_NS
    q.heartbeat("young", "w2")
    clock[0] += 1
    assert q.claim("w3")["namespace"] == "old"
    q.complete("young", "w2")
    assert [j["namespace"] for j in q.jobs()] == ["old"]


def test_worker_builds_what_lags(space):
    ns, q = space("lag"), Queue(MemoryStore())
    assert not enqueue_if_behind(q, ns)
    ns.upsert([doc("a", [1, 1])])
    assert not enqueue_if_behind(q, ns, 2)
    assert enqueue_if_behind(q, ns)
    assert work(q, ns._at, "w") == 1
    assert ns.info()["epoch"] == 1 and q.jobs() == []


def test_group_commit(space):
    ns = space("group")
    writer, failed = Committer(ns), []
    threads = [threading.Thread(target=lambda n=n: writer.upsert([doc(f"g{n}", [n, 0])])) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    with pytest.raises(ValueError, match="3 components"):
        writer.upsert([doc("bad", [1, 2, 3])])
    writer.close()
    writer.close()
    with pytest.raises(CommitterClosed):
        writer.upsert([doc("x", [1, 1])])
    assert ns.info()["wal_seq"] <= 6 and ns.live().count() == 6 and not failed


def test_command_line(spark, tmp_path, capsys):
    root, file = str(tmp_path / "root"), tmp_path / "docs.json"
    file.write_text(json.dumps([doc("x", [1, 0], "hello"), doc("y", [0, 1], "world", lang="en")]))
    run = lambda *a: cli.main(["--root", root, *a], spark)
    run("create", "n", "--dim", "2", "--text-field", "body")
    run("upsert", "n", "--file", str(file))
    run("index", "n")
    capsys.readouterr()
    run("query", "n", "--vector", "1, 0", "--top-k", "1")
    out = json.loads(capsys.readouterr().out)
    assert out[0]["id"] == "x" and out[0]["$dist"] == 0
    run("query", "n", "--text", "world", "--filter", '{"op":"eq","field":"lang","value":"en"}')
    assert json.loads(capsys.readouterr().out)[0]["id"] == "y"
    with pytest.raises(SystemExit):
        run("create", "m", "--dim", "2", "--metric", "manhattan")


@pytest.mark.parametrize("later_first", [True, False])
def test_two_builders_lose_nothing(space, later_first):
    """A builder that began earlier and covers less, published before or after one that covers more."""
    ns = space("race")
    ns.upsert([doc("a", [0, 0], "one")])
    early = ns.build()
    ns.upsert([doc("b", [1, 0], "two")])
    late = ns.build()
    for build in (late, early) if later_first else (early, late):
        ns.publish(build)
    assert ns.info()["indexed_up_to"] == 2 and ns.info()["unindexed"] == 0
    assert ids(ns.query(vector=[0, 0])) == ["a", "b"] and ids(ns.query(text="two")) == ["b"]
    ns.upsert([doc("c", [2, 0])])
    ns.publish(early)
    assert ids(ns.query(vector=[0, 0])) == ["a", "b", "c"] and ns.info()["doc_count"] == 3


def test_an_epoch_that_is_gone_is_not_needed(space):
    ns = space("gone")
    ns.upsert([doc("a", [0, 0]), doc("b", [1, 0])])
    ns.swap(lambda m: m.__class__(**{**m.__dict__, "epoch": 1, "index_key": "gone/epochs/nowhere", "indexed_up_to": 1}))
    assert ids(ns.query(vector=[0, 0])) == ["a", "b"]
    ns.upsert([doc("c", [2, 0])])
    assert ns.index() == 2 and ids(ns.query(vector=[0, 0])) == ["a", "b", "c"] and ns.info()["unindexed"] == 0


@pytest.mark.parametrize("kind", ["memory", "file", "hadoop"])
def test_of_racing_writers_one_wins(spark, tmp_path, kind):
    s = {"memory": MemoryStore, "file": lambda: FileStore(str(tmp_path)), "hadoop": lambda: HadoopStore(spark, f"file://{tmp_path}")}[kind]()
    for key in range(20):
        won, bodies = [], [f"{n}".encode() * 1000 for n in range(8)]

        def put(n, key=key, won=won, bodies=bodies):
            try:
                s.put_if_absent(f"r/{key}", bodies[n])
                won.append(n)
            except PreconditionFailed:
                pass

        threads = [threading.Thread(target=put, args=(n,)) for n in range(8)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and s.get(f"r/{key}")[0] == bodies[won[0]]
    assert len(s.list("r/")) == 20


def test_heartbeats_keep_a_job():
    q = Queue(MemoryStore())
    q.enqueue("ns", 1)
    job, beats = q.claim("w"), []
    q.heartbeat = lambda *a, beat=q.heartbeat: beats.append(a) or beat(*a)
    with Heartbeat(q, "ns", "w", 0.01):
        time.sleep(0.2)
    assert len(beats) > 3 and q.jobs()[0]["heartbeat_at"] > job["heartbeat_at"]
    stolen = Heartbeat(q, "ns", "another", 0.01)
    with stolen:
        time.sleep(0.1)
    assert stolen.lost


def test_indexer_service(space):
    ns, q, stop = space("served"), Queue(MemoryStore()), threading.Event()
    service = threading.Thread(target=serve_jobs, args=(q, ns._at, "w", stop, 0.05))
    service.start()
    q.enqueue("nowhere", 1)  # a job that fails does not end the service
    ns.upsert([doc("a", [1, 1])])
    enqueue_if_behind(q, ns)
    for _ in range(600):
        if ns.info()["epoch"]:
            break
        time.sleep(0.1)
    stop.set()
    service.join()
    assert ns.info()["epoch"] == 1 and [j["namespace"] for j in q.jobs()] == ["nowhere"]


def _e(field, value):
    return {"op": "eq", "field": field, "value": value}


FILTERS = [
    _e("tier", "rare"), _e("tier", "common"), _e("n", 7), _e("n", 7.0), _e("flag", True), _e("flag", None), _e("nowhere", 1), _e("uid", "u3"), _e("tags", ["x"]), {"op": "gte"},
    {"op": "and", "sub": [_e("tier", "common"), _e("n", 3)]}, {"op": "or", "sub": [_e("tier", "rare"), _e("n", 3)]}, {"op": "and", "sub": [_e("tier", "common"), _e("uid", "u5")]},
]


def test_filters_of_any_selectivity_are_exact(space):
    """Looked up in the attribute index or applied to the scan: the same results as brute force."""
    random.seed(9)
    ns = space("plan", Config(4, "l2", "body"))
    made = [doc(f"d{k:03d}", [random.random() for _ in range(4)], f"words {k}", tier="rare" if k < 4 else "common", n=k % 10, flag=[True, False, None][k % 3], uid=f"u{k}", tags=["x"]) for k in range(160)]
    ns.upsert(made[:150])
    ns.index()
    ns.upsert(made[150:])
    plans = [ns.plan(spec) for spec in FILTERS]
    assert [p["usable"] for p in plans] == [True] * 7 + [False, False] + [True] * 3 + [False]
    assert plans[0]["hits"] == 4 and plans[0]["filter_first"] and plans[1]["hits"] == 146 and not plans[1]["filter_first"] and plans[6]["hits"] == 0
    holds = [lambda a: a["tier"] == "rare", lambda a: a["tier"] == "common", lambda a: a["n"] == 7, lambda a: a["n"] == 7, lambda a: a["flag"] is True, lambda a: a["flag"] is None, lambda a: False, lambda a: a["uid"] == "u3", lambda a: True, lambda a: False,
             lambda a: a["tier"] == "common" and a["n"] == 3, lambda a: a["tier"] == "rare" or a["n"] == 3, lambda a: a["tier"] == "common" and a["uid"] == "u5"]
    q = [0.5] * 4
    for spec, keeps in zip(FILTERS, holds):
        want = sorted((np.linalg.norm(np.array(d["vector"], np.float32) - 0.5), d["id"]) for d in made if keeps(d["attributes"]))[:10]
        assert ids(ns.query(vector=q, where=spec)) == [i for _, i in want]
        if spec in FILTERS[:3]:
            assert ids(ns.query(vector=q, where=spec, approx=True, n_probe=100))[:3] == [i for _, i in want][:3]


def test_epochs_are_cached_manifests_are_not(space):
    ns = space("cached")
    ns.upsert([doc("a", [0, 0])])
    ns.index()
    before = ns.cache.counters
    assert ids(ns.query(vector=[0, 0])) == ids(ns.query(vector=[0, 0])) == ["a"]
    asked = ns.cache.counters.since(before)
    assert asked.hits >= 2 and asked.misses <= 1
    ns._at("cached").upsert([doc("b", [1, 0])])
    assert ids(ns.query(vector=[0, 0])) == ["a", "b"]


def test_cache_is_bounded():
    cache = Cache(10)
    assert [cache.get(k, lambda k=k: bytes(4) + k.encode()) for k in "abab"] == [bytes(4) + k for k in (b"a", b"b", b"a", b"b")]
    assert (cache.counters.hits, cache.counters.misses, cache.counters.evictions) == (2, 2, 0) and cache.counters.hit_rate == 0.5
    cache.get("c", lambda: bytes(5))
    cache.get("a", lambda: bytes(5))
    cache.get("large", lambda: bytes(11))
    assert cache.counters.evictions == 2 and cache.size == 10


def test_tree_routes_near_the_exact_clusters():
    rng = np.random.default_rng(3)
    centroids = {c: x.tolist() for c, x in enumerate(rng.normal(size=(120, 8)).astype(np.float32))}
    root, hits = ivf.tree(centroids, metric="l2"), 0
    for q in rng.normal(size=(40, 8)):
        found, compared = ivf.route(centroids, root, q, 8, "l2")
        assert len(found) == len(set(found)) == 8
        hits += len(set(found) & set(ivf.probe(centroids, q, 8, "l2")))
        assert ivf.route(centroids, root, q, 120, "l2")[0] == ivf.probe(centroids, q, 120, "l2") == ivf.route(centroids, None, q, 120, "l2")[0]
    assert hits >= 0.8 * 320 and ivf.tree({0: [1.0]})["children"] == []


def test_rotation_is_orthonormal():
    for dim in (3, 64, 65):
        p = quant.rotation(dim)
        assert np.allclose(p @ p.T, np.eye(dim), atol=1e-9) and np.array_equal(p, quant.rotation(dim))


def test_estimates_are_unbiased():
    """128 components, 400 Gaussian trials: each error within 5 / root of D, the mean far below; a zero residual gives 0."""
    rng, dim = np.random.default_rng(11), 128
    p, errors = quant.rotation(dim), []
    for trial in range(400):
        v, c, q = rng.normal(size=(3, dim))
        bits, _, align = quant.encode(v[None], c, p)
        unit = lambda x: x / np.linalg.norm(x)
        errors.append(quant.estimate_inner(bits, align, quant.encode_query(q, c, p, seed=trial))[0] - unit(v - c) @ unit(q - c))
    assert np.max(np.abs(errors)) <= 5 / np.sqrt(dim) and abs(np.mean(errors)) < 0.1 * np.max(np.abs(errors))
    bits, size, align = quant.encode(np.ones((1, dim)), np.ones(dim), p)
    assert bits.all() and size[0] == align[0] == 0 and quant.estimate_inner(bits, align, quant.encode_query(q, np.ones(dim), p))[0] == 0


def test_estimates_shortlist_better_than_signs():
    """600 vectors of 64 components, 40 queries: recall of the shortlist of 4 K by estimate against that by plain signs."""
    rng = np.random.default_rng(5)
    points, queries = rng.normal(size=(600, 64)).astype(np.float32), rng.normal(size=(40, 64)).astype(np.float32)
    centre, p = points.mean(0), quant.rotation(64)
    bits, norms, align = quant.encode(points, centre, p)
    plain, by = (points >= centre), {"estimate": 0, "signs": 0}
    for n, q in enumerate(queries):
        exact = set(np.argsort(np.linalg.norm(points - q, axis=1))[:10])
        est = quant.estimate_distance("l2", bits, norms, align, quant.encode_query(q, centre, p, seed=n))
        by["estimate"] += len(exact & set(np.argsort(est, kind="stable")[:40]))
        by["signs"] += len(exact & set(np.argsort(-(plain == (q >= centre)).sum(1), kind="stable")[:40]))
    assert by["estimate"] >= by["signs"] and by["estimate"] >= 0.5 * 400


def test_http(spark, space):
    ns = space("web")
    ns.upsert([doc("a", [0, 0], "hello", lang="en"), doc("b", [1, 0], "world")])
    httpd = server(spark, ns.store, ns.data, 0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{httpd.server_address[1]}"

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, None if body is None else body.encode())) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("/healthz") == (200, {"status": "ok"})
    assert ask("/v1/namespaces/web/info")[1]["wal_seq"] == 1
    status, found = ask("/v1/namespaces/web/query", json.dumps({"vector": [0, 0], "topK": 1}))
    assert status == 200 and found[0]["id"] == "a" and "$score" not in found[0]
    assert ask("/v1/namespaces/web/query", json.dumps({"bm25": "world"}))[1][0]["id"] == "b"
    assert ask("/v1/namespaces/web/query", "{}")[0] == ask("/v1/namespaces/web/query", "no json")[0] == 400
    assert ask("/v1/namespaces/nowhere/query", json.dumps({"vector": [0, 0]}))[0] == ask("/v1/namespaces/nowhere/info")[0] == ask("/elsewhere")[0] == 404
    assert ask("/stats")[1]["queries"] == 2
    httpd.shutdown()


def test_broker():
    q = Queue(MemoryStore())
    swaps = []
    q._swap = lambda change, swap=q._swap: swaps.append(1) or swap(change)
    httpd = broker(q, 0, window=0.3)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{httpd.server_address[1]}"

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, None if body is None else json.dumps(body).encode())) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    answers = []
    threads = [threading.Thread(target=lambda n=n: answers.append(ask("/v1/enqueue", {"namespace": f"n{n % 3}", "requestedUpTo": n}))) for n in range(9)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [s for s, _ in answers] == [200] * 9 and len(swaps) < 9
    status, body = ask("/v1/queue")
    assert status == 200 and {j["namespace"]: j["up_to"] for j in body["jobs"]} == {"n0": 6, "n1": 7, "n2": 8}
    assert ask("/v1/enqueue", {"requestedUpTo": 1})[0] == 400 and ask("/healthz")[0] == 200 and ask("/nowhere")[0] == 404
    httpd.shutdown()
