"""``python -m brindle.cli``: create, branch, upsert, index, query, info, serve."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .functions.filters import parse
from .plans.namespace import Config, Namespace
from .sources.documents import read_documents, results_json
from .sources.store import FileStore


def parse_vector(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("--root", default="./brindle-data")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create", "branch", "upsert", "index", "query", "info", "serve"):
        s = sub.add_parser(name)
        if name != "serve":
            s.add_argument("namespace")
        if name == "create":
            s.add_argument("--dim", type=int, required=True)
            s.add_argument("--metric", choices=("cosine", "l2"), default="cosine")
            s.add_argument("--text-field", default="")
        if name == "branch":
            s.add_argument("child")
        if name == "upsert":
            s.add_argument("--file", required=True)
        if name == "query":
            s.add_argument("--vector", type=parse_vector)
            s.add_argument("--text")
            s.add_argument("--filter", type=parse)
            s.add_argument("--top-k", type=int, default=0)
            s.add_argument("--n-probe", type=int, default=0)
            s.add_argument("--approx", action="store_true")
        if name == "serve":
            s.add_argument("--port", type=int, default=8080)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("brindle").getOrCreate()
    store = FileStore(f"{a.root}/objects")
    if a.command == "serve":
        from .serve import server

        server(spark, store, f"{a.root}/tables", a.port).serve_forever()
        return 0
    ns = Namespace(spark, store, f"{a.root}/tables", a.namespace)
    if a.command == "create":
        ns.create(Config(a.dim, a.metric, a.text_field))
    elif a.command == "branch":
        ns.branch(a.child)
    elif a.command == "upsert":
        ns.upsert(read_documents(spark, a.file))
    elif a.command == "index":
        print(json.dumps({"epoch": ns.index()}))
    elif a.command == "query":
        print(results_json(ns.query(a.vector, a.text, a.top_k, a.filter, a.approx, a.n_probe)))
    else:
        print(json.dumps(ns.info(), indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
