"""Command line: plan, build and search an index."""

from __future__ import annotations

import argparse
import hashlib
import json
import os

from pyspark.sql import SparkSession

from .plans import index
from .plans.render import hits_as_json, hits_as_text


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="srcquarry")
    sub = p.add_subparsers(dest="action", required=True)
    for name in ("plan", "build", "query"):
        s = sub.add_parser(name)
        s.add_argument("--repo", required=True)
        s.add_argument("--db")
        s.add_argument("--tokenizer", help="tokenizer file; tokens are characters without it")
        if name == "build":
            s.add_argument("--full", action="store_true")
        if name == "query":
            s.add_argument("--query", required=True)
            s.add_argument("--top-k", type=int, default=5)
            s.add_argument("--file")
            s.add_argument("--format", choices=["text", "json"], default="text")
    a = p.parse_args(argv)
    repo = os.path.abspath(a.repo)
    identity = f"{os.path.basename(repo) or 'root'}-{hashlib.sha256(repo.encode()).hexdigest()[:16]}"
    spark = SparkSession.builder.appName("srcquarry").getOrCreate()
    db = a.db or default_db(spark, identity)
    if a.action == "plan":
        out = index.plan(spark, repo, db)
        files = out.pop("changed_files")
        print(json.dumps(out, indent=2, ensure_ascii=False))
        for r in files.orderBy("relative_path").toLocalIterator():
            print(r["change"], r["relative_path"])
    elif a.action == "build":
        print(json.dumps(index.build(spark, repo, db, full=a.full, tokenizer=a.tokenizer), indent=2, ensure_ascii=False))
    else:
        hits = index.query(spark, db, a.query, k=a.top_k, path=a.file, repo=repo, tokenizer=a.tokenizer)
        print(hits_as_json(hits) if a.format == "json" else hits_as_text(hits, a.query))
    return 0


def default_db(spark: SparkSession, identity: str) -> str:
    """A folder of the index in the home folder; on a cluster, where executors write it, a shared one must be named."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a shared folder for the index with --db")
    return os.path.join(os.path.expanduser("~"), ".srcquarry", identity)


if __name__ == "__main__":
    raise SystemExit(main())
