"""Command line: init, check, ingest, query, inspect, delete, eval."""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loam.operators import evaluate
from loam.plans import config as cfg
from loam.plans.pipeline import Pipeline
from loam.sources import datasets


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loam")
    top.add_argument("--config")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("path")
    sub.add_parser("check")
    ingest = sub.add_parser("ingest")
    ingest.add_argument("collection")
    ingest.add_argument("paths", nargs="+")
    ingest.add_argument("--dry-run", action="store_true")
    ingest.add_argument("--limit", type=int)
    ingest.add_argument("--force", action="store_true")
    query = sub.add_parser("query")
    query.add_argument("collection")
    query.add_argument("text")
    query.add_argument("--where")
    query.add_argument("--no-route", action="store_true")
    query.add_argument("--prompt", action="store_true", help="print the passages as a model is shown them")
    inspect = sub.add_parser("inspect")
    inspect.add_argument("collection")
    inspect.add_argument("--quarantined", action="store_true")
    delete = sub.add_parser("delete")
    delete.add_argument("collection")
    delete.add_argument("doc_id")
    ev = sub.add_parser("eval")
    ev.add_argument("dataset")
    ev.add_argument("recording")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        with open(args.path, "x", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(cfg.Config()), f, indent=1)
        return 0
    spark = spark or SparkSession.builder.appName("loam").getOrCreate()
    pipeline = Pipeline(spark, cfg.load(args.config))
    if args.command == "check":
        print(json.dumps({"spark": spark.version, "embedder": pipeline.config.embedder, "dim": pipeline.dim}))
    elif args.command == "ingest":
        pipeline.ingest(args.paths, args.collection, args.dry_run, args.limit, args.force).orderBy("doc_id").show(50, truncate=60)
    elif args.command == "query":
        asked = spark.createDataFrame([("q", args.text)], "query_id string, text string")
        results = pipeline.retrieve(asked, args.collection, json.loads(args.where) if args.where else None, route=not args.no_route)
        if args.prompt:
            print(pipeline.prompts(results, args.collection).first()["prompt"])
            return 0
        print(results.toJSON().first())
    elif args.command == "inspect":
        rows = pipeline.collection(args.collection).read()
        rows = rows.filter("quarantined") if args.quarantined else rows
        rows.orderBy("doc_id", "chunk_index").select("doc_id", "chunk_index", "tokens", "quarantined", F.left("text", F.lit(60)).alias("text")).show(50, truncate=False)
    elif args.command == "delete":
        pipeline.delete_document(args.collection, args.doc_id)
    elif args.command == "eval":
        data = datasets.load(spark, args.dataset)
        rows = datasets.candidate_rows(datasets.recording(spark, args.recording))
        units = rows.select("query_id", "rank", F.explode(F.map_keys("units")).alias("unit"))
        scored = evaluate.query_metrics(units, data.qrels)
        scored.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "any_hit", "hit_at_1", "mrr", "ndcg")]).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
