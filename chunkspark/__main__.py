"""Command line: find the best chunking strategy of a folder, or apply a saved plan to one."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators.embed import get_encoder
from .plans.config import Config, EvalConfig
from .plans.plan import Plan
from .plans.tournament import ChunkOptimizer
from .sources.documents import load_documents

log = logging.getLogger("chunkspark")


def _documents(spark: SparkSession, root: str, cache_dir: str | None = None) -> DataFrame:
    try:
        return load_documents(spark, root, cache_dir=cache_dir)
    except (FileNotFoundError, RuntimeError) as e:
        raise SystemExit(str(e)) from e


def optimize(args: argparse.Namespace, spark: SparkSession) -> None:
    config = Config(eval=EvalConfig(objective=args.objective), mode=args.mode, cache_dir=args.cache_dir)
    if args.no_proxy:
        config.proxy.enabled, config.proxy.above = False, None
    encoder = get_encoder(args.embedding_provider, args.embedding_model)
    found = ChunkOptimizer(config, encoder).optimize(_documents(spark, args.docs, args.cache_dir), candidate_names=args.candidates or None, on_progress=lambda m, k: log.info("%s: %s", k, m))
    found.plan.write(args.out)
    if args.report:
        Path(args.report).write_text(found.to_json(), encoding="utf-8")
    print(f"{found.plan.generator_pipeline['label']} -> {args.out}")


def apply(args: argparse.Namespace, spark: SparkSession) -> None:
    """Chunks as JSON for a name that ends in .json, else as a folder of Parquet files, which the executors write."""
    chunks = Plan.read(args.plan).apply(_documents(spark, args.docs))
    if args.out.endswith(".json"):
        with open(args.out, "w", encoding="utf-8") as out:
            rows = chunks.orderBy("doc_id", "chunk_index").toLocalIterator()
            out.write("[" + ",\n".join(json.dumps({"id": r.chunk_id, "doc_id": r.doc_id, "text": r.text, "meta": r.meta}, ensure_ascii=False) for r in rows) + "]")
    else:
        chunks.write.mode("overwrite").parquet(args.out)
    print(args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m chunkspark", description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    o = commands.add_parser("optimize", help="find the best strategy")
    o.add_argument("--docs", required=True, help="folder of documents")
    o.add_argument("--mode", default="light", choices=["light", "full"])
    o.add_argument("--objective", default="balanced", choices=["balanced", "quality", "cost", "latency"])
    o.add_argument("--embedding-provider", default="hashing", choices=["hashing", "local", "openai", "ollama"])
    o.add_argument("--embedding-model", default=None)
    o.add_argument("--candidates", nargs="*", help="names of strategies; all by default")
    o.add_argument("--out", default="best_plan.yaml")
    o.add_argument("--report", help="path of a JSON report")
    o.add_argument("--cache-dir", default=None, help="folder of cached texts and questions")
    o.add_argument("--no-proxy", action="store_true", help="all documents compete, not a sample")
    o.set_defaults(run=optimize)
    a = commands.add_parser("apply", help="chunk documents by a saved plan")
    a.add_argument("--plan", required=True)
    a.add_argument("--docs", required=True)
    a.add_argument("--out", default="chunks.json")
    a.set_defaults(run=apply)
    args = parser.parse_args(argv)
    args.run(args, spark or SparkSession.builder.appName("chunkspark").getOrCreate())


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main()
