"""Command line: ingest, stats, search, merge, export."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from loomgraph.operators import extract, graph, search
from loomgraph.plans import config, ingest
from loomgraph.sources import files, graphs, model


def _graph(spark: SparkSession, path: str):
    return graphs.read_json(spark, path) if os.path.isfile(path) else graphs.read_tables(spark, path)


def _names(flag: str) -> list[str]:
    short, _, name = flag.rpartition(":")
    return [f"-{short}"] * bool(short) + [f"--{name}"]


def _agreed(estimate: dict) -> bool:
    """Whether the cost is accepted; an end of input is a no."""
    try:
        answer = input(f"{_told(estimate)}\nProceed? [Y/n] ")
    except EOFError:
        return False
    return not answer or answer.lower().startswith("y")


def _told(estimate: dict) -> str:
    return f"chunks {estimate['chunks']}, input tokens {estimate['input_tokens']}, estimated cost ${estimate['estimated_cost']:.4f}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("loomgraph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("ingest")
    run.add_argument("sources", nargs="*")
    for flag in ("p:provider", "m:model", "k:api-key", "o:output", "base-url", "max-concurrent", "chunk-size"):
        run.add_argument(*_names(flag))
    for flag in ("y:yes", "v:verbose", "dry-run", "stdin", "rules"):
        run.add_argument(*_names(flag), action="store_true")
    commands.add_parser("stats").add_argument("graph")
    find = commands.add_parser("search")
    find.add_argument("graph")
    find.add_argument("query", nargs="+")
    both = commands.add_parser("merge")
    both.add_argument("a")
    both.add_argument("b")
    both.add_argument("--output", default="merged.json")
    out = commands.add_parser("export")
    out.add_argument("graph")
    out.add_argument("--dot")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, unknown = parser().parse_known_args(argv)
    if args.command == "ingest":  # unknown flags are ignored, words after them are sources
        args.sources += [word for word in unknown if not word.startswith("-")]
    spark = spark or SparkSession.builder.appName("loomgraph").getOrCreate()
    if args.command == "ingest":
        settings = config.resolve(vars(args))
        call = None if args.rules else model.chat(settings.base_url, settings.api_key, settings.model)
        extractor = extract.RuleExtractor() if args.rules else extract.ModelExtractor(call, concurrent=settings.max_concurrent)
        text = files.from_stdin(spark).first()["content"] if args.stdin or not args.sources else None
        asked = None if settings.yes or settings.dry_run or args.rules or text is not None else _agreed
        done = ingest.ingest(spark, args.sources, extractor, settings.output, settings.chunk_size, settings.model, settings.dry_run, call, text, proceed=asked)
        if asked is None:
            print(_told(done.estimate))
        for source, reason in done.failed_sources:
            print(f"skipped {source}: {reason}", file=sys.stderr)
        if done.kept or done.cut:
            print(f"kept {done.kept}, cut {done.cut} noise nodes; nodes {done.nodes.count()}, edges {done.edges.count()}; failed chunks {done.failed_chunks}")
    elif args.command == "stats":
        for row in graph.stats(*_graph(spark, args.graph)).orderBy("what", "count", ascending=[False, False]).toLocalIterator():
            print(f"{row['what']:5} {row['type']:15} {row['count']}")
    elif args.command == "search":
        for row in search.top(_graph(spark, args.graph)[0], " ".join(args.query)).collect():
            print(f"[{row['score']:.2f}] {row['type']}: {row['label']}" + (f"  aka {row['aka']}" if row["aka"] else ""))
    elif args.command == "merge":
        print("nodes %d, edges %d" % graphs.write_json(*graph.merge(_graph(spark, args.a), _graph(spark, args.b)), args.output))
    elif args.dot:
        graphs.write_dot(*_graph(spark, args.graph), args.dot)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
