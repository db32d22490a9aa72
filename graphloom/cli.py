"""Command line: build a vector collection from a folder of texts, or time a catalog query."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.plans import catalog, retrieval
from graphloom.sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="clean, chunk, embed and store the documents of a folder")
    build.add_argument("--raw_dir", default="data/raw", help="folder of the documents")
    build.add_argument("--db_dir", default="data/collection", help="folder of the collection")
    build.add_argument("--pattern", default="*.txt", help="file names to read; other formats need an extractor of their own")
    run = commands.add_parser("query", help="run a catalog query and show its first rows")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("--tables", required=True, help="folder of the Parquet tables")
    run.add_argument("--rows", type=int, default=20)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if args.command == "build":
        pages = tables.pages(tables.files(spark, args.raw_dir, args.pattern), lambda raw: [raw.decode("utf-8", "replace")])
        sinks.add_vectors(retrieval.build_collection(pages), args.db_dir)
    else:
        catalog.QUERIES[args.name](spark, args.tables).show(args.rows, truncate=80)


if __name__ == "__main__":
    main()
