"""python -m quarrymill crawl STORE WEB URL, … search STORE QUERY, … stats STORE; see --help."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from .operators.jobs import LIMIT
from .plans import search
from .plans.crawl import crawl
from .sources.store import Store


def positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError("a positive whole number is wanted")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrymill")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("crawl", help="bring a store up to date with a site of a table of fetched pages")
    c.add_argument("store")
    c.add_argument("web", help="Parquet of fetched pages, with the columns of plans.crawl.WEB")
    c.add_argument("url", help="where the crawl starts")
    c.add_argument("--max-pages", type=positive)
    c.add_argument("--max-pages-per-host", type=positive)
    c.add_argument("--max-crawl-size-bytes", type=positive, default=LIMIT)
    c.add_argument("--allowed-server", action="append", default=[], help="a further host rule; may be given more than once")
    s = commands.add_parser("search", help="a search's results as JSON")
    s.add_argument("store")
    s.add_argument("query")
    commands.add_parser("stats", help="an index's size as JSON").add_argument("store")
    return p


def answer(spark, command: str, store: Store, query: str = "") -> tuple[int, dict]:
    """(status, JSON) as a web service would say: 200, 400 for a blank query, 503 without an index."""
    try:
        if command == "stats":
            return 200, search.stats(store).first().asDict()
        found = [r.asDict() for r in search.search(store, query).collect()]  # at most three pools
        return 200, {"items": found, "totalMatches": len(found)}
    except ValueError as e:
        return 400, {"error": str(e)}
    except search.IndexNotBuilt as e:
        return 503, {"error": f"no index: {e}"}


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quarrymill").getOrCreate()
    store = Store(spark, a.store)
    if a.command == "crawl":
        done = crawl(store, spark.read.parquet(a.web), a.url, datetime.now(UTC), a.max_pages, a.allowed_server, a.max_pages_per_host, a.max_crawl_size_bytes)
        print(json.dumps(vars(done)))
        return 0
    status, said = answer(spark, a.command, store, getattr(a, "query", ""))
    print(json.dumps(said, default=str))
    return 0 if status == 200 else 1


if __name__ == "__main__":
    sys.exit(main())
