"""python -m codelode ingest|synthesize|watch|query ..."""

from __future__ import annotations

import argparse
import json

from codelode.workspace import session, ship


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codelode")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("repo_path")
    a.add_argument("--index", required=True)
    a.add_argument("--config", action="append", default=[])
    a.add_argument("--force", action="store_true")
    a.add_argument("--no-classify", action="store_true")
    a.add_argument("--no-gitignore", action="store_true")
    a.add_argument("--repo")
    b = sub.add_parser("synthesize")
    b.add_argument("--index", required=True)
    b.add_argument("--mode", default="all", choices=("directory", "logical", "all"))
    b.add_argument("--min-files", type=int, default=3)
    b.add_argument("--resolution", type=float, default=1.5)
    b.add_argument("--max-community-size", type=int, default=20)
    b.add_argument("--hub-percentile", type=float, default=90.0)
    w = sub.add_parser("watch")
    w.add_argument("feed")
    w.add_argument("--index", required=True)
    w.add_argument("--once", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--tables", required=True)
    q.add_argument("--limit", type=int, default=50)
    args = p.parse_args(argv)
    spark = session()
    ship(spark)
    if args.command == "ingest":
        from codelode.pipeline import ingest
        from codelode.sources.repository import load_settings

        print(json.dumps(ingest(spark, args.repo_path, args.index, args.repo, load_settings(*args.config), args.force, not args.no_classify, gitignore=not args.no_gitignore)))
    elif args.command == "synthesize":
        from codelode.pipeline import synthesize

        print(json.dumps({"modules": synthesize(spark, args.index, args.mode, args.min_files, args.resolution, args.max_community_size, args.hub_percentile)}))
    elif args.command == "watch":
        from codelode.streaming.watch import Watcher

        Watcher(spark, args.index).start(args.feed, args.once).awaitTermination()
    else:
        from codelode.api import to_markdown
        from codelode.plans.registry import core

        print(to_markdown(core()[0][args.name](spark, args.tables), args.limit))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
