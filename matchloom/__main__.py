"""Command line: ``query NAME SF_DIR`` and ``list``; ``train``, ``recommend``, ``serve``, ``publish`` and ``pull`` over a store."""

from __future__ import annotations

import argparse

from matchloom.session import build_session
from matchloom.settings import Settings


def parser() -> argparse.ArgumentParser:
    settings = Settings.from_env()
    out = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    query = sub.add_parser("query", help="run a registered query and show or write its rows")
    query.add_argument("name")
    query.add_argument("sf_dir")
    query.add_argument("--out")
    train = sub.add_parser("train", help="train over the tables targets, items and interactions of a store")
    train.add_argument("store")
    train.add_argument("--numbers", default="bpm,energy,danceability")
    train.add_argument("--dim", type=int, default=settings.embedding_dim)
    recommend = sub.add_parser("recommend", help="the trained model's best targets for requests: JSON lines, or the samples")
    recommend.add_argument("store")
    recommend.add_argument("--requests", help="a file of JSON lines, fields as in requests.SCHEMA")
    recommend.add_argument("-n", type=int, default=settings.top_n)
    recommend.add_argument("--tier")
    recommend.add_argument("--out", help="a table of the store; else rows are shown")
    serve = sub.add_parser("serve", help="answer over HTTP: POST /recommend, GET /health")
    serve.add_argument("store")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    for name in ("publish", "pull"):
        copy = sub.add_parser(name, help=f"{name} tables of a store to or from another place")
        copy.add_argument("store")
        copy.add_argument("place")
        copy.add_argument("tables", nargs="+")
        copy.add_argument("--dry-run", action="store_true")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from matchloom.plans.catalog import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return
    if args.command == "recommend" and args.n <= 0:
        parser().error("n must be above 0")
    spark = build_session()
    if args.command == "query":
        df = QUERIES[args.name](spark, args.sf_dir)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, False)
        return

    from pyspark.sql import functions as F

    from matchloom.operators import requests, rows, training
    from matchloom.operators.service import Service
    from matchloom.sources import tables

    settings, store = Settings.from_env(), tables.Store(spark, args.store)
    if args.command == "train":
        history, rejected = rows.labelled(store.read("interactions"))
        store.write("label_rejects", rejected)
        store.write_csv("label_rejects", rejected)
        _, report = training.train(store.read("targets"), store.read("items"), history, args.numbers.split(","), args.dim, settings, store=store)
        print(report["binary_metrics"], report["ranking_metrics"])
    elif args.command == "recommend":
        tier = requests.strict_tier(args.tier)
        asked = spark.read.schema(requests.SCHEMA).json(args.requests) if args.requests else requests.frame(spark, requests.samples())
        lists = {n: F.coalesce(n, F.array().cast("array<string>")) for n in requests.LISTS.split()}
        asked = asked.withColumns(lists | ({"tier": F.lit(tier)} if tier is not None else {}))
        best = Service(store, settings).recommend(asked, args.n)
        store.write(args.out, best) if args.out else best.orderBy("item_id", "rank").show(100, False)
    elif args.command == "serve":
        from matchloom.server import serve

        with serve(Service(store, settings), args.host, args.port) as server:
            server.serve_forever()
    elif args.command == "publish":
        print(tables.publish(store, args.tables, args.place, args.dry_run))
    else:
        print(tables.pull(store, args.tables, args.place) if not args.dry_run else [n for n in args.tables if not store.exists(n)])


if __name__ == "__main__":
    main()
