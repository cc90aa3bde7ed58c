"""python -m postlode: checks, builds, syncs and searches an index.

The store is a folder with versions (V10, V11, ...), each with a database and message files.
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import tempfile
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArchiveError
from .functions import match
from .functions.match import MatchSyntaxError
from .operators import fulltext, ingest
from .operators.search import newest
from .settings import Settings
from .sources import mime, store
from .sources.index import Index


def search(index: Index, query: str, limit: int) -> DataFrame:
    """date_received, subject, sender, account, boxes (all mailboxes, joined) of the newest matches; a query that doesn't parse fails."""
    match.parsed(query, fulltext.TEXT)  # no second reading of a bad query here
    ids, _ = index.find(query)
    hits = newest(index.messages().join(ids.withColumnRenamed("id", "__i"), F.col("id") == F.col("__i"), "left_semi"), limit, 10**6)
    hits = hits.select("id", "date_received", "subject", "sender", "account")
    few = F.broadcast(hits.select(F.col("id").alias("__h")))  # at most ``limit``
    boxes = index.locations().select(F.col("message").alias("id"), "mailbox").join(few, F.col("id") == F.col("__h"), "left_semi")
    return hits.join(boxes.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("mailbox")), ", ").alias("boxes")), "id", "left")


def _show(index: Index, query: str, limit: int) -> int:
    """One line a match: day, account, subject, sender, mailboxes."""
    for r in search(index, query, limit).orderBy(F.desc("date_received"), F.desc("id")).collect():
        day = datetime.fromtimestamp(r["date_received"]).strftime("%Y-%m-%d") if r["date_received"] else "-"
        print(" | ".join([day, r["account"] or "", r["subject"] or "", r["sender"] or "", r["boxes"] or ""]))
    return 0


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    index = Index(spark, args.index)
    if args.search:
        return _show(index, args.search, args.limit)
    try:
        root = store.find_store(args.store)
    except (PermissionError, FileNotFoundError) as e:
        print(e)
        return 1
    databases = sorted(glob.glob(os.path.join(root, "**", "*.db"), recursive=True))
    if not databases:
        print(f"no database under {root}")
        return 1
    with tempfile.TemporaryDirectory(dir=args.workspace) as workspace:
        tables = store.open_store(spark, store.snapshot(databases[0], workspace))
        files = mime.scan_store(spark, root)
        if args.check or args.build:
            report = ingest.checks(tables, files, mime.parse_files)
            for r in report.collect():
                print(f"{'ok  ' if r['passed'] else 'FAIL'} {r['check']}: {r['detail']}")
            passed = report.where("not passed").isEmpty()
            if args.check:
                return 0 if passed else 1
            if not passed and not args.force:
                print("Not built. --force builds all the same.")
                return 1
        parse = partial(mime.parse_files, folder=root)
        if args.build:
            index.build(*ingest.built(tables, files, parse))
        else:
            done = ingest.sync_index(index, tables, files, parse)
            print(f"added {done['added']}, removed {done['removed']}")
    print(f"index: {args.index}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    settings = Settings()
    p = argparse.ArgumentParser(prog="postlode", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = p.add_mutually_exclusive_group(required=True)
    for name, said in (("check", "check the store and stop"), ("build", "build the index"), ("sync", "bring the index up to date")):
        what.add_argument(f"--{name}", action="store_true", help=said)
    what.add_argument("--search", help="a query for the index")
    p.add_argument("--force", help="build whatever the checks say", action="store_true")
    p.add_argument("--limit", help="matches that a search shows", default=20, type=int)
    p.add_argument("--index", help="folder of the index", default=settings.get("index_path"))
    p.add_argument("--store", help="folder of the store", default=settings.get("store_root"))
    p.add_argument("--workspace", help="a folder that all workers see, for the copy of the database")
    args = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("postlode").getOrCreate()
    try:
        return run(spark, args)
    except (ArchiveError, MatchSyntaxError) as e:
        print(e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
