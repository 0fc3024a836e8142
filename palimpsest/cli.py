"""Command line: python -m palimpsest.cli [options] image|-|folder ..."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import palimpsest
from palimpsest import api
from palimpsest.plans.numbering import numbered
from palimpsest.plans.storage import kept
from palimpsest.sources import files, sinks
from palimpsest.spec import SPECS, spec_named


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description="Find and handle duplicate images.")
    p.add_argument("targets", nargs="*", help="image, folder, or - for a list on the standard input")
    for names, text in ((("-output", "-o", "--output"), "print results only"), (("-quiet", "-q", "--quiet"), "print nothing"), (("-recursive", "-r", "--recursive"), "look into folders of folders"), (("-verbose", "-v", "--verbose"), "log more"), (("-version", "--version"), "print the version"), (("-delete", "-d", "--delete"), "delete all but the first of each group"), (("-delete-all", "--delete-all"), "with -delete: delete the first too"), (("-search", "--search"), "search among the files even if the first is an image")):
        p.add_argument(*names, action="store_true", help=text)
    p.add_argument("-move", "-m", "--move", metavar="DIR", default="")
    p.add_argument("-copy", "-c", "--copy", metavar="DIR", default="", help="hard links in folders of groups")
    p.add_argument("-threshold", "--threshold", type=int, default=0)
    p.add_argument("-hash", "--hash", default="dct", help=", ".join(sorted(SPECS)))
    return p


def run(argv: list[str], spark: SparkSession | None = None, stdin=sys.stdin, out=sys.stdout) -> int:
    """0, or 1 after errors."""
    args = parser().parse_args(argv)
    if args.version:
        print(f"v{palimpsest.__version__}" if palimpsest.__version__ else f"{palimpsest.BRANCH}-{palimpsest.COMMIT}", file=out)
        return 0
    if not args.targets:
        print("error: no arguments provided", file=sys.stderr)
        return 1
    targets = [w for line in stdin for w in line.rstrip("\n").split(" ")] if "-" in args.targets else args.targets
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    spec = spec_named(args.hash).with_threshold(args.threshold)
    first_image = files.image_or_dir(targets[0])[1] if targets else False
    against = first_image and not args.search
    found = files.expand(targets, args.recursive)
    if len(found) <= 1:
        print("error: not enough images provided", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    if against:
        matches, errors = api.compare(spark, spec, found[0], found[1:])
        members = numbered(matches.select(F.lit(0).alias("group_id"), (-F.col("dist")).alias("near"), "id", "path"), ["near", "id"], "ord")
    else:
        members, errors = api.duplicates(spark, spec, found)
    members = kept(members.select("group_id", "ord", "path"), "members")
    gathered = members.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("ord", "path"))).alias("m")).select("group_id", F.transform("m", lambda x: x["path"]).alias("paths"))
    if not args.quiet:
        if not args.output:
            print(sinks.summary(members.count(), found[0] if against else None), file=out)
        for r in sinks.csv_rows(gathered).orderBy("group_id").toLocalIterator():
            print(r["value"], file=out)
    problems: list[object] = [r["error"] for r in errors.toLocalIterator()]
    if args.move or args.copy:
        act, folder = (sinks.move_files, args.move) if args.move else (sinks.link_files, args.copy)
        for r in gathered.orderBy("group_id").toLocalIterator():
            problems += act(r["paths"], f"{folder}/group{r['group_id']}")
    elif args.delete:
        problems += sinks.delete_files(r["path"] for r in sinks.delete_plan(members, args.delete_all).orderBy("path").toLocalIterator())
    for x in problems:
        print(f"error: {x}", file=sys.stderr)
    return 1 if problems else 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
