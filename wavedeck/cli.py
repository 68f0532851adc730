"""python -m wavedeck.cli [--db PATH] COMMAND: the directory's questions on the command line.

The directory is --db, else $WAVEDECK_DB, else the first there is of ~/.local/share/wavedeck, ~/Library/Application
Support/wavedeck and ./HAMCALL. Exit codes: 0 found, 1 not found or failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .directory import Directory

#: Commands and the number of their arguments: some, one or none.
COMMANDS = {
    "lookup": "+", "country": "+", "count": "+", "profile": "+", "map": "+", "assets": "+", "trace-lookup": "+", "interest": 1, "hci-dump": 1, "stats": 0, "tags": 0, "interests": 0, "sidecars": 0, "sidecar-stats": 0, "verify": 0,
    "verify-inverted": 0, "postings": 0, "hci-posting-invariant": 0, "tally": 0,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavedeck")
    p.add_argument("--db")
    p.add_argument("--json", action="store_true", help="one JSON document a row")
    p.add_argument("--raw", action="store_true", help="lookup, hci-dump: the decoded bytes")
    p.add_argument("--limit", type=int, default=160, help="bytes of a preview")
    p.add_argument("--interests", action="store_true", help="stats: those of interest codes too")
    p.add_argument("--tags", action="store_true", help="stats: those of tags too")
    p.add_argument("--unknown-samples", type=int, default=0, help="stats: so many unknown codes")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in COMMANDS.items():
        sub.add_parser(name).add_argument("args", nargs=words if words else "*")
    return p


def database(flag: str | None) -> str | None:
    if flag or os.environ.get("WAVEDECK_DB"):
        return flag or os.environ["WAVEDECK_DB"]
    places = [Path.home() / ".local/share/wavedeck", Path.home() / "Library/Application Support/wavedeck", Path("HAMCALL")]
    return next((str(p) for p in places if p.is_dir()), None)


def answers(d: Directory, args: argparse.Namespace) -> list[DataFrame]:
    """What a command prints."""
    one = {
        "country": lambda: d.country_info(args.args), "count": lambda: d.lookup_count(args.args), "profile": lambda: d.profile(args.args), "map": lambda: d.map_svg(args.args), "assets": lambda: d.assets(args.args).orderBy("call", "seq"),
        "trace-lookup": lambda: d.trace(args.args), "interest": lambda: d.search_interest(args.args[0]), "tags": d.tag_statistics, "interests": d.interest_statistics, "sidecars": d.sidecar_files, "verify": d.verify_index,
        "verify-inverted": d.verify_inverted, "postings": d.posting_statistics, "hci-posting-invariant": lambda: d.posting_invariant()[0], "tally": d.tally, "hci-dump": lambda: d.inverted_entry(int(args.args[0]), args.limit),
    }
    if args.command == "lookup":
        return [d.raw_records(args.args)] if args.raw else [d.lookup(args.args)]
    if args.command == "sidecar-stats":
        return [d.layer_statistics(), d.manifest_diagnostics(), d.catalog_sizes()]
    if args.command == "stats":
        found = [d.stats(), d.record_statistics()]
        found += [d.interest_statistics()] if args.interests else []
        found += [d.tag_statistics()] if args.tags else []
        return found + ([d.unknown_codes().orderBy("code").limit(args.unknown_samples)] if args.unknown_samples else [])
    return [one[args.command]()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    path = database(args.db)
    if not path:
        print("no directory: give --db or set WAVEDECK_DB", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        found = answers(Directory(spark, path), args)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    n = 0
    for df in found:
        if args.raw and "raw" in df.columns and not args.json:
            for r in df.select("raw").toLocalIterator():
                sys.stdout.buffer.write(bytes(r.raw))
                n += 1
            continue
        rows = df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator() if args.json else df.toLocalIterator()
        for r in rows:
            n += 1
            print(r.j if args.json else "  ".join("" if v is None else str(v) for v in r))
    if args.command == "lookup" and not args.raw:
        return 0 if found[0].where("status <> 'not_found'").limit(1).count() else 1
    return 0 if n or args.command not in ("assets", "hci-dump", "lookup") else 1


if __name__ == "__main__":
    sys.exit(main())
