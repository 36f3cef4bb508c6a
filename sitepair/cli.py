"""Command line: extract, verify, slugs, thumbs, probe-orphans, fetch-orphans. Exit codes: 0 clean, 1 warnings, 2 errors or misuse, 130 cancelled."""

from __future__ import annotations

import argparse
import os
import sys

from .sources.config import ConfigError
from .sources.files import lines, write_text

#: Lines shown of each kind.
SHOWN = 20


def _years(text: str) -> tuple[int, int]:
    first, _, last = text.partition("-")
    years = int(first), int(last or first)
    if years[0] > years[1]:
        raise ValueError(text)
    return years


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("sitepair")
    parser.add_argument("--version", action="version", version="0.1.0")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("extract")
    p.add_argument("config")
    p.add_argument("--root", default=".")
    for name in ("raw", "media", "out"):
        p.add_argument(f"--{name}")
    p.add_argument("--dry-run", action="store_true")
    p = commands.add_parser("verify")
    p.add_argument("out")
    p.add_argument("--media")
    p.add_argument("--media-prefix", default="/media/")
    p.add_argument("--allow-unlinked")
    p = commands.add_parser("slugs")
    p.add_argument("config")
    p.add_argument("--section", required=True)
    p.add_argument("--lang")
    p.add_argument("--raw", default="raw")
    for name, options in (("thumbs", ("--media", "--out")), ("probe-orphans", ("--lang", "--out")), ("fetch-orphans", ("--slugs",))):
        p = commands.add_parser(name)
        p.add_argument("config")
        p.add_argument("--root", default=".")
        for option in options:
            p.add_argument(option)
        if name != "thumbs":
            p.add_argument("--section", required=True)
    commands.choices["probe-orphans"].add_argument("--years", required=True, type=_years)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.engine import SiteEngine
    from .sources.config import SiteConfig

    try:
        spark = SparkSession.builder.appName("sitepair").getOrCreate()
        if args.command == "extract":
            engine = SiteEngine.from_file(spark, args.config)
            report = engine.extract(args.raw or f"{args.root}/raw", args.media or f"{args.root}/media", args.out or args.root, args.dry_run)
            print(report)
            return report.exit_code
        if args.command == "verify":
            allow = lines(open(args.allow_unlinked, encoding="utf-8").read()) if args.allow_unlinked else []
            report = SiteEngine(spark, SiteConfig()).verify(args.out, args.media, args.media_prefix, allow)
            counts = {r[0]: r[1] for r in report.groupBy("severity").count().collect()}
            for severity in ("error", "warning"):
                for r in report.where(report.severity == severity).limit(SHOWN).collect():
                    print(*r, sep="\t")
            print(f"{counts.get('error', 0)} errors, {counts.get('warning', 0)} warnings")
            return 2 if counts.get("error") else 1 if counts else 0
        if args.command == "thumbs":
            media = args.media or f"{args.root}/media"
            if not os.path.isdir(media):
                raise OSError(f"no media folder {media}")
            _, made = SiteEngine.from_file(spark, args.config).thumbnails(media, args.out or f"{args.root}/media_thumb")
            rows = made.groupBy(made.error.isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.slice(F.collect_set(F.concat_ws(": ", "media", "error")), 1, SHOWN).alias("shown")).collect()
            for r in rows:
                print(*(r.shown if r.failed else []), f"{r.n} {'failed' if r.failed else 'created'}", sep="\n")
            return int(any(r.failed for r in rows))
        if args.command == "probe-orphans":
            found = SiteEngine.from_file(spark, args.config).probe_orphans(f"{args.root}/raw", args.section, args.years, args.lang, say=print)
            write_text(args.out or f"{args.root}/orphan_slugs.txt", "\n".join(found))
            print(f"{len(found)} found")
            return 0
        if args.command == "fetch-orphans":
            with open(args.slugs or f"{args.root}/orphan_slugs.txt", encoding="utf-8") as f:
                wanted = [x.strip() for x in f if x.strip()]
            done = SiteEngine.from_file(spark, args.config).fetch_orphans(f"{args.root}/raw", f"{args.root}/media", args.section, wanted, say=print)
            print(*done["errors"][:SHOWN], *(f"{k} {v}" for k, v in done.items() if k != "errors"), sep="\n")
            return int(bool(done["errors"]))
        slugs = SiteEngine.from_file(spark, args.config).mirror_slugs(args.raw, args.section, args.lang)
        if slugs is None:
            print(f"no section {args.section!r}", file=sys.stderr)
            return 2
        print("\n".join(slugs))
        print(f"{len(slugs)} slugs", file=sys.stderr)
        return 0
    except KeyboardInterrupt:  # a second one ends the process while jobs are being cancelled
        SparkSession.getActiveSession() and SparkSession.getActiveSession().sparkContext.cancelAllJobs()
        return 130
    except (ConfigError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
