"""Command line: convert one file or a folder; receipts go to standard output, one line each. Exit 0, 1 (refused) or 2 (usage)."""

from __future__ import annotations

import argparse
import os
import sys

from foliant.plans.convert import convert
from foliant.selfcheck import self_check
from foliant.session import build_session
from foliant.sources.files import scan
from foliant.sources.sinks import write_files


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant", description="Documents to Markdown.")
    p.add_argument("document", nargs="?", help="a file or a folder")
    p.add_argument("--self-check", action="store_true", help="convert built-in documents twice and compare")
    p.add_argument("--out", help="folder for Markdown files, named after their sources")
    p.add_argument("--article", action="store_true", help="HTML: the article or main content only")
    p.add_argument("--no-links", action="store_true", help="HTML: no link targets")
    p.add_argument("--body-only", action="store_true", help="no metadata envelope")
    p.add_argument("--sheet", action="append", help="workbooks: this sheet only; repeatable, in this order")
    p.add_argument("--master", default="local[*]")
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.self_check:
        wrong = self_check(build_session(args.master))
        print("\n".join(wrong) or "self-check passed")
        return int(bool(wrong))
    if args.document is None or not os.path.exists(args.document):
        print(f"no such file: {args.document}", file=sys.stderr)
        return 2
    spark = build_session(args.master)
    rows = convert(scan(spark, args.document), body_only=args.body_only, article=args.article, links=not args.no_links, sheets=args.sheet)
    ok = True
    for row in rows.toLocalIterator():  # one file is written at a time
        print(row.receipt)
        ok &= bool(row.file_ok)
        if args.out and row.file_ok:
            os.makedirs(args.out, exist_ok=True)
            write_files({os.path.join(args.out, row.name + ".md"): row.markdown.encode()}, (args.document,))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
