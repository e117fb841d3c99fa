"""Walks a directory: a manifest file with --out, or a line of JSON for each part."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sylva.errors import SylvaError
from sylva.frames import Zstd, ZstdFormat
from sylva.operators.cut import DEFAULT_BUDGET, with_parts
from sylva.operators.tree import skip_counts, totals
from sylva.sources.filesystem import scan
from sylva.sources.manifest import write_manifest
from sylva.streaming.delivery import deliver


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sylva", description=__doc__)
    p.add_argument("dir")
    p.add_argument("--budget", type=int, default=DEFAULT_BUDGET, help="estimated bytes of JSON of a part")
    p.add_argument("-o", "--out", help="the manifest file")
    p.add_argument("--level", type=int, default=3)
    p.add_argument("--window-log", type=int, default=19)
    p.add_argument("--threads", type=int, default=2)
    p.add_argument("--metadata", choices=("full", "kinds"), default="full")
    a = p.parse_args(args)
    spark = SparkSession.builder.master(f"local[{max(1, a.threads)}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        entries, skipped = scan(spark, a.dir, metadata=a.metadata)
        parted = with_parts(entries, a.budget)
        counts = skip_counts(skipped)
        line = ""
        if a.out:
            written = write_manifest(parted, a.out, ZstdFormat(Zstd(a.level, a.window_log)), counts)
            line = f", {written.raw_length} bytes of text in {written.file_length} ({written.raw_length / max(1, written.file_length):.2f} times)"
            n = len(written.index["parts"])
        else:
            n = deliver(parted, lambda part: print(part.document))
        t, s = totals(entries).first(), counts.first()
        print(f"{t.directories} directories, {t.files} files, {t.symlinks} symlinks, {t.total_bytes} bytes, {n} parts{line}", file=sys.stderr)
        if s.total:
            print(f"skipped: {s.special} special, {s.non_utf8} not UTF-8, {s.unreadable} unreadable, {s.failed} failed", file=sys.stderr)
        return 0
    except (SylvaError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
