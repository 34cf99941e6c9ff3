"""Command line: ``python -m lodestar.cli {read,search,map,trace,symbols} ...`` over directories."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.corpus import Corpus
from lodestar.functions.regex import PatternError, no_match_advice
from lodestar.operators import rollup, search


def emit(df: DataFrame, out=sys.stdout) -> None:
    """Rows as JSON Lines, in their order; a reader that goes away ends it."""
    try:
        for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            print(row.j, file=out)
    except BrokenPipeError:
        pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    p.add_argument("--root", action="append", default=[])
    p.add_argument("--budget", type=int)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("read")
    r.add_argument("targets", nargs="+")
    r.add_argument("--mode", choices=("auto", "full", "skeleton", "outline"), default="auto")
    r.add_argument("--no-line-numbers", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("pattern")
    s.add_argument("paths", nargs="*")
    s.add_argument("--glob", action="append", default=[])
    s.add_argument("--literal", action="store_true")
    s.add_argument("--word", action="store_true")
    s.add_argument("--case", choices=("smart", "sensitive", "insensitive"), default="smart")
    s.add_argument("--context", type=int, default=0)
    s.add_argument("--output", choices=("matches", "symbols", "files"), default="matches")
    m = sub.add_parser("map")
    m.add_argument("path", nargs="?")
    m.add_argument("--depth", type=int)
    m.add_argument("--json", action="store_true")
    t = sub.add_parser("trace")
    t.add_argument("target")
    t.add_argument("--direction", default="callers")
    t.add_argument("--depth", type=int, default=1)
    y = sub.add_parser("symbols")
    y.add_argument("globs", nargs="*")
    y.add_argument("--json", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    globs = getattr(a, "glob", None) or (a.globs if a.command == "symbols" else None)
    corpus = Corpus.from_path(spark, *(a.root or ["."]), globs=globs or None)
    if a.command == "read":
        print(corpus.read(a.targets, mode=a.mode, budget=a.budget, line_numbers=not a.no_line_numbers), file=out)
    elif a.command == "search":
        try:
            rows = corpus.search(a.pattern, a.output, a.context, literal=a.literal, word=a.word, case=a.case, paths=a.paths or None)
        except PatternError as e:
            print(e, file=sys.stderr)
            return 2
        rows = rows.orderBy("path", *(["line"] if "line" in rows.columns else [])).limit(search.MAX_RECORDS)
        if rows.isEmpty():
            print(no_match_advice(a.pattern, a.literal, a.case), file=sys.stderr)
            return 1
        emit(rows, out)
    elif a.command == "map":
        files = corpus.files if not a.path else corpus.files.where(F.startswith("path", F.lit(a.path.rstrip("/") + "/")))
        if a.json:
            emit(rollup.records(files, corpus.sources).orderBy("path"), out)
        else:
            print(rollup.render_map(rollup.directories(files), files, a.budget or rollup.MAP_BUDGET, a.depth), file=out)
    elif a.command == "trace":
        emit(corpus.trace(a.target, a.direction, a.depth), out)
    else:
        rows = corpus.symbols.orderBy("path", "idx")
        fields = ("path", "name", "qualified", "kind", "start", "end", "def", "depth", "signature")
        if a.json:
            emit(rows.select(*fields), out)
        else:
            for r in rows.select("path", "start", "end", "kind", "qualified").toLocalIterator():
                print("\t".join(map(str, r)), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
