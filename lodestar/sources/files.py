"""Directory trees as a Spark data source.

``spark.read.format("lodestar_files").option("path", root)`` gives one row a file.  The driver lists the root's
own entries; each subdirectory is a partition that an executor walks.  Hidden files are listed, links are not
followed, ignore files are honoured as ``sources.ignore`` says, and a nested repository starts with rules
of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.functions.regex import glob_to_regex
from lodestar.session import ship_code
from lodestar.sources.ignore import ALWAYS_SKIP, Stack

SCHEMA = "root string, path string, depth int, size long, mtime_ns long, is_symlink boolean, link_target string, raw binary"


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def stack_above(root: str) -> Stack:
    """The rules that hold at a root: those of its parents up to the enclosing repository."""
    chain = [root]
    while not os.path.exists(os.path.join(chain[-1], ".git")) and os.path.dirname(chain[-1]) != chain[-1]:
        chain.append(os.path.dirname(chain[-1]))
    if not os.path.exists(os.path.join(chain[-1], ".git")):
        return Stack()
    stack = Stack()
    for parent in reversed(chain[1:]):
        # rules of a parent hold for paths below it, which are written from the root here
        texts = _texts(parent)
        up = os.path.relpath(root, parent).replace(os.sep, "/")
        stack = Stack((*stack.layers, *(("", [r._replace(pattern=_Below(r.pattern, up)) for r in rules]) for _, rules in Stack().push("", *texts).layers)))
    return stack


class _Below:
    """A parent's pattern, matched against paths that are written from a directory below it."""

    def __init__(self, pattern: re.Pattern, up: str):
        self.pattern, self.up = pattern, up

    def match(self, path: str):
        return self.pattern.match(f"{self.up}/{path}")


def _texts(folder: str) -> list[str]:
    return [t for t in (_read(os.path.join(folder, n)) for n in (".git/info/exclude", ".gitignore", ".ignore")) if t]


def walk(root: str, start: str = "", stack: Stack | None = None, globs: tuple[str, ...] = (), max_depth: int | None = None, deep: bool = True) -> Iterator[tuple[str, os.DirEntry, int]]:
    """(path, entry, depth) of the files below a directory, and with ``deep`` false of its own entries only."""
    patterns = [(re.compile(glob_to_regex(g.removeprefix("!"))), not g.startswith("!")) for g in globs]
    wanted = any(keep for _, keep in patterns)
    work = [(start, stack if stack is not None else stack_above(root))]
    while work:
        at, rules = work.pop()
        folder = os.path.join(root, at) if at else root
        if at and os.path.exists(os.path.join(folder, ".git")):
            rules = Stack()
        rules = rules.push(at, *_texts(folder))
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        depth = at.count("/") + 1 if at else 0
        for e in entries:
            path = f"{at}/{e.name}" if at else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name in ALWAYS_SKIP:
                continue
            hit = next((keep for p, keep in reversed(patterns) if p.match(path)), None)
            if hit is None and (rules.ignores(path, is_dir) or wanted and not is_dir):
                continue
            if hit is False:
                continue
            if is_dir:
                if deep and (max_depth is None or depth + 1 < max_depth):
                    work.append((path, rules))
                elif not deep:
                    yield path, e, depth
            else:
                yield path, e, depth


class _Part(InputPartition):
    def __init__(self, start: str | None, files: tuple[str, ...] = ()):
        super().__init__(start)
        self.start, self.files = start, files


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options.get("path", "."))
        self.globs = tuple(filter(None, options.get("globs", "").split("\n")))
        self.max_depth = int(options["maxdepth"]) if options.get("maxdepth") else None
        self.content = options.get("content", "true").lower() == "true"
        self.limit = int(options.get("maxbytes", 256 << 20))

    def partitions(self):
        if os.path.isfile(self.root):
            return [_Part(None, ("",))]
        dirs, files = [], []
        for path, e, _ in walk(self.root, globs=self.globs, deep=False):
            (dirs if e.is_dir(follow_symlinks=False) else files).append(path)
        deeper = [] if self.max_depth == 1 else [_Part(d) for d in dirs]
        return [_Part(None, tuple(files)), *deeper]

    def _row(self, path: str, depth: int):
        full = os.path.join(self.root, path) if path else self.root
        try:
            st = os.lstat(full)
            link = os.readlink(full) if os.path.islink(full) else None
            raw = None
            if self.content and link is None and os.path.isfile(full) and st.st_size <= self.limit:
                with open(full, "rb") as f:
                    raw = f.read()
        except OSError:
            return None
        root = self.root if path else os.path.dirname(self.root)
        return root, path or os.path.basename(self.root), depth, st.st_size, st.st_mtime_ns, link is not None, link, raw

    def read(self, part):
        if part.start is None:
            rows = (self._row(p, 0) for p in part.files)
        else:
            root_rules = stack_above(self.root).push("", *_texts(self.root))
            rows = (self._row(p, d) for p, _, d in walk(self.root, part.start, root_rules, self.globs, self.max_depth))
        return (r for r in rows if r is not None)


class Files(DataSource):
    """Files of a directory tree; options ``path``, ``globs`` (one a line), ``maxDepth``, ``content``, ``maxBytes``."""

    @classmethod
    def name(cls):
        return "lodestar_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FilesReader({k.lower(): v for k, v in self.options.items()})


def read_files(spark: SparkSession, *roots: str, globs: list[str] | None = None, max_depth: int | None = None, content: bool = True, max_bytes: int = 256 << 20) -> DataFrame:
    """The files of several roots, one row for each root that a file is under; contents only where asked for, and of files of
    at most ``max_bytes``."""
    ship_code(spark)
    spark.dataSource.register(Files)
    out = None
    for root in roots:
        r = spark.read.format("lodestar_files").option("path", root).option("globs", "\n".join(globs or ())).option("content", str(content).lower()).option("maxBytes", str(max_bytes))
        df = (r.option("maxDepth", str(max_depth)) if max_depth else r).load()
        out = df if out is None else out.unionByName(df)
    return out


def list_files(files: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The first paths in byte order, and whether there are more."""
    few = files.orderBy("path").limit(limit + 1)
    return few.limit(limit), few.count() > limit
