"""The map of a tree: totals by directory, extensions, and which directories are worth opening."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.tokens import MAP_BUDGET, budget_bytes, enforce, estimate_python

# How much of a directory is listed, and which names weigh less.
MAX_FILES, MAX_ROOT_FILES, MAX_DIRS, NAMES_SHOWN, MAX_LISTED = 14, 80, 24, 160, 400_000
FAR_NAMES = "vendor third_party third-party external deps pods carthage coverage".split()
SIDE_NAMES = "test tests __tests__ spec specs fixtures testdata test-data e2e benches examples samples docs doc".split()


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root (the empty path) down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def directories(files: DataFrame) -> DataFrame:
    """(dir, depth, files, bytes): totals of every directory, bottom up.  Counts are partial before the shuffle, so the
    root's row costs one row a task."""
    rows = files.select(F.explode(ancestors(F.col("path"))).alias("dir"), "size")
    out = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return out.select("dir", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))).alias("depth"), "files", "bytes")


def penalty(name: Column) -> Column:
    """How far from ordinary sources a directory is, by its name."""
    n = F.lower(name)
    return F.when(F.startswith(n, F.lit(".")) | n.isin(FAR_NAMES), 3).when(n.isin(SIDE_NAMES), 2).otherwise(0)


def importance(dirs: DataFrame) -> DataFrame:
    """``dirs`` with ``score``: files, a quarter for each level down, an eighth for each step of penalty; ordinary
    directories of the top level first."""
    pen = penalty(F.substring_index("dir", "/", -1))
    depth = F.greatest(F.col("depth"), F.lit(1))
    v = F.col("files") / F.pow(F.lit(4.0), depth - 1) / F.pow(F.lit(8.0), pen)
    v = F.when((F.col("depth") == 1) & (pen == 0), v * 1000).otherwise(v)
    return dirs.withColumn("score", F.floor(v * 1000).cast("long"))


def extensions(files: DataFrame, top: int) -> DataFrame:
    """(ext, files): the commonest extensions, dot files and names without a dot counted under the empty one."""
    name = F.substring_index("path", "/", -1)
    ext = F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, F.substring_index(name, ".", -1)).otherwise("")
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext").limit(top)


def visible(dirs: DataFrame) -> DataFrame:
    """The directories shown in their parent's listing: the ``MAX_DIRS`` with most files."""
    rows = dirs.where("dir <> ''").withColumn("parent", F.when(F.instr("dir", "/") > 0, F.regexp_replace("dir", "/[^/]*$", "")).otherwise(""))
    w = W.partitionBy("parent").orderBy(F.desc("files"), "dir")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MAX_DIRS).drop("rn")


def file_notes(files: DataFrame, sources: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(path, size, n_lines, link_target, names): what is said of a file; top-level names if symbols are given."""
    out = files.select("path", "size", "link_target").join(sources.select("path", "n_lines"), "path", "left")
    if symbols is None:
        return out.withColumn("names", F.lit(None).cast("string"))
    top = symbols.where("parent is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "name"))).alias("tops"))
    names = F.array_join(F.transform("tops", lambda t: t["name"]), ", ")
    return out.join(top.select("path", F.left(names, F.lit(NAMES_SHOWN)).alias("names")), "path", "left")


def records(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, bytes, lines, symlink): one record a file, for JSON Lines."""
    rows = files.join(sources.select("path", "n_lines", "binary", F.col("bytes").alias("_b")), "path", "left")
    lines = F.when(F.col("is_symlink") | F.col("binary") | (F.col("size") > 8 << 20), None).otherwise(F.col("n_lines"))
    return rows.select("path", F.when(~F.col("is_symlink"), F.col("size")).alias("bytes"), lines.alias("lines"), F.col("link_target").alias("symlink"))


def render_map(dirs: DataFrame, files: DataFrame, budget: int = MAP_BUDGET, depth: int | None = None, names: dict[str, str] | None = None) -> str:
    """The map as text: directories opened by importance while their listings fit the budget.

    The tables are aggregates of a tree; what is collected is bounded by ``MAX_LISTED`` files.
    """
    total = {r.dir: r for r in importance(dirs).collect()}
    own: dict[str, list] = defaultdict(list)
    for r in files.select("path", "size").orderBy("path").limit(MAX_LISTED).collect():
        own[r.path.rpartition("/")[0]].append(r)
    shown: dict[str, list[str]] = defaultdict(list)
    for r in visible(dirs).select("dir", "parent").orderBy("dir").collect():
        shown[r.parent].append(r.dir)
    children = Counter(d.rpartition("/")[0] for d in total if d)

    def chain(d: str) -> str:
        while len(shown[d]) == 1 and not own[d]:
            d = shown[d][0]
        return d

    def listing(d: str) -> list[str]:
        pad = "  " * (d.count("/") + 1 if d else 0)
        few = own[d][: MAX_FILES if d else MAX_ROOT_FILES]
        out = [f"{pad}{r.path.rpartition('/')[2]} {r['size']}B" + (f" {names[r.path]}" if names and r.path in names else "") for r in few]
        rest = own[d][len(few) :]
        if rest:
            exts = Counter(("." + n.rpartition(".")[2]) if "." in n[1:] else "(no ext)" for n in (r.path.rpartition("/")[2] for r in rest))
            out.append(f"{pad}⋯ {len(rest)} more: " + ", ".join(f"{e} {c}" for e, c in sorted(exts.items(), key=lambda x: (-x[1], x[0]))[:4]))
        if children[d] > len(shown[d]):
            out.append(f"{pad}⋯ {children[d] - len(shown[d])} more directories")
        return out

    most = budget_bytes(budget)
    root = total.get("")
    head = f"{root.files if root else 0} files, {root.bytes if root else 0} bytes"
    for _ in range(4):
        opened, used = {""}, len(head) + sum(map(len, listing("")))
        heap = [(-total[d].score, d) for d in shown[""]]
        heapq.heapify(heap)
        while heap:
            d = chain(heapq.heappop(heap)[1])
            if depth is not None and d.count("/") + 1 >= depth:
                continue
            cost = sum(len(x) + 1 for x in listing(d)) + sum(len(x) + 20 for x in shown[d])
            if used + cost > most:
                continue
            used += cost
            opened.add(d)
            for c in shown[d]:
                heapq.heappush(heap, (-total[c].score, c))
        lines, work = [head], [("", "")]
        while work:
            d, label = work.pop()
            if label:
                lines.append(label)
            if d in opened:
                nested = [(chain(c), "  " * c.count("/") + f"{chain(c).removeprefix(d + '/' if d else '')}/ ({total[c].files} files)") for c in shown[d]]
                lines += listing(d)
                work += reversed(nested)
        out = "\n".join(lines)
        if estimate_python(out) <= budget or most < 1024:
            break
        most = int(most * budget / estimate_python(out) * 0.97)
    return enforce(out, budget)
