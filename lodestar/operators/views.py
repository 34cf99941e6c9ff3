"""Views of texts under a budget: whole, skeleton, compact skeleton, outline; and the batched read of targets."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.regex import glob_filter, is_glob
from lodestar.functions.tokens import DEFAULT_BUDGET, PROFILES, Profile, clamp_budget, enforce, estimate_python
from lodestar.operators import block, lookup
from lodestar.operators.budget import degrade, fair_shares

# Clips of a shown line, least runs that fold, most lines around a symbol and in a window, names shown.
LINE_AUTO, LINE_FULL, COMMENT_RUN, IMPORT_RUN, AROUND_SYMBOL, WINDOW, GLOB_FILES, FILE_SYMBOLS, WORKSPACE_SYMBOLS = 2000, 8000, 3, 4, 400, 40, 200, 8, 5
#: Lines shown of the beginning and the end of a text too large for a row.
HEAD_LINES, TAIL_LINES = 200, 100
HASH_COMMENTS = ("python", "ruby", "bash", "yaml", "toml")


class Target(NamedTuple):
    """What is asked for: a path (or glob, or null), a selection in it, and the etag of the version last seen."""

    path: str | None
    lines: tuple[int, int | None] | None = None
    around: int | None = None
    symbol: str | None = None
    since: str | None = None


def parse_target(text: str, exists=lambda path: False) -> Target:
    """``path``, ``path:A-B``, ``path:A-``, ``path:LINE[:COL]``, ``path#L5-L9``, ``path#Symbol``, ``#Symbol``, each with
    ``@etag``; a path that exists as it is wins over all of these."""
    text = text.strip()
    if exists(text):
        return Target(text)
    since = None
    if m := re.search(r"@([0-9A-Fa-f]{16})$", text):
        text, since = text[: m.start()], m.group(1).lower()
    if exists(text):
        return Target(text, since=since)
    if m := re.fullmatch(r"(.*?)#L(\d+)(?:-L?(\d+)?)?", text):
        end = m.group(3)
        return Target(m.group(1) or None, (int(m.group(2)), int(end) if end else None if text.endswith("-") else int(m.group(2))), since=since)
    if "#" in text:
        path, _, name = text.partition("#")
        return Target(path or None, symbol=name, since=since)
    if m := re.fullmatch(r"(.+?):(\d+)-(\d+)?", text):
        a, b = int(m.group(2)), int(m.group(3)) if m.group(3) else None
        return Target(m.group(1), (min(a, b), max(a, b)) if b else (a, None), since=since)
    if m := re.fullmatch(r"(.+?):(\d+)(?::\d+)?", text):
        return Target(m.group(1), around=int(m.group(2)), since=since)
    return Target(text, since=since)


#: How a line that brings in another module begins, by language.
IMPORTS = {
    ("python",): r"import\s|from\s+[\w.]+\s+import\b",
    ("rust",): r"(?:pub(?:\([^)]*\))?\s+)?use\s|extern\s+crate\s",
    ("javascript", "typescript", "tsx"): r"import\b|export\b.*\bfrom\s|(?:const|let|var)\b.*=\s*require\(",
    ("go", "java", "kotlin", "scala", "swift"): r"import\b|@testable\s+import\b",
    ("c", "cpp", "objc"): r"#\s*(?:include|import)\b|@import\b|using\s",
    ("csharp",): r"(?:global\s+)?using\s",
    ("ruby",): r"(?:require|require_relative|load|autoload)\b",
    ("php",): r"use\s|(?:require|include)(?:_once)?\b",
    ("lua", "luau"): r"local\b.*(?:\brequire\b|:GetService\()|require\b",
    ("bash",): r"(?:source|\.)\s",
}
COMMENTS = {("lua", "luau"): r"--", HASH_COMMENTS: r"#(?!!)", None: r"//|/\*|\*"}


def line_kind(text: Column, lang: Column) -> Column:
    """blank, comment, import or other, by the language's own syntax."""
    t = F.ltrim(text)

    def begins(table: dict) -> Column:
        hit = F.lit(False)
        for langs, pattern in table.items():
            one = F.rlike(t, F.lit(f"^(?:{pattern})"))
            hit = hit | (one if langs is None else lang.isin(*langs) & one)
        return F.coalesce(hit, F.lit(False))

    return F.when(F.trim(t) == "", "blank").when(begins(COMMENTS), "comment").when(begins(IMPORTS), "import").otherwise("other")


def runs(lines: DataFrame) -> DataFrame:
    """(path, kind, first, last): runs of at least ``COMMENT_RUN`` comment or ``IMPORT_RUN`` import lines (path, line, kind).

    Blank lines do not end a run of imports: they are numbered away before the islands are looked for.
    """
    solid = lines.where("kind <> 'blank'").select("path", "line", "kind", F.row_number().over(W.partitionBy("path").orderBy("line")).alias("solid"))
    by = W.partitionBy("path", "kind").orderBy("line")
    imports = solid.where("kind = 'import'").withColumn("island", F.col("solid") - F.row_number().over(by))
    comments = lines.where("kind = 'comment'").select("path", "line", "kind", F.col("line").alias("solid")).withColumn("island", F.col("line") - F.row_number().over(by))
    both = comments.unionByName(imports).groupBy("path", "kind", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return both.where(F.col("last") - F.col("first") + 1 >= F.when(F.col("kind") == "comment", COMMENT_RUN).otherwise(IMPORT_RUN)).drop("island")


def outermost(ranges: DataFrame) -> DataFrame:
    """The (path, start, end) that lie in no earlier one."""
    before = F.max("end").over(W.partitionBy("path").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    return ranges.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("start") > F.col("_before"))).drop("_before")


def collapse_ranges(symbols: DataFrame) -> DataFrame:
    """(path, start, end): the bodies that a skeleton leaves out."""
    return outermost(symbols.where("collapse is not null").select("path", F.col("collapse.start").alias("start"), F.col("collapse.end").alias("end")))


def elided(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, line, last, text): the lines outside the ranges, and a marker row ``⋯`` for each range."""
    inside = lines.join(ranges.select("path", "start", "end"), "path").where(F.col("line").between(F.col("start"), F.col("end")))
    indent = F.regexp_extract(F.min_by("text", "line"), r"^[ \t]*", 0)
    marks = inside.groupBy("path", "start", "end").agg(F.concat(indent, F.lit("⋯")).alias("text"))
    kept = lines.join(inside.select("path", "line").distinct(), ["path", "line"], "left_anti")
    return kept.select("path", "line", F.col("line").alias("last"), "text").unionByName(marks.select("path", F.col("start").alias("line"), F.col("end").alias("last"), "text"))


def skeleton(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    return elided(lines, collapse_ranges(symbols))


def compact(lines: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """A skeleton whose long comments and imports show their first line only."""
    bodies = collapse_ranges(symbols)
    kinds = lines.join(sources.select("path", "lang"), "path").select("path", "line", line_kind(F.col("text"), F.col("lang")).alias("kind"))
    folds = runs(kinds).select("path", (F.col("first") + 1).alias("start"), F.col("last").alias("end"))
    return elided(lines, outermost(bodies.unionByName(folds)))


def outline_rows(symbols: DataFrame) -> DataFrame:
    """(path, idx, parent, depth, start, end, text, members): a listing row for each symbol with the number of its members."""
    members = symbols.where("parent is not null").groupBy("path", F.col("parent").alias("idx")).agg(F.count(F.lit(1)).alias("members"))
    return symbols.join(members, ["path", "idx"], "left").select("path", "idx", "parent", "depth", "start", "end", F.concat(F.repeat(F.lit("  "), F.col("depth")), "signature").alias("text"), F.coalesce("members", F.lit(0)).alias("members"))


def fitted(outline: DataFrame, most: int) -> DataFrame:
    """The outline's top level, and of the rest as much as fits, level by level; ``hidden`` counts a symbol's members that are
    left out."""
    cost = F.octet_length("text") + 16
    run = F.sum(cost).over(W.partitionBy("path").orderBy("depth", "idx").rowsBetween(W.unboundedPreceding, 0))
    rows = outline.withColumn("_shown", (F.col("depth") == 0) | (run <= most))
    left = rows.where("not _shown and parent is not null").groupBy("path", F.col("parent").alias("idx")).agg(F.count(F.lit(1)).alias("hidden"))
    return rows.where("_shown").drop("_shown").join(left, ["path", "idx"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))


def numbered_text(rows: list, line_numbers: bool = True, clip: int = LINE_AUTO) -> str:
    """Rows (line, last, text) as displayed text: the number, a tab, the line, without its carriage return."""
    out = []
    for r in rows:
        text = r.text[:-1] if r.text.endswith("\r") else r.text
        raw = text.encode("utf-8", "replace")
        if len(raw) > clip:
            text = raw[:clip].decode("utf-8", "ignore") + "…"
        out.append((f"{r.line}-{r.last}\t" if r.last != r.line else f"{r.line}\t") + text if line_numbers else text)
    return "\n".join(out)


def _views(corpus, source, mode: str, numbers: bool) -> list[tuple[str, str]]:
    """(name, text) of the views of one text, best first."""
    s = corpus.sources.where(F.col("path") == source.path)
    lines = corpus.lines().where(F.col("path") == source.path)
    symbols = corpus.symbols.where(F.col("path") == source.path)
    get = lambda df: df.orderBy("line").collect()
    whole = lambda: numbered_text(get(lines.select("path", "line", F.col("line").alias("last"), "text")), numbers, LINE_FULL if mode == "full" else LINE_AUTO)
    listing = lambda: "\n".join(f"{r.start}-{r.end}\t{r.text}" + (f" (+{r.members})" if r.members else "") for r in outline_rows(symbols).orderBy("idx").collect())
    views = {"full": whole, "skeleton": lambda: numbered_text(get(skeleton(lines, symbols)), numbers), "compact": lambda: numbered_text(get(compact(lines, symbols, s)), numbers), "outline": listing}
    if mode in ("skeleton", "outline", "full"):
        return [(mode, views[mode]())]
    out = [("full", views["full"]())]
    if estimate_python(out[0][1]) > 400:
        out += [(n, t) for n in ("skeleton", "compact", "outline") if (t := views[n]())]
    return out


def _select(corpus, source, target: Target, numbers: bool) -> list[tuple[str, str]]:
    """The views of a target's selection in one text."""
    s, content = corpus.symbols.where(F.col("path") == source.path), source.content
    all_lines = content.split("\n")
    if all_lines and all_lines[-1] == "":
        all_lines.pop()
    span = None
    if target.lines:
        a, b = target.lines
        span = (a, b or len(all_lines))
    elif target.around:
        at = target.around
        own = s.where((F.col("start") <= at) & (F.col("end") >= at)).orderBy(F.desc("depth"), "idx").first()
        if own is not None and own.end - own.start < AROUND_SYMBOL:
            span = (own.start, own.end)
        else:
            span = block.enclosing(all_lines, at) or (max(1, at - WINDOW), min(len(all_lines), at + WINDOW))
    elif target.symbol:
        found = lookup.named(s, target.symbol).orderBy("idx").limit(FILE_SYMBOLS).collect()
        if not found:
            tips = [r.name for r in lookup.suggest_symbols(s, target.symbol).collect()]
            return [("missing", f"no symbol {target.symbol} in {source.path}" + (f"; did you mean {', '.join(tips)}?" if tips else ""))]
        return [("symbol", "\n".join(_span(all_lines, r.start, r.end, numbers) for r in found))]
    if span is None:
        return []
    if span[0] > len(all_lines):
        return [("missing", f"{source.path} has {len(all_lines)} lines")]
    return [("lines", _span(all_lines, span[0], min(span[1], len(all_lines)), numbers))]


def _span(lines: list[str], a: int, b: int, numbers: bool) -> str:
    return "\n".join((f"{i}\t" if numbers else "") + lines[i - 1].removesuffix("\r") for i in range(a, b + 1))


def header(source, view: str) -> str:
    """What stands above a text: path, etag, lines, language and oddities."""
    flags = [n for n, on in (("CRLF", source.crlf), ("UTF-16", source.utf16), ("BOM", source.bom and not source.utf16), ("invalid UTF-8", source.lossy), ("minified", any(len(x) > LINE_AUTO for x in source.content.split("\n")))) if on]
    return f"== {source.path}@{source.etag} {source.n_lines} lines" + "".join(f", {x}" for x in [*flags, *([] if view == "full" else [view])])


def read(corpus, targets: list[str], mode: str = "auto", budget: int | None = None, line_numbers: bool = True, snapshots=None, profile: Profile = PROFILES["legacy"]) -> str:
    """The targets as one text within the budget.

    Each item has a ladder of views; items are lowered, cheapest tier and costliest first, until all fit, then get
    fair shares.  What is collected are the texts asked for.
    """
    from lodestar.functions.text import etag

    budget = clamp_budget(budget, DEFAULT_BUDGET)
    paths = corpus.sources.select("path")
    exists = lambda p: bool(p) and paths.where(F.col("path") == p).limit(1).count() > 0
    items: list[tuple[str, list[tuple[str, str]], int]] = []

    def some(found: DataFrame) -> list[str]:
        """The first ``GLOB_FILES`` paths; how many more there are is said in an item of its own."""
        got = [r.path for r in found.orderBy("path").limit(GLOB_FILES).collect()]
        more = found.count() - len(got) if len(got) == GLOB_FILES else 0
        if more:
            items.append((f"omitted: {more} more files", [("omitted", f"after {got[-1]}; ask for them by a narrower glob")], 3))
        return got

    for text in targets:
        t = parse_target(text, exists)
        if t.path is None:
            found = lookup.ranked(lookup.named(corpus.symbols, t.symbol or ""), (lookup.name_parts(t.symbol or "") or [""])[-1]).limit(12).collect()
            if not found:
                items.append((f"no symbol {t.symbol}", [("missing", ", ".join(r.name for r in lookup.suggest_symbols(corpus.symbols, t.symbol or "").collect()))], 0))
            for r in found[:WORKSPACE_SYMBOLS]:
                items += _items(corpus, [r.path], Target(r.path, lines=(r.start, r.end)), mode, line_numbers, snapshots, etag, 1)
            if found[WORKSPACE_SYMBOLS:]:
                items.append(("more", [("list", "\n".join(f"{r.path}#{r.qualified}" for r in found[WORKSPACE_SYMBOLS:]))], 0))
            continue
        if is_glob(t.path):
            names = some(paths.where(glob_filter(F.col("path"), [t.path])))
        elif exists(t.path):
            names = [t.path]
        else:
            names = some(paths.where(F.startswith("path", F.lit(t.path.rstrip("/") + "/"))))
        if not names:
            near = [r.path for r in lookup.suggest_paths(paths, t.path).collect()]
            same = [p for p in near if p.rsplit("/", 1)[-1] == t.path.rsplit("/", 1)[-1]]
            if len(same) == 1:  # a file name that only one path has
                names = same
            else:
                items.append((f"{t.path} not found", [("missing", f"did you mean {', '.join(near)}?" if near else "")], 0))
        items += _items(corpus, names, t, mode, line_numbers, snapshots, etag, 2 if len(names) == 1 else 1)
    ladders = [[estimate_python(head + "\n" + v, profile.scale) for _, v in views] for head, views, _ in items]
    at = degrade(ladders, [tier for _, _, tier in items], budget)
    shares = fair_shares([l[i] for l, i in zip(ladders, at)], budget)
    out, left_out = [], []
    for (head, views, _), i, share, ladder in zip(items, at, shares, ladders):
        if not share:
            left_out.append(head)
            continue
        name, text = views[i]
        body = f"{head}, {name}" if head.startswith("== ") and name not in ("full", "lines", "symbol") else head
        out.append(body + "\n" + (text if share >= ladder[i] else enforce(text, max(share - 20, 20), profile.scale, "⋯ cut; ask for a range")))
    if left_out:
        out.append("omitted: " + ", ".join(left_out))
    return enforce("\n\n".join(out), budget, profile.scale)


def _items(corpus, names: list[str], t: Target, mode: str, numbers: bool, snapshots, etag, tier: int):
    out = []
    rows = corpus.sources.where(F.col("path").isin(names)).withColumn("etag", etag("content")).orderBy("path").collect() if names else []
    for source in rows:
        if source.binary:
            out.append((f"== {source.path}", [("binary", f"binary file, {source.bytes or 0} bytes")], tier))
            continue
        if source.content is None:
            out.append((f"== {source.path} {source.bytes} bytes", _large(corpus, source, t, numbers), tier))
            continue
        if t.since == source.etag:
            out.append((f"== {source.path}@{source.etag}", [("unchanged", "unchanged")], 3))
            continue
        views = _since(corpus, source, t.since, snapshots) if t.since else []
        views = views or _select(corpus, source, t, numbers) or _views(corpus, source, mode, numbers)
        out.append((header(source, "full"), views, tier))
    if snapshots is not None and rows:
        snapshots.remember(corpus.sources.where(F.col("path").isin(names)))
    return out


def _large(corpus, source, t: Target, numbers: bool) -> list[tuple[str, str]]:
    """The lines asked for of a text too large for a row, else its first and last ones."""
    lines = corpus.large.where(F.col("path") == source.path).withColumn("last", F.col("line"))
    show = lambda df: numbered_text(df.orderBy("line").limit(HEAD_LINES + TAIL_LINES).collect(), numbers)
    if t.lines or t.around:
        a, b = t.lines or (max(1, t.around - WINDOW), t.around + WINDOW)
        return [("lines", show(lines.where(F.col("line").between(a, b or 1 << 62))))]
    n = lines.agg(F.max("line").alias("n")).first()["n"] or 0
    tail = show(lines.where(F.col("line") > max(HEAD_LINES, n - TAIL_LINES)))
    return [("head and tail", show(lines.where(F.col("line") <= HEAD_LINES)) + (f"\n⋯ {max(n - HEAD_LINES - TAIL_LINES, 0)} lines\n{tail}" if tail else ""))]


def _since(corpus, source, since: str, snapshots) -> list[tuple[str, str]]:
    """What a text gained since a version that was shown, if that is known and shorter than the text."""
    from lodestar.operators import changes

    if snapshots is None:
        return []
    spark = corpus.sources.sparkSession
    both = snapshots.since(corpus.sources.where(F.col("path") == source.path), spark.createDataFrame([(source.path, since)], "path string, etag string"))
    row = both.first()
    if row is None or row.old is None:
        return []
    if row.change == "appended":
        return [("appended", "\n".join(f"{r.line}\t{r.text}" for r in changes.appended_lines(both.select("path", "old", "new")).orderBy("line").collect()))]
    hunks = changes.labelled_hunks(changes.diff_hunks(both.select("path", "old", "new")), corpus.symbols.where(F.col("path") == source.path)).orderBy("hunk").collect()
    text = "\n".join(f"@@ -{h.old_start},{h.old_lines} +{h.new_start},{h.new_lines} @@ {h.symbol or ''}".rstrip() + "\n" + h.body for h in hunks)
    return [("diff", text)] if len(text) * 10 < len(row.new) * changes.WHOLE_ABOVE else []
