"""Callers, callees, references and implementations over symbols and occurrences.

Results are flat rows with a level and the key of what they hang on, never nested.  A level is two or three
joins, written once; the visited set is a table, and the next frontier is what is not in it.  Nothing comes to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions.text import shared_components
from lodestar.operators import lookup
from lodestar.operators.outline import innermost
from lodestar.operators.symbols import CALLABLE
from lodestar.session import materialize

# Nodes opened a level, and levels.
EXPANDED, MAX_DEPTH = 24, 3
# Words for the object itself, and languages in which a method is called without one, or never.
SELF = ("self", "this", "Self", "cls", "static", "$this")
IMPLICIT = ("java", "csharp", "cpp", "kotlin", "scala", "swift", "ruby", "c", "objc")
EXPLICIT = ("python", "rust", "javascript", "typescript", "tsx", "php", "lua", "luau")
TYPES = ("class", "struct", "interface", "trait", "enum", "type", "impl", "module", "object")
LUA_GLOBALS = "table string math os io coroutine debug utf8 bit32 task buffer vector".split()
DIRECTIONS = {"callers": "callers", "caller": "callers", "in": "callers", "callees": "callees", "callee": "callees", "calls": "callees", "out": "callees", "refs": "refs", "references": "refs", "usages": "refs", "impls": "impls", "implementations": "impls", "subtypes": "impls"}


def direction_of(word: str) -> str:
    """A direction by any of its names."""
    got = DIRECTIONS.get(word.strip().lower())
    if got is None:
        raise ValueError(f"direction must be one of callers, callees, refs, impls, not {word!r}")
    return got


def definitions(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Symbols with their directory, owner type, Go package and whether they are callable."""
    s = symbols.alias("s")
    up = symbols.select("path", F.col("idx").alias("parent"), F.col("name").alias("_up"), F.col("kind").alias("_up_kind"))
    package = sources.where("lang = 'go'").select("path", F.regexp_extract(F.left("content", F.lit(8192)), r"(?m)^\s*package\s+(\w+)", 1).alias("package"))
    rows = s.join(up, ["path", "parent"], "left").join(package, "path", "left")
    own = F.when(F.col("scope").isNotNull(), F.element_at(F.split("scope", r"::|[.#/]"), -1)).when(F.col("_up_kind").isin(*TYPES), F.col("_up"))
    return rows.withColumn("owner", F.regexp_replace(own, r"[<\[].*$", "")).withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")).drop("_up", "_up_kind")


def enclosing(points: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with ``owner_idx``: the innermost callable around each, else the innermost symbol."""
    call = innermost(points, symbols, keys, kinds=CALLABLE + ("property",)).withColumnRenamed("owner_idx", "call_idx")
    every = innermost(call, symbols, keys)
    return every.withColumn("owner_idx", F.coalesce("call_idx", "owner_idx")).drop("call_idx")


def attribution() -> Column:
    """Whether a site means the target: ``target``, ``other`` or ``unknown``.

    Columns: qualifier, s_path, s_dir, s_owner (the site's), name, t_path, t_dir, t_owner, t_package, t_kind, t_lang (the
    target's), and what the definitions of the name have (``_known``): o_named, o_owned, o_free_here, o_any.
    """
    q = F.col("qualifier")
    method = F.col("t_owner").isNotNull() & ~F.col("t_kind").isin(*TYPES)
    s_owner = F.col("s_owner")
    by_owner = F.when(s_owner.isNull(), "unknown").when(s_owner == F.col("t_owner"), "target").when(F.col("o_owned"), "other").otherwise("unknown")
    go = F.col("t_lang") == "go"
    named = (
        F.when(q == F.col("t_owner"), "target")
        .when(go & (q == F.col("t_package")), "target")
        .when(F.col("o_named"), "other")
        .when(go & ~method, "other")
        .when(F.col("t_lang").isin("lua", "luau") & q.isin(LUA_GLOBALS), "other")
        .otherwise("unknown")
    )
    plain = (
        F.when(go, F.when(~method & (F.col("s_dir") == F.col("t_dir")), "target").otherwise("other"))
        .when(method & F.col("t_lang").isin(*IMPLICIT), by_owner)
        .when(method & F.col("t_lang").isin(*EXPLICIT), "other")
        .when(method, "unknown")
        .when(F.col("s_path") == F.col("t_path"), "target")
        .when(F.col("o_free_here"), "other")
        .otherwise("unknown")
    )
    said = (
        F.when(q.isin(*SELF), by_owner)
        .when(q == "super", "unknown")
        .when(q == "", F.when(~method & F.col("t_lang").isin("go", "rust"), "other").otherwise("unknown"))
        .when(q.isNotNull(), named)
        .otherwise(plain)
    )
    return F.when((said == "unknown") & ~F.col("o_any"), "target").otherwise(said)


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind), value)


def given() -> Column:
    """Keys, a kind and a value, under which sites ask for a target (``wanted``): a site that ``attribution`` lets mean the
    target asks for exactly one of them, any other for none."""
    owner, package, lang = F.col("t_owner"), F.col("t_package"), F.col("t_lang")
    go, method = lang == "go", owner.isNotNull() & ~F.col("t_kind").isin(*TYPES)
    plain = (
        F.when(go, F.array(F.when(~method, _key("d", F.col("t_dir")))))
        .when(method & lang.isin(*IMPLICIT), F.array(F.lit("I"), _key("i", owner)))
        .when(method & lang.isin(*EXPLICIT), F.array())
        .when(method, F.array(F.lit("M")))
        .otherwise(F.array(F.lit("P"), _key("p", F.col("t_path"))))
    )
    every = (
        F.lit("A"),
        F.when(method | ~lang.isin("go", "rust"), "E"),
        F.when(lang.isin("lua", "luau"), "L").when(method | ~go, "W"),
        _key("o", owner),
        F.when(~package.eqNullSafe(owner), _key("k", package)),
    )
    return F.array_compact(F.concat(F.array(*every), plain))


def wanted() -> Column:
    """Keys of the targets that a site may mean: all of a sort (capitals), or those with a value where that decides."""
    q, s_owner = F.col("qualifier"), F.col("s_owner")
    keys = (
        F.when(q.isin(*SELF), F.array(F.when(F.col("o_owned"), _key("o", s_owner)).otherwise("A")))
        .when(q == "super", F.array(F.lit("A")))
        .when(q == "", F.array(F.lit("E")))
        .when(q.isNotNull() & F.col("o_named"), F.array(_key("o", q), _key("k", q)))
        .when(q.isNotNull(), F.array(F.lit("W"), F.when(~q.isin(LUA_GLOBALS), "L")))
        .otherwise(F.array(_key("d", F.col("s_dir")), F.when(F.col("o_owned"), _key("i", s_owner)).otherwise("I"), F.lit("M"), F.when(F.col("o_free_here"), _key("p", F.col("s_path"))).otherwise("P")))
    )
    return F.array_compact(keys)


class Tracer:
    """Questions about one corpus; ``occurrences`` and ``symbols`` are best written tables."""

    def __init__(self, sources: DataFrame, symbols: DataFrame, occurrences: DataFrame):
        self.sources, self.symbols = sources, symbols
        self.defs = definitions(symbols, sources)
        # a definition's own name is no occurrence of it
        named = symbols.select("path", "name", F.col("def").alias("line")).distinct()
        self.sites = occurrences.join(named, ["path", "name", "line"], "left_anti")

    def resolve(self, target: str) -> DataFrame:
        """The definitions that a target means, best first: ``Name``, ``path#Name``, ``path:LINE`` or ``#Name``."""
        if m := re.fullmatch(r"(.+?):(\d+)(?::\d+)?", target):
            line = int(m.group(2))
            here = self.defs.where((F.col("path") == m.group(1)) & (F.col("start") <= line) & (F.col("end") >= line))
            return here.orderBy(F.desc("depth"), "idx").limit(1)
        path, hash_, name = target.rpartition("#")
        found = lookup.named(self.defs, name if hash_ else target)
        if path:
            found = found.where((F.col("path") == path) | F.endswith("path", F.lit("/" + path)))
        return lookup.ranked(found, (lookup.name_parts(name or target) or [target])[-1])

    def _known(self, sites: DataFrame) -> DataFrame:
        """Sites with what the definitions of their name have: an owner or package that the qualifier names (o_named), the
        site's owner (o_owned), a free definition in the site's text (o_free_here), and more than one definition (o_any).

        The target is among them: where it alone has one of these, ``attribution`` has already said that it is meant.
        So what is known stands by name and value, one row each, and never by pairs of definitions of a name.
        """
        d = self.defs.select("name", "path", "idx", "owner", "package")
        owner, package = (d.select("name", F.col(c).alias("_value")).where("_value is not null") for c in ("owner", "package"))
        one = F.struct("path", "idx")
        for flag, at, facts in (
            ("o_named", "qualifier", owner.unionByName(package).distinct()),
            ("o_owned", "s_owner", owner.distinct()),
            ("o_free_here", "s_path", d.where("owner is null").select("name", F.col("path").alias("_value")).distinct()),
            ("o_any", None, d.groupBy("name").agg(F.min(one).alias("_a"), F.max(one).alias("_b")).where("_a <> _b").select("name")),
        ):
            facts, same = facts.withColumnRenamed("name", "_name").withColumn(flag, F.lit(True)), F.col("name") == F.col("_name")
            sites = sites.join(facts, same & (F.col(at) == F.col("_value")) if at else same, "left").drop("_name", "_value").withColumn(flag, F.coalesce(flag, F.lit(False)))
        return sites

    def sites_of(self, keys: DataFrame, kinds: tuple[str, ...] = ("call",)) -> DataFrame:
        """Sites of definitions (t_path, t_idx), attributed, with the symbol around each."""
        t = self.defs.join(keys.select("path", "idx").distinct(), ["path", "idx"], "left_semi")
        t = t.select("name", *[F.col(c).alias(f"t_{c}") for c in ("path", "idx", "dir", "owner", "package", "kind", "lang")])
        s = self.sites.where(F.col("kind").isin(*kinds)).join(t.select("name").distinct(), "name", "left_semi")
        s = enclosing(s.select("path", "line", "col", "name", "kind", "qualifier"), self.symbols, ["path", "line", "col"])
        own = self.defs.select("path", F.col("idx").alias("owner_idx"), F.when(F.col("kind").isin(*TYPES), F.col("name")).otherwise(F.col("owner")).alias("s_owner"))
        s = s.join(own, ["path", "owner_idx"], "left").withColumnRenamed("path", "s_path").withColumn("s_dir", F.when(F.instr("s_path", "/") > 0, F.regexp_replace("s_path", "/[^/]*$", "")).otherwise(""))
        # by what is meant, not by name alone: of a name with many definitions and sites most pairs would be dropped again
        rows = self._known(s).withColumn("_key", F.explode(wanted())).join(t.withColumn("_key", F.explode(given())), ["name", "_key"]).withColumn("attr", attribution())
        return rows.where("attr <> 'other'").select("t_path", "t_idx", "name", "s_path", "owner_idx", "line", "col", "kind", "qualifier", "attr")

    def groups(self, sites: DataFrame) -> DataFrame:
        """Sites by enclosing symbol: (t_path, t_idx, s_path, owner_idx, lines, n_calls, n_refs, n_imports, uncertain, nth):
        ``nth`` sorts tests last, then those that share most leading folders with the target first."""
        shared = shared_components(F.col("s_path"), F.col("t_path"))
        own = F.when(F.col("kind") == "import", None).otherwise(F.col("owner_idx"))
        g = sites.withColumn("owner_idx", own).groupBy("t_path", "t_idx", "s_path", "owner_idx").agg(
            F.sort_array(F.collect_set("line")).alias("lines"),
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("call", "ref", "import")],
            F.bool_and(F.col("attr") == "unknown").alias("uncertain"),
            F.min("line").alias("first"),
        )
        return g.withColumn("nth", F.struct(lookup.is_test_path(F.col("s_path")).alias("in_test"), (-shared).alias("apart"), "s_path", "uncertain", "first")).drop("first")

    def _bfs(self, start: DataFrame, step, depth: int, expanded: int = EXPANDED) -> DataFrame:
        """Rows (level, from_path, from_idx, to_path, to_idx, n, lines, uncertain, nth) by levels; a node is opened once, and
        ``expanded`` nodes a level, those that come first by ``nth``."""
        seen = materialize(start.select("path", "idx").distinct(), "seen")
        frontier, levels = seen, None
        for level in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
            found = materialize(step(frontier, level).withColumn("level", F.lit(level)), "level")
            levels = found if levels is None else levels.unionByName(found)
            new = found.where("to_idx is not null").groupBy(F.col("to_path").alias("path"), F.col("to_idx").alias("idx")).agg(F.min("nth").alias("nth"))
            new = new.join(seen, ["path", "idx"], "left_anti").orderBy("nth", "path", "idx").limit(expanded)
            frontier = materialize(new.select("path", "idx"), "frontier")
            if not frontier.limit(1).count():
                break
            seen = seen.unionByName(frontier)
        return levels

    def callers(self, start: DataFrame, depth: int = 1, kinds: tuple[str, ...] = ("call",)) -> DataFrame:
        def step(frontier: DataFrame, level: int) -> DataFrame:
            g = self.groups(self.sites_of(frontier, kinds))
            rows = g.select(F.col("t_path").alias("from_path"), F.col("t_idx").alias("from_idx"), F.col("s_path").alias("to_path"), F.col("owner_idx").alias("to_idx"), (F.col("n_calls") + F.col("n_refs") + F.col("n_imports")).alias("n"), "lines", "uncertain", "nth")
            # a call of itself counts at the top level only
            return rows if level == 1 else rows.where(~((F.col("from_path") == F.col("to_path")) & F.col("from_idx").eqNullSafe(F.col("to_idx"))))

        return self._bfs(start, step, depth)

    def calls_in(self, keys: DataFrame) -> DataFrame:
        """Calls in the bodies of definitions: (path, idx, name, qualifier, n, first)."""
        body = self.defs.join(keys.select("path", "idx"), ["path", "idx"], "left_semi").select("path", "idx", F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("name").alias("_own"))
        c = self.sites.where("kind = 'call'").join(body, "path").where(F.col("line").between(F.col("_a"), F.col("_b")))
        return c.groupBy("path", "idx", "name", "qualifier").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"), F.sort_array(F.collect_set("line")).alias("lines"))

    def resolved(self, calls: DataFrame) -> DataFrame:
        """Calls with the definitions they may mean, by score: receiver 8, implicit self 6, file 3, directory 2, free
        function 2, language 1, body 1; all with the best score are kept."""
        me = self.defs.select("path", "idx", F.col("owner").alias("m_owner"), F.col("lang").alias("m_lang"), F.col("dir").alias("m_dir"))
        d = self.defs.where(F.col("kind").isin(*CALLABLE, *TYPES)).select("name", F.col("path").alias("to_path"), F.col("idx").alias("to_idx"), F.col("owner").alias("d_owner"), F.col("lang").alias("d_lang"), F.col("dir").alias("d_dir"), F.col("collapse").isNotNull().alias("body"), F.col("package").alias("d_package"))
        rows = calls.join(me, ["path", "idx"]).join(d, "name")
        q = F.col("qualifier")
        point = lambda c, n: F.when(c, n).otherwise(0)
        score = (
            point(q.isNotNull() & ((q == F.col("d_owner")) | (q == F.col("d_package"))), 8)
            + point((q.isin(*SELF) | q.isNull()) & (F.col("d_owner") == F.col("m_owner")), 6)
            + point(F.col("to_path") == F.col("path"), 3)
            + point(F.col("d_dir") == F.col("m_dir"), 2)
            + point(F.col("d_lang") == F.col("m_lang"), 1)
            + point(F.col("body"), 1)
            + point(q.isNull() & F.col("d_owner").isNull(), 2)
        )
        best = F.rank().over(W.partitionBy("path", "idx", "name", "qualifier").orderBy(F.desc("score")))
        return rows.withColumn("score", score).withColumn("rank", best).where("rank = 1")

    def callees(self, start: DataFrame, depth: int = 1) -> DataFrame:
        def step(frontier: DataFrame, level: int) -> DataFrame:
            calls = self.calls_in(frontier)
            rows = self.resolved(calls)
            # a call is descended into if it means exactly one definition
            one = rows.withColumn("of", F.count(F.lit(1)).over(W.partitionBy("path", "idx", "name", "qualifier")))
            nth = F.struct("path", "idx", "first", "to_path", "to_idx").alias("nth")
            return one.select(F.col("path").alias("from_path"), F.col("idx").alias("from_idx"), "to_path", "to_idx", "n", "lines", (F.col("of") > 1).alias("uncertain"), nth)

        return self._bfs(start, step, depth)

    def external(self, start: DataFrame) -> DataFrame:
        """Names called by a definition that no symbol answers to."""
        calls = self.calls_in(start)
        return calls.join(self.defs.select("name").distinct(), "name", "left_anti").select("name", "qualifier", "n", "first").orderBy("first", "name")

    def heritage(self) -> DataFrame:
        """(path, idx, name, base): type declarations and the names in their clauses of inheritance."""
        head = F.col("signature")
        kinds = F.col("kind").isin("class", "struct", "interface", "trait", "enum", "impl", "object")
        clause = (
            F.when(F.col("lang") == "python", F.regexp_extract(head, r"\((.*)\)", 1))
            .when(F.col("lang") == "rust", F.when(F.col("kind") == "impl", F.regexp_extract(head, r"^(?:unsafe )?impl(?:<.*?>)?\s+(.+?) for ", 1)).otherwise(F.regexp_extract(head, r":\s*(.+)$", 1)))
            .when(F.col("lang") == "ruby", F.regexp_extract(head, r"<\s*(.+)$", 1))
            .when(F.col("lang").isin("cpp", "csharp", "swift", "kotlin", "objc"), F.regexp_extract(head, r":\s*(?!:)(.+)$", 1))
            .otherwise(F.regexp_extract(head, r"\b(?:extends|implements|with)\b\s*(.+)$", 1))
        )
        words = F.regexp_extract_all(F.regexp_replace(clause, r"<[^<>]*>|\([^()]*\)|\b(?:public|private|protected|virtual|extends|implements|with|metaclass=\w+)\b", " "), F.lit(r"([A-Za-z_$][\w$]*)(?![\w$.:]*(?:\.|::))"), F.lit(1))
        return self.defs.where(kinds & (clause != "")).select("path", "idx", "name", F.explode(F.array_distinct(words)).alias("base")).where("base <> name")

    def structural(self) -> DataFrame:
        """(path, idx, base_path, base_idx): Go types whose methods cover an interface's, by relational division."""
        need = self.defs.where("lang = 'go' and owner is not null and kind = 'method'").join(self.symbols.where("kind = 'interface'").select("path", F.col("idx").alias("parent")), ["path", "parent"]).select("dir", F.col("path").alias("base_path"), F.col("parent").alias("base_idx"), F.col("name").alias("method"))
        size = need.groupBy("base_path", "base_idx").agg(F.countDistinct("method").alias("size"))
        have = self.defs.where("lang = 'go' and kind = 'method' and scope is not null").select("dir", F.col("owner").alias("type"), F.col("name").alias("method")).distinct()
        cover = need.join(have, ["dir", "method"]).groupBy("dir", "type", "base_path", "base_idx").agg(F.countDistinct("method").alias("met")).join(size, ["base_path", "base_idx"]).where("met = size")
        types = self.defs.where("lang = 'go' and kind in ('struct', 'type')").select("dir", F.col("name").alias("type"), "path", "idx")
        return cover.join(types, ["dir", "type"]).select("path", "idx", "base_path", "base_idx")

    def impls(self, start: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
        h = self.heritage()

        def step(frontier: DataFrame, level: int) -> DataFrame:
            bases = self.defs.join(frontier, ["path", "idx"], "left_semi").select(F.col("path").alias("from_path"), F.col("idx").alias("from_idx"), F.col("name").alias("base"))
            named = h.join(bases, "base").select("from_path", "from_idx", F.col("path").alias("to_path"), F.col("idx").alias("to_idx"))
            built = self.structural().join(bases, (F.col("base_path") == F.col("from_path")) & (F.col("base_idx") == F.col("from_idx"))).select("from_path", "from_idx", F.col("path").alias("to_path"), F.col("idx").alias("to_idx"))
            rows = named.unionByName(built).distinct()
            line = self.defs.select(F.col("path").alias("to_path"), F.col("idx").alias("to_idx"), F.array("def").alias("lines"))
            return rows.join(line, ["to_path", "to_idx"]).select("from_path", "from_idx", "to_path", "to_idx", F.lit(1).cast("long").alias("n"), "lines", F.lit(False).alias("uncertain"), F.struct("to_path", "to_idx").alias("nth"))

        return self._bfs(start, step, depth)

    def overrides(self, method: DataFrame) -> DataFrame:
        """Methods of the same name in the types that inherit from a method's type."""
        m = method.select("name", F.col("path").alias("m_path"), F.col("parent").alias("m_parent")).limit(1)
        base = m.select(F.col("m_path").alias("path"), F.col("m_parent").alias("idx")).where("idx is not null")
        types = self.impls(base).select(F.col("to_path").alias("path"), F.col("to_idx").alias("parent")).distinct()
        return self.defs.join(types, ["path", "parent"], "left_semi").join(m.select("name"), "name", "left_semi")

    def trace(self, target: str, direction: str = "callers", depth: int = 1) -> DataFrame:
        """The rows of a trace from the best definition of a target, names added."""
        start = self.resolve(target).limit(1)
        direction = direction_of(direction)
        if direction == "callees":
            rows = self.callees(start, depth)
        elif direction == "impls":
            rows = self.impls(start, MAX_DEPTH)
        else:
            rows = self.callers(start, 1 if direction == "refs" else depth, ("call", "ref", "import") if direction == "refs" else ("call",))
        name = self.defs.select(F.col("path").alias("to_path"), F.col("idx").alias("to_idx"), F.col("qualified").alias("to_name"))
        return rows.join(name, ["to_path", "to_idx"], "left").orderBy("level", "nth", "from_path", "from_idx", "to_path", "to_idx").drop("nth")


def counts(groups: DataFrame) -> DataFrame:
    """(calls, refs, imports, scopes) over groups of sites."""
    return groups.agg(F.sum("n_calls").alias("calls"), F.sum("n_refs").alias("refs"), F.sum("n_imports").alias("imports"), F.countDistinct("s_path", "owner_idx").alias("scopes"))
