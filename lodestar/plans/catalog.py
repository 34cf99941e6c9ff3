"""Queries over the driver's tables, one per operator, each with the SQL that says the same.

Tables become corpora: ``documents`` under ``<lang>/<source>/<doc_id>.txt``; ``conversations`` as one text each, with
the conversation and its turns as symbols.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.corpus import Corpus
from lodestar.functions.regex import glob_filter
from lodestar.functions.text import etag, line_count, segments
from lodestar.functions.tokens import WEIGHTS, estimate
from lodestar.operators import budget, changes, lookup, outline, rollup, search, sets, views
from lodestar.sources.languages import detect, file_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Corpus:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return Corpus.from_table(d.withColumn("path", path), "path", "text")


_DOCS = "(select coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || doc_id::varchar || '.txt' as path, text as content from documents where text is not null)"
_LINES = f"""(select path, i as line, lines[i] as text from (select path, lines, unnest(range(1, len(lines) + 1)) as i
  from (select path, case when content = '' then [] else string_split(case when ends_with(content, chr(10)) then left(content, length(content) - 1) else content end, chr(10)) end as lines from {_DOCS})))"""


def conversations(spark: SparkSession, sf_dir: str) -> Corpus:
    """One text a conversation: its turns, joined by newlines.  Symbol 0 is the conversation, the others its turns."""
    t = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), "turn", "role", "text")
    texts = t.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    corpus = Corpus.from_table(texts, "path", "text")
    w = W.partitionBy("path").orderBy("turn")
    n = t.withColumn("n", F.regexp_count("text", F.lit("\n")) + 1).withColumn("upto", F.sum("n").over(w)).withColumn("idx", F.row_number().over(w))
    none = F.lit(None)
    turn = n.select("path", F.lit(None).cast("string").alias("lang"), F.col("idx").cast("int").alias("idx"), F.concat_ws("_", "role", "turn").alias("name"), F.concat(F.col("path"), F.lit("."), F.concat_ws("_", "role", "turn")).alias("qualified"), none.cast("string").alias("scope"), F.lit("function").alias("kind"), (F.col("upto") - F.col("n") + 1).cast("int").alias("start"), F.col("upto").cast("int").alias("end"), F.lit(0).alias("parent"), F.lit(1).alias("depth"), F.left("text", F.lit(40)).alias("signature"))
    whole = n.groupBy("path").agg(F.max("upto").cast("int").alias("end")).select("path", none.cast("string").alias("lang"), F.lit(0).alias("idx"), F.col("path").alias("name"), F.col("path").alias("qualified"), none.cast("string").alias("scope"), F.lit("module").alias("kind"), F.lit(1).alias("start"), "end", none.cast("int").alias("parent"), F.lit(0).alias("depth"), F.col("path").alias("signature"))
    symbols = whole.unionByName(turn).withColumn("def", F.col("start")).withColumn("collapse", F.when(F.col("end") > F.col("start") + 2, F.struct((F.col("start") + 1).alias("start"), F.col("end").alias("end"))))
    return Corpus(corpus.files, corpus.sources, symbols)


_TURNS = "(select 'conv/' || conv_id::varchar as path, turn, role, text, length(text) - length(replace(text, chr(10), '')) + 1 as n from conversations)"
_CONV_SYMBOLS = f"""(select path, (row_number() over w)::integer as idx, role || '_' || turn::varchar as name, 'function' as kind, (sum(n) over w - n + 1)::integer as s, (sum(n) over w)::integer as e, 1 as depth, left(text, 40) as signature from {_TURNS} window w as (partition by path order by turn)
  union all select path, 0, path, 'module', 1, sum(n)::integer, 0, path from {_TURNS} group by path)"""
_CONV_LINES = f"""(select path, i as line, lines[i] as text from (select path, lines, unnest(range(1, len(lines) + 1)) as i from (select path, string_split(string_agg(text, chr(10) order by turn), chr(10)) as lines from {_TURNS} group by path)))"""
THE = {"pattern": "the", "word": True, "case": "insensitive"}
_THE = r"regexp_matches(text, '(?i)(?:^|[^\w\p{L}\p{N}])the(?:[^\w\p{L}\p{N}]|$)')"


@query(f"select path, line::integer as line, text from {_LINES}")
def corpus_lines(spark, sf_dir):
    return documents(spark, sf_dir).lines()


@query(f"""select path, octet_length(encode(content))::bigint as bytes, case when content = '' then 0 else length(content) - length(replace(content, chr(10), '')) + case when ends_with(content, chr(10)) then 0 else 1 end end::integer as n_lines,
  contains(content, chr(13) || chr(10)) as crlf, regexp_matches(content, '[^\\x00-\\x7F]') as non_ascii from {_DOCS}""")
def source_stats(spark, sf_dir):
    return documents(spark, sf_dir).sources.select("path", "bytes", line_count(F.col("content")).alias("n_lines"), "crlf", (F.octet_length("content") != F.char_length("content")).alias("non_ascii"))


_COUNTS = {
    "digits": "length(t) - length(translate(t, '0123456789', ''))",
    "punct": r"length(regexp_replace(t, '[^\x00-\x7F]|[A-Za-z0-9 \t\r\n]', '', 'g'))",
    "ws_runs": r"len(regexp_extract_all(t, '[ \t\r]+'))",
    "newlines": r"len(regexp_extract_all(t, '\n'))",
    "non_ascii": r"len(regexp_extract_all(t, '[^\x00-\x7F]'))",
    "words": "len(regexp_extract_all(t, '[A-Za-z]+'))",
    "digit_runs": "len(regexp_extract_all(t, '[0-9]+'))",
    "case_breaks": "len(regexp_extract_all(t, '[a-z][A-Z]'))",
    "dense": "coalesce(list_sum([length(r) for r in regexp_extract_all(t, '[A-Za-z0-9+/=_-]{16,}') if regexp_matches(r, '[A-Za-z]') and regexp_matches(r, '[0-9]')]), 0)",
}


@query("select path, ceil(" + " + ".join(f"({_COUNTS[k]})::double * {v}::double" for k, v in WEIGHTS.items()) + f")::bigint as est_tokens from (select path, content as t from {_DOCS} union all select 'pages/' || page_id::varchar, html from pages where html is not null)")
def token_estimate(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("html is not null").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"))
    texts = documents(spark, sf_dir).sources.select("path", "content").unionByName(pages)
    return texts.select("path", estimate(F.col("content")).alias("est_tokens"))


@query(f"select path, count(*)::bigint as matches from {_LINES} where {_THE} group by path")
def search_files(spark, sf_dir):
    return documents(spark, sf_dir).search(output="files", **THE)


@query(f"select path, line::integer as line, text from {_LINES} where contains(text, 'token = \"')")
def search_matches(spark, sf_dir):
    return search.hits(documents(spark, sf_dir).sources, 'token = "', literal=True, case="sensitive")


@query(f"select count(*)::bigint as n, sum(line)::bigint as lines, count(distinct path)::bigint as paths from {_LINES} where regexp_matches(text, '(?i)licensed? under')")
def search_regex(spark, sf_dir):
    found = search.hits(documents(spark, sf_dir).sources, "licensed? under")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"), F.countDistinct("path").alias("paths"))


@query(f"""with l as {_LINES}, h as (select path, line from l where contains(text, 'token = "')),
  c as (select path, unnest(range(greatest(line - 1, 1), line + 2)) as line, line as hit from h)
  select l.path, l.line::integer as line, l.text, bool_or(c.hit = c.line) as is_match from l join c using (path, line) group by all""")
def search_context(spark, sf_dir):
    c = documents(spark, sf_dir)
    return search.context(search.hits(c.sources, 'token = "', literal=True, case="sensitive"), c.lines(), 1)


@query(f"""with s as {_CONV_SYMBOLS}, h as (select path, line from {_CONV_LINES} where {_THE}),
  o as (select h.path, h.line, (select arg_max(s.idx, s.depth * 100000 - s.idx) from s where s.path = h.path and h.line between s.s and s.e) as owner_idx from h)
  select path, owner_idx, count(*)::bigint as matches, string_agg(line::varchar, ',' order by line) as lines from o group by path, owner_idx""")
def search_symbols(spark, sf_dir):
    c = conversations(spark, sf_dir)
    rows = search.by_symbol(search.hits(c.sources, **THE), c.symbols)
    return rows.withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


@query(f"""with s as {_CONV_SYMBOLS}, h as (select path, line, text from {_CONV_LINES} where {_THE}),
  o as (select h.path, h.line, h.text, (select arg_max(s.idx, s.depth * 100000 - s.idx) from s where s.path = h.path and h.line between s.s and s.e) as idx from h)
  select o.path, o.line::integer as line, case when octet_length(encode(o.text)) <= 1000 then o.text else left(o.text, list_max(list_filter(range(0, 1001), lambda i: octet_length(encode(left(o.text, i))) <= 1000))) end as text, case when octet_length(encode(o.text)) > 1000 then true end as clipped,
    case when s.idx = 0 then s.name else s.path || '.' || s.name end as symbol, s.s::varchar || ':' || s.e::varchar as symbol_lines from o left join s using (path, idx)""")
def search_records(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return search.match_records(search.hits(c.sources, **THE), c.symbols).withColumn("symbol_lines", F.array_join(F.transform("symbol_lines", lambda x: x.cast("string")), ":"))


@query(f"""with m as (select path, count(*) as matches from {_LINES} where {_THE} group by path),
  b as (select *, coalesce(sum(matches) over (order by path rows between unbounded preceding and 1 preceding), 0) as before from m)
  select path, matches::bigint as matches, before::bigint as before from b where before < 5000""")
def search_limited(spark, sf_dir):
    found = search.hits(documents(spark, sf_dir).sources, **THE)
    return search.limited(found).where(F.col("before") < search.MAX_MATCHES).select("path", "matches", "before").distinct()


@query(f"select (select count(*) from {_DOCS})::bigint as files_searched, count(distinct path)::bigint as files_matched, count(*)::bigint as matches from {_LINES} where {_THE}")
def search_summary(spark, sf_dir):
    c = documents(spark, sf_dir)
    return search.summary(search.hits(c.sources, **THE), c.sources)


@query(f"select path, idx, name, row_number() over (order by path, s) as nth from {_CONV_SYMBOLS} where name = 'assistant_1'")
def symbol_lookup(spark, sf_dir):
    found = lookup.ranked(lookup.named(conversations(spark, sf_dir).symbols.withColumn("collapse", F.lit(1)), "assistant_1"), "assistant_1")
    return found.select("path", "idx", "name", F.row_number().over(W.orderBy("rank", "bodiless", "in_test", "path", "start")).cast("long").alias("nth"))


_NATIONS = "(select n_name as name, 'r' || n_regionkey::varchar || '.' || n_name as qualified, case when n_nationkey % 5 = 4 then 'heading' else 'class' end as kind from nation)"


@query(f"""select qualified as name, (case when contains(lower(name), 'naton_3') or contains('naton_3', lower(name)) then 0 else levenshtein(lower(name), 'naton_3') end)::integer as distance
  from {_NATIONS} where kind <> 'heading' and (contains(lower(name), 'naton_3') or contains('naton_3', lower(name)) or levenshtein(lower(name), 'naton_3') <= 2) order by 2, 1 limit 5""")
def suggest_symbols(spark, sf_dir):
    kind = F.when(F.col("n_nationkey") % 5 == 4, "heading").otherwise("class")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("."), "n_name").alias("qualified"), kind.alias("kind"))
    return lookup.suggest_symbols(n, "x.NATON_3")


@query(f"""with p as (select path, string_split(lower(path), '/') as parts, lower(regexp_extract(path, '[^/]*$')) as name from {_DOCS}),
  s as (select *, string_split(name, '.')[1] as stem, levenshtein(name, '1217.txt') as d from p),
  g as (select path, case when name = '1217.txt' then 1000 when stem = '1217' then 600 when abs(length(name) - 8) <= 8 and d <= 2 then 400 - 50 * d when contains(name, '1217') then 200 end
    + 20 * (list_contains(parts, 'en')::int + list_contains(parts, 'src3')::int + list_contains(parts, '1217.txt')::int) - len(parts) as score from s)
  select path, score::integer as score from g where score is not null order by score desc, path limit 5""")
def path_suggest(spark, sf_dir):
    return lookup.suggest_paths(documents(spark, sf_dir).sources, "./En/src3/1217.txt").withColumn("score", F.col("score").cast("int"))


_TESTS = ("src/latest.py", "src/contest.go", "fixtures/a.py", "testing/a.py", "AppTests/a.swift", "a/Test_x.c", "x_test.go", "y.spec.ts", "z_spec.rb", "FooTest.java", "FooTest.py", "specs/q", "tests", "unit-tests/r", "b.test", "test/s")


@query(f"""with p as (select doc_id, {list(_TESTS)}[1 + doc_id % {len(_TESTS)}] as path from documents), s as (select *, lower(path) as low, string_split(lower(path), '/') as segs from p),
  n as (select *, segs[len(segs)] as name from s)
  select doc_id, path, len(list_filter(segs, lambda x: x in ('test', 'tests', '__tests__', 'spec', 'specs', 'testing', 'testdata') or ends_with(x, 'tests'))) > 0 or contains(name, '_test.') or starts_with(name, 'test_') or contains(name, '.test.')
    or contains(name, '.spec.') or contains(name, '_spec.') or ends_with(name, 'tests.swift') or ends_with(name, 'test.java') or ends_with(name, 'test.kt') as is_test from n""")
def test_paths(spark, sf_dir):
    path = F.get(F.array(*[F.lit(t) for t in _TESTS]), (F.col("doc_id") % len(_TESTS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("is_test", lookup.is_test_path(F.col("path")))


_DIRS = f"""(select dir, case when dir = '' then 0 else len(string_split(dir, '/')) end as depth, count(*) as files, sum(size) as bytes from (
  select unnest(['', string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) as dir, octet_length(encode(content)) as size from {_DOCS}) group by dir)"""


@query(f"select dir, depth::integer as depth, files::bigint as files, bytes::bigint as bytes from {_DIRS}")
def map_rollup(spark, sf_dir):
    return rollup.directories(documents(spark, sf_dir).files)


@query(f"""select dir, files::bigint as files, floor(case when depth = 1 then v * 1000 else v end * 1000)::bigint as score
  from (select dir, depth, files, files::double / pow(4.0, greatest(depth, 1) - 1) as v from {_DIRS})""")
def map_importance(spark, sf_dir):
    return rollup.importance(rollup.directories(documents(spark, sf_dir).files)).select("dir", "files", "score")


@query(f"""select dir, parent, files::bigint as files from (select *, row_number() over (partition by parent order by files desc, dir) as rn
  from (select dir, files, case when contains(dir, '/') then regexp_replace(dir, '/[^/]*$', '') else '' end as parent from {_DIRS} where dir <> '')) where rn <= 24""")
def map_visible(spark, sf_dir):
    return rollup.visible(rollup.directories(documents(spark, sf_dir).files)).select("dir", "parent", "files")


@query("select coalesce(lang, '') as ext, count(*)::bigint as files from documents group by 1 order by 2 desc, 1 limit 3")
def ext_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return rollup.extensions(d.select(F.concat(F.col("doc_id").cast("string"), F.coalesce(F.concat(F.lit("."), F.col("lang")), F.lit(""))).alias("path")), 3)


@query(f"""with b as (select path, sum(octet_length(encode(text))) as size from {_LINES} where {_THE} group by path),
  r as (select path, size, sum(size) over (order by path) as used, row_number() over (order by path) as rn from b)
  select path, size::bigint as size, used::bigint as used, (used <= 20000 or rn = 1) as kept from r""")
def budget_prefix(spark, sf_dir):
    blocks = search.hits(documents(spark, sf_dir).sources, **THE).groupBy("path").agg(F.sum(F.octet_length("text")).alias("size"))
    return budget.prefix(blocks, "size", 20_000, ["path"])


@query(f"""with k as (select path, line, case when trim(text) = '' then 'blank' when length(text) < 60 then 'comment' when contains(text, 'the') then 'import' else 'other' end as kind from {_LINES}),
  c as (select path, kind, line, line - row_number() over (partition by path order by line) as g from k where kind = 'comment'),
  n as (select path, kind, line, row_number() over (partition by path order by line) as solid from k where kind <> 'blank'),
  i as (select path, kind, line, solid - row_number() over (partition by path order by line) as g from n where kind = 'import'),
  r as (select path, kind, min(line) as first, max(line) as last from (select * from c union all select * from i) group by path, kind, g)
  select path, kind, first::integer as first, last::integer as last from r where last - first + 1 >= case when kind = 'comment' then 3 else 4 end""")
def compact_runs(spark, sf_dir):
    kind = F.when(F.trim("text") == "", "blank").when(F.char_length("text") < 60, "comment").when(F.contains("text", F.lit("the")), "import").otherwise("other")
    return views.runs(documents(spark, sf_dir).lines().select("path", "line", kind.alias("kind")))


@query(f"""with r as (select path, s as start, e + (idx % 3) * 5 as stop from {_CONV_SYMBOLS} where idx > 0),
  b as (select *, max(stop) over (partition by path order by start, stop desc rows between unbounded preceding and 1 preceding) as before from r)
  select path, start::integer as start, stop::integer as stop from b where before is null or start > before""")
def collapse_ranges(spark, sf_dir):
    s = conversations(spark, sf_dir).symbols.where("idx > 0").select("path", "start", (F.col("end") + F.col("idx") % 3 * 5).alias("end"))
    return views.outermost(s).withColumnRenamed("end", "stop")


@query(f"""with s as {_CONV_SYMBOLS}, b as (select path, s + 1 as a, e as b from s where idx > 0 and e > s + 2)
  select l.path, l.line::integer as line, l.line::integer as last, l.text from {_CONV_LINES} l where not exists (select 1 from b where b.path = l.path and l.line between b.a and b.b)
  union all select b.path, b.a, b.b, regexp_extract(l.text, '^[ \\t]*') || '⋯' from b join {_CONV_LINES} l on l.path = b.path and l.line = b.a""")
def skeleton_view(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return views.skeleton(c.lines(), c.symbols.where("idx > 0"))


@query(f"""select path, idx, case when idx = 0 then signature else '  ' || signature end as text, case when idx = 0 then (select count(*) from {_CONV_SYMBOLS} t where t.path = s.path and t.idx > 0) else 0 end::bigint as members from {_CONV_SYMBOLS} s""")
def outline_listing(spark, sf_dir):
    return views.outline_rows(conversations(spark, sf_dir).symbols).select("path", "idx", "text", F.col("members").cast("long").alias("members"))


@query(f"select md5(content) as digest, count(*)::bigint as n, min(path) as first_path from {_DOCS} group by 1")
def snapshot_dups(spark, sf_dir):
    s = documents(spark, sf_dir).sources
    return s.groupBy(F.md5("content").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


_OLD = f"(select path, content as new, case when len(l) = 1 then content else array_to_string(l[1 : greatest(len(l) // 2, 1)], chr(10)) || case when len(l) % 2 = 0 then 'x' else '' end end as old from (select path, content, string_split(content, chr(10)) as l from {_DOCS}))"


def _versions(spark, sf_dir):
    """Each document and an older version of it: its first half, changed where its lines are even in number."""
    s = documents(spark, sf_dir).sources.select("path", "content", F.split("content", "\n").alias("l"))
    n = F.size("l")
    half = F.concat(F.array_join(F.slice("l", F.lit(1), F.greatest(F.floor(n / 2), F.lit(1)).cast("int")), "\n"), F.when(n % 2 == 0, "x").otherwise(""))
    return changes.pairs(s.select("path", F.when(n == 1, F.col("content")).otherwise(half).alias("content")), s.select("path", "content"))


@query(f"select path, case when old = new then 'unchanged' when starts_with(new, old) then 'appended' else 'edited' end as change from {_OLD}")
def version_changes(spark, sf_dir):
    return changes.classify(_versions(spark, sf_dir)).select("path", "change")


@query(f"""with o as (select path, new, old from {_OLD} where old <> new and starts_with(new, old)),
  s as (select path, string_split(new, chr(10)) as l, len(string_split(old, chr(10))) - case when old <> '' and not ends_with(old, chr(10)) then 1 when ends_with(old, chr(10)) then 1 else 0 end as seen from o),
  r as (select path, l, seen, unnest(range(1, len(l) + 1)) as line from s)
  select path, line::integer as line, l[line] as text from r where line > seen and not (line = len(l) and l[line] = '')""")
def append_detect(spark, sf_dir):
    return changes.appended_lines(_versions(spark, sf_dir))


@query()
def diff_hunks(spark, sf_dir):
    return changes.diff_counts(changes.diff_hunks(_versions(spark, sf_dir)))


@query(f"""with n as (select path, case when idx = 0 then path else path || '.' || regexp_extract(name, '^[a-z]+') end as q, idx, signature, s as start from {_CONV_SYMBOLS}),
  b as (select path, q as qualified, row_number() over (partition by path, q order by idx) as nth, signature, start, idx % 2 as body from n),
  a as (select path, qualified, nth, case when nth = 2 then signature || '!' else signature end as signature, case when nth = 3 then 9 else body end as body from b where start % 7 <> 3),
  z as (select * from b where start % 11 <> 5)
  select coalesce(a.path, z.path) as path, coalesce(a.qualified, z.qualified) as qualified, coalesce(a.nth, z.nth)::integer as nth,
    case when a.path is null then 'added' when z.path is null then 'removed' when a.signature <> z.signature then 'signature' else 'body' end as change
  from a full join z on a.path = z.path and a.qualified = z.qualified and a.nth = z.nth where a.path is null or z.path is null or a.signature <> z.signature or a.body <> z.body""")
def symbol_changes(spark, sf_dir):
    s = conversations(spark, sf_dir).symbols.withColumn("qualified", F.when(F.col("idx") == 0, F.col("path")).otherwise(F.concat_ws(".", "path", F.regexp_extract("name", "^[a-z]+", 0))))
    b = changes.numbered(s).withColumn("body", F.col("idx") % 2)
    a = b.withColumn("signature", F.when(F.col("nth") == 2, F.concat("signature", F.lit("!"))).otherwise(F.col("signature"))).withColumn("body", F.when(F.col("nth") == 3, 9).otherwise(F.col("body")))
    return changes.compare(a.where("start % 7 <> 3"), b.where("start % 11 <> 5")).select("path", "qualified", "nth", "change")


@query("""select user_id from events where value > 30 group by user_id having count(distinct event_type) = (select count(distinct event_type) from events)""")
def structural_impl(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return sets.divide(e.where("value > 30"), e, ["user_id"], "event_type")


@query("""with recursive e as (select distinct 's' || l_suppkey::varchar as a, 'p' || l_partkey::varchar as b from lineitem), g as (select a, b from e union all select b, a from e),
  r as (select 's1' as node, 0 as level union select g.b, r.level + 1 from r join g on g.a = r.node where r.level < 3) select node, min(level)::integer as level from r group by node""")
def callers_bfs(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")).distinct()
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return sets.reach(both, spark.createDataFrame([("s1",)], "node string"), 3)


@query("""with c as (select l_partkey, l_suppkey, count(*) as n, max(l_quantity) as q from lineitem group by 1, 2),
  s as (select l_partkey, l_suppkey, case when n > 1 then 8 else 0 end + case when q > 25 then 3 else 0 end + case when s_acctbal > 0 then 1 else 0 end as score from c join supplier on s_suppkey = l_suppkey)
  select l_partkey, l_suppkey, score::integer as score from (select *, rank() over (partition by l_partkey order by score desc) as r from s) where r = 1""")
def callee_rank(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    s = c.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    point = lambda cond, n: F.when(cond, n).otherwise(0)
    score = point(F.col("n") > 1, 8) + point(F.col("q") > 25, 3) + point(F.col("s_acctbal") > 0, 1)
    return s.withColumn("score", score).withColumn("r", F.rank().over(W.partitionBy("l_partkey").orderBy(F.desc("score")))).where("r = 1").select("l_partkey", "l_suppkey", "score")


_WORDS = "unnest(list_filter(string_split_regex({0}, '[^A-Za-z]+'), lambda x: x <> ''))"


@query(f"select distinct {_WORDS.format('text')} as name from benchmark except select {_WORDS.format('content')} from {_DOCS}")
def external_names(spark, sf_dir):
    words = lambda df, c: df.select(F.explode(F.filter(F.split(c, "[^A-Za-z]+"), lambda w: w != "")).alias("name")).distinct()
    return words(table(spark, sf_dir, "benchmark"), "text").join(words(documents(spark, sf_dir).sources, "content"), "name", "left_anti")


@query(f"select path from {_DOCS} where regexp_matches(path, '^[^/]*/src1[^/]/[^/]*\\.txt$') and not regexp_matches(path, '^de/')")
def glob_paths(spark, sf_dir):
    return documents(spark, sf_dir).sources.where(glob_filter(F.col("path"), ["*/src1?/*.txt", "!de/**"])).select("path")


_EXT = ("rs", "py", "tsx", "h", "yml", "txt", "MD", "c++")


@query("select 'x/' || doc_id::varchar || '.' || ['rs', 'py', 'tsx', 'h', 'yml', 'txt', 'MD', 'c++'][1 + doc_id % 8] as path, ['rust', 'python', 'tsx', 'cpp', 'yaml', null, 'markdown', 'cpp'][1 + doc_id % 8] as lang from documents")
def language_detect(spark, sf_dir):
    ext = F.get(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 8).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), "text")
    return d.select("path", detect(F.col("path"), F.left("text", F.lit(8192))).alias("lang"))


@query("select 'e/' || event_id::varchar || '.json' as path, unnest(json_keys(props)) as name, unnest(range(len(json_keys(props))))::integer as idx from events where props is not null")
def json_outline(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("props is not null").select(F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.lit("json").alias("lang"), F.col("props").alias("content"))
    return outline.extract(e).where("depth = 0").select("path", "name", "idx")


@query(f"select path, regexp_extract(path, '[^/]*$') as file, len(list_filter(string_split_regex(path, '::|[.#/]'), lambda x: x <> ''))::integer as parts from {_DOCS}")
def name_parts(spark, sf_dir):
    return documents(spark, sf_dir).sources.select("path", file_name(F.col("path")).alias("file"), F.size(segments(F.col("path"))).alias("parts"))


@query()
def source_etags(spark, sf_dir):
    return documents(spark, sf_dir).sources.select("path", etag("content").alias("etag"))
