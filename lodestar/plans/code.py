"""Queries that run the library over source code made from the tables: outlines, occurrences, traces, versions.

The code is a fixed text a language with a number in it, one file for each supplier, so that SQL can say what must be
found; the calls between the Python files follow arithmetic on those numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.corpus import Corpus
from lodestar.operators import changes, lookup, trace
from lodestar.session import shared_path

# A text for each language, ``@`` for the number, and the symbols in it: name, qualified name, kind, first and
# last line, depth.
TEXTS: dict[str, tuple[str, str, list[tuple[str, str, str, int, int, int]]]] = {
    "python": ("py", "import os\n\n\nclass C@(Base):\n    def m@(self):\n        return f@()\n\n    def h@(self):\n        return ext()\n\n\ndef f@():\n    return C@()\n", [("C@", "C@", "class", 4, 9, 0), ("m@", "C@.m@", "method", 5, 6, 1), ("h@", "C@.h@", "method", 8, 9, 1), ("f@", "f@", "function", 12, 13, 0)]),
    "rust": ("rs", "use std::fmt;\n\npub struct C@ {\n    x: i32,\n}\n\nimpl C@ {\n    pub fn m@(&self) -> i32 {\n        self.x\n    }\n}\n\npub trait T@ {\n    fn g@(&self);\n}\n\nfn f@() -> i32 {\n    3\n}\n", [("C@", "C@", "struct", 3, 5, 0), ("C@", "C@", "impl", 7, 11, 0), ("m@", "C@.m@", "method", 8, 10, 1), ("T@", "T@", "trait", 13, 15, 0), ("g@", "T@.g@", "method", 14, 14, 1), ("f@", "f@", "function", 17, 19, 0)]),
    "go": ("go", "package p\n\ntype C@ struct {\n\tx int\n}\n\ntype T@ interface {\n\tG@()\n}\n\nfunc (c *C@) M@() int {\n\treturn c.x\n}\n\nfunc F@() int {\n\treturn 3\n}\n", [("C@", "C@", "struct", 3, 5, 0), ("T@", "T@", "interface", 7, 9, 0), ("G@", "T@.G@", "method", 8, 8, 1), ("M@", "C@.M@", "method", 11, 13, 0), ("F@", "F@", "function", 15, 17, 0)]),
    "java": ("java", "package p;\n\npublic class C@ extends Base {\n    private int x;\n\n    public C@() {\n        x = 1;\n    }\n\n    public int m@() {\n        return x;\n    }\n}\n\ninterface T@ {\n    int g@();\n}\n", [("C@", "C@", "class", 3, 13, 0), ("C@", "C@.C@", "constructor", 6, 8, 1), ("m@", "C@.m@", "method", 10, 12, 1), ("T@", "T@", "interface", 15, 17, 0), ("g@", "T@.g@", "method", 16, 16, 1)]),
    "javascript": ("js", "class C@ extends Base {\n  constructor() {\n    super();\n  }\n\n  m@() {\n    return f@();\n  }\n}\n\nfunction f@() {\n  return 3;\n}\n\nconst a@ = () => {\n  return 1;\n};\n", [("C@", "C@", "class", 1, 9, 0), ("constructor", "C@.constructor", "constructor", 2, 4, 1), ("m@", "C@.m@", "method", 6, 8, 1), ("f@", "f@", "function", 11, 13, 0), ("a@", "a@", "function", 15, 17, 0)]),
    "typescript": ("ts", "interface T@ {\n  g@(): number;\n}\n\nexport class C@ implements T@ {\n  g@(): number {\n    return 1;\n  }\n}\n\nexport function f@(): number {\n  return 3;\n}\n\nenum E@ {\n  A,\n}\n", [("T@", "T@", "interface", 1, 3, 0), ("g@", "T@.g@", "method", 2, 2, 1), ("C@", "C@", "class", 5, 9, 0), ("g@", "C@.g@", "method", 6, 8, 1), ("f@", "f@", "function", 11, 13, 0), ("E@", "E@", "enum", 15, 17, 0)]),
    "c": ("c", "#include <stdio.h>\n\nstruct s@ {\n    int x;\n};\n\nint f@(int a) {\n    return a;\n}\n\nstatic void g@(void) {\n    f@(1);\n}\n", [("s@", "s@", "struct", 3, 5, 0), ("f@", "f@", "function", 7, 9, 0), ("g@", "g@", "function", 11, 13, 0)]),
    "cpp": ("cpp", "namespace n@ {\n\nclass C@ : public Base {\npublic:\n    int m@() {\n        return 1;\n    }\n};\n\nint f@(int a) {\n    return a;\n}\n\n}\n", [("n@", "n@", "module", 1, 14, 0), ("C@", "n@.C@", "class", 3, 8, 1), ("m@", "n@.C@.m@", "method", 5, 7, 2), ("f@", "n@.f@", "function", 10, 12, 1)]),
    "csharp": ("cs", "namespace N@ {\n    public class C@ : Base {\n        public int M@() {\n            return 1;\n        }\n    }\n\n    interface T@ {\n        int G@();\n    }\n}\n", [("N@", "N@", "module", 1, 11, 0), ("C@", "N@.C@", "class", 2, 6, 1), ("M@", "N@.C@.M@", "method", 3, 5, 2), ("T@", "N@.T@", "interface", 8, 10, 1), ("G@", "N@.T@.G@", "method", 9, 9, 2)]),
    "ruby": ("rb", "module M@\n  class C@ < Base\n    def m@\n      1\n    end\n  end\nend\n\ndef f@\n  3\nend\n", [("M@", "M@", "module", 1, 7, 0), ("C@", "M@.C@", "class", 2, 6, 1), ("m@", "M@.C@.m@", "method", 3, 5, 2), ("f@", "f@", "function", 9, 11, 0)]),
    "php": ("php", "<?php\n\nclass C@ extends Base {\n    public function m@() {\n        return 1;\n    }\n}\n\nfunction f@() {\n    return 3;\n}\n", [("C@", "C@", "class", 3, 7, 0), ("m@", "C@.m@", "method", 4, 6, 1), ("f@", "f@", "function", 9, 11, 0)]),
    "swift": ("swift", "struct S@ {\n    func m@() -> Int {\n        return 1\n    }\n}\n\nprotocol T@ {\n    func g@()\n}\n\nfunc f@() -> Int {\n    return 3\n}\n", [("S@", "S@", "struct", 1, 5, 0), ("m@", "S@.m@", "method", 2, 4, 1), ("T@", "T@", "interface", 7, 9, 0), ("g@", "T@.g@", "method", 8, 8, 1), ("f@", "f@", "function", 11, 13, 0)]),
    "kotlin": ("kt", "class C@ : Base() {\n    fun m@(): Int {\n        return 1\n    }\n}\n\ninterface T@ {\n    fun g@()\n}\n\nfun f@(): Int {\n    return 3\n}\n", [("C@", "C@", "class", 1, 5, 0), ("m@", "C@.m@", "method", 2, 4, 1), ("T@", "T@", "interface", 7, 9, 0), ("g@", "T@.g@", "method", 8, 8, 1), ("f@", "f@", "function", 11, 13, 0)]),
    "scala": ("scala", "class C@ extends Base {\n  def m@(): Int = {\n    1\n  }\n}\n\ntrait T@ {\n  def g@(): Int\n}\n", [("C@", "C@", "class", 1, 5, 0), ("m@", "C@.m@", "method", 2, 4, 1), ("T@", "T@", "trait", 7, 9, 0), ("g@", "T@.g@", "method", 8, 8, 1)]),
    "lua": ("lua", "local function f@()\n  return 3\nend\n\nfunction g@(x)\n  return x\nend\n", [("f@", "f@", "function", 1, 3, 0), ("g@", "g@", "function", 5, 7, 0)]),
    "bash": ("sh", "#!/bin/bash\n\nf@() {\n  echo 3\n}\n\nfunction g@ {\n  f@\n}\n", [("f@", "f@", "function", 3, 5, 0), ("g@", "g@", "function", 7, 9, 0)]),
    "objc": ("m", "@@implementation C@\n- (int)m@ {\n    return 1;\n}\n@@end\n", [("C@", "C@", "class", 1, 5, 0), ("m@", "C@.m@", "method", 2, 4, 1)]),
    "markdown": ("md", "# A@\n\ntext\n\n## B@\n\nmore\n```\n# no\n```\n# C@\n", [("A@", "A@", "heading", 1, 10, 0), ("B@", "A@.B@", "heading", 5, 10, 1), ("C@", "C@", "heading", 11, 11, 0)]),
    "yaml": ("yaml", "a@:\n  b: |\n    x: 1\n  c: 2\nd@: x\n", [("a@", "a@", "key", 1, 4, 0), ("b", "a@.b", "key", 2, 3, 1), ("c", "a@.c", "key", 4, 4, 1), ("d@", "d@", "key", 5, 5, 0)]),
    "toml": ("toml", "[a@]\nx = 1\n\n[[b@]]\ny = 2\n", [("a@", "a@", "section", 1, 2, 0), ("b@", "b@", "section", 4, 5, 0)]),
    "json": ("json", '{\n  "a@": {\n    "b": 1\n  },\n  "c@": [1, 2]\n}\n', [("a@", "a@", "key", 2, 4, 0), ("b", "a@.b", "key", 3, 3, 1), ("c@", "c@", "key", 5, 5, 0)]),
}
# Fixed value: a Python file, ``@k`` its number, ``@b`` that of its base class, ``@c`` that of the function it calls.
MODULE = "class C@k(C@b):\n    def run(self):\n        self.step@k()\n        return f@c()\n\n    def step@k(self):\n        return f@k()\n\n\ndef f@k():\n    print(@k)\n    return C@k()\n"
# Fixed value: texts that a task reads for symbols.
PER_TASK = 1000
_S = "(select s_suppkey as k, s_suppkey // 2 as b, (s_suppkey * 3 + 1) % (select count(*) from supplier) as c from supplier)"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    n = s.count()
    # a row of a few bytes becomes a text to be read for symbols: dealt out by rows, the table is one task
    return s.repartition(1 + n // PER_TASK, "k").select("k", F.expr("k div 2").alias("b"), ((F.col("k") * 3 + 1) % F.lit(n)).alias("c"))


def _filled(text: str, *names: str):
    out = F.lit(text)
    for n in names:
        out = F.replace(out, F.lit("@" + n), F.col(n or "k").cast("string"))
    return out


def modules(spark: SparkSession, sf_dir: str, text: str = MODULE) -> Corpus:
    """The Python files, their symbols and occurrences written once."""
    s = _numbers(spark, sf_dir).select(F.concat(F.lit("pkg/s"), F.col("k").cast("string"), F.lit(".py")).alias("path"), _filled(text, "k", "b", "c").alias("text"))
    return Corpus.from_table(s, "path", "text").materialize(shared_path(spark, "corpus"))


def _tracer(spark, sf_dir) -> trace.Tracer:
    c = modules(spark, sf_dir)
    return trace.Tracer(c.sources, c.symbols, c.occurrences)


def _outline_query(lang: str):
    ext, text, _ = TEXTS[lang]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body = F.replace(F.replace(F.replace(F.lit(text), F.lit("@@"), F.lit("\1")), F.lit("@"), F.col("k").cast("string")), F.lit("\1"), F.lit("@"))
        s = _numbers(spark, sf_dir).select(F.concat(F.lit("x/"), F.col("k").cast("string"), F.lit(f".{ext}")).alias("path"), body.alias("text"))
        return Corpus.from_table(s, "path", "text").symbols.select("path", "lang", "idx", "name", "qualified", "kind", F.col("start").alias("first"), F.col("end").alias("last"), "depth")

    return run


def _outline_sql(lang: str) -> str:
    ext, _, symbols = TEXTS[lang]
    rows = ", ".join(f"({i}, '{n}', '{q}', '{kind}', {a}, {b}, {d})" for i, (n, q, kind, a, b, d) in enumerate(symbols))
    return f"""select 'x/' || k::varchar || '.{ext}' as path, '{lang}' as lang, idx::integer as idx, replace(name, '@', k::varchar) as name, replace(qualified, '@', k::varchar) as qualified, kind,
      v.first::integer as first, v.last::integer as last, v.depth::integer as depth from {_S}, (values {rows}) v(idx, name, qualified, kind, first, last, depth)"""


def call_sites(spark, sf_dir):
    """Every call with the definition it means and the symbol around it."""
    t = _tracer(spark, sf_dir)
    s = t.sites_of(t.defs.select("path", "idx"), ("call",))
    own = t.symbols.select(F.col("path").alias("s_path"), F.col("idx").alias("owner_idx"), F.col("qualified").alias("caller"))
    return s.join(own, ["s_path", "owner_idx"], "left").select("name", "t_path", "s_path", "line", "caller", "attr")


CALL_SITES = f"""select 'step' || k::varchar as name, 'pkg/s' || k::varchar || '.py' as t_path, 'pkg/s' || k::varchar || '.py' as s_path, 3::integer as line, 'C' || k::varchar || '.run' as caller, 'target' as attr from {_S}
  union all select 'f' || c::varchar, 'pkg/s' || c::varchar || '.py', 'pkg/s' || k::varchar || '.py', 4, 'C' || k::varchar || '.run', 'target' from {_S}
  union all select 'f' || k::varchar, 'pkg/s' || k::varchar || '.py', 'pkg/s' || k::varchar || '.py', 7, 'C' || k::varchar || '.step' || k::varchar, 'target' from {_S}
  union all select 'C' || k::varchar, 'pkg/s' || k::varchar || '.py', 'pkg/s' || k::varchar || '.py', 12, 'f' || k::varchar, 'target' from {_S}"""


def reference_counts(spark, sf_dir):
    """Calls, references and scopes of every class, over the groups of its sites by enclosing symbol."""
    t = _tracer(spark, sf_dir)
    keys = t.defs.where("kind = 'class'").select("path", "idx")
    g = t.groups(t.sites_of(keys, ("call", "ref", "import")))
    return g.groupBy("t_path").agg(F.sum("n_calls").alias("calls"), F.sum("n_refs").alias("refs"), F.countDistinct("s_path", F.coalesce("owner_idx", F.lit(-1))).alias("scopes"))


REFERENCE_COUNTS = f"""select 'pkg/s' || k::varchar || '.py' as t_path, 1::bigint as calls, (select count(*) from {_S} o where o.b = s.k and o.k <> s.k)::bigint as refs, (1 + (select count(*) from {_S} o where o.b = s.k and o.k <> s.k))::bigint as scopes from {_S} s"""


def callers_tree(spark, sf_dir):
    return _tracer(spark, sf_dir).trace("f5", "callers", 3).select("level", "from_path", "to_path", "to_name", "n", "uncertain")


CALLERS_TREE = f"""select 1::integer as level, 'pkg/s5.py' as from_path, 'pkg/s' || k::varchar || '.py' as to_path, 'C' || k::varchar || '.run' as to_name, 1::bigint as n, false as uncertain from {_S} where c = 5
  union all select 1, 'pkg/s5.py', 'pkg/s5.py', 'C5.step5', 1, false union all select 2, 'pkg/s5.py', 'pkg/s5.py', 'C5.run', 1, false"""


def callees_tree(spark, sf_dir):
    return _tracer(spark, sf_dir).trace("pkg/s4.py#run", "callees", 3).select("level", "from_path", "to_path", "to_name", "n", "uncertain")


CALLEES_TREE = f"""with s as (select c from {_S} where k = 4)
  select 1::integer as level, 'pkg/s4.py' as from_path, 'pkg/s4.py' as to_path, 'C4.step4' as to_name, 1::bigint as n, false as uncertain union all select 1, 'pkg/s4.py', 'pkg/s' || c::varchar || '.py', 'f' || c::varchar, 1, false from s
  union all select 2, 'pkg/s4.py', 'pkg/s4.py', 'f4', 1, false where (select c from s) <> 4 union all select 2, 'pkg/s' || c::varchar || '.py', 'pkg/s' || c::varchar || '.py', 'C' || c::varchar, 1, false from s
  union all select 3, 'pkg/s4.py', 'pkg/s4.py', 'C4', 1, false where (select c from s) <> 4 union all select 3, 'pkg/s' || c::varchar || '.py', p, n, 1, false from s,
    lateral (select unnest(['pkg/s' || c::varchar || '.py', 'pkg/s' || ((c * 3 + 1) % (select count(*) from supplier))::varchar || '.py', 'pkg/s' || c::varchar || '.py']) as p,
      unnest(['C' || c::varchar || '.step' || c::varchar, 'f' || ((c * 3 + 1) % (select count(*) from supplier))::varchar, 'f' || c::varchar]) as n)"""


def subtypes(spark, sf_dir):
    return _tracer(spark, sf_dir).trace("C1", "impls").select("level", "from_path", "to_path", "to_name")


SUBTYPES = f"""with recursive r as (select 0 as level, 0::bigint as p, 1::bigint as k union all select r.level + 1, r.k, s.k from r join {_S} s on s.b = r.k where r.level < 3)
  select level::integer as level, 'pkg/s' || p::varchar || '.py' as from_path, 'pkg/s' || k::varchar || '.py' as to_path, 'C' || k::varchar as to_name from r where level > 0"""


def outer_names(spark, sf_dir):
    """Names that functions call and nothing in the corpus defines."""
    t = _tracer(spark, sf_dir)
    calls = t.calls_in(t.defs.where("kind = 'function'").select("path", "idx"))
    return calls.join(t.defs.select("name").distinct(), "name", "left_anti").select("path", "name", "n", "first")


OUTER_NAMES = f"select 'pkg/s' || k::varchar || '.py' as path, 'print' as name, 1::bigint as n, 11::integer as first from {_S}"


def class_bases(spark, sf_dir):
    return _tracer(spark, sf_dir).heritage().select("path", "name", "base")


CLASS_BASES = f"select 'pkg/s' || k::varchar || '.py' as path, 'C' || k::varchar as name, 'C' || b::varchar as base from {_S} where k > 0"


def definitions_found(spark, sf_dir):
    """Definitions of a method's name, best first."""
    c = modules(spark, sf_dir)
    return lookup.ranked(lookup.named(c.symbols, "c9.RUN"), "run").select("path", "qualified", "kind", F.col("start").alias("first"))


DEFINITIONS_FOUND = "select 'pkg/s9.py' as path, 'C9.run' as qualified, 'method' as kind, 2::integer as first where (select count(*) from supplier) >= 9"


def name_occurrences(spark, sf_dir):
    """Calls by name and qualifier, numbers in names taken away; a definition's own name is none."""
    name = F.regexp_replace("name", "[0-9]+$", "")
    return _tracer(spark, sf_dir).sites.where(F.col("kind") == "call").groupBy(name.alias("name"), "qualifier").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"))


NAME_OCCURRENCES = f"select name, qualifier, (count(*) * t)::bigint as n, (count(*) * l)::bigint as lines from {_S}, (values ('step', 'self', 1, 3), ('f', null, 2, 11), ('print', null, 1, 11), ('C', null, 1, 12)) v(name, qualifier, t, l) group by name, qualifier, t, l"


def _older(spark, sf_dir) -> Corpus:
    """An earlier version: by number modulo 4, another body of f, another signature of run, no f, or the same."""
    s = _numbers(spark, sf_dir)
    text = _filled(MODULE, "k", "b", "c")
    k4 = F.col("k") % 4
    old = F.when(k4 == 0, F.replace(text, F.lit("    print("), F.lit("    show("))).when(k4 == 1, F.replace(text, F.lit("run(self)"), F.lit("run(self, x)"))).when(k4 == 2, F.regexp_replace(text, r"(?s)\n\ndef .*$", "")).otherwise(text)
    return Corpus.from_table(s.select(F.concat(F.lit("pkg/s"), F.col("k").cast("string"), F.lit(".py")).alias("path"), old.alias("text")), "path", "text")


def code_changes(spark, sf_dir):
    now = modules(spark, sf_dir)
    return now.changes(_older(spark, sf_dir)).select("path", "qualified", "change", "old_signature")


CODE_CHANGES = f"""select 'pkg/s' || k::varchar || '.py' as path, case k % 4 when 1 then 'C' || k::varchar || '.run' else 'f' || k::varchar end as qualified, ['body', 'signature', 'added'][1 + k % 4] as change,
  case k % 4 when 1 then 'def run(self, x)' end as old_signature from {_S} where k % 4 < 3"""


def seen_versions(spark, sf_dir):
    """What became of versions shown earlier, looked up by their etags in a snapshot store."""
    old, now = _older(spark, sf_dir), modules(spark, sf_dir)
    store = changes.Snapshots(spark, shared_path(spark, "snapshots"))
    store.remember(old.sources)
    store.remember(old.sources)
    return store.since(now.sources, old.etags()).select("path", "change")


SEEN_VERSIONS = f"select 'pkg/s' || k::varchar || '.py' as path, ['edited', 'edited', 'appended', 'unchanged'][1 + k % 4] as change from {_S}"


def go_interfaces(spark, sf_dir):
    """Go types whose methods cover an interface of their directory: those with an even number."""
    head = "package p\n\ntype T@k interface {\n\tG()\n\tH() int\n}\n\ntype C@k struct {\n}\n\nfunc (c *C@k) G() {\n}\n"
    s = _numbers(spark, sf_dir).withColumn("text", F.when(F.col("k") % 2 == 0, _filled(head + "\nfunc (c C@k) H() int {\n\treturn 1\n}\n", "k")).otherwise(_filled(head, "k")))
    s = s.select(F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("/a.go")).alias("path"), "text")
    c = Corpus.from_table(s, "path", "text").materialize(shared_path(spark, "corpus"))
    return trace.Tracer(c.sources, c.symbols, c.occurrences).structural().select("path", "base_path")


GO_INTERFACES = f"select 'd' || k::varchar || '/a.go' as path, 'd' || k::varchar || '/a.go' as base_path from {_S} where k % 2 = 0"

_NAMES = "call_sites reference_counts callers_tree callees_tree subtypes outer_names class_bases definitions_found name_occurrences code_changes seen_versions go_interfaces".split()
QUERIES = {f"outline_{lang}": _outline_query(lang) for lang in TEXTS} | {n: globals()[n] for n in _NAMES}
SQL = {f"outline_{lang}": _outline_sql(lang) for lang in TEXTS} | {n: globals()[n.upper()] for n in _NAMES}
