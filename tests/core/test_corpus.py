"""Corpora of our own: trees with ignore files, search, traces, views, changes, streams, the command line."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.corpus import Corpus
from lodestar.functions.regex import no_match_advice
from lodestar.operators import changes, lookup, occurrences, rollup, search, trace, views
from lodestar.sources.files import list_files, read_files
from lodestar.sources.ignore import Stack
from lodestar.streaming.tail import tail

PY = '''import util
from util import helper


class Base:
    def run(self):
        return self.step()

    def step(self):
        raise NotImplementedError


class Child(Base):
    def step(self):
        # helper() in a comment
        return helper("helper()") + local()


def local():
    return helper(1)


def loop(n):
    return loop(n - 1) if n else main()


def main():
    Child().run()
    print("x")
    loop(3)
'''
UTIL = "def helper(x):\n    return x\n\n\ndef other():\n    a.helper(2)\n"
GO = {
    "g/a.go": "package g\n\ntype Doer interface {\n\tDo(x int) error\n\tStop()\n}\n\ntype A struct{}\n\nfunc (a *A) Do(x int) error { return work() }\n\nfunc (a *A) Stop() {}\n\ntype B struct{}\n\nfunc (b B) Do(x int) error { return nil }\n",
    "g/b.go": "package g\n\nfunc work() error { return nil }\n",
    "h/c.go": "package h\n\nfunc work() error { return nil }\n\nfunc use() { work(); g.work() }\n",
}
TREE = {
    "app/main.py": PY,
    "app/util.py": UTIL,
    **GO,
    "README.md": "# Top\n\n## Part\ntext\n",
    "data/x.json": '{"k": {"v": 1}}\n',
    "bin.dat": "a\0b",
    ".gitignore": "*.log\nbuild/\n!keep.log\n/only\n",
    "a.log": "x",
    "keep.log": "token one\n",
    "build/out.txt": "x",
    "sub/only": "y",
    "only": "x",
    "sub/.ignore": "z*\n",
    "sub/zed": "x",
    "sub/.hidden": "h\n",
    "node_modules/m.js": "x",
    "nested/.git/HEAD": "x",
    "nested/b.log": "kept: rules outside a nested repository end there\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    (top / ".git").mkdir()
    for path, text in TREE.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    os.symlink("README.md", top / "link.md")
    return top


@pytest.fixture(scope="module")
def corpus(spark, root, tmp_path_factory):
    return Corpus.from_path(spark, str(root)).materialize(str(tmp_path_factory.mktemp("tables")))


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_walk(spark, root):
    want = sorted([".gitignore", "README.md", "app/main.py", "app/util.py", "bin.dat", "data/x.json", *GO, "keep.log", "link.md", "nested/b.log", "sub/.hidden", "sub/.ignore", "sub/only"])
    files = read_files(spark, str(root), content=False)
    assert paths(files) == want
    assert files.where("is_symlink").first().link_target == "README.md"
    assert paths(read_files(spark, str(root), globs=["*.py", "!util.py"])) == ["app/main.py"]
    assert paths(read_files(spark, str(root), globs=["a.log"])) == ["a.log"]
    assert paths(read_files(spark, str(root / "app/util.py"))) == ["util.py"]
    assert paths(read_files(spark, str(root / "sub"), content=False)) == [".hidden", ".ignore", "only"]
    assert "app/main.py" not in paths(read_files(spark, str(root), max_depth=1))
    few, more = list_files(files, 2)
    assert [r.path for r in few.collect()] == want[:2] and more


def test_ignore_rules():
    s = Stack().push("", "*.o\n!a.o\n/top\nd/\n# c\n\\#x\na/**/z\n").push("sub", "b\n!*.o\n")
    assert [s.ignores(p, d) for p, d in (("x.o", False), ("a.o", False), ("sub/x.o", False), ("top", False), ("q/top", False), ("d", False), ("d", True), ("#x", False), ("a/z", False), ("a/b/c/z", False), ("sub/q/b", False), ("b", False))] == [True, False, False, True, False, False, True, True, True, True, True, False]


def test_sources(corpus):
    got = {r.path: r for r in corpus.sources.collect()}
    assert got["bin.dat"].binary and got["bin.dat"].content is None
    assert (got["app/main.py"].lang, got["g/a.go"].lang, got["README.md"].lang, got["data/x.json"].lang, got["keep.log"].lang) == ("python", "go", "markdown", "json", None)
    assert got["app/util.py"].n_lines == 6


def test_roots_once(spark, root):
    both = Corpus.from_path(spark, str(root), str(root))
    assert both.files.count() == both.files.select("path").distinct().count()


def test_search(corpus):
    got = {(r.path, r.line): r for r in corpus.search("helper", word=True).collect()}
    assert got["app/util.py", 1].symbol == "helper" and got["app/main.py", 15].symbol == "Child.step" and got["app/main.py", 2].symbol is None
    files = {r.path: r.matches for r in corpus.search("helper", "files", word=True).collect()}
    assert files == {"app/main.py": 4, "app/util.py": 2}
    by = {(r.path, r.symbol.qualified if r.symbol else None): (r.matches, r.lines) for r in corpus.search("helper", "symbols", word=True).collect()}
    assert by["app/main.py", "Child.step"] == (2, [15, 16]) and by["app/main.py", None] == (1, [2])
    near = [(r.line, r.is_match) for r in corpus.search("def other", context=1).orderBy("line").collect()]
    assert near == [(4, False), (5, True), (6, False)]
    assert corpus.search("helper", globs=["*.go"]).count() == 0
    assert paths(corpus.search("work", "files", paths=["h"])) == ["h/c.go"]
    assert no_match_advice("X", False, "smart").startswith("no matches; try case")


def test_clips(spark):
    df = spark.createDataFrame([("a" * 500 + "x" + "b" * 500,), ("short x",)], "t string")
    long, short = [r.c for r in df.select(search.clip_around(F.col("t"), F.lit("x")).alias("c")).collect()]
    assert short == "short x" and "x" in long and len(long) <= search.LINE_CLIP + 2


def test_lookup(corpus):
    assert [r.qualified for r in corpus.find("Child.step").collect()] == ["Child.step"]
    assert [(r.path, r.qualified) for r in corpus.find("work").collect()] == [("g/b.go", "work"), ("h/c.go", "work")]
    assert [r.qualified for r in corpus.find("CHILD").collect()] == ["Child"]
    assert corpus.find("nothing").count() == 0
    assert [r.name for r in lookup.suggest_symbols(corpus.symbols, "helpr").collect()][:1] == ["helper"]
    assert [r.path for r in lookup.suggest_paths(corpus.sources, "src/utl.py").collect()][:1] == ["app/util.py"]
    some = paths(lookup.may_define(corpus.sources.where("content is not null"), ["helper"]))  # a filter, may keep more
    assert "app/util.py" in some and not any(p.endswith(".go") for p in some)


@pytest.fixture(scope="module")
def tracer(corpus):
    return trace.Tracer(corpus.sources, corpus.symbols, corpus.occurrences)


def names(rows):
    return sorted((r.level, r.to_path, r.to_name) for r in rows.collect())


def test_callers(corpus):
    got = corpus.trace("helper", "callers")
    assert names(got) == [(1, "app/main.py", "Child.step"), (1, "app/main.py", "local"), (1, "app/util.py", "other")]
    two = names(corpus.trace("helper", "callers", 3))
    assert (2, "app/main.py", "Child.step") in two  # local() is called there


def test_recursion(corpus):
    assert names(corpus.trace("loop", "callers")) == [(1, "app/main.py", "loop"), (1, "app/main.py", "main")]
    deep = names(corpus.trace("main", "callers", 3))
    assert deep == [(1, "app/main.py", "loop"), (2, "app/main.py", "main")]


def test_go_packages(corpus):
    first = corpus.find("work").first()
    assert first.path == "g/b.go"
    assert names(corpus.trace("g/b.go#work", "callers")) == [(1, "g/a.go", "A.Do"), (1, "h/c.go", "use")]
    assert names(corpus.trace("h/c.go#work", "callers")) == [(1, "h/c.go", "use")]


def test_refs(corpus, tracer):
    start = tracer.resolve("app/util.py#helper")
    g = tracer.groups(tracer.sites_of(start.select("path", "idx"), ("call", "ref", "import")))
    got = {(r.s_path, r.owner_idx is None): (r.n_calls, r.n_imports) for r in g.collect() if r.s_path == "app/main.py"}
    assert got["app/main.py", True] == (0, 1)
    n = trace.counts(g).first()
    assert n.calls == 3 and n.imports == 1


def test_callees(corpus, tracer):
    got = names(corpus.trace("main", "callees"))
    assert (1, "app/main.py", "Base.run") in got and (1, "app/main.py", "loop") in got and (1, "app/main.py", "Child") in got
    assert [r.name for r in tracer.external(tracer.resolve("main").select("path", "idx")).collect()] == ["print"]


def test_impls(corpus, tracer):
    assert names(corpus.trace("Base", "impls")) == [(1, "app/main.py", "Child")]
    assert names(corpus.trace("Doer", "impls")) == [(1, "g/a.go", "A")]
    assert [r.qualified for r in tracer.overrides(tracer.resolve("Base.step")).collect()] == ["Child.step"]


def test_targets(tracer):
    assert tracer.resolve("app/main.py:15").first().qualified == "Child.step"
    assert tracer.resolve("app/main.py:15:4").first().qualified == "Child.step"
    assert tracer.resolve("#helper").first().path == "app/util.py"
    assert trace.direction_of("Usages") == "refs"
    with pytest.raises(ValueError):
        trace.direction_of("sideways")


def most_rows(df):
    """The most rows that one operator of an executed plan made."""
    most, work = 0, [df._jdf.queryExecution().executedPlan()]
    while work:
        node = work.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            work.append(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        work += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_names_with_many_definitions(spark):
    """A method that every class defines and calls: the work grows with the classes, not with their pairs."""
    n = 150
    texts = spark.range(n).select(F.format_string("m/c%d.py", "id").alias("path"), F.format_string("class C%d:\n    def run(self):\n        return self.step()\n\n    def step(self):\n        return 1\n", "id").alias("text"))
    c = Corpus.from_table(texts, "path", "text")
    t = trace.Tracer(c.sources, c.symbols, c.occurrences)
    got = t.sites_of(t.defs.select("path", "idx"))
    assert sorted((r.t_path, r.s_path, r.name, r.line, r.attr) for r in got.collect()) == sorted((f"m/c{i}.py", f"m/c{i}.py", "step", 3, "target") for i in range(n))
    assert most_rows(got) <= 20 * n


MIXED = {
    "a/x.py": "class A:\n    def act(self):\n        self.act()\n        x().act()\n        q.act()\n        B.act()\n        super().act()\n        act()\n\n\ndef act():\n    C.act()\n",
    "a/y.py": "class B(A):\n    def act(self):\n        return self.act() + act()\n\n    class act:\n        pass\n\n\ndef f():\n    return self.act() + string.act() + p.act()\n",
    "a/z.java": "class C extends A {\n    int act() {\n        return act() + this.act();\n    }\n}\n\nclass D {\n    int f() {\n        return act() + A.act();\n    }\n}\n",
    "b/x.go": "package p\n\ntype A struct {\n}\n\nfunc (a *A) go2() int {\n\treturn a.go2() + p.go2() + go2()\n}\n\nfunc go2() int {\n\treturn x().go2()\n}\n",
    "b/y.go": "package q\n\nfunc go2() int {\n\treturn go2() + p.go2() + r.go2()\n}\n",
    "b/z.rs": "fn go2() -> i32 {\n    x().go2() + go2() + A::go2() + string.go2()\n}\n\nimpl A {\n    fn act() -> i32 {\n        Self::act() + act()\n    }\n}\n",
    "b/w.lua": "function act()\n  return string.act() + table.go2() + act()\nend\n\nfunction A:go2()\n  return self:go2()\nend\n",
    "c/w.py": "def g():\n    return act() + go2() + self.go2() + z.go2()\n",
}


def test_sites_by_what_they_mean(spark, monkeypatch):
    """Every pair that ``attribution`` keeps is met by key, and once."""
    c = Corpus.from_table(spark.createDataFrame(list(MIXED.items()), "path string, text string"), "path", "text")
    t = trace.Tracer(c.sources, c.symbols, c.occurrences)

    def rows():
        return sorted(map(repr, t.sites_of(t.defs.select("path", "idx"), ("call", "ref", "import")).collect()))

    got = rows()
    for f in ("given", "wanted"):  # all pairs of a name
        monkeypatch.setattr(trace, f, lambda: F.array(F.lit("A")))
    assert len(got) > 50 and got == rows()


def test_occurrences():
    got = {(line, name): (kind, q) for line, _, name, kind, q in occurrences.occurrences("use a::b;\nfn f() { self.g(); X::h::<T>(1); m!(x); y?.z; \"s()\" }\n", "rust")}
    assert got[1, "b"][0] == "import" and got[2, "g"] == ("call", "self") and got[2, "h"] == ("call", "X") and got[2, "m"][0] == "call" and (2, "s") not in got
    js = {n: (k, q) for _, _, n, k, q in occurrences.occurrences("a?.b(1); (x).c(); d", "javascript")}
    assert js["b"] == ("call", "a") and js["c"] == ("call", "") and js["d"] == ("ref", None)


def test_map(corpus):
    dirs = {r.dir: r.files for r in rollup.directories(corpus.files).collect()}
    assert dirs[""] == corpus.files.count() and dirs["app"] == 2 and dirs["g"] == 2
    text = corpus.map()
    assert "app/" in text and "main.py" in text and len(corpus.map(budget=200)) <= len(text)
    notes = {r.path: r.names for r in rollup.file_notes(corpus.files, corpus.sources, corpus.symbols).collect()}
    assert notes["app/util.py"] == "helper, other"
    recs = {r.path: r for r in rollup.records(corpus.files, corpus.sources).collect()}
    assert recs["link.md"].symlink == "README.md" and recs["link.md"].bytes is None and recs["bin.dat"].lines is None and recs["app/util.py"].lines == 6


@pytest.mark.parametrize(
    "text,want",
    [
        ("a/b.py", views.Target("a/b.py")),
        ("a/b.py:3-9", views.Target("a/b.py", (3, 9))),
        ("a/b.py:9-3", views.Target("a/b.py", (3, 9))),
        ("a/b.py:3-", views.Target("a/b.py", (3, None))),
        ("a/b.py:12", views.Target("a/b.py", around=12)),
        ("a/b.py:12:4", views.Target("a/b.py", around=12)),
        ("a/b.py#L5-L9", views.Target("a/b.py", (5, 9))),
        ("a/b.py#L5", views.Target("a/b.py", (5, 5))),
        ("a/b.py#C.m", views.Target("a/b.py", symbol="C.m")),
        ("#C.m", views.Target(None, symbol="C.m")),
        ("a/b.py@0123456789abcDEF", views.Target("a/b.py", since="0123456789abcdef")),
        ("odd:3", views.Target("odd:3")),
    ],
)
def test_target_grammar(text, want):
    assert views.parse_target(text, lambda p: p == "odd:3") == want


def test_read(corpus):
    whole = corpus.read(["app/util.py"])
    assert whole.startswith("== app/util.py@") and "1\tdef helper(x):" in whole
    assert "15\t" in corpus.read(["app/main.py#Child.step"]) and "27\t" not in corpus.read(["app/main.py#Child.step"])
    assert corpus.read(["app/util.py:5-6"]).count("\n") == 2
    assert "Base" in corpus.read(["app/main.py"], mode="outline") and "+2" in corpus.read(["app/main.py"], mode="outline")
    assert "did you mean helper" in corpus.read(["app/util.py#helpr"])
    assert "app/util.py" in corpus.read(["nowhere/util.py"])  # the only file of that name
    assert "binary file" in corpus.read(["bin.dat"])
    assert corpus.read(["g/*.go"]).count("== g/") == 2
    etag = whole.split("@")[1][:16]
    assert "unchanged" in corpus.read([f"app/util.py@{etag}"])
    assert "loop" in corpus.read(["#loop"])
    assert corpus.read(["app/main.py:21"]).count("\n") >= 2


def test_skeletons(spark):
    text = "// a\n// b\n// c\nimport x\nimport y\n\nimport z\nimport w\nfunction f() {\n  a\n  b\n  c\n}\n"
    c = Corpus.from_table(spark.createDataFrame([("m.js", text)], "p string, t string"), "p", "t")
    rows = [(r.line, r.last) for r in views.skeleton(c.lines(), c.symbols).orderBy("line").collect()]
    assert (10, 12) in rows and (9, 9) in rows and (10, 10) not in rows
    rows = [(r.line, r.last) for r in views.compact(c.lines(), c.symbols, c.sources).orderBy("line").collect()]
    assert rows == [(1, 1), (2, 3), (4, 4), (5, 8), (9, 9), (10, 12), (13, 13)]
    assert views.fitted(views.outline_rows(c.symbols), 0).count() == 1


def versions(spark, rows):
    return Corpus.from_table(spark.createDataFrame(rows, "p string, t string"), "p", "t")


def test_changes(spark, tmp_path):
    old = versions(spark, [("a.py", "def f():\n    return 1\n\n\ndef g(x):\n    return x\n\n\ndef h():\n    pass\n"), ("b.txt", "x\ny"), ("c.txt", "same\n"), ("d.txt", "gone\n")])
    new = versions(spark, [("a.py", "def f():\n    return 2\n\n\ndef g(x, y):\n    return x\n\n\ndef k():\n    pass\n"), ("b.txt", "x\nyz\nw\n"), ("c.txt", "same\n"), ("e.txt", "new\n")])
    both = changes.pairs(old.sources, new.sources)
    assert {r.path: r.change for r in changes.classify(both).collect()} == {"a.py": "edited", "b.txt": "appended", "c.txt": "unchanged", "d.txt": "removed", "e.txt": "added"}
    assert [(r.line, r.text) for r in changes.appended_lines(both).orderBy("line").collect()] == [(2, "yz"), (3, "w")]
    assert {(r.qualified, r.change, r.old_signature) for r in new.changes(old).where("path = 'a.py'").collect()} == {("f", "body", None), ("g", "signature", "def g(x)"), ("h", "removed", None), ("k", "added", None)}
    hunks = changes.diff_hunks(both)
    c = changes.shown_whole(changes.diff_counts(hunks), new.sources).first()
    assert (c.added, c.removed) == (3, 3)
    assert changes.labelled_hunks(hunks, new.symbols).orderBy("hunk").first().symbol == "f"
    snaps = changes.Snapshots(spark, str(tmp_path / "snaps"))
    snaps.remember(old.sources)
    snaps.remember(old.sources)
    assert snaps.table().count() == 4
    seen = old.etags()
    assert {r.path: r.change for r in snaps.since(new.sources, seen).collect()} == {"a.py": "edited", "b.txt": "appended", "c.txt": "unchanged"}
    etag = {r.path: r.etag for r in seen.collect()}
    assert "2\tyz" in new.read([f"b.txt@{etag['b.txt']}"], snapshots=snaps)


def test_refresh(spark, tmp_path):
    old = versions(spark, [("a.py", "def f(): pass\n"), ("b.py", "def g(): pass\n")]).materialize(str(tmp_path / "t"))
    new = versions(spark, [("a.py", "def f(): pass\n"), ("b.py", "def k(): pass\n"), ("c.py", "def m(): f()\n")])
    fresh = old.refresh(str(tmp_path / "t"), new)
    assert sorted(r.name for r in fresh.symbols.collect()) == ["f", "k", "m"]
    assert sorted(r.name for r in fresh.occurrences.where("kind = 'call'").collect())[-1] == "m"


def test_stream(spark, tmp_path):
    src, schema = tmp_path / "in", "path string, version int, content string"
    seen = []
    for k, rows in enumerate([[("a", 1, "x\ny")], [("a", 2, "x\nyz\nw\n"), ("b", 1, "q\n")], [("a", 3, "x\nyz\nw\n"), ("b", 2, "r\n")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = tail(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        now = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        rest = list(now)
        for r in seen:
            rest.remove(r)
        if k == 0:
            assert rest == [("a", "added", 1, "x"), ("a", "added", 2, "y")]
        elif k == 1:
            assert rest == [("a", "appended", 2, "yz"), ("a", "appended", 3, "w"), ("b", "added", 1, "q")]
        else:
            assert rest == [("b", "edited", 1, "r")]
        seen = now


def test_command_line(spark, root, capsys):
    def run(*args):
        out = io.StringIO()
        return cli.main(["--root", str(root), *args], spark, out), out.getvalue()

    code, text = run("search", "helper", "--output", "files")
    assert code == 0 and [json.loads(x)["path"] for x in text.splitlines()] == ["app/main.py", "app/util.py"]
    assert run("search", "zzz_nothing")[0] == 1 and run("search", "(")[0] == 2
    assert "helper" in run("symbols", "util.py")[1] and json.loads(run("symbols", "--json", "util.py")[1].splitlines()[0])["kind"] == "function"
    assert "app/" in run("map")[1] and json.loads(run("map", "--json", "app")[1].splitlines()[0])["path"] == "app/main.py"
    assert "== app/util.py" in run("read", "app/util.py")[1]
    assert json.loads(run("trace", "helper")[1].splitlines()[0])["level"] == 1


def test_big_files(spark, tmp_path):
    from lodestar.sources import bigfile

    path = str(tmp_path / "log.txt")
    text = [f"line {i} " + "x" * (i % 50) for i in range(1, 5001)]
    (tmp_path / "log.txt").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = bigfile.numbered(spark, path)
        assert lines.rdd.getNumPartitions() > 3 or lines.count() == 5000
        assert [r.text for r in bigfile.between(lines, 1020, 1030).orderBy("line").collect()] == text[1019:1030]
        assert [r.text for r in lines.orderBy("line").collect()] == text
        was = bigfile.describe(lines)
        old = spark.createDataFrame(was.collect(), was.schema)
        (tmp_path / "log.txt").write_text("\n".join([*text, "more"]) + "\n")
        assert bigfile.continues(old, bigfile.numbered(spark, path)).first().appended
        (tmp_path / "log.txt").write_text("\n".join(["other", *text[1:], "more"]) + "\n")
        assert not bigfile.continues(old, bigfile.numbered(spark, path)).first().appended
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_too_large_for_a_row(spark, tmp_path, monkeypatch):
    """A file over the limit is found by listings, search and read, and its lines are numbered."""
    import lodestar.corpus as module

    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "log.txt").write_text("".join(f"line {i} {'needle' if i == 777 else 'hay'}\n" for i in range(1, 2001)))
    (tmp_path / "small.py").write_text("def needle():\n    pass\n")
    monkeypatch.setattr(module, "MEMORY_LIMIT", 10_000)
    c = module.Corpus.from_path(spark, str(tmp_path))
    assert sorted((r.path, r.matches) for r in c.search("needle", "files").collect()) == [("a b/log.txt", 1), ("small.py", 1)]
    assert [(r.path, r.line) for r in c.search("needle", globs=["*.txt"]).collect()] == [("a b/log.txt", 777)]
    kept = c.materialize(str(tmp_path / "tables"))
    assert kept.lines().where("path = 'a b/log.txt'").count() == 2000 and kept.files.count() == 2
    text = kept.read(["a b/log.txt:777-778"])
    assert "777\tline 777 needle" in text and "778\tline 778 hay" in text
    head = kept.read(["a b/log.txt"])
    assert "1\tline 1 hay" in head and "2000\tline 2000 hay" in head and "1700 lines" in head


def test_running(spark):
    from lodestar.operators.running import running

    df = spark.range(1000).selectExpr("id", "id % 7 as size").repartition(9)
    got = sorted((r.nth, r.id, r.upto_size) for r in running(df, ["id"], "size").collect())
    assert got == [(i + 1, i, sum(j % 7 for j in range(i + 1))) for i in range(1000)]
