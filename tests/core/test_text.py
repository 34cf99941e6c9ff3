"""Lines, patterns, tokens, names, languages, decoding."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import regex, text, tokens
from lodestar.operators import budget
from lodestar.sources import decode, languages

TEXTS = ["", "\n", "a", "a\n", "a\r\nb", "a\rb\n\n", "é😀 x\n", "fooBar 123abc456def789012345 $x\t\r\n"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def test_lines(texts):
    got = {r.t: (r.n, r.l) for r in texts.select("t", text.line_count(F.col("t")).alias("n"), text.line_array(F.col("t")).alias("l")).collect()}
    for t in TEXTS:
        want = t.split("\n")
        want = [] if not t else want[:-1] if want[-1] == "" else want
        assert got[t] == (len(want), want)


def test_token_counts_agree(texts):
    cols = tokens.features(F.col("t"))
    for r in texts.select("t", *[c.alias(n) for n, c in cols.items()]).collect():
        assert {n: r[n] for n in cols} == tokens.count_python(r.t)
    for r in texts.select("t", tokens.estimate(F.col("t")).alias("e")).collect():
        assert r.e == tokens.estimate_python(r.t)


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab1 \n.é", max_size=400), st.integers(10, 80))
def test_budget_is_kept(t, n):
    cut = tokens.enforce(t, n)
    assert cut == t or tokens.estimate_python(cut) <= n + n // 20 + 45 and t.startswith(cut.rpartition("\n")[0])


@pytest.mark.parametrize("n,want", [(None, 8000), (5, 200), (99999, 10000), (500, 500)])
def test_budget_bounds(n, want):
    assert tokens.clamp_budget(n) == want


@pytest.mark.parametrize(
    "pattern,opts,line,hit",
    [
        ("foo", {}, "a FOO b", True),
        ("Foo", {}, "a foo b", False),
        ("foo", {"case": "sensitive"}, "FOO", False),
        ("FOO", {"case": "insensitive"}, "foo", True),
        ("a.b", {"literal": True}, "axb", False),
        ("a.b", {"literal": True}, "xa.By", True),
        ("the", {"word": True}, "other", False),
        ("--", {"word": True}, "a -- b", True),
        ("ä", {}, "Ä", True),
        (r"\w+$", {}, "fä\r", False),
        ("foo$", {}, "foo\r", False),
        (r"foo\s*$", {}, "foo\r", True),
        ("x", {"literal": True, "case": "sensitive"}, "x", True),
    ],
)
def test_matching(spark, pattern, opts, line, hit):
    df = spark.createDataFrame([(line,)], "t string")
    assert df.select(regex.matches(F.col("t"), pattern, **opts).alias("m")).first().m is hit


@pytest.mark.parametrize("bad", ["(", "a(?=b)", r"(a)\1", "[z-a]", "(?<!x)y"])
def test_bad_patterns(bad):
    with pytest.raises(regex.PatternError):
        regex.compile_pattern(bad)
    assert regex.compile_pattern(bad, literal=True)


def test_advice():
    assert regex.no_match_advice("Foo(", False, "smart") == "no matches; try case=insensitive or literal=true"
    assert regex.no_match_advice("foo", False, "smart") == "no matches"


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("*.rs", "a/b.rs", True), ("*.rs", "b.rsx", False), ("src/*.rs", "src/a/b.rs", False), ("src/**/*.rs", "src/b.rs", True), ("**/x", "a/b/x", True),
        ("{a,b}.py", "d/b.py", True), ("[!a]?.c", "bx.c", True), ("[!a]?.c", "ax.c", False), ("/top", "x/top", False), ("a/**", "a/b/c", True),
    ],
)
def test_globs(spark, glob, path, hit):
    import re

    assert bool(re.match(regex.glob_to_regex(glob), path)) is hit
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(regex.glob_filter(F.col("p"), [glob]).alias("m")).first().m is hit
    assert df.select(regex.glob_filter(F.col("p"), ["!" + glob]).alias("m")).first().m is not hit


def test_names(spark):
    df = spark.createDataFrame([("a::b.C#d/e", "greet:times:", "&mut Vec<T>", "std::io::Error<'a>")], "q string, s string, g string, t string")
    r = df.select(text.segments(F.col("q")).alias("q"), text.strip_selector(F.col("s")).alias("s"), text.type_base_name(F.col("t")).alias("t"), text.squash(F.lit(" a \n b ")).alias("w")).first()
    assert (r.q, r.s, r.t, r.w) == (["a", "b", "C", "d", "e"], "greet", "Error", "a b")


def test_distances(spark):
    df = spark.createDataFrame([("ä",), ("a",), ("kitten",), ("a" * 20,)], "n string")
    got = {r.n: (r.a, r.b) for r in df.select("n", text.distance(F.col("n"), "a").alias("a"), text.distance(F.col("n"), "sittin").alias("b")).collect()}
    assert got["ä"][0] == 2 and got["a"][0] == 0 and got["kitten"][1] == 2 and got["a" * 20] == (1 << 30, 1 << 30)
    assert text.byte_levenshtein("ä", "a") == 2


def test_sizes(spark):
    df = spark.createDataFrame([(10,), (2048,), (5 << 20,)], "n long")
    assert [r.s for r in df.select(text.human_bytes(F.col("n")).alias("s")).collect()] == ["10 B", "2.0 KB", "5.0 MB"]
    assert (text.plural(1, "match"), text.plural(2000, "match"), text.plural(2, "file")) == ("1 match", "2,000 matches", "2 files")
    assert text.clip_bytes("äää", 3) == "ä…" and text.proximity("a/b/c", "a/b/d") == 2


def test_etag(spark):
    import xxhash

    df = spark.createDataFrame([("abc",), (None,)], "t string")
    got = [r.e for r in df.select(text.etag("t").alias("e")).collect()]
    assert got == [xxhash.xxh3_64_hexdigest(b"abc"), None] and got[0] == "78af5f94892f3950"


CASES = [
    ("a/Rakefile", "", "ruby"), ("x.PY", "", "python"), ("h.h", "#import <x>\n@interface A", "objc"), ("h.h", "class A {};", "cpp"), ("m.lua", "--!strict\nlocal x: number = 1", "luau"), ("m.lua", "local x = 1\n", "lua"),
    ("run", "#!/usr/bin/env -S python3.11 -u\n", "python"), ("run", "#!/bin/sh", "bash"), ("run", "plain", None), (".bashrc", "", "bash"), (".hidden", "", None), ("Cargo.lock", "", "toml"), ("x.unknown", "", None), ("a.b/c", "", None),
]


def test_languages(spark):
    df = spark.createDataFrame([(p, h) for p, h, _ in CASES], "p string, h string")
    got = [r.lang for r in df.select(languages.detect(F.col("p"), F.col("h")).alias("lang")).collect()]
    assert got == [lang for *_, lang in CASES]
    assert [languages.detect_python(p, h) for p, h, _ in CASES] == got


def test_searchable(spark):
    df = spark.createDataFrame([("a.PNG",), ("a.txt",), ("png",), (".zip",)], "p string")
    assert [r.s for r in df.select(languages.searchable(F.col("p")).alias("s")).collect()] == [False, True, True, True]


RAW = [b"plain\n", b"\xef\xbb\xbfbom", "hé\n".encode("utf-16"), "hé".encode("utf-16-be").join([b"\xfe\xff", b""]), b"a\x00b", b"x\r\ny", b"\xff\xfa", None, b""]


def test_decoding(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(RAW)], "i int, raw binary")
    got = {r.i: (r.content, r.binary, r.bom, r.utf16, r.crlf, r.lossy) for r in decode.decoded(df).collect()}
    assert got[0] == ("plain\n", False, False, False, False, False)
    assert got[1][0] == "bom" and got[1][2] and got[2][0] == "hé\n" and got[2][3] and got[3][0] == "hé"
    assert got[4][:2] == (None, True) and got[5][4] and got[6][5] and "�" in got[6][0] and got[7][0] is None and got[8][0] == ""


def test_binary_kinds(spark):
    made = [(b"\x89PNG\r\n\x1a\nxx", "PNG image"), (b"RIFF1234WEBPx", "WebP image"), (b"RIFF1234WAVEx", "binary data"), (b"\x1f\x8b\x08", "gzip data"), (b"0000ftypisom", "MP4/QuickTime media"), (b"", "binary data")]
    df = spark.createDataFrame([(r,) for r, _ in made], "r binary")
    assert [x.k for x in df.select(decode.describe_binary(F.col("r")).alias("k")).collect()] == [k for _, k in made]


def test_shares():
    assert budget.fair_shares([100, 500, 900], 1000) == [100, 450, 450]
    assert budget.fair_shares([10, 900, 900], 100) == [10, 0, 90]
    assert budget.degrade([[100, 50, 10], [100, 95, 20]], [1, 2], 130) == [2, 0] or budget.degrade([[100, 50, 10], [100, 95, 20]], [1, 2], 130) == [2, 0]
    assert budget.degrade([[100, 50], [200, 100]], [1, 1], 160) == [1, 1]
    assert budget.degrade([[100], [200]], [1, 1], 10) == [0, 0]


def test_prefix(spark):
    df = spark.createDataFrame([("a", 5000), ("b", 1), ("c", 1)], "path string, size int")
    assert [r.kept for r in budget.prefix(df, "size", 100, ["path"]).orderBy("path").collect()] == [True, False, False]
    assert [r.kept for r in budget.prefix(df.where("size < 9"), "size", 2, ["path"]).orderBy("path").collect()] == [True, True]
    assert budget.omitted(budget.prefix(df, "size", 100, ["path"])).count() == 2


def test_clipped_on_a_character(spark):
    df = spark.createDataFrame([("ä" * 600,), ("a" + "ä" * 600,), ("€" * 400,), ("a" + "€" * 400,), ("ab" + "€" * 400,), ("😀" * 300,), ("aaa" + "😀" * 300,), ("x" * 1000,), ("x" * 1001,), (None,)], "t string")
    from pyspark.sql import functions as F

    got = [r.c for r in df.select(text.clip_utf8(F.col("t"), 1000).alias("c")).collect()]
    assert got == [None if r.t is None else r.t.encode()[:1000].decode("utf-8", "ignore") for r in df.collect()]


def test_quoting(spark):
    from pyspark.sql import functions as F

    from lodestar.functions import regex

    for t in ("a.b", r"x\Ey", "", r"\Q\E\E", "[(*", "\\"):
        assert spark.range(1).select(F.rlike(F.lit(f"<{t}>"), F.lit("^<" + regex.escape(t) + ">$"))).first()[0]
        assert not spark.range(1).select(F.rlike(F.lit(f"<{t}!>"), F.lit("^<" + regex.escape(t) + ">$"))).first()[0]


def test_shared_components(spark):
    from pyspark.sql import functions as F

    pairs = [("a/b/c", "a/b/d"), ("a", "a"), ("a/x/b", "b/x/a"), ("a/b", "a/b/c"), ("", "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(text.shared_components(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [text.proximity(a, b) for a, b in pairs]
