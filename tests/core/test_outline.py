"""Outlines of texts of our own: structured formats exactly, code by family."""

import textwrap

import pytest

from lodestar.operators import block, lexer
from lodestar.operators.outline import extract, innermost, outline
from lodestar.operators.symbols import qualified


def shown(text, lang):
    got = outline(textwrap.dedent(text).lstrip("\n"), lang)
    return [f"{'  ' * s.depth}{s.kind} {qualified(got, i)} {s.start}-{s.end}" + (f" [{s.collapse[0]}-{s.collapse[1]}]" if s.collapse else "") for i, s in enumerate(got)]


CASES = {
    ("markdown", "headings"): (
        "---\n# no\n---\n# One #\ntext\n\n## Two\n```\n# not\n```\na\nb\n\nSetext\n======\nx\n~~~~\n~~~\n# no\n~~~~\n####### no\n",
        ["heading One 4-12", "  heading One.Two 7-12 [8-12]", "heading Setext 14-21 [15-21]"],
    ),
    ("json", "keys"): (
        '{\n  // c\n  "a": {\n    "b": [1,\n      {"x": 1}],\n    "c": "s:\\"{"\n  },\n  "long": [\n    1,\n    2,\n    3\n  ]\n}\n',
        ["key a 3-7", "  key a.b 4-5", "  key a.c 6-6", "key long 8-12 [9-11]"],
    ),
    ("yaml", "keys"): (
        "# c\non:\n  push: [a]\n  run: |\n    key: no\n    x\njobs:\n  - name: b\n    with: c\nurl: http://x:80 # d\n{a: 1}\n",
        ["key on 2-6", "  key on.push 3-3", "  key on.run 4-6", "key jobs 7-9", "  key jobs.name 8-8", "  key jobs.with 9-9", "key url 10-11"],
    ),
    ("toml", "tables"): (
        'a = 1\n[x.y]\nb = """\n[no]\n"""\n[[z]]\nc = 1\nd = 2\ne = 3\n\n["q.r"]\n',
        ["section x.y 2-5 [3-5]", "section z 6-9 [7-9]", "section q.r 11-11"],
    ),
    ("python", "classes"): (
        '''
        import os


        @deco
        class A(Base):
            """Doc."""

            # note
            def m(self):
                """Say."""
                def inner():
                    pass
                return inner

            class B:
                x = 1


        async def f(a, *, b=")"): return 1
        ''',
        ["class A 4-16", "  method A.m 8-13 [11-13]", "  class A.B 15-16", "function f 19-19"],
    ),
    ("python", "broken"): ("def f(:\n    x\n    y\n    z\n\nclass A:\n    def m(self):\n        pass\n", ["function f 1-4 [2-4]", "class A 6-8", "  method A.m 7-8"]),
    ("rust", "impl"): (
        """
        /// Docs.
        #[derive(Debug)]
        pub struct S<'a> { s: &'a str }

        impl<'a> fmt::Display for S<'a> {
            fn fmt(&self) -> R {
                let c = '{';
                let t = "}";
                x
            }
        }
        trait T { fn need(&self); }
        """,
        ["struct S 1-3", "impl S 5-11", "  method S.fmt 6-10 [7-9]", "trait T 12-12", "  method T.need 12-12"],
    ),
    ("go", "methods"): (
        """
        package p

        // A does.
        type A struct {
            x int
        }

        type I interface {
            Do(x int) error
        }

        func (a *A) Do(x int) error {
            if x > 0 { return nil }
            y := 1
            return y
        }
        """,
        ["struct A 3-6", "interface I 8-10", "  method I.Do 9-9", "method A.Do 12-16 [13-15]"],
    ),
    ("typescript", "forms"): (
        """
        export default class C<T> extends D {
          constructor(a: string) { super(a) }
          async m(x: () => void): Promise<{a: 1}> {
            if (x) { return f(`${g({})}`) }
            return 1
            // }
          }
        }
        export const h = async (a: number): Promise<void> => {
          await a
          await a
          await a
        }
        type U = { a: 1 }
        function* gen() {}
        """,
        ["class C 1-8", "  constructor C.constructor 2-2", "  method C.m 3-7 [4-6]", "function h 9-13 [10-12]", "type U 14-14", "function gen 15-15"],
    ),
    ("java", "nesting"): (
        """
        package a;
        /** Doc
         */
        public class K extends L implements M<N> {
            private int x = f(1);
            public K(int x) { this.x = x; }
            @Override public <T> List<T> get(String s) throws E {
                for (;;) { }
            }
            enum E2 { A, B }
        }
        interface Q { void q(); }
        """,
        ["class K 2-11", "  constructor K.K 6-6", "  method K.get 7-9", "  enum K.E2 10-10", "interface Q 12-12", "  method Q.q 12-12"],
    ),
    ("cpp", "scopes"): (
        """
        #include <x>
        namespace n {
        class V {
        public:
            V(int a) : a_(a) {}
            int dot(const V& o) const;
        };
        }
        int n::V::dot(const V& o) const {
            int r = 0;
            r += o.a_;
            return r;
        }
        """,
        ["module n 2-8", "  class n.V 3-7", "    method n.V.V 5-5", "    method n.V.dot 6-6", "method n.V.dot 9-13 [10-12]"],
    ),
    ("ruby", "ends"): (
        """
        module M
          class K < B
            def a(x)
              if x
                y
              end
              z
            end
            def self.b; end
          end
        end
        """,
        ["module M 1-11", "  class M.K 2-10", "    method M.K.a 3-8 [4-7]", "    method M.K.b 9-9"],
    ),
    ("lua", "tables"): (
        """
        local M = {}
        function M.add(a, b)
          if a then return b end
          for i = 1, 2 do x() end
          return a
        end
        function M:go() end
        local handlers = {
          on = function(p)
            return p
          end,
        }
        """,
        ["function M.add 2-6 [3-5]", "method M.go 7-7", "function handlers.on 9-11"],
    ),
    ("bash", "functions"): ("f() {\n  x\n  # }\n  y\n}\nfunction g { z; }\n", ["function f 1-5 [2-4]", "function g 6-6"]),
}


@pytest.mark.parametrize("key", CASES, ids=lambda k: "-".join(k))
def test_outline(key):
    text, want = CASES[key]
    assert shown(text, key[0]) == want


@pytest.mark.parametrize("text", ['{"a', '{"a":', "{]", '"', "{{{{", '{"a": {"b"', "\\", "[1, 2", "'''", "def", "class {", "fn f(", "impl", "func (", "function", "if", "```", "/*", "`${"])
def test_broken_texts(text):
    for lang in [*lexer.STYLES, "json", "yaml", "toml", "markdown"]:
        assert isinstance(outline(text, lang), list)


def test_mask():
    masked = lexer.mask('x = "a // b" // c\ny = \'d\' + `e${f("g")}h`', "javascript")
    assert masked.split() == ["x", "=", "y", "=", "+", "f(", ")"] and len(masked) == len('x = "a // b" // c\ny = \'d\' + `e${f("g")}h`')
    assert lexer.mask("let c = '\"'; // x\n&'a str", "rust").split() == ["let", "c", "=", ";", "&'a", "str"]


def test_innermost(spark):
    """The deepest symbol wins, the first of two alike; a line on the border belongs, one outside does not."""
    s = spark.createDataFrame([("p", 0, 0, 1, 9, "class"), ("p", 1, 1, 2, 4, "method"), ("p", 2, 1, 2, 4, "method"), ("p", 3, 2, 3, 3, "class")], "path string, idx int, depth int, start int, end int, kind string")
    points = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("p", 4), ("p", 9), ("p", 10), ("q", 1)], "path string, line int")
    got = {(r.path, r.line): r.owner_idx for r in innermost(points, s, ["path", "line"]).collect()}
    assert got == {("p", 1): 0, ("p", 2): 1, ("p", 3): 3, ("p", 4): 1, ("p", 9): 0, ("p", 10): None, ("q", 1): None}
    only = {r.line: r.owner_idx for r in innermost(points.where("path = 'p'"), s, ["path", "line"], kinds=("method",)).collect()}
    assert only[3] == 1 and only[1] is None


def test_extract(spark):
    df = spark.createDataFrame([("a.json", "json", '{"k": 1}'), ("b", None, "x"), ("c.py", "python", "def f():\n  pass\n"), ("d.md", "markdown", "")], "path string, lang string, content string")
    got = {(r.path, r.qualified, r.kind, r.start, r.parent) for r in extract(df).collect()}
    assert got == {("a.json", "k", "key", 1, None), ("c.py", "f", "function", 1, None)}


@pytest.mark.parametrize(
    "text,line,want",
    [
        ("x\nfoo(function() {\n  a\n  b\n})\ny", 3, (2, 5)),
        ("proc a {} {\n  x\n}\nset y", 2, (1, 3)),
        ("# doc\nsub f {\n\tif (x) {\n\t\ty;\n\t}\n}\n", 4, (1, 6)),
        ("a\nb\nc", 2, None),
        ("x", 9, None),
    ],
)
def test_block(text, line, want):
    assert block.enclosing(text.split("\n"), line) == want


@pytest.mark.parametrize(
    "lang,text,want",
    [
        ("markdown", "# A ## b ##\n\n#x\n##\ntitle\n---\n> q\n---\n```py\n# no\n", [("A ## b", 1, 10), ("", 4, 4), ("title", 5, 10)]),
        ("markdown", "---\nkey: 1\n# never closed\n", []),
        ("markdown", "a\r\n===\r\n## b\r\n", [("a", 1, 3), ("b", 3, 3)]),
        ("yaml", "a:\n  - b: |\n      c: 1\n    d: 2\n'it''s': \"x: y\"\nhttp://x: 1\n-x: 2\nk # no: 1\n", [("a", 1, 4), ("b", 2, 3), ("d", 4, 4), ("it''s", 5, 5), ("http://x", 6, 6), ("-x", 7, 8)]),
        ("yaml", "top:\n  mid:\n    low: 1\n    low2: 2\n  mid2: >-\n    t: u\n\n    v\n# c: d\nend:\n", [("top", 1, 9), ("mid", 2, 4), ("mid2", 5, 9), ("end", 10, 10)]),
        ("toml", "[a.'b.c']\nx = '''\n[no]\n'''\n[[ p . q ]]\n[\"\"]\n# [c]\ny = [\n  [1]]\n", [("b.c", 1, 4), ("q", 5, 5), ("", 6, 9)]),
    ],
)
def test_structured(lang, text, want):
    assert [(s.name, s.start, s.end) for s in outline(text, lang)] == want
