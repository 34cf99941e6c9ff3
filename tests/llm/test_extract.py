import pytest

from lodestar.llm import extract
from lodestar.llm.extract import main_text

P = "This is a paragraph of the article with a good number of words in it, so that it weighs something."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("plain text only", "plain text only"),
        (f"<body><p>{P}</p><p>{P} two</p></body>", f"{P}\n{P} two"),
        (f"<body><nav><a href=x>Home</a></nav><div class=ad>Buy now</div><article><h1>T &amp;amp; x</h1><p>{P}<br><p><b>b</b>old&nbsp; \n i&#116;</p></article><footer>f</footer></body>", f"T &amp; x\n{P}\nbold it"),
        (f"<body><header><h1>Site</h1></header><main><p>{P}</p><aside>side</aside><form><input><button>go</button></form><p>{P} end</p></main></body>", f"{P}\n{P} end"),
        (f"<div id=wrap><div class='site-header'>Site name</div><div class='post'><p>{P}</p><ul><li>one<li>two</ul></div><div id=sidebar><p>{P}</p></div><div class=comments><p>{P} says reader</p><p>{P}</p></div></div>", f"{P}\none\ntwo"),
        (f"<article><p>{P}</p></article><section class='comment-list'><article class=comment><p>{P} reader</p></article></section>", P),
        (f"<div class=cookie-notice>We use cookies</div><article><script>if (a<b) document.write('<p>x</p>')</script><style>p{{}}</style><!-- <p>no</p> --><p>{P}</p><noscript>on</noscript></article>", P),
        (f"<article><p>{P}</p><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>", f"{P}\na b\nc\nx y"),
        (f"<article><p title='a>b'>{P} < 3 & 4</p></article", f"{P} < 3 & 4"),
        (f"<ARTICLE><P hidden>h</P><P STYLE='display:none'>h</P><P aria-hidden=true>h</P><P>{P}</ARTICLE>", P),
        ("<article><p>é　😀\tx</p></article>", "é 😀 x"),
        ("<p>a</p><script>never ended", "a"),
        ("</p></div>a</b>", "a"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_links_without_names():
    """A block of links goes by its density, whatever it is called."""
    menu = "".join(f"<li><a href=/{i}>Link number {i} to somewhere</a></li>" for i in range(30))
    page = f"<body><div><ul>{menu}</ul></div><div><p>{P}</p><p>{P} {P}</p><p>{P}</p></div></body>"
    assert main_text(page) == f"{P}\n{P} {P}\n{P}"


def test_deep_and_long():
    assert main_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    many = "".join(f"<p>{P} {i}</p>" for i in range(3000))
    assert main_text(f"<article>{many}</article>").count("\n") == 2999


def test_rows(spark, small, none):
    kind = "page_id long, url string, html string, URL string, text string"
    df = spark.createDataFrame([(1, "u", None, "x", "y"), (1, "u", None, "x", "y"), (None, None, "<p>a", "x", "y"), (2, "u", "", None, None)], kind)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract.extract(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (1, "", 0), (None, "a", 1), (2, "", 0)], key=str)
    assert extract.extract(df.limit(0)).count() == 0


def test_generated_pages(spark, small):
    """The tables' pages: the article's blocks, cut out by hand."""
    import html
    import re

    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br|article)\b[^>]*>", inner)]
        assert main_text(r.html) == "\n".join(filter(None, parts))


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><p>{P} 1</p></article><article><p>{P} 2</p></article>", f"{P} 1\n{P} 2"),
        ("<article>Short lead</article><div>" + f"<p>{P}</p>" * 5 + "</div>", "\n".join([P] * 5)),
        (f"<form><div><article><h1>x</h1><p>{P}</p></article><input><button>go</button></div></form>", f"x\n{P}"),
        (f"<form><div><p>{P}</p><p>{P}</p></div></form>", f"{P}\n{P}"),
        (f"<div><p>{P}</p><p>{P}</p></div><form>Your name <input></form>", f"{P}\n{P}"),
        (f"<article><h2 class=share>Share of oil</h2><p class=related>{P}</p><p class=share><a>Tweet</a></p><p class='ad'>Buy</p><p>{P}</p></article>", f"Share of oil\n{P}\n{P}"),
        (f"<article><p>{P}</p></article><article><a href=x>Another post</a></article>", P),
    ],
)
def test_density_decides(page, text):
    assert main_text(page) == text


def test_against_brute_force():
    """Densities, sums and the choice by threshold, against the definitions on random trees."""
    import math
    import random

    rng = random.Random(4)

    def grow(depth):
        kids = [grow(depth - 1) if depth and rng.random() < 0.6 else "w" * rng.randint(1, 60) for _ in range(rng.randint(1, 4))]
        return (rng.choice(["div", "p", "a", "section"]), kids)

    def html_of(t):
        return t if isinstance(t, str) else f"<{t[0]}>" + "<!-- -->".join(map(html_of, t[1])) + f"</{t[0]}>"

    def below(x):
        return [y for k in x.kids if not isinstance(k, str) for y in (k, *below(k))]

    def chars(x, linked=False):
        return sum((len(k) if linked or x.name == "a" else 0) if isinstance(k, str) else chars(k, linked or x.name == "a") for k in x.kids)

    def all_chars(x):
        return sum(len(k) if isinstance(k, str) else all_chars(k) for k in x.kids)

    for _ in range(60):
        root = extract.parse("".join(html_of(grow(4)) for _ in range(3)))
        got = extract.content(root)
        share = chars(root) / all_chars(root)

        def density(c, t, lc, lt):
            if not c:
                return 0.0
            up = c / max(lc, 1) * max(t, 1) / max(lt, 1)
            return c / max(t, 1) * math.log(max(up, 1)) / math.log(1 + math.log(c / max(c - lc, 1) * lc + share * c + math.e))

        def of(x, in_link=False):
            tags = below(x)
            return density(all_chars(x), len(tags), all_chars(x) if x.name == "a" else chars(x), sum(y.name == "a" for y in tags))

        def total(x):
            return sum(density(len(k), 1, len(k) if x.name == "a" else 0, 0) if isinstance(k, str) else of(k) for k in x.kids)

        every = [root, *below(root)]
        for x in every:
            assert math.isclose(x.density, of(x), abs_tol=1e-9) and math.isclose(x.total, total(x), abs_tol=1e-9)
        best = max((x.total, x.name in extract.BLOCK, i) for i, x in enumerate(every))
        best = every[best[2]] if best[1] else max(every, key=lambda x: x.total)
        path = [x for x in every if x is best or best in below(x)]
        least = min(x.density for x in path)
        assert best in got or any(best in below(x) for x in got)
        # every branch that reaches the threshold is covered by its subtree with the greatest sum
        for x in every:
            ups, up = [], x
            while up is not None:
                ups.append(up)
                up = up.up
            if all(u.density >= least and all_chars(u) for u in ups):
                top = max([x, *below(x)], key=lambda y: y.total)
                assert any(top is g or top in below(g) or g.total == top.total for g in got)


def test_linear_in_depth():
    """Unmatched ends, blocks in nested spans and deep articles take time in proportion."""
    import time

    for make in (lambda n: "<div><span>" * n + "x" + "</zzz>" * n, lambda n: "<span>" * n + "<p>x" * n, lambda n: "<article>" + "<div>" * n + f"<p>{P}</p>"):
        main_text(make(1000))
        began = time.perf_counter()
        main_text(make(40_000))
        assert time.perf_counter() - began < 10
