from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import quality
from lodestar.llm.queries import OP1_COLUMNS, OP1_SQL

PLAIN = "doc_id long, text string, lang string, source string"


def brute_repeats(words):
    hit = set()
    for i in range(len(words) - 2):
        if any(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2) if j != i):
            hit |= {i, i + 1, i + 2}
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeated_words(words):
    assert quality.repeated_words(words) == brute_repeats(words)


def test_counts():
    assert quality.count_text(None) == quality.count_text("") == (0, 0, 0, 0, 0, 0)
    assert quality.count_text("é# b\n\n \né# b\nx|\xa0y") == (5, 10, 3, 1, 0, 3)


def test_long_texts_in_blocks(monkeypatch):
    text = "alpha beta gamma delta " * 50
    whole = quality.count_text(text)
    monkeypatch.setattr(quality, "word_blocks", lambda raw: __import__("lodestar.llm.common", fromlist=["x"]).word_blocks(raw, 16))
    assert quality.count_text(text) == whole


def test_edges(spark, edge, none, duck, rows):
    got = quality.quality(edge).select(*OP1_COLUMNS)
    assert got.count() == edge.count()
    assert quality.quality(none).count() == 0
    plain = edge.select("doc_id", edge.columns and edge["doc_id"].alias("x")).limit(0)
    assert plain.count() == 0
    from lodestar.llm.common import pick

    assert rows(got) == duck(OP1_SQL, documents=pick(edge, "doc_id", "text", "lang", "source"))


def test_fences_adapt(spark):
    """Symbols that are usual in one source are outliers in another; a small group takes its language's fences."""
    word = lambda i, n, sym: " ".join(f"w{i}x{j}" + ("##" if j < sym else "") for j in range(n))
    made = [(i, word(i, 60, 0), "en", "prose") for i in range(60)] + [(100 + i, word(i, 60, 50), "en", "code") for i in range(60)]
    made += [(300, word(7, 60, 50), "en", "prose"), (301, word(8, 60, 50), "en", "rare"), (302, word(9, 60, 0), "en", "rare")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(made, PLAIN)).collect()}
    assert all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60))
    assert not got[300] and got[302]


def test_sketches_merge(spark):
    import random

    random.seed(3)
    made = [(i, " ".join("w" * random.randint(1, 9) for _ in range(60)), "en", f"s{i % 3}") for i in range(90)]
    df = quality.judged(quality.features(spark.createDataFrame(made, PLAIN)))
    whole = quality.sketch(df)
    parts = quality.sketch(df.where("doc_id < 40")).unionByName(quality.sketch(df.where("doc_id >= 40")))
    again = parts.groupBy("lang", "source", "metric", "bin").sum("n").withColumnRenamed("sum(n)", "n")
    key = lambda d: sorted(map(tuple, d.select("lang", "source", "metric", "bin", "n").collect()))
    assert key(whole) == key(again)


def test_kept_rows(edge, none):
    got = quality.kept(edge)
    assert got.columns == edge.columns
    want = sorted(str(r.doc_id) for r in quality.quality(edge).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in got.toDF(*[f"c{i}" if i else "doc_id" for i in range(len(got.columns))]).collect()) == want
    assert quality.kept(none).count() == 0


def test_groups_with_odd_names(spark, duck, rows):
    """A separator in a name joins no two groups, and no document comes back twice."""
    made = [(1, "a b c", "a\x01vb", None), (2, "a b c", "a", "b\x01n"), (3, "a b c", None, None), (4, "a b c", "", ""), (4, "a b c", "", "")]
    df = spark.createDataFrame(made, PLAIN)
    got = quality.quality(df).select(*OP1_COLUMNS)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 4]
    assert rows(got) == duck(OP1_SQL, documents=df)


def test_copies_shut_out_nobody(spark):
    """A source of copies has no spread of its own; its other documents are judged by their language's."""
    import random

    rng = random.Random(5)
    prose = lambda: " ".join("w" * rng.randint(2, 7) + str(rng.randint(0, 99999)) for _ in range(80))
    made = [(i, "seven words of a text in copies " * 1 + " ".join(f"x{j}" for j in range(60)), "en", "s") for i in range(80)]
    made += [(100 + i, prose(), "en", "s" if i < 20 else "t") for i in range(300)]
    made += [(900, " ".join(f"#x{j}##" for j in range(80)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(made, PLAIN)).collect()}
    assert all(got[100 + i] for i in range(300)) and got[0] and not got[900]


def test_repeats_of_numbered_words():
    import random

    import numpy as np

    rng = random.Random(1)
    for n in (0, 1, 3, 4, 50, 400):
        some = [rng.randint(0, 5) for _ in range(n)]
        assert quality.repeated_ids(np.array(some, np.int64)) == brute_repeats(some)
