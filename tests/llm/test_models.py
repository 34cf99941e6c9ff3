"""Language identification and toxicity: held-out accuracy, and the models against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4


def test_trigrams():
    got = langid.profiles(["Ab", "1", None, "", "a b"])
    v = {c: langid.letter_vector(ord(c)).astype(int) for c in " abc"}
    tri = lambda s: np.roll(v[s[0]], 2) * np.roll(v[s[1]], 1) * v[s[2]]
    assert (got[0] == tri(" ab") + tri("ab ")).all()
    assert not got[1:4].any()
    assert (got[4] == tri(" a ") + tri("a b") + tri(" b ")).all()


def test_blocks(monkeypatch):
    texts = ["hello world " * 40, "", "abc", "éü" * 100]
    whole = langid.profiles(texts)
    monkeypatch.setattr(langid, "BIND", 7)
    assert np.allclose(langid.profiles(texts), whole)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (fold(r.doc_id) == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(edge, none):
    got = langid.identify(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 6, 11))
    assert all(r.lang_pred in ("en", "de", "", "und") for r in got)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(edge.withColumn("lang", edge["source"].cast("string").substr(9, 1)).where("lang is null")).collect()} <= {"und"}


def brute_ratio(counts, gram):
    """The log ratio of one n-gram from the class counts, by the formula."""
    k, d = len(gram), toxicity.DISCOUNT
    types = {g for c in counts for g, n in c.items() if n}

    def low(g, seen):
        level = Counter(t[1:] for t in seen)
        if len(g) == 1:
            h, t = sum(level.values()), len(level)
            return (level[g] - d) / h + d * t / h / (t + 1)
        ctx = {x: n for x, n in level.items() if x[:-1] == g[:-1]}
        return (level[g] - d) / sum(ctx.values()) + d * len(ctx) / sum(ctx.values()) * low(g[1:], set(level))

    shared, out = low(gram[1:], types), []
    for c in counts:
        ctx = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        h = sum(ctx.values())
        out.append(shared if not h else max(c[gram] - d, 0) / h + d * len(ctx) / h * shared)
    return math.log(out[1]) - math.log(out[0])


def test_ratios_by_formula(spark):
    texts = [("aba abc bca", 0), ("abc abd bad", 1), ("cab cad aba aba", 0)]
    counts = [Counter(), Counter()]
    for t, y in texts:
        for w in toxicity.words(t):
            counts[y].update(toxicity.grams(w))
    every = sorted(set(counts[0]) | set(counts[1]))
    seen, _ = toxicity.log_ratios(spark.createDataFrame([(g, counts[0][g], counts[1][g]) for g in every], "g string, c0 long, c1 long"))
    got = {r.key: r.ratio for r in seen.collect()}
    assert set(got) == set(every)
    assert all(got[g] == pytest.approx(brute_ratio(counts, g)) for g in every)


def test_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == 1 and r.toxic == 1 for r in held)
    assert right >= 0.8 * sum(r.toxic for r in held) and right >= 0.85 * sum(r.predicted for r in held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in held)


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 1), (4, 0, 1), (4, 0, 1), (8, 1, 1), (None, 1, 1), (5, None, 1), (9, 0, 1)], "doc_id long, toxic int, TOXIC int")
    got = toxicity.toxicity(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id) == 2) for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert all(r.score == 0 for r in toxicity.toxicity(edge, labels.limit(0)).collect())


def test_long_words_in_pieces():
    m = toxicity.Model((np.array([], np.int64), np.array([])), (np.array([], np.int64), np.array([])))
    word = "ab" * 3000
    keys = toxicity.grams(word)
    import xxhash

    at = np.sort(np.array(list({xxhash.xxh64_intdigest(k.encode(), 42) for k in keys}), np.uint64).view(np.int64))
    m.seen = (at, np.ones(len(at)))
    assert m.ratios([word, "zz"]).tolist() == [len(keys), 0]


def test_unseen_is_unseen(spark):
    """An n-gram that was not seen takes its context's ratio, never another n-gram's, however many were seen."""
    rng = np.random.default_rng(3)
    keys = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(20_000)]
    table = spark.createDataFrame([(k, 1.0) for k in set(keys)], "key string, ratio double")
    m = toxicity.Model(toxicity._hashed(table), toxicity._hashed(table.limit(0)))
    other = ["".join(chr(65 + c) for c in rng.integers(0, 26, 5)) for _ in range(20_000)]
    assert not m._lookup(m.seen, other)[0].any() and m._lookup(m.seen, keys)[0].all()


def brute_evidence(counts, text):
    """The evidence of a text by the formula, from class counts of n-grams."""
    types = {g for c in counts for g, n in c.items() if n}

    def ratio(g):
        if g in types:
            return brute_ratio(counts, g)
        back = []
        for c in counts:
            ctx = {x: n for x, n in c.items() if x[:-1] == g[:-1] and n}
            back.append(toxicity.DISCOUNT * len(ctx) / sum(ctx.values()) if ctx else 1.0)
        return math.log(back[1]) - math.log(back[0])

    ws = toxicity.words(text)
    odds = [math.exp(min(sum(map(ratio, toxicity.grams(w))), toxicity.CLIP)) for w in ws]
    return math.log((sum(odds) + 1) / (len(ws) + 1))


def test_scores_by_formula(spark, monkeypatch):
    """Scores of a small corpus against brute force, and the two ways of meeting the tables against each other."""
    vocab = ["good", "day", "idiot", "fool", "read", "book", "fools", "bookish"]
    rng = np.random.default_rng(0)
    made = [(i, " ".join(rng.choice(vocab[:2] + vocab[4:6] if i % 3 else vocab, 6))) for i in range(48)] + [(48, None), (49, ""), (50, "new words only"), (50, "new words only"), (None, "idiot " * 3)]
    marks = {i: int(t is not None and ("idiot" in t or "fool" in t)) for i, t in made if i is not None}
    docs = spark.createDataFrame([(i, t, "x") for i, t in made], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")
    counts = {k: [Counter(), Counter()] for k in ("first", "all")}
    for i, t in made:
        if i is not None and fold(i) != 2:
            for k in ("all", *(["first"] if fold(i) != 3 else [])):
                for w in toxicity.words(t):
                    counts[k][marks[i]].update(toxicity.grams(w))
    cal = sorted((brute_evidence(counts["first"], t), marks[i]) for i, t in made if i is not None and fold(i) == 3)
    a, b = toxicity.fit_curve(np.array([x for x, _ in cal]), np.array([float(y) for _, y in cal]))
    want = sorted((-1 if i is None else i, round(1 / (1 + math.exp(-(a * brute_evidence(counts["all"], t) + b))), 6)) for i, t in made)
    for most in (1 << 20, 0):
        got = toxicity.score(docs, toxicity.train(docs, labels, most), most).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in got) == want
        assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_languages_by_formula(spark):
    """Predictions and cosines against sums and products by hand."""
    rng = np.random.default_rng(1)
    texts = {"aa": ["abra cadabra", "a bad cab", "bach"], "bb": ["xyz zyx", "wxyz yy", "zw-xy"], "cc": ["mnop", "pon mon", "nnn ooo"]}
    made = [(i, " ".join(rng.choice(texts[x], 3)), x) for i, x in enumerate(["aa", "bb", "cc"] * 8)] + [(90, "cab zyx", None), (91, "", "aa"), (None, "pon", "bb")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")

    def bundle(t):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        if not any(map(str.isalpha, s)):
            return np.zeros(langid.DIM)
        v = {c: langid.letter_vector(ord(c)).astype(float) for c in set(s)}
        return sum(np.array([v[x][(np.arange(langid.DIM) - 2) % langid.DIM], v[y][(np.arange(langid.DIM) - 1) % langid.DIM], v[z]]).prod(axis=0) for x, y, z in zip(s, s[1:], s[2:]))

    def unit(v):
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    protos = {}
    for i, t, x in made:
        if x is not None and fold(i) != 2:
            protos[x] = protos.get(x, 0) + unit(bundle(t))
    for r in langid.identify(docs).collect():
        text = next(t for i, t, _ in made if i == r.doc_id)
        cos = {x: float(unit(bundle(text)) @ unit(p)) for x, p in protos.items()}
        best = max(cos, key=cos.get)
        want = ("und", 0.0) if not any(map(str.isalpha, text)) else (best, min(max(cos[best], 0), 1))
        assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=1e-4), (text, cos)
