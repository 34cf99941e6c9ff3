import hashlib
import random
import re

from lodestar.llm import decontam
from lodestar.llm.common import pick
from lodestar.llm.queries import OP4_COLUMNS as EVERY

OP4_COLUMNS = EVERY[:6]
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        ws, hit, ids = words(text), set(), set()
        for i, t in items:
            iw = words(t)
            k = min(10, len(iw))
            for s in range(len(iw) - k + 1) if k else ():
                for p in range(len(ws) - k + 1):
                    if ws[p : p + k] == iw[s : s + k]:
                        hit |= set(range(p, p + k))
                        ids.add(str(i))
        out.append((d, len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    random.seed(2)
    some = lambda n, k: " ".join(random.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(0, some(25, 8)), (1, some(12, 2)), (10, "A b-C d"), (2, "ä Ö, x"), (3, ""), (4, None), (5, "zzz"), (6, some(10, 3)), (7, some(40, 1))]
    docs = [(i, some(60, random.choice([1, 2, 3, 8]))) for i in range(20)]
    docs += [(100, "x " + items[0][1] + " y"), (101, "...".join(words(items[1][1]))), (102, "a B! c d"), (103, "ä Ö x"), (103, "ä ö x"), (104, None), (105, ""), (106, items[0][1]), (106, items[0][1]), (None, items[6 + 1][1])]
    got = decontam.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).select(*OP4_COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_sql(spark, duck, rows):
    from lodestar.llm.queries import OP4_SQL

    docs = spark.createDataFrame([(1, "A b c d e f g h i j k"), (2, None), (3, ""), (3, "x y"), (3, "x y"), (None, "y x, Y")], DOC)
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "Y"), (30, None), (30, "x.y")], ITEM)
    got = decontam.decontaminate(docs, items).select(*EVERY)
    assert rows(got) == duck(OP4_SQL, documents=docs, benchmark=items)


def test_edges(spark, edge, none):
    named = spark.createDataFrame([(1, "the same id with another text the same id with another"), (2, None), (3, "und Öl")], ITEM)
    got = decontam.decontaminate(edge, named).select(*OP4_COLUMNS)
    texts = [tuple(r) for r in pick(edge, "doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(texts, [tuple(r) for r in named.collect()])
    items = named.unionByName(spark.createDataFrame([(None, "lorem ipsum dolor")], ITEM))
    got = decontam.decontaminate(edge, items).select(*OP4_COLUMNS)
    hit = got.where("doc_id = 3").first()
    assert (hit.n_hit, hit.n_items, hit.contaminated) == (60_000, 0, True)  # null item_ids hit, but are not listed
    empty = spark.createDataFrame([], ITEM)
    assert decontam.decontaminate(edge, empty).where("contaminated").count() == 0
    assert decontam.decontaminate(none, items).count() == 0
    clean = decontam.clean(edge, items)
    assert clean.columns == edge.columns
    assert sorted(str(r[0]) for r in clean.collect()) == sorted(str(r.doc_id) for r in got.where("not contaminated").collect())


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item), (2, "one two x three four x five six seven eight nine ten"), (3, "one " + "x " * 30 + "two " + "x " * 30 + "three four five six seven"), (4, "other words")]
    docs += [(5 + i, "six seven eight nine ten") for i in range(5)]
    index = decontam.Index(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item)], ITEM))
    got = {r.doc_id: (r.contaminated, r.n_near) for r in index.report().collect()}
    assert got[1] == (True, 1) and got[2] == (False, 1) and got[3] == (False, 0) and got[4] == (False, 0)


def brute_near(docs, items):
    """(doc number, item_id) of near items, by the definition."""
    texts = [words(t) for _, t in docs]
    n = {}
    for ws in texts:
        for w in ws:
            n[w] = n.get(w, 0) + 1
    out = set()
    for i, t in items:
        iw = words(t)
        for s in sorted({*range(0, max(len(iw) - 9, 1), 10), max(len(iw) - 10, 0)}):
            rare = sorted((n[w], off) for off, w in list(enumerate(iw))[s : s + 10] if w in n)[:4]
            offs = [off for _, off in rare]
            need = 3 if len(offs) == 4 else len(offs)
            for d, ws in enumerate(texts):
                for lead in offs[:2]:
                    for p in [p for p, w in enumerate(ws) if w == iw[lead]]:
                        met = sum(o == lead or any(abs(q - o - (p - lead)) <= 5 for q, w in enumerate(ws) if w == iw[o]) for o in offs)
                        if met >= need:
                            out.add((d, i))
    return out


def test_proximity_by_brute_force(spark, monkeypatch, duck, rows):
    """Items with words that the corpus lacks, parts of long items, and replaced words; with tables in memory and without."""
    from lodestar.llm import common
    from lodestar.llm.queries import OP4_SQL

    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 9, 10, 24, 40])))) for i in range(14)] + [(50, "w1 absent w2 w3"), (51, "gone never"), (52, "w9"), (53, "")]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(30)]
    for i in range(8, 14):
        ws = words(items[i][1])
        ws[len(ws) // 2] = "replaced"
        docs.append((100 + i, " ".join(rng.choices(vocab, k=9) + ws[: 2 * len(ws) // 3] + rng.choices(vocab, k=5))))
    docs.append((200, "w1 x w2 w3"))
    df, bench = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    want = brute_near(docs, items)
    count = {docs[d][0]: sum(x == d for x, _ in want) for d in range(len(docs))}
    got = decontam.decontaminate(df, bench).select(*EVERY)
    assert {r.doc_id: r.n_near for r in got.collect()} == count and count[200] >= 1 and all(count[100 + i] for i in range(8, 14) if len(words(items[i][1])) >= 24)
    assert rows(got) == duck(OP4_SQL, documents=df, benchmark=bench)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_SHARE", 0.02)
    assert {r.doc_id: (r.n_near, r.n_hit) for r in decontam.decontaminate(df, bench).collect()} == {r.doc_id: (r.n_near, r.n_hit) for r in got.collect()}
