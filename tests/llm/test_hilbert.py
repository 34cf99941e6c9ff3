import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import hilbert


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 2), (4, 2)])
def test_curve(spark, n, bits):
    """The index is a bijection and neighbours on the curve differ by one step in one dimension."""
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, [f"x{i}" for i in range(n)])
    got = df.select("*", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(len(cells)))
    assert all(sum(abs(p[i] - q[i]) for i in range(n)) == 1 for p, q in zip(got, got[1:]))


def check(planned, docs, shards=8):
    got = planned.collect()
    assert len(got) == len(docs)
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert 0 <= s < shards
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    return got


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(hilbert.plan(docs), texts)
    by_shard = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(by_shard) - min(by_shard) <= 2 * max(r["size"] for r in got) + sum(by_shard) / 8 / hilbert.WHOLE
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in got)


def test_groups_stay_whole_and_large_ones_are_cut(spark):
    made = [(i, f"text {i} " * 20, "en", "a") for i in range(400)] + [(1000 + i, "copy " * 10, "fr", f"s{i}") for i in range(6)]
    got = hilbert.plan(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    assert len({r.shard for r in got if r.doc_id >= 1000}) == 1
    made += [(5000 + i, "many " * 30, "en", f"s{i}") for i in range(500)]
    got = hilbert.plan(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    by_shard = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(by_shard) <= 1.05 * min(by_shard)


def test_edges(spark, edge, none):
    texts = [(r[0], r[1]) for r in edge.collect()]
    check(hilbert.plan(edge), texts)
    assert hilbert.plan(none).count() == 0


def test_files_and_pruning(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m = hilbert.write_shards(docs, str(tmp_path / "out")).cache()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("_shard").exceptAll(docs).count() == 0 and back.count() == docs.count() == m.agg(F.sum("rows")).first()[0]
    for d, v in (("lang", "es"), ("size", 40), ("doc_id", 3)):
        kept = {r.shard for r in hilbert.prune(m, d, v, v).collect()}
        have = {r._shard for r in back.where((F.octet_length("text") + 1 if d == "size" else F.col(d)) == v).select("_shard").distinct().collect()}
        assert have <= kept


def brute_plan(docs, shards=8, bits=hilbert.BITS):
    """(doc_id, shard, slot) of rows (doc_id, text, lang, source) by the definitions."""
    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    least = lambda v: (v is not None, v)
    rows = [{"doc_id": d, "size": len((t or "").encode()) + 1, "lang": lang, "source": s, "group": 0 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42))} for d, t, lang, s in docs]
    bounds = {}
    for c in hilbert.DIMENSIONS:
        vals = sorted(r[c] for r in rows if r[c] is not None)
        bounds[c] = {vals[-(-len(vals) * i // (1 << bits)) - 1] for i in range(1, 1 << bits)} if vals else set()
    groups = {}
    for r in rows:
        groups.setdefault(r["group"], []).append(r)
    place, after = hilbert.curve_tables(4)
    for g in groups.values():
        for r in g:
            of = {c: min((x[c] for x in g if x[c] is not None), default=None) for c in ("lang", "source", "doc_id")} | {"size": r["size"]}
            cell = [sum(of[c] is not None and of[c] > b for b in bounds[c]) for c in hilbert.DIMENSIONS]
            state = h = 0
            for level in reversed(range(bits)):
                at = (state << 4) + sum(((x >> level) & 1) << j for j, x in enumerate(cell))
                state, h = after[at], h * 16 + place[at]
            r["h"] = h
    rows.sort(key=lambda r: (r["h"], r["group"], least(r["doc_id"]), least(r["lang"]), least(r["source"])))
    total, at, first = sum(r["size"] for r in rows), 0, {}
    for r in rows:
        r["start"] = at
        first.setdefault(r["group"], at)
        at += r["size"]
    seen = {}
    out = []
    for r in rows:
        g = groups[r["group"]]
        size = sum(x["size"] for x in g)
        middle = 2 * first[r["group"]] + size if len(g) > 1 and size * shards * hilbert.WHOLE <= total else 2 * r["start"] + r["size"]
        shard = min(shards - 1, middle * shards // (2 * total))
        seen[shard] = seen.get(shard, -1) + 1
        out.append((str(r["doc_id"]), shard, seen[shard]))
    return sorted(out)


@pytest.mark.parametrize("small_tables", [True, False])
def test_assignment_by_brute_force(spark, small_tables, monkeypatch):
    """Shards and slots against the definitions; with tables met in memory, and with hot keys dealt with apart."""
    import random

    from lodestar.llm import common

    if not small_tables:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(common, "HOT_SHARE", 0.1)
    rng = random.Random(6)
    made = [(i, "w " * rng.randint(0, 90) + str(i), rng.choice(["en", "de", None, "fr"]), f"https://example.com/common/path/{rng.randint(0, 40)}") for i in range(300)]
    made += [(1000 + i % 90, "copy of a text", "en", f"https://example.com/common/path/{i % 7}") for i in range(150)]
    made += [(2000 + i, f"twice {i // 2}", "de", None) for i in range(60)] + [(None, None, None, None), (7, "", "en", "x"), (7, "", "en", "x")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    got = hilbert.plan(df).collect()
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in got) == brute_plan(made)
    assert len({r.hilbert for r in got}) > 50


def test_repeated_rows_are_dealt_out(spark):
    """A row repeated for most of the table lies in many ranges, and in shards of equal bytes."""
    made = [(5, "the very same row", "en", "a")] * 4000 + [(i, f"row {i}", "en", "b") for i in range(1000)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").repartition(8)
    got = hilbert.plan(df)
    by = {r.shard: r["bytes"] for r in hilbert.manifest(got).collect()}
    assert len(by) == 8 and max(by.values()) - min(by.values()) <= 40
    run = hilbert.running(df.withColumn("nth", F.monotonically_increasing_id()).withColumn("one", F.lit(1)), ("doc_id", "nth"), "one")
    assert sorted((r.idx, r.upto_one) for r in run.select("idx", "upto_one").collect()) == [(i, i + 1) for i in range(5000)]
