import random

import numpy as np
import xxhash

from lodestar.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids):
    u = np.array(sorted(set(fps)), dtype=np.uint64)
    up = list(range(len(u)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 3):
            a, b = find(i), find(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    at = {int(x): i for i, x in enumerate(u)}
    least = {}
    for f, d in zip(fps, ids):
        if d is not None:
            least[find(at[f])] = min(least.get(find(at[f]), d), d)
    return [least.get(find(at[f])) for f in fps]


def test_fingerprint(edge, monkeypatch):
    texts = [r["text"] for r in edge.toDF(*["x0", "text", *[f"x{i}" for i in range(2, len(edge.columns))]]).collect() if len(r["text"] or "") < 5000]
    assert texts and all(simhash.fingerprint(t) == brute_fingerprint(t) for t in texts)
    from lodestar.llm import common

    monkeypatch.setattr(simhash, "word_blocks", lambda raw: common.word_blocks(raw, 16))
    assert all(simhash.fingerprint(t) == brute_fingerprint(t) for t in texts)


def test_documents(spark, small, edge, none):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), edge):
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == docs.count()
        fps = [r.fp & (1 << 64) - 1 for r in got]
        assert [r.component_id for r in got] == brute_components(fps, [r.doc_id for r in got])
    assert simhash.near_duplicates(none).count() == 0


def test_dense_buckets(spark):
    """Clusters far beyond a bucket's cap lose no link and gain none."""
    random.seed(5)
    fps = {random.getrandbits(64) for _ in range(200)}
    for size, flips in ((500, 5), (200, 3)):
        base = random.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(random.randint(0, flips)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps, list(range(len(fps))))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for cap, hot in ((256, simhash.HOT_BUCKET), (6, simhash.HOT_BUCKET), (256, 30)):
        roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(df, cap, hot)).collect()}
        group = {}
        for i, x in enumerate(fps):
            group.setdefault(roots.get(x, x), []).append(i)
        assert sorted(map(tuple, group.values())) == sorted(tuple(i for i, w in enumerate(want) if w == v) for v in set(want))


def test_chain(spark):
    """A long path of links is one component."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_survivors(edge, none):
    got = simhash.survivors(edge)
    assert got.columns == edge.columns
    ids = sorted(str(r[0]) for r in got.collect())
    # one row of each component; id 4 has two texts, and so is in two
    want = {str(r.component_id) for r in simhash.near_duplicates(edge).collect()}
    assert ids == sorted([*want, "4"])
    assert simhash.survivors(none).count() == 0


def test_pivot_table(spark):
    """Distances by hand; and no pair within three bits is ever discarded by them."""
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in fps[:150]]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = simhash.pivot_table(df).collect()
    table = simhash._distances(np.array([r.d0 for r in got]), np.array([r.d1 for r in got]))
    refs = [int(p) for p in simhash.pivots()]
    assert table.tolist() == [[(x ^ p).bit_count() for p in refs] for x in fps]
    a, b = simhash.bucket_pairs(np.array([0]), np.array(fps, np.uint64), table)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) >= 150


def test_hot_keys_meet_apart(spark, monkeypatch):
    """A fingerprint and a component that hold most rows, with tables too large for memory: the same result."""
    from lodestar.llm import common

    rng = random.Random(9)
    made = [(i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(12))) for i in range(60)] + [(100 + i, "the very same text in many rows") for i in range(120)] + [(300, "twice"), (300, "twice"), (None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("m", __import__("pyspark").sql.functions.expr("map('a', doc_id)"))
    want = sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    kept = sorted(str(r.doc_id) for r in simhash.survivors(df).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_SHARE", 0.2)
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == want
    got = simhash.survivors(df).collect()
    assert sorted(str(r.doc_id) for r in got) == kept and kept.count("300") == 1
    assert len(kept) == len({x[2] for x in want})
