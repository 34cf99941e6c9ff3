"""SimHash near-duplicates by pivot distance tables.

A fingerprint is 64 bits; two link when they differ in at most ``MAX_BITS`` = 3.

1. Each document gets its fingerprint; equal fingerprints become one class (partial aggregation), so a
   group of exact copies, however large, is one row from here on.
2. The 64 bits are cut into six blocks.  Fingerprints that differ in three bits agree on three whole blocks
   at least, so each class goes into 20 buckets, one per choice of three blocks (33 key bits or so).
3. Each class has a row in the pivot table: its Hamming distances to ``N_PIVOTS`` reference fingerprints, computed once
   and carried into the class's buckets, eight to a long.  By the triangle inequality a pair within a bucket whose rows differ by more than 3 in any coordinate cannot link; such pairs are
   discarded and the survivors are verified.  Only the edges of a spanning forest leave the bucket.
4. A bucket with more than ``MAX_BUCKET`` classes is not paired.  Its classes are sent to the points at
   distance 1 and 2 in the bits outside the key: two classes at distance 3 or less share a point that is at
   distance 1 or less from one and 2 or less from the other.  All classes at a point are tied to one class
   at distance 1 or less from it, which is linked to each of them.  The work is linear in the classes, and
   no link is lost.  Buckets of over about ``HOT_BUCKET`` classes are found beforehand by counting some of the classes,
   and their classes go to the points without being brought together.
5. Edges go through alternating large-star and small-star rounds until nothing changes; every round is a
   table in the shared folder.

Pivots alone cannot deal out the work: distances of random 64-bit fingerprints to a pivot have a standard
deviation of 4, so cells of pivot distances that admit a difference of 3 discard less than they duplicate.
Buckets by whole blocks bring the candidates together, pivots discard, and the exact distance decides.

Tables with a row for each document meet those with a row for each class or component by ``meet``, so a fingerprint or a
component that holds a third of all rows is not one task's work.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows and ties get the same
component; where all doc_ids of a component are null its id is null; a very long text is read whole, in blocks of words;
extra columns are ignored, or carried along by ``survivors``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import FOLD_AZ, checked, give_back, materialize, meet, pick, positional, ship_code, word_blocks

MAX_BITS = 3
SHINGLE = 3
SEED = 42
N_PIVOTS = 16
MAX_BUCKET = 256
#: Buckets of about this size are looked for among one of ``DRAW`` classes, and never go to one task.
HOT_BUCKET, DRAW = 1 << 17, 16
#: (lowest bit, width) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
CHOICES = tuple(combinations(range(6), 3))


def _masks() -> list[int]:
    return [sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in c) for c in CHOICES]


MASKS = np.array(_masks(), dtype=np.uint64)


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints, spread by a fixed hash."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (repeats included)."""
    if not text:
        return 0
    raw = text.encode("utf-8", "surrogatepass").translate(FOLD_AZ)
    h, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    total, tail = 0, []
    for words in word_blocks(raw):
        words = tail + words
        if len(words) >= shingle:
            grams = zip(*[words[i:] for i in range(shingle)])
            hashes = np.array([h(join(g), SEED) for g in grams], dtype="<u8")
            for at in range(0, len(hashes), 1 << 16):
                ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        if not tail:
            return 0
        return h(join(tail), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) for each row; h is the text's hash, fp the fingerprint's bits as a signed long."""
    ship_code(docs.sparkSession)
    d = pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    return d.mapInArrow(_fingerprints, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, h long, fp long")


class _Forest:
    """Union-find over small index ranges."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def pivot_table(classes: DataFrame) -> DataFrame:
    """(fp, d0, d1): the distances of each fingerprint to the pivots, one byte each."""
    refs = pivots().view(np.int64).tolist()
    near = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long"), 8 * (i % 8)) for i, r in enumerate(refs)]
    return classes.select("fp", *[reduce(Column.bitwiseOR, near[i : i + 8]).alias(f"d{i // 8}") for i in (0, 8)])


def _distances(d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """Rows of the pivot table as bytes."""
    return np.stack([d0, d1], axis=1).astype("<i8").view(np.int8)


def bucket_pairs(starts: np.ndarray, fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linking pairs (indices) within runs of ``fps`` that begin at ``starts``: pivot table, then verification."""
    sizes = np.diff(np.append(starts, len(fps)))
    run_end = np.repeat(starts + sizes, sizes)
    later = run_end - np.arange(len(fps)) - 1
    out_a, out_b = [], []
    at = 0
    while at < len(fps):
        # as many left members as make about a million pairs
        upto = at + max(1, int(np.searchsorted(np.cumsum(later[at:]), 1 << 20)))
        a = np.repeat(np.arange(at, min(upto, len(fps))), later[at:upto])
        if len(a):
            first = np.cumsum(later[at:upto]) - later[at:upto]
            b = a + 1 + np.arange(len(a)) - np.repeat(first, later[at:upto])
            for p in range(table.shape[1]):
                near = np.abs(table[a, p] - table[b, p]) <= MAX_BITS
                a, b = a[near], b[near]
            good = np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS
            out_a.append(a[good])
            out_b.append(b[good])
        at = upto
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _links(batches: Iterator[pa.RecordBatch], max_bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (choice, key): edges of a spanning forest of each bucket, or its classes where it is large.

    Output rows are (choice, a, b): an edge where choice is null, a class ``a`` of a large bucket otherwise.
    A bucket may span batches; at most ``max_bucket`` of its members are held, besides the batch.
    """
    held = (np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty((0, N_PIVOTS), np.int8))
    large: tuple | None = None  # key of a bucket already known to be large

    def work(choice, key, fps, table):
        if not len(fps):
            return None
        new = np.ones(len(fps), dtype=bool)
        new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fps)))
        big = sizes > max_bucket
        if large is not None and (int(choice[0]), int(key[0])) == large:
            big[0] = True
        is_big = np.repeat(big, sizes)
        c, a, b = [], [], []
        for i in np.flatnonzero(is_big):
            c.append(int(choice[i]))
            a.append(fps[i])
            b.append(fps[i])
        rest = ~is_big & np.repeat(sizes > 1, sizes)
        keep = np.flatnonzero(rest)
        if len(keep):
            sub = fps[keep]
            sub_starts = np.flatnonzero(new[keep])
            x, y = bucket_pairs(sub_starts, sub, table[keep])
            forest = _Forest(len(sub))
            for i, j in zip(x.tolist(), y.tolist()):
                if forest.join(i, j):
                    c.append(None)
                    a.append(sub[i])
                    b.append(sub[j])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], names=["choice", "a", "b"]) if c else None

    for batch in batches:
        choice, key, fps, d0, d1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp", "d0", "d1"))
        cols = (choice, key.view(np.uint64), fps.view(np.uint64), _distances(d0, d1))
        choice, key, fps, table = cols = tuple(np.concatenate([h, c]) for h, c in zip(held, cols))
        if not len(fps):
            continue
        changes = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        first = int(changes[-1]) + 1 if len(changes) else 0  # the last bucket, which may go on in the next batch
        last = (int(choice[-1]), int(key[-1]))
        if len(fps) - first > max_bucket or large == last:
            done = work(*cols)
            large, held = last, tuple(x[:0] for x in cols)
        else:
            done = work(*(x[:first] for x in cols))
            held = tuple(x[first:] for x in cols)
        if done is not None:
            yield done
    done = work(*held)
    if done is not None:
        yield done


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class of a large bucket at every point within distance 2 of it in the bits outside the key."""
    for batch in batches:
        choices = batch.column("choice").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for c in np.unique(choices):
            own = fps[choices == c]
            free = [np.uint64(1) << np.uint64(i) for i in range(64) if not (int(MASKS[c]) >> i) & 1]
            ones = np.array([0, *free], dtype=np.uint64)
            twos = np.array([x ^ y for x, y in combinations(free, 2)], dtype=np.uint64)
            flips = np.concatenate([ones, twos])
            far = np.concatenate([np.zeros(len(ones), np.int8), np.ones(len(twos), np.int8)])
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                point = (part[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(point), c, np.int32)), pa.array(point.view(np.int64)), pa.array(np.tile(far, len(part))), pa.array(np.repeat(part, len(flips)).view(np.int64))],
                    names=["choice", "point", "far", "fp"],
                )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (choice, point, far, fp): ties all classes at a point to the first if that is at distance 1 or less."""
    hub = None  # (choice, point, fp or None)
    for batch in batches:
        a, b = [], []
        for choice, point, far, fp in zip(*(batch.column(n).to_pylist() for n in ("choice", "point", "far", "fp"))):
            if hub is None or hub[:2] != (choice, point):
                hub = (choice, point, None if far else fp)
            elif hub[2] is not None and fp != hub[2]:
                a.append(hub[2])
                b.append(fp)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bucket_keys() -> Column:
    """One struct (choice, key) per choice of blocks; the key is the fingerprint under the choice's mask."""
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks()]
    return F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])


def links(classes: DataFrame, max_bucket: int = MAX_BUCKET, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all links."""
    spark = classes.sparkSession
    ship_code(spark)
    keyed = pivot_table(classes).select("fp", "d0", "d1", F.explode(_bucket_keys()).alias("k")).select("k.choice", "k.key", "fp", "d0", "d1")
    drawn = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(DRAW)) == 0).groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"))
    hot = checked(materialize(drawn.where(F.col("n") * DRAW > hot_bucket).select("choice", "key"), "hot"))
    apart = keyed.join(hot, ["choice", "key"], "left_semi").select("choice", "fp")
    keyed = keyed.join(hot, ["choice", "key"], "left_anti")
    dealt = keyed.repartition(_width(spark), "choice", "key").sortWithinPartitions("choice", "key", "fp")
    found = materialize(dealt.mapInArrow(partial(_links, max_bucket=max_bucket), "choice int, a long, b long"), "links")
    edges = found.where("choice is null").select("a", "b")
    large = found.where("choice is not null").select("choice", F.col("a").alias("fp")).unionByName(apart)
    points = large.mapInArrow(_points, "choice int, point long, far tinyint, fp long")
    stars = points.repartition(_width(spark), "choice", "point").sortWithinPartitions("choice", "point", "far", "fp").mapInArrow(_stars, "a long, b long")
    return edges.unionByName(stars).distinct()


def _width(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected graph given as edges (a, b); root is the least node.

    Alternating large-star and small-star (Kiveris et al., "Connected components in MapReduce and beyond"):
    the number of rounds is logarithmic in practice and every round moves each edge a constant number of times.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # large star: every neighbour above a node goes to the least node around it
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u").select("u", "v", "m")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(small, "edges")
        # a forest of stars: no node is both a leaf and a centre, and each leaf has one centre
        stats = nxt.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("leaves")).first()
        chained = 0
        if stats["n"] == stats["leaves"]:
            chained = nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        cur = nxt
        if stats["n"] == stats["leaves"] and not chained:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(prints: DataFrame) -> DataFrame:
    """(fp, root, first_id, n) of every distinct fingerprint: its component's least fingerprint, its own least doc_id and
    number of rows."""
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(links(classes.select("fp")))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return materialize(named.select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "n"), "roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the least doc_id reachable over links."""
    prints = materialize(fingerprints(docs), "fingerprints")
    named = _rooted(prints)
    ids = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("prints")), "components")
    by_print = materialize(meet(named.select("fp", "root", "n"), ids, "root", "prints", named.count()).select("fp", "component_id", "n"), "by_print")
    return meet(prints, by_print, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: that with the least doc_id, then the least text hash; of
    rows repeated with both the same, the first by its columns as JSON.

    The rows that go are found on narrow tables.  ``docs`` then meets those only, in memory if they are few.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    named = _rooted(prints).select("fp", "root", F.col("n").alias("of_print"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    rows = prints.groupBy("fp", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    total = prints.count()
    rows = materialize(meet(rows, named, "fp", "of_print", total).withColumn("at", order).select("root", "doc_id", "h", "n", "at"), "members")
    best = materialize(rows.groupBy("root").agg(F.min("at").alias("best"), F.count(F.lit(1)).alias("of_root")), "best")
    met = materialize(meet(rows, best, "root", "of_root", total).select("doc_id", "h", "n", (F.col("at") == F.col("best")).alias("stays")), "verdicts")
    gone = materialize(met.where("not stays").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "gone")
    again = materialize(met.where("stays and n > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "repeated")
    plain, where, names = positional(docs)
    keyed = plain.withColumn("h", F.xxhash64(F.col(where["text"]).cast("string")))
    same = F.col(where["doc_id"]).eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h"))
    left = keyed.join(checked(gone), same, "left_anti")
    if again.count():
        one = F.struct(*plain.columns)
        # partial aggregates, so that each task passes on one of its repeated rows
        some = left.join(checked(again), same, "left_semi").groupBy(where["doc_id"], "h").agg(F.min_by(one, F.to_json(one)).alias("row"))
        left = left.join(checked(again), same, "left_anti").drop("h").unionByName(some.select("row.*"))
        return left.toDF(*names)
    return left.drop("h").toDF(*names)


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
