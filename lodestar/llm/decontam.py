"""Benchmark decontamination over a distributed positional inverted index.  DataFrame operations only.

1. ``items``: each benchmark text becomes its words by offset; its vocabulary gets term ids.
2. ``postings``: one row (document, position, term) for every occurrence of a benchmark term in the corpus,
   written to the shared folder.  Words outside the vocabulary cannot be part of a match and are not stored.
3. Term counts come from the postings.  Every window of ``WINDOW`` words is looked up by its rarest term only;
   a window with a term that the corpus lacks is dropped.
4. A posting of a rarest term, adjusted by the term's offset, says where the item would have to begin.  These
   alignments are intersected with the adjusted lists of the windows' second rarest terms, and what is left is
   intersected with the postings of all the item's terms.
5. Runs of ``WINDOW`` consecutive offsets (or the whole item, if it is shorter) that all match are occurrences.

Lists of common terms are never paired with each other: step 4 reads them only at the positions that the
rare terms have left.

Proximity matches (``proximity``) are looser.  Every tenth window of an item, and its last, is a block; an item's words that the
corpus lacks are left out.  A block is near a place in a document if one of its two rarest words stands there and, of
its ``NEAR_TERMS`` rarest, all but one stand within ``SLOP`` words of where the first puts them (all, if it has fewer).

The postings also hold, under the term ``LENGTH``, each document's id and number of words.

Defined results: null has no words; an item without words is no item; repeated item rows and ties count once by
item_id (null item_ids are left out of lists and counts of items, but their hits count); repeated documents
are judged one by one; a very long text is indexed whole; extra columns are ignored, or carried along by ``clean``; an
empty corpus gives an empty table and an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.llm.common import checked, fold_ascii, materialize, meet, pick, positional

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
NEAR_TERMS = 4
SLOP = 5
#: The term that stands for a document's length; no word holds such a character.
LENGTH, LENGTH_TERM = -1, "\0"


def words(text: Column) -> Column:
    return F.array_remove(F.split(fold_ascii(text), SEPARATORS), "")


def key_of(doc_id: str, text: str) -> list[Column]:
    """A row's key is the hash of its id and that of its text, so that repeated ids stay apart."""
    return [F.xxhash64(F.col(doc_id).cast("string")).alias("k1"), F.xxhash64(F.col(text).cast("string")).alias("k2")]


def item_terms(bench: DataFrame) -> DataFrame:
    """(item, item_id, len, off, term) for each word of each item; ``item`` numbers the rows."""
    b = pick(bench, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
    b = b.where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id())
    return b.select("item", "item_id", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(k1, k2, pos, tid, doc_id) for every occurrence of a term of ``terms`` (term, tid), and one row a document with its
    number of words as ``pos`` and its id, which is null elsewhere."""
    d = pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    found = F.concat(F.coalesce(words(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(LENGTH_TERM)))
    # the keys are made once a document, before its words are rows
    tok = d.select(*key_of("doc_id", "text"), "doc_id", found.alias("words")).select("k1", "k2", "doc_id", F.posexplode("words").alias("pos", "term"))
    return tok.join(checked(terms), "term").select("k1", "k2", "pos", "tid", F.when(F.col("tid") == LENGTH, F.col("doc_id")).alias("doc_id"))


class Index:
    """The postings of a corpus for the terms of a benchmark, written to the shared folder."""

    def __init__(self, docs: DataFrame, bench: DataFrame):
        raw = materialize(item_terms(bench), "items")
        length = docs.sparkSession.createDataFrame([(LENGTH_TERM, LENGTH)], "term string, tid long")
        self.terms = materialize(raw.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()).unionByName(length), "terms")
        every = materialize(postings(docs, self.terms), "postings")
        self.lengths = every.where(F.col("tid") == LENGTH).select("doc_id", "k1", "k2", F.col("pos").cast("long").alias("n_words"))
        self.postings = every.where(F.col("tid") != LENGTH).drop("doc_id")
        counts = materialize(self.postings.groupBy("tid").agg(F.count(F.lit(1)).alias("n")), "counts")
        self.total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        counted = self.terms.join(counts, "tid", "left").select("term", "tid", F.coalesce("n", F.lit(0)).alias("n"))
        self.items = materialize(raw.join(counted, "term").select("item", "item_id", "len", "off", "tid", "n"), "items")

    def _windows(self) -> DataFrame:
        """(item, start, off, tid, n, rank): the terms of each window that can occur, the rarest first."""
        w = F.least(F.lit(WINDOW), F.col("len"))
        starts = F.sequence(F.greatest(F.col("off") - w + 1, F.lit(0)), F.least(F.col("off"), F.col("len") - w))
        rows = self.items.select("item", "off", "tid", "n", F.explode(starts).alias("start"))
        by = W.partitionBy("item", "start")
        rows = rows.withColumn("least", F.min("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy("n", "off")))
        return rows.where("least > 0").select("item", "start", "off", "tid", "n", "rank")

    def _lists(self, anchors: DataFrame) -> DataFrame:
        """The postings of the anchors' terms (tid, n, ...), with the anchors' columns."""
        return meet(self.postings, materialize(anchors, "anchors"), "tid", "n", self.total, "inner").drop("n")

    def _alignments(self, anchors: DataFrame, *keys: str) -> DataFrame:
        """Where postings of the anchors' terms put the items' beginnings."""
        return self._lists(anchors).select("k1", "k2", *keys, (F.col("pos") - F.col("off")).alias("at")).distinct()

    def candidates(self) -> DataFrame:
        """(k1, k2, item, at): alignments at which the two rarest terms of some window occur."""
        ranked = materialize(self._windows(), "windows")
        # a window's rarest terms as pairs of offsets: many windows of an item share one pair
        first = ranked.where("rank = 1").select("item", "start", F.col("off").alias("off1"), F.col("tid").alias("tid1"), F.col("n").alias("n1"))
        second = ranked.where("rank = 2").select("item", "start", F.col("off").alias("off2"), F.col("tid").alias("tid2"), F.col("n").alias("n2"))
        pairs = materialize(first.join(second, ["item", "start"], "left").select("item", "off1", "tid1", "n1", "off2", "tid2", "n2").distinct(), "pairs")
        a1 = self._alignments(pairs.select("item", F.col("off1").alias("off"), F.col("tid1").alias("tid"), F.col("n1").alias("n")).distinct(), "item", "off")
        a2 = self._alignments(pairs.where("off2 is not null").select("item", F.col("off2").alias("off"), F.col("tid2").alias("tid"), F.col("n2").alias("n")).distinct(), "item", "off")
        both = a1.withColumnRenamed("off", "off1").join(checked(pairs.select("item", "off1", "off2")), ["item", "off1"])
        alone = both.where("off2 is null").select("k1", "k2", "item", "at")
        met = both.where("off2 is not null").join(a2.withColumnRenamed("off", "off2"), ["k1", "k2", "item", "at", "off2"], "left_semi")
        return met.select("k1", "k2", "item", "at").unionByName(alone).distinct()

    def hits(self) -> DataFrame:
        """(k1, k2, item, item_id, pos): document words inside occurrences of windows."""
        cand = materialize(self.candidates(), "candidates")
        where = checked(materialize(cand.select("k1", "k2").distinct(), "where"))
        near = self.postings.join(where, ["k1", "k2"], "left_semi")
        want = cand.join(self.items, "item").select("k1", "k2", "item", "item_id", "len", "at", "off", "tid", (F.col("at") + F.col("off")).alias("pos"))
        met = want.join(near, ["k1", "k2", "pos", "tid"]).select("k1", "k2", "item", "item_id", "len", "at", "off", "pos").distinct()
        by = W.partitionBy("k1", "k2", "item", "at")
        runs = met.withColumn("run", F.col("off") - F.row_number().over(by.orderBy("off")))
        sized = runs.withColumn("run_len", F.count(F.lit(1)).over(W.partitionBy("k1", "k2", "item", "at", "run")))
        return sized.where(F.col("run_len") >= F.least(F.lit(WINDOW), F.col("len"))).select("k1", "k2", "item", "item_id", "pos")

    def _blocks(self) -> DataFrame:
        """(item, item_id, start, off, tid, n, rank, of): the ``NEAR_TERMS`` rarest words of each block that the corpus has."""
        last = F.greatest(F.col("len") - WINDOW, F.lit(0))
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(WINDOW)), F.array(last)))
        here = F.filter(starts, lambda s: (s <= F.col("off")) & (F.col("off") < s + WINDOW))
        rows = self.items.where("n > 0").select("item", "item_id", "off", "tid", "n", F.explode(here).alias("start"))
        by = W.partitionBy("item", "start")
        ranked = rows.withColumn("rank", F.row_number().over(by.orderBy("n", "off"))).where(F.col("rank") <= NEAR_TERMS)
        return ranked.withColumn("of", F.count(F.lit(1)).over(by))

    def proximity(self) -> DataFrame:
        """(k1, k2, item_id): documents with a block of an item nearly in place.

        All but one of a block's ``NEAR_TERMS`` rarest words hold all but one of the others without the commonest, so the
        commonest word's list is read only where the others have met, and not all did.
        """
        blocks = materialize(self._blocks(), "blocks")
        lists = self._lists(blocks.where(F.col("rank") < NEAR_TERMS)).select("k1", "k2", "item", "item_id", "start", "rank", "of", (F.col("pos") - F.col("off")).alias("at"))
        lists = materialize(lists, "lists")
        cell = lambda c: F.floor(c / F.lit(SLOP + 1))
        place = ["k1", "k2", "item", "item_id", "start", "of", "lead", "at1"]
        lead = lists.where("rank <= 2").select(*place[:6], F.col("rank").alias("lead"), F.col("at").alias("at1"))
        cells = lead.where("of > 1").select("*", F.explode(F.array(*[cell(F.col("at1")) + i for i in (-1, 0, 1)])).alias("cell"))
        rest = lists.select("k1", "k2", "item", "start", "rank", "at", cell(F.col("at")).alias("cell"))
        near = cells.join(rest, ["k1", "k2", "item", "start", "cell"]).where((F.abs(F.col("at") - F.col("at1")) <= SLOP) & (F.col("rank") != F.col("lead")))
        met = materialize(near.groupBy(*place).agg((F.countDistinct("rank") + 1).alias("met")), "met")
        most = F.col("of") == NEAR_TERMS
        full = met.where(F.col("met") >= F.when(most, NEAR_TERMS - 1).otherwise(F.col("of")))
        # the commonest word, where it decides
        common = blocks.where(F.col("rank") == NEAR_TERMS).select("item", "start", "off", "tid")
        open_ = met.where(most & (F.col("met") == NEAR_TERMS - 2)).select("k1", "k2", "item", "item_id", "start", "at1")
        want = materialize(open_.join(common, ["item", "start"]).select("k1", "k2", "tid", "item_id", (F.col("at1") + F.col("off")).alias("to")).distinct(), "wanted")
        at = self.postings.join(checked(materialize(want.select("tid").distinct(), "tids")), "tid", "left_semi")
        last = at.join(checked(want), ["k1", "k2", "tid"]).where(F.abs(F.col("pos") - F.col("to")) <= SLOP)
        alone = lead.where("of = 1")
        return full.select("k1", "k2", "item_id").unionByName(last.select("k1", "k2", "item_id")).unionByName(alone.select("k1", "k2", "item_id")).distinct()

    def report(self) -> DataFrame:
        """A row for each document: its words, hits and items."""
        hits = materialize(self.hits(), "hits")
        key = ["k1", "k2"]
        n_hit = hits.select(*key, "pos").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
        # a document's own items, in one list as its digest needs them
        items = hits.where("item_id is not null").select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        near = self.proximity().groupBy(*key).agg(F.countDistinct("item_id").alias("n_near"))
        per, near = materialize(n_hit.join(items, key, "left"), "report"), materialize(near, "near")
        ids = F.coalesce("ids", F.array().cast("array<string>"))
        return self.lengths.join(checked(per), key, "left").join(checked(near), key, "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "k1",
            "k2",
        )


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """A row for each document: words, hits, items, their digest, the verdict, and items near by."""
    return Index(docs, bench).report().drop("k1", "k2")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, that hold no benchmark window."""
    bad = materialize(Index(docs, bench).hits().select("k1", "k2").distinct(), "contaminated")
    plain, where, names = positional(docs)
    keyed = plain.select("*", *key_of(where["doc_id"], where["text"]))
    return keyed.join(checked(bad), ["k1", "k2"], "left_anti").drop("k1", "k2").toDF(*names)
