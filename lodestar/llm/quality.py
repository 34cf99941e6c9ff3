"""Quality rules with adaptive thresholds.

Fixed cutoffs are replaced by fences read from mergeable quantile sketches, one per language and source:

1. every document is reduced to counts (words, symbols, repeated lines, repeated 3-word windows);
2. four ratios per document go into sketches.  A sketch is a histogram over logarithmic bins with
   ``SKETCH_BITS`` significant bits (relative error below 2 ** -(SKETCH_BITS - 1)).  Bins are fixed, so
   sketches merge by adding counts: partial aggregation builds them, and the sketch of a language or of the
   corpus is the sum of the sketches of its sources;
3. quartiles of a (language, source) sketch give outer fences, ``FENCE`` widths beyond the quartile.  A width is the
   greater of the group's interquartile range and of its language's tail (from the median to the outer decile), and
   no word length between its language's outer deciles is outside, so that a source of copies does not shut out the
   rest of its language.  A group with fewer than ``min_group``
   documents takes its language's fences, and a language with fewer takes the corpus's;
4. documents are joined with the fences of their group and filtered.  A ratio of a short document is uncertain: it
   is judged by its count, which must pass what the fence leads to expect by ``FENCE`` standard deviations.

Defined results: a null or empty text has no words, fails the base rule and is not kept; null ``lang`` or
``source`` is a group of its own; repeated rows and ties count and are judged one by one; a very long text is read in
blocks and held as one number a word; an empty table gives an empty table; extra columns are ignored, or carried along
by ``kept``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lodestar.llm.common import ASCII_SPACE, checked, give_back, materialize, pick, positional, ship_code, word_blocks

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SKETCH_BITS = 7
METRICS = ("sym_bp", "dup_bp", "rep_bp", "len_pc")
#: What each ratio is made of: the count, what it is a share of, parts to the whole, and the least that one event adds.
MADE_OF = {"sym_bp": ("n_symbols", "n_words", 10_000, 1), "dup_bp": ("n_dup_lines", "n_lines", 10_000, 1), "rep_bp": ("n_repeat_words", "n_words", 10_000, 6), "len_pc": ("word_chars", "n_words", 100, 1)}
FENCE = 3
MIN_GROUP = 50


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, characters in words, symbols, repeated lines, words in repeated 3-word windows, lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    n_chars = len(text) - (len(raw) - len(raw.translate(None, ASCII_SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    blocks = word_blocks(raw)
    words = next(blocks, [])
    more = next(blocks, None)
    if more is None:
        return len(words), n_chars, n_symbols, n_dup, repeated_words(words), n_lines
    numbers: dict[bytes, int] = {}
    ids = np.concatenate([np.fromiter((numbers.setdefault(w, len(numbers)) for w in b), np.int64) for b in chain([words, more], blocks)])
    return len(ids), n_chars, n_symbols, n_dup, repeated_ids(ids), n_lines


def repeated_ids(ids: np.ndarray) -> int:
    """``repeated_words`` of words given as numbers."""
    if len(ids) < 4:
        return 0
    key = ids[:-2]
    for part in (ids[1:-1], ids[2:]):  # number the pairs, then the windows
        key = np.unique(key * (int(part.max()) + 1) + part, return_inverse=True)[1]
    hit = np.bincount(key)[key] > 1
    inside = np.zeros(len(ids), bool)
    for i in range(3):
        inside[i : len(hit) + i] |= hit
    return int(inside.sum())


def repeated_words(words: list[bytes]) -> int:
    """Positions inside 3-word windows that occur twice or more; every occurrence counts, the first too."""
    if len(words) < 4:
        return 0
    counts = Counter(zip(words, words[1:], words[2:]))
    if len(counts) == len(words) - 2:
        return 0
    hit, covered = 0, 0
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if counts[window] > 1:
            hit += i + 3 - max(covered, i)
            covered = i + 3
    return hit


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [count_text(t.as_py()) for t in b.column("text")]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
        keep = [b.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays(keep + cols, names=["doc_id", "lang", "source", *COUNTS])
    give_back()


def features(docs: DataFrame) -> DataFrame:
    """Counts of every document; see ``count_text``."""
    ship_code(docs.sparkSession)
    d = pick(docs, "doc_id", "lang", "source", "text")
    d = d.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_features, f"doc_id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")


def judged(feats: DataFrame) -> DataFrame:
    """Adds the ratios and ``base_failed``."""
    return feats.select(
        "*",
        F.expr("n_symbols * 10000 div greatest(n_words, 1)").alias("sym_bp"),
        F.expr("n_dup_lines * 10000 div greatest(n_lines, 1)").alias("dup_bp"),
        F.expr("n_repeat_words * 10000 div greatest(n_words, 1)").alias("rep_bp"),
        F.expr("word_chars * 100 div greatest(n_words, 1)").alias("len_pc"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def sketch(rows: DataFrame) -> DataFrame:
    """One sketch per language, source and metric, as rows (lang, source, metric, bin, n)."""
    tall = rows.select("lang", "source", F.expr("stack(4, " + ", ".join(f"'{m}', {m}" for m in METRICS) + ") as (metric, v)"))
    shift = f"greatest(length(bin(v)) - {SKETCH_BITS}, 0)"
    binned = tall.select("lang", "source", "metric", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})").alias("bin"))
    return binned.groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sk: DataFrame, *keys: str) -> DataFrame:
    """Quantiles of merged sketches: the first bin at which the cumulative count reaches the rank.  Lower quantiles and
    the median are the bin's least value, upper ones its greatest."""
    merged = sk.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "metric")
    cum = merged.select(*keys, "metric", "bin", F.sum("n").over(w).alias("total"), F.sum("n").over(w.orderBy("bin")).alias("cum"))
    top = F.expr(f"bin + shiftleft(1L, greatest(length(bin(bin)) - {SKETCH_BITS}, 0)) - 1")
    at = lambda tenths, c: F.min(F.when(20 * F.col("cum") >= tenths * F.col("total"), c))
    return cum.groupBy(*keys, "metric").agg(
        F.max("total").alias("total"), at(2, F.col("bin")).alias("p10"), at(5, F.col("bin")).alias("p25"), at(10, F.col("bin")).alias("p50"), at(15, top).alias("p75"), at(18, top).alias("p90")
    )


LIMITS = (*(f"{m}_hi" for m in METRICS), "len_pc_lo")


def _fences(q: DataFrame, *keys: str) -> DataFrame:
    """One row a group, from (keys, metric, total, p25, p75, iqr, above, below, p10, p90)."""
    hi = F.col("p75") + FENCE * F.greatest("iqr", "above")
    hi = F.when(F.col("metric") == "len_pc", F.greatest(hi, "p90")).otherwise(hi)
    lo = F.least(F.col("p25") - FENCE * F.greatest("iqr", "below"), "p10")
    one = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    return q.groupBy(*keys).agg(F.max("total").alias("total"), *[one(m, hi).alias(f"{m}_hi") for m in METRICS], one("len_pc", lo).alias("len_pc_lo"))


def _spread(q: DataFrame) -> DataFrame:
    return q.withColumns({"iqr": F.col("p75") - F.col("p25"), "above": F.col("p90") - F.col("p50"), "below": F.col("p50") - F.col("p10")})


def thresholds(sk: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Fences by language and source, each from the narrowest sketch with at least ``min_group`` documents."""
    # the corpus's quantiles are four rows of numbers
    corpus = {r.metric: r for r in _spread(_quantiles(sk.withColumn("_all", F.lit(1)), "_all")).collect()}
    every = lambda c: F.coalesce(*[F.when(F.col("metric") == m, F.lit(int(r[c]))) for m, r in corpus.items()], F.lit(0)).cast("long")
    # a language with few documents takes the corpus's quantiles
    small = F.col("total") < min_group
    lang = _spread(_quantiles(sk, "lang")).select("lang", "metric", *[F.when(small, every(c)).otherwise(F.col(c)).alias(c) for c in ("p25", "p75", "iqr", "above", "below", "p10", "p90")])
    l_ = lang.select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), *[F.col(c).alias(f"l_{c}") for c in lang.columns[2:]])
    own = _spread(_quantiles(sk, "lang", "source"))
    met = own.join(l_, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    few = F.col("total") < min_group
    level = [F.when(few, F.col(f"l_{c}")).otherwise(F.col(c)).alias(c) for c in ("p25", "p75", "iqr")]
    return _fences(met.select("lang", "source", "metric", "total", *level, *[F.col(f"l_{c}").alias(c) for c in ("above", "below", "p10", "p90")]), "lang", "source").drop("total")


def _inside() -> Column:
    """Whether all counts lie within what the fences lead to expect, and ``FENCE`` standard deviations more."""
    ok = F.lit(True)
    for m, (count, of, whole, least) in MADE_OF.items():
        seen = F.col(count).cast("double") / F.lit(float(least))
        want = lambda c: (F.col(of) * F.greatest(F.col(c), F.lit(0))).cast("double") / F.lit(float(whole * least))  # noqa: B023, E731
        slack = lambda e: F.lit(float(FENCE)) * F.sqrt(e + F.lit(1.0))
        ok = ok & (seen <= want(f"{m}_hi") + slack(want(f"{m}_hi")))
        if m == "len_pc":
            ok = ok & (seen >= want("len_pc_lo") - slack(want("len_pc_lo")))
    return ~F.col("base_failed") & F.coalesce(ok, F.lit(True))


def _met(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with the fences of their language and source, null being a value of its own."""
    f = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")


def quality(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, ratios, fences and verdict of every document (one row for each row of ``docs``).

    ``kept`` is false where the base rule fails; elsewhere it says that every ratio lies within the fences.
    """
    rows = judged(materialize(features(docs), "quality"))
    limits = materialize(thresholds(materialize(sketch(rows.where(~F.col("base_failed"))), "sketch"), min_group), "fences")
    return _met(rows, checked(limits)).withColumn("kept", _inside()).drop("_lang", "_source")


def kept(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their own columns.

    A row's verdict follows from its counts and its group's fences, so the counts are taken a second time beside
    the text and meet the (small, written) table of fences; texts are shuffled only if that table is large.
    """
    ship_code(docs.sparkSession)
    narrow = judged(materialize(features(docs), "quality"))
    limits = materialize(thresholds(materialize(sketch(narrow.where(~F.col("base_failed"))), "sketch"), min_group), "fences")
    plain, where, names = positional(docs)
    text = where["text"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count_text(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=b.schema.names + list(COUNTS))
        give_back()

    schema = T.StructType(plain.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])
    full = plain.mapInArrow(counted, schema).withColumn("lang", F.col(where["lang"]).cast("string")).withColumn("source", F.col(where["source"]).cast("string"))
    met = _met(judged(full), checked(limits)).where(_inside())
    return met.select(*[F.col(f"_c{i}") for i in range(len(names))]).toDF(*names)
