"""Language identification by hyperdimensional profiles.

Each letter has a random vector of ``DIM`` signs, made from its code point.  A trigram is its letters' vectors,
rotated by their place and multiplied (bound); a document is the sum (bundle) of its trigrams' vectors; a
language's prototype is the bundle of its documents at unit length.  A document's language is that of the
prototype with the greatest cosine, the first by name on a tie, and the score is the cosine, at least 0.

Texts are taken in lower case; runs of other characters than letters count as one blank.  Prototypes are fitted
on at most about ``PER_LANGUAGE`` documents of each language, taken by a hash of the id from all training rows.

What comes to the driver and goes to every executor is one vector for each distinct language.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned; null
languages are not learned; repeated rows are learned and judged one by one; a very long text is read whole, ``BLOCK``
characters at a time; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checked, materialize, pick, ship_code

DIM = 2048
SEED = 20240229
HELD_OUT = 2
PER_LANGUAGE = 5000
#: Characters taken at a time, and distinct trigrams bound at a time.
BLOCK, BIND = 1 << 19, 1 << 12
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=4096)
def letter_vector(code: int) -> np.ndarray:
    """``DIM`` random signs that depend on the code point only."""
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIM, dtype=np.int8)
    return 2 * bits - 1


def _bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of trigrams given as packed code points."""
    parts = [(codes >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)]
    names, at = np.unique(np.concatenate(parts), return_inverse=True)
    base = np.stack([letter_vector(int(c)) for c in names])
    a, b, c = np.split(at, 3)
    return (np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]).astype(np.float32)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, packed trigram) of every trigram of the texts."""
    big = "\0".join(" " + t.replace("\0", " ").lower() + " " for t in texts)
    arr = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(arr == 0, 0, np.where(_letters()[arr], arr, 32)).astype(np.uint64)
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 32) | (kind[:-1] != 32)
    kind = kind[keep]
    doc = np.cumsum(kind == 0)
    a, b, c = kind[:-2], kind[1:-1], kind[2:]
    good = (a != 0) & (b != 0) & (c != 0)
    return doc[1:-1][good], ((a << np.uint64(42)) | (b << np.uint64(21)) | c)[good]


def profiles(texts: list[str | None]) -> np.ndarray:
    """A row for each text: the bundle of its trigrams, zero if it has no letter."""
    out = np.zeros((len(texts), DIM), np.float32)
    pieces = [(i, t[at : at + BLOCK + 2]) for i, t in enumerate(texts) if t for at in range(0, max(1, len(t) - 2), BLOCK)]
    at = 0
    while at < len(pieces):
        upto, size = at, 0
        while upto < len(pieces) and (upto == at or size + len(pieces[upto][1]) <= BLOCK):
            size += len(pieces[upto][1])
            upto += 1
        owner = np.array([i for i, _ in pieces[at:upto]])
        doc, codes = _trigrams([t for _, t in pieces[at:upto]])
        names, which = np.unique(codes, return_inverse=True)
        rows, n = np.zeros((upto - at, DIM), np.float32), upto - at
        for first in range(0, len(names), BIND):
            some = names[first : first + BIND]
            mine = (which >= first) & (which < first + BIND) if len(names) > BIND else slice(None)
            counts = np.bincount(doc[mine] * len(some) + which[mine] - first, minlength=n * len(some)).reshape(n, len(some))
            rows += counts.astype(np.float32) @ _bound(some)
        np.add.at(out, owner, rows)
        at = upto
    return out


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 4


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, i, v): sums over the partition's documents, by language and dimension."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        unit = _unit(profiles(texts)).astype(np.float64)
        for lang in set(langs):
            mine = np.array([x == lang for x in langs])
            sums[lang] = sums.get(lang, 0) + unit[mine].sum(axis=0)
    for lang, v in sums.items():
        # rounded, so that sums do not depend on the order of the partitions
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.rint(v * (1 << 20)).astype(np.int64))], names=["lang", "i", "v"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages learned, by name, and their prototypes at unit length."""
    ship_code(docs.sparkSession)
    d = pick(docs, "doc_id", "text", "lang").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = d.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull())
    share = materialize(rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share")), "share")
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.join(checked(share), "lang").where(draw < F.col("share")).where(F.col("text").isNotNull())
    got = sample.select("text", "lang").mapInArrow(_learn, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    table = np.zeros((len(langs), DIM))
    where = {x: k for k, x in enumerate(langs)}
    table[[where[x] for x in got.column("lang").to_pylist()], got.column("i").to_numpy()] = got.column("v").to_numpy()
    good = np.linalg.norm(table, axis=1) > 0
    return [x for x, g in zip(langs, good) if g], _unit(table[good]).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    ship_code(docs.sparkSession)
    d = pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    d = d.withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT)
    kind = d.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, texts = [], [], b.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                part = texts[at : at + 512]
                if langs:
                    cos = _unit(profiles(part)) @ prototypes.T
                    best, top = cos.argmax(axis=1), np.clip(cos.max(axis=1), 0, 1)
                for i, t in enumerate(part):
                    known = bool(langs) and _has_letter(t)
                    names.append(langs[best[i]] if known else UNKNOWN)
                    scores.append(float(top[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return d.mapInArrow(rate, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *train(docs))
