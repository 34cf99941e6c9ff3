"""SentencePiece encoding and decoding by suffix-array matching.

The model is a byte-pair one.  Its encoding of a text is the only sequence of pieces in which every piece encodes
to itself and every two neighbours encode, joined, to themselves (a merge across their border would have come
first otherwise).  So instead of merging, pieces are matched and a lattice is relaxed:

1. the batch's texts are cut where no piece goes across: before word marks, and between two characters that
   stand side by side in no piece.  Its distinct parts are joined into one text, and the text's suffixes are
   sorted by as many characters as the longest piece has (prefix doubling);
2. all pieces are looked up by binary search at once, a character a round; each gets the range of suffixes, that
   is the places, where it occurs;
3. the resulting edges are sorted by position;
4. relaxing them in that order, an edge is taken if its beginning was reached and its piece may follow the piece
   that reached it.  Exactly one edge reaches each position, and the last piece of the whole part gives the
   encoding backwards.

A character without a piece becomes its UTF-8 bytes' pieces (or the unknown piece).  Parts are remembered from
batch to batch: the last ``MEMO`` that came up and the ``MEMO`` before them.  Decoding joins the pieces, takes byte pieces as UTF-8, turns word marks
into blanks and drops the one that encoding put in front.

Defined results: a null text has null ids, the empty text none; every text without U+2581 comes back unchanged
(U+2581 comes back as a blank, which is what the model takes it for); repeated rows are encoded one by one;
a very long text is cut into its parts as a whole; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import give_back, pick, ship_code

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO = 200_000
#: Characters indexed at a time, and of texts taken at a time.
INDEX, TEXTS = 1 << 18, 1 << 21
#: Longest part that is relaxed side by side with others; slots of the table of pairs, as a power of 2.
LONG, SLOT_BITS = 256, 21
_BORDER = 0x110000
_BEGIN, _UNKNOWN, _NONE = -2, -3, -1


class Encoder:
    """The pieces of a model, and what can be said of them once for all; goes to the executors as it is."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces = pieces
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.ids = {pieces[i]: i for i in normal}
        # equal scores have equal ranks: the leftmost merge comes first
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.rank = {pieces[i]: order[scores[i]] for i in normal}
        self.bytes = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.unknown = kinds.index("unknown") if "unknown" in kinds else 0
        self.plain = [b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds)]
        if "unknown" in kinds:
            self.plain[self.unknown] = " ⁇ ".encode()
        self.splits: dict[str, tuple[str, str]] = {}
        self.own = {i for p, i in self.ids.items() if self.merge(p, self.splits) == [p]}
        self.ordered = all(self._at(part) <= self.rank[p] for p, i in self.ids.items() if i in self.own and len(p) > 1 for part in self.splits[p])
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in self.own)
        usable = [p for p in self.ids if self.ids[p] in self.own]
        self.usable = np.array([self.ids[p] for p in usable])
        self.longest = max(map(len, usable), default=1)
        self.lengths = np.array([len(p) for p in usable])
        # the pieces as a trie, level by level: each node's parent in the level above and its character
        codes = np.zeros((len(usable), self.longest), np.int64)
        for i, p in enumerate(usable):
            codes[i, : len(p)] = list(map(ord, p))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        node = np.zeros(len(usable), np.int64)
        for d in range(self.longest):
            live = np.flatnonzero(self.lengths > d)
            names, back = np.unique(node[live] << 21 | codes[live, d], return_inverse=True)
            node[live] = back
            ending = np.flatnonzero(self.lengths == d + 1)
            self.levels.append((names >> 21, names & 0x1FFFFF, node[ending], self.usable[ending]))
        self.length_at = np.ones(len(pieces), np.int64)
        self.length_at[self.usable] = self.lengths
        self.inside = {ab for p in usable for ab in zip(p, p[1:])}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lossy: set[str] = set()
        self.slots: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "older": {}, "slots": None}

    def _at(self, p: str) -> int:
        return self.rank[p] if len(p) > 1 else -1

    def merge(self, text: str, splits: dict | None = None) -> list[str]:
        """The encoding by merging, best rank first and leftmost on ties: slow, for single pieces and as a check."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            if splits is not None and len(parts) == 2:
                splits[text] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, piece: int, side: int) -> Iterator[tuple[str, float]]:
        """The parts of a piece along its last (side 1) or first (side 0) border, each with the rank at which it goes on."""
        p, until = self.pieces[piece], float("inf")
        while True:
            yield p, until
            if len(p) == 1:
                return
            until, p = self.rank[p], self.splits[p][side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether pieces a, b, joined, encode to a, b."""
        if not self.ordered:
            return self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        # no merge across the border comes before those that take its sides away
        get, right = self.rank.get, list(self._spine(b, 0))
        return not any((r := get(x + y)) is not None and r < x_until and r <= y_until for x, x_until in self._spine(a, 1) for y, y_until in right)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in a text of code points, sorted by start."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        k = 1
        while k < self.longest and k < n:  # ranks of the first 2k characters from those of k
            after = np.zeros(n, np.int64)
            after[: max(n - k, 0)] = rank[k:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            k *= 2
        suffixes = np.argsort(rank, kind="stable")
        padded = np.concatenate([text, np.full(self.longest + 1, _BORDER)])
        low, high, starts, found = np.zeros(1, np.int64), np.full(1, n, np.int64), [], []
        for d, (parent, want, ending, piece) in enumerate(self.levels):
            ends = [low[parent], high[parent]]
            live = np.flatnonzero(ends[0] < ends[1])
            want = want[live]
            low, high = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
            for right, out in ((False, low), (True, high)):
                a, b = ends[0][live], ends[1][live]
                for _ in range(int(n).bit_length() + 1):
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) >> 1
                    here = padded[suffixes[np.minimum(mid, n - 1)] + d]
                    less = (here <= want) if right else (here < want)
                    a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
                out[live] = a
            size = (high - low)[ending]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[ending], size)
            starts.append(suffixes[at])
            found.append(np.repeat(piece, size))
        start, which = np.concatenate(starts), np.concatenate(found)
        order = np.argsort(start, kind="stable")
        return start[order], which[order]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, as the bytes of 32-bit numbers."""
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes + 1) - sizes - 1
        joined = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        joined[begins + sizes] = _BORDER
        start, piece = self.edges(joined)
        known = np.zeros(len(joined), bool)
        known[start[np.isin(piece, self.usable[self.lengths == 1])]] = True
        single = np.flatnonzero(~known & (joined != _BORDER))
        if len(single):  # characters without a piece
            start, piece = np.concatenate([start, single]), np.concatenate([piece, np.full(len(single), _UNKNOWN)])
            order = np.argsort(start, kind="stable")
            start, piece = start[order], piece[order]
        part = np.searchsorted(begins, start, "right") - 1
        # parts without odd characters go side by side, a character a step; long and odd ones alone
        alone = sizes > LONG
        alone[part[piece < 0]] = True
        ends = start + np.where(piece >= 0, self.length_at[piece], 1)
        out: list[bytes] = [b""] * len(parts)
        by = ~alone[part]
        if by.any():
            self._abreast(begins, sizes, ~alone, start[by], ends[by], piece[by], part[by], out)
        if alone.any():
            self._apart(joined, begins, sizes, np.flatnonzero(alone), start[~by], ends[~by], piece[~by], out)
        return out

    def _abreast(self, begins, sizes, which, start, ends, piece, part, out) -> None:
        """Relaxes many short parts at once: all edges at one offset, then those at the next."""
        last = np.full(int(begins[-1] + sizes[-1]) + 2, _NONE, np.int64)
        last[begins[which]] = _BEGIN
        offset = start - begins[part]
        order = np.argsort(offset, kind="stable")
        bounds = np.searchsorted(offset[order], np.arange(int(sizes[which].max()) + 1))
        for first, upto in zip(bounds[:-1], bounds[1:]):
            now = order[first:upto]
            before = last[start[now]]
            now, before = now[before != _NONE], before[before != _NONE]
            good = self._may_follow(before, piece[now])
            last[ends[now[good]]] = piece[now[good]]
        # walk back from the ends, all parts a piece a step
        ids = np.flatnonzero(which)
        at, got_part, got_piece = begins[ids] + sizes[ids], [], []
        while len(ids):
            p = last[at]
            got_part.append(ids)
            got_piece.append(p)
            at = at - self.length_at[p]
            more = at > begins[ids]
            ids, at = ids[more], at[more]
        part_of, found = np.concatenate(got_part[::-1]), np.concatenate(got_piece[::-1]).astype(np.int32)
        order = np.argsort(part_of, kind="stable")
        raw, counts = found[order].tobytes(), np.bincount(part_of, minlength=len(out))
        stops = (4 * np.cumsum(counts)).tolist()
        for i in np.flatnonzero(counts).tolist():
            out[i] = raw[stops[i] - 4 * int(counts[i]) : stops[i]]

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs.  A table with one slot a hash holds most answers; the rest are worked out."""
        good = before < 0
        both = np.flatnonzero(~good)
        key = before[both] << 32 | piece[both]
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        if self.slots is None:
            self.slots = (np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool))
        keys, answers = self.slots
        miss = np.flatnonzero(keys[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            known = np.array([self.may_follow(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            good[both] = answers[slot]
            good[both[miss]] = known[back]
            keys[slot[miss]], answers[slot[miss]] = key[miss], known[back]
        else:
            good[both] = answers[slot]
        return good

    def _apart(self, joined, begins, sizes, which, start, ends, piece, out) -> None:
        """Relaxes parts edge by edge."""
        last = {int(b): _BEGIN for b in begins[which]}
        for s, e, p in zip(start.tolist(), ends.tolist(), piece.tolist()):
            before = last.get(s, _NONE)
            if before != _NONE and (before < 0 or p < 0 or self.may_follow(before, p)):
                last[e] = p
        full = len(self.bytes) == 256
        for i in which.tolist():
            b, at, ids = int(begins[i]), int(begins[i] + sizes[i]), []
            while at > b:
                p = last[at]
                if p == _UNKNOWN:
                    raw = chr(int(joined[at - 1])).encode("utf-8", "replace")
                    ids.extend([self.bytes[x] for x in reversed(raw)] if full else [self.unknown])
                    at -= 1
                else:
                    ids.append(p)
                    at -= int(self.length_at[p])
            ids.reverse()
            out[i] = array("i", ids).tobytes()

    def cut(self, text: str) -> list[str]:
        """The text, marked, cut before word marks; each part without the mark that it begins with."""
        if not self.apart:
            return [text.replace(" ", MARK)]
        if MARK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")  # one blank between parts
        return [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def parts(self, segment: str) -> list[str]:
        """A segment cut between characters that stand side by side in no piece."""
        inside, out, at = self.inside, [], 0
        for i, ab in enumerate(zip(segment, segment[1:]), 1):
            if ab not in inside:
                out.append(segment[at:i])
                at = i
        out.append(segment[at:])
        return out

    def _learn(self, names: set[str]) -> dict[str, bytes]:
        """A table with the ids of each of the names (and of others)."""
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older, new = self.memo, self.older, {}
        for name in names.difference(memo):
            ids = older.get(name)
            if ids is not None:
                memo[name] = ids
            else:
                # letters alone are seldom cut further, and need not be
                new[name] = [MARK + name] if name.isalpha() else self.parts(MARK + name)
        some = {}
        for name, ps in new.items():
            if len(ps) == 1:
                some[ps[0]] = None
            else:
                for p in ps:
                    some[p] = memo.get(p[1:], older.get(p[1:])) if p[0] == MARK else None
        lacking = sorted(p for p, ids in some.items() if ids is None)
        first = 0
        while first < len(lacking):
            end, chars = first, 0
            while end < len(lacking) and (end == first or chars + len(lacking[end]) < INDEX):
                chars += len(lacking[end]) + 1
                end += 1
            some.update(zip(lacking[first:end], self.encode_parts(lacking[first:end])))
            first = end
        plain = self.plain
        for name, ps in new.items():
            ids = memo[name] = some[ps[0]] if len(ps) == 1 else b"".join([some[p] for p in ps])
            if b"".join([plain[i] for i in memoryview(ids).cast("i")]) != (MARK + name).replace(MARK, " ").encode("utf-8", "replace"):
                self.lossy.add(name)
        return memo

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text."""
        return [ids for ids, _ in self.encode_checked(texts)]

    def encode_checked(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray | None, bool | None]]:
        """(ids, whether they decode to the text) of each text.  Decoding joins what the parts decode to, and each
        part is decoded when it is learned, so a text comes back if all its parts do; but a mark in the text itself
        comes back as a blank."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= TEXTS):
                size += len(texts[upto] or "")
                upto += 1
            cut = [self.cut(t) if t else [] for t in texts[at:upto]]
            got = self._learn(set(chain.from_iterable(cut)))
            for t, c in zip(texts[at:upto], cut):
                if t is None:
                    yield None, None
                else:
                    yield np.frombuffer(b"".join(map(got.__getitem__, c)), np.int32), MARK not in t and (not self.lossy or self.lossy.isdisjoint(c))
            at = upto

    def forget(self) -> None:
        """Lets go of the parts remembered: a Python worker outlives its task."""
        self.memo, self.older = {}, {}
        self.lossy.clear()
        give_back()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.plain.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def load(path: str = MODEL) -> Encoder:
    """The encoder of a model file, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "unused" if sp.is_unused(i) else "normal" for i in range(len(sp))]
    return Encoder([sp.id_to_piece(i) for i in range(len(sp))], [sp.get_score(i) for i in range(len(sp))], kinds)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of every row; ``round_trip`` says that decoding the ids gives the text."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(load(path))  # bounded by the vocabulary
    d = pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                got, same = zip(*enc.encode_checked(b.column("text").to_pylist()))
                sizes = [0 if g is None else len(g) for g in got]
                values = pa.array(np.concatenate([np.empty(0, np.int32), *[g for g in got if g is not None]]), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values, mask=pa.array([g is None for g in got]))
                n = pa.array([None if g is None else len(g) for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, ids, pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "round_trip"])
        enc.forget()

    return d.mapInArrow(rows, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    spark = encoded.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(load(path))
    d = pick(encoded, "doc_id", "ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in (v.as_py() for v in b.column("ids"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return d.mapInArrow(rows, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")
