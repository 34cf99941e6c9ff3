"""Secret scans with a recursive decoding worklist.

The base patterns run over the whole text.  Then a worklist unwraps encodings until nothing new appears:

* percent escapes (``%70``) and Unicode escapes (backslash ``u0070``, ``x70``, ``&#112;``) are decoded in
  place, so that a key in plain text and a value in escapes meet in one layer;
* base64 runs become a layer of their own, and so does what gzip, zlib or bzip2 data in them holds; lines of
  base64 are joined across line breaks.  Control characters, NULs and bytes that are not UTF-8 end a stretch of
  text but lose nothing beside them, and ASCII in UTF-16 or UTF-32 is read;
* each layer is scanned and unwrapped again.  Layers already seen at a place are skipped, which ends cycles;
* escapes of escapes are unwrapped level by level ``LEVELS`` times; what is nested deeper is decoded to its end in one pass,
  whose time is in proportion to the text, and scanned there.

Every layer knows, for each of its characters, the start and end of what it came from in the text, so a
find in any layer is reported as a span of the original text: code points, end exclusive.

Defined results: null is the empty text; repeated rows are scanned one by one; of spans with one start the kind's order
decides; extra columns are ignored, or carried along by ``redacted``; an empty table gives an empty table.  Packed data is read to its end, all members of it, in blocks of about ``max_layer`` bytes: what is held is a
block, or the longest unbroken run of it; the time grows with what is unpacked (a bomb takes as long as its content).
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import give_back, pick, positional, ship_code

#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: One escape; a percent escape may be a character of several bytes.
_ONE = re.compile(r"%[0-7][0-9A-Fa-f]|%[cdCD][0-9A-Fa-f]%[89abAB][0-9A-Fa-f]|%[eE][0-9A-Fa-f](?:%[89abAB][0-9A-Fa-f]){2}|%[fF][0-7](?:%[89abAB][0-9A-Fa-f]){3}|" + _ESCAPED.pattern.split("|", 1)[1])
LEVELS, LONGEST = 32, 12
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"[\x20\t]*+(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*+")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
_URLSAFE = str.maketrans("-_", "+/")
#: Data without control characters, and what of it may matter: no find is shorter than 12 characters of ASCII.
_STRETCH = re.compile(rb"[^\x00-\x08\x0e-\x1f\x7f]{12,}")
_PRINTED = re.compile(rb"[\t-\r\x20-\x7e]{12}")
_PART = 1 << 16
#: Ends of what no find, escape or run of base64 lines holds, in any of these codings.
_SAFE = re.compile(rb"[\x01-\x08\x0e-\x1f\x7f-\xff,()<>!?@*|~^$\[\]`]|\x00{4}|\n\r?\n|[A-Za-z0-9]\x00{0,3}\x20\x00{0,3}(?=[A-Za-z0-9])")
_WIDE = [(n, re.compile(rb"(?:[\t-\r\x20-\x7e]\x00{%d}){11,}[\t-\r\x20-\x7e]?" % (n - 1))) for n in (2, 4)]
MAX_LAYER = 1 << 26


class Layer(NamedTuple):
    """A decoded text and where it came from: ``at`` holds the layer positions at which pieces begin, ``parts``
    the piece's (start, end, moves) in the original; in a piece that moves, each character is one of the
    original's, elsewhere each stands for the whole span.  The original itself has no pieces."""

    text: str
    at: list[int] | None
    parts: list[tuple[int, int, bool]] | None


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _origin(layer: Layer, start: int, end: int) -> tuple[int, int]:
    """The span of the original that the characters start to end (exclusive) of a layer came from."""
    if layer.at is None:
        return start, end

    def one(i: int) -> tuple[int, int]:
        k = bisect_right(layer.at, i) - 1
        s, e, moves = layer.parts[k]
        return (s + i - layer.at[k], s + i - layer.at[k] + 1) if moves else (s, e)

    return one(start)[0], one(end - 1)[1]


def _unescape(layer: Layer) -> Layer | None:
    """The layer with all escapes decoded in place, or None if there are none."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    out, pos, parts, size, at = [], [], [], 0, 0

    def add(piece: str, start: int, end: int, moves: bool) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            pos.append(size)
            parts.append((start, end, moves))
            size += len(piece)

    def keep(a: int, b: int) -> None:
        if layer.at is None:
            add(text[a:b], a, b, True)
            return
        k = bisect_right(layer.at, a) - 1
        while a < b:
            upto = min(b, layer.at[k + 1] if k + 1 < len(layer.at) else b)
            s, e, moves = layer.parts[k]
            add(text[a:upto], s + (a - layer.at[k]) * moves, e, moves)
            a, k = upto, k + 1

    for m in _ESCAPED.finditer(text):
        got = _decode_escape(m.group())
        if got is None:
            continue
        keep(at, m.start())
        for a, b, piece in got:
            add(piece, *_origin(layer, m.start() + a, m.start() + b), False)
        at = m.end()
    if not at:
        return None
    keep(at, len(text))
    return Layer("".join(out), pos, parts)


def _settled(layer: Layer) -> Layer | None:
    """The layer with its escapes, and what escapes these make, decoded in place until none is left; None if there is none.

    The characters are a linked list.  A decoded character may complete an escape that begins up to ``LONGEST`` characters
    before it, so these are looked at again; every escape shortens the list, so the work is linear.
    """
    text, n = layer.text, len(layer.text)
    chars, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
    spans: dict[int, tuple[int, int]] = {}
    work = [m.start() for m in _ONE.finditer(text)][::-1]
    gone = bytearray(n)
    while work:
        i = work.pop()
        if gone[i]:
            continue
        some, j = [], i
        while j < n and len(some) < LONGEST:
            some.append(j)
            j = after[j]
        m = _ONE.match("".join([chars[k] for k in some]))
        got = _decode_escape(m.group()) if m else None
        if got is None or len(got) != 1:
            continue
        used = some[: m.end()]
        first, last = spans.get(used[0]) or _origin(layer, used[0], used[0] + 1), spans.get(used[-1]) or _origin(layer, used[-1], used[-1] + 1)
        spans[i], chars[i] = (first[0], last[1]), got[0][2]
        for k in used[1:]:
            gone[k] = 1
        after[i] = after[used[-1]]
        if after[i] < n:
            before[after[i]] = i
        back = i
        for _ in range(LONGEST):
            if back < 0:
                break
            if chars[back] in "%\\&":
                work.append(back)
            back = before[back]
    if not spans:
        return None
    left, i = [], 0
    while i < n:
        left.append(i)
        i = after[i]
    parts = [(*(spans.get(i) or _origin(layer, i, i + 1)), False) for i in left]
    return Layer("".join([chars[i] for i in left]), list(range(len(left))), parts)


def _decode_escape(esc: str) -> list[tuple[int, int, str]] | None:
    """(start, end, characters) within an escape sequence; None if it stands for no character."""
    if esc[0] == "%":
        raw, got, i = bytes.fromhex(esc.replace("%", "")), [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    got.append((3 * i, 3 * (i + n), raw[i : i + n].decode("utf-8")))
                    break
                except UnicodeDecodeError:
                    n = 0
            if not n:
                got.append((3 * i, 3 * i + 3, "�"))
                n = 1
            i += n
        return got
    digits = re.sub(r"[^0-9A-Fa-f]", "", esc[2:] if esc[0] == "\\" else esc[3:] if esc[2] in "xX" else esc[2:])
    code = int(digits, 10 if esc[0] == "&" and esc[2] not in "xX" else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(0, len(esc), chr(code))]


def _coder(head: bytes):
    """A decoder for the packed data that begin so, or None."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return None


def _inflate(source: Callable[[], Iterable[bytes]], rest: list[int] | None = None) -> Iterator[bytes]:
    """What all members of packed data hold, in parts, up to where the data break off or turn into something else;
    ``rest`` gets the number of bytes that are left there."""
    coder, data = None, b""
    for block in source():
        for i in range(0, len(block), _PART):
            data += block[i : i + _PART]
            while True:
                if coder is None:
                    if len(data) < 3:
                        break
                    coder = _coder(data)
                    if coder is None:
                        if rest is not None:
                            rest.append(len(data) + max(len(block) - i - _PART, 0))
                        return
                try:
                    got = coder.decompress(data, _PART)
                except (zlib.error, OSError, EOFError, ValueError):
                    return
                if got:
                    yield got
                if coder.eof:
                    data, coder = coder.unused_data.lstrip(b"\0"), None  # members may be padded
                    continue
                data = getattr(coder, "unconsumed_tail", b"")
                if not data and len(got) < _PART:
                    break
    if coder is None and rest is not None:
        rest.append(len(data))


def _cut(buf: bytearray, known: int) -> int:
    """The last place in ``buf`` after ``known`` that no find and no base64 can cross, or 0."""
    step, lo = _PART, len(buf)
    while lo > known:
        lo, step, last = max(known, len(buf) - step), 16 * step, None
        for last in _SAFE.finditer(buf, lo):
            pass
        if last:
            return last.end()
    return 0


def _unpacked(raw: bytes, size: int) -> Iterator[bytes]:
    """What packed data holds, and what packed data in that holds, and so on: blocks of about ``size`` bytes, longer
    where an unbroken run is.  Each level is unpacked from the start again; one that was there before ends it."""
    source: Callable[[], Iterable[bytes]] = lambda: (raw,)
    seen = {hashlib.sha1(raw).digest()}
    while True:
        source = partial(_inflate, source)
        digest, head, buf, known = hashlib.sha1(), b"", bytearray(), 0
        for part in source():
            digest.update(part)
            head = head if len(head) > 2 else head + part[:3]
            buf += part
            if len(buf) >= size:
                cut = _cut(buf, known)
                if cut:
                    yield bytes(buf[:cut])
                    del buf[:cut]
                known = max(len(buf) - 16, 0)
        if buf:
            yield bytes(buf)
        if _coder(head) is None or digest.digest() in seen:
            return
        seen.add(digest.digest())


def _pieces(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(first byte, bytes a character, text) of the stretches of data that may hold a find: UTF-8 between control
    characters (bytes a character 0: as many as it has in UTF-8, one for a byte that is not UTF-8, which becomes a lone
    surrogate), and ASCII in UTF-16 or UTF-32 of either order."""
    for m in _STRETCH.finditer(raw):
        if _PRINTED.search(m.group()):
            yield m.start(), 0, m.group().decode("utf-8", "surrogateescape")
    if b"\0" in raw:
        for step, wide in _WIDE:
            for m in wide.finditer(raw):
                yield m.start(), step, m.group()[::step].decode("ascii")


def _width(ch: str) -> int:
    return 1 if "\udc80" <= ch <= "\udcff" else len(ch.encode("utf-8"))


def _runs(text: str) -> Iterator[tuple[list[tuple[int, int]], int, bool]]:
    """(lines as (start, end), end with padding, whether data may be packed) of base64: lines that follow each other,
    and each line by itself, where packed data that goes on was with the others."""
    begun = set()
    for m in _WRAPPED.finditer(text):
        if m.end() - m.start() > 16:
            lines, at = [], m.start()
            for b in _BREAK.finditer(text, m.start(), m.end()):
                lines.append((at, b.start()))
                at = b.end()
            lines.append((at, m.start() + len(m.group().rstrip("="))))
            begun.update(a for a, _ in lines)
            yield lines, m.end(), True
    for m in _BASE64.finditer(text):
        yield [(m.start(), m.start() + len(m.group().rstrip("=")))], m.end(), m.start() not in begun


def _inner(layer: Layer, max_layer: int) -> Iterator[Layer]:
    """Layers out of the base64 runs of a layer: their text, or what compressed data in them holds.

    What stands before wrapped lines may look like base64 too, so these are read from each of four characters, and
    packed data may begin at any line."""
    for lines, end, packed in _runs(layer.text):
        starts = [0, *accumulate(b - a for a, b in lines)]
        n = starts.pop()
        run = "".join(layer.text[a:b] for a, b in lines).translate(_URLSAFE)

        def at(i: int) -> int:
            k = bisect_right(starts, i) - 1
            return lines[k][0] + i - starts[k]

        def data(i: int, upto: int = n) -> bytes:
            part = run[i : upto - ((upto - i) % 4 == 1)]
            return base64.b64decode(part + "=" * (-len(part) % 4))

        for s in starts if packed else ():
            if _coder(data(s, min(n, s + 8))) is None:
                continue
            raw, upto, rest = data(s), end, []
            if len(lines) > 1:  # words after the last line are not of the data
                for _ in _inflate(lambda: (raw,), rest):
                    pass
                if rest and rest[0]:
                    upto = at(s - (-4 * (len(raw) - rest[0]) // 3) - 1) + 1
            whole = _origin(layer, at(s), upto)
            for block in _unpacked(raw, max_layer):
                for _, _, text in _pieces(block):
                    yield Layer(text, [0], [(*whole, False)])
        for shift in range(min(4, n) if len(lines) > 1 else 1):
            for first, step, text in _pieces(data(shift)):
                parts, byte = [], first
                for ch in text:  # byte i of the data is in characters 4i//3 to 4(i+1)//3 of the run
                    after = byte + (step or _width(ch))
                    parts.append((*_origin(layer, at(shift + 4 * byte // 3), at(min(n, shift - (-4 * after // 3)) - 1) + 1), False))
                    byte = after
                yield Layer(text, list(range(len(text))), parts)


def _nested(held: list[Layer], max_layer: int, level: int = 0) -> Iterator[tuple[Layer, int]]:
    """The layers in the one of ``held``, one by one, each with the number of times that escapes were unwrapped in place;
    lists are emptied so that the last keeps no other alive."""
    for inner in _inner(held[0], max_layer):
        yield inner, 0
    plain = [_unescape(held.pop()) if level < LEVELS else _settled(held.pop())]
    if plain[0] is not None and plain[0].text:
        yield plain.pop(), level + 1


def find_secrets(text: str | None, max_layer: int = MAX_LAYER) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as sorted (start, kind index, end)."""
    text = text or ""
    base = scan(text)
    spans = set(base)
    seen: set[tuple[bytes, tuple[int, int]]] = set()
    work = [_nested([Layer(text, None, None)], max_layer)] if _may_hold_layers(text) else []
    while work:
        new, level = next(work[-1], (None, 0))
        if new is None:
            work.pop()
            continue
        where = _origin(new, 0, len(new.text))
        key = hashlib.sha1(new.text.encode("utf-8", "surrogatepass")).digest()
        if (key, where) in seen:
            continue
        seen.add((key, where))
        for s, k, e in scan(new.text):
            a, b = _origin(new, s, e)
            spans.add((a, k, b))
        work.append(_nested([new], max_layer, level))
    return base, sorted(spans)


def _may_hold_layers(text: str) -> bool:
    return bool(_BASE64.search(text) or _ESCAPED.search(text) or _WRAPPED.search(text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [find_secrets(t.as_py()) for t in b.column("text")]
        counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
        sums = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        spans = pa.array([joined(every) for _, every in found], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, sums, spans], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    ship_code(docs.sparkSession)
    d = pick(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_scan_rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MARK = "[REDACTED]"


def redact(text: str | None) -> str | None:
    """The text with every span, overlapping ones merged, replaced by ``MARK``."""
    if not text:
        return text
    _, spans = find_secrets(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s] if end < 0 else text[end:s], MARK]
            at = s
        end = max(end, e)
    out.append(text[end:])
    return "".join(out)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``, and ``n_chars``, where there is one, counted anew."""
    ship_code(docs.sparkSession)
    plain, where, names = positional(docs)
    text, count = where["text"], where.get("n_chars")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [redact(t.as_py()) for t in b.column(text)]
            cols = []
            for name, old in zip(b.schema.names, b.columns):
                if name == text:
                    old = pa.array(new, old.type)
                elif name == count:
                    old = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(old.type)
                cols.append(old)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)
        give_back()

    return plain.mapInArrow(rows, plain.schema).toDF(*names)
