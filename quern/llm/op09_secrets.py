"""Secret scans with a recursive decoding worklist.

Every text is scanned as it is; then encoded stretches are unwrapped into new
layers, each layer is scanned and unwrapped in turn, until no layer gives a new
one.  URL escapes and Unicode escapes are decoded in place.  Base64 runs, and
runs wrapped over lines, become layers of their own at all four alignments, so
that a joined prefix hides nothing; bytes that are not UTF-8 stand in a layer as
lone surrogates; bytes with zeros between the others, as in wide encodings, are
read without them too.  Gzip and zlib data that begins anywhere in such bytes becomes a
layer too, all its members together, and is unwrapped again if it holds such
data itself.  A layer whose text
was seen before at the same stretch of the original is not entered again, which
ends cycles; at another stretch it is.  Spans found in a layer are mapped back
to the code points of the original text.

Null text counts as empty; every row gives one row, repeated ids and null ids
included.  An empty table gives an empty result.  Decoding shortens a text,
only decompression can lengthen it.  A compressed layer of more than ``WHOLE``
bytes is scanned in overlapping chunks, so memory is bounded; a stretch that is
encoded or compressed, crosses the end of a chunk and doesn't fit in ``WHOLE``
bytes marks its document ``unfinished``.  ``max_expanded`` (by default none) limits
what one document's compressed layers may expand to; a document that needs more
is marked ``unfinished`` too (its other layers are still scanned).
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import slices

KINDS = ("assign", "access", "hex")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Line ends, also as they stand in quoted strings.
BREAK = re.compile(r"[\x20\t]*+(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)+")
#: Where gzip or zlib data may begin.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\A[\x08\x18\x28\x38\x48\x58\x68]")
#: Zeros from which bytes may be a wide encoding of a secret.
ZEROS = 8
STEP, WHOLE, CHUNK, OVERLAP = 512, 64 << 20, 16 << 20, 1 << 20
TOKEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=.%\\{}\r\n"
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")

Span = tuple[int, int]
Places = Callable[[int, int], Span]
#: The way back from a layer, through all above it: its own places, then those of the layer above.
Chain = tuple[Places, "Chain"] | None


def matches(text: str, long_runs: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns; hex runs lie inside long runs."""
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for first, last in long_runs:
        out += [(*m.span(), 2) for m in HEX.finditer(text, first, last)]
    return out


def original(places: Chain, a: int, b: int) -> Span:
    """Where a stretch of a layer comes from in the original text."""
    while places:
        own, places = places
        a, b = own(a, b)
    return a, b


def unbroken(text: str, first: int, last: int) -> tuple[str, Callable[[int], int]]:
    """A run that is wrapped over lines, and where each of its characters stands."""
    ends = [m.span() for m in BREAK.finditer(text, first, last)]
    starts = [first, *(b for _, b in ends)]
    lines = [text[a:b] for a, b in zip(starts, [*(a for a, _ in ends), last], strict=True)]
    before = [0, *accumulate(map(len, lines))]

    def at(k: int) -> int:
        line = min(bisect_right(before, k), len(starts)) - 1
        return starts[line] + k - before[line]

    return "".join(lines), at


def in_place(text: str, found: Iterator[tuple[int, int, str, list[int] | None]]) -> tuple[str, Places] | None:
    """text with stretches replaced, and the way back.

    found: start, end, what stands there instead, and for each of its
    characters where it began in the stretch (None: all belongs to all).
    """
    parts: list[str] = []
    at: list[int] = []  # decoded position, source start and end of each decoded character
    first: list[int] = []
    last: list[int] = []
    done = length = 0
    for a, b, new, inner in found:
        parts += [text[done:a], new]
        length += a - done
        for k in range(len(new)):
            at.append(length + k)
            first.append(a + inner[k] if inner else a)
            last.append(a + inner[k + 1] if inner and k + 1 < len(new) else b)
        length += len(new)
        done = b
    if not at:
        return None

    def one(p: int) -> Span:
        k = bisect_right(at, p) - 1
        if k < 0:
            return p, p + 1
        if at[k] == p:
            return first[k], last[k]
        p = last[k] + p - at[k] - 1
        return p, p + 1

    return "".join([*parts, text[done:]]), lambda a, b: (one(a)[0], one(b - 1)[1])


def percent(text: str) -> Iterator[tuple[int, int, str, list[int] | None]]:
    for m in PERCENT.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            new = data.decode()
        except UnicodeDecodeError:
            yield m.start(), m.end(), data.decode(errors="replace"), None
            continue
        inner, k = [], 0
        for c in new:
            inner.append(k)
            k += 3 * len(c.encode())
        yield m.start(), m.end(), new, inner


def escapes(text: str) -> Iterator[tuple[int, int, str, list[int] | None]]:
    for m in ESCAPE.finditer(text):
        digits = re.findall(r"[0-9A-Fa-f]+", m[0][1:] if m[0][1] in "uUx" else m[0])
        if len(digits) == 2:
            code = 0x10000 + ((int(digits[0], 16) & 0x3FF) << 10) + (int(digits[1], 16) & 0x3FF)
        else:
            code = int(digits[-1], 16)
        if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            yield m.start(), m.end(), chr(code), None


def steps(pieces: Iterator[bytes]) -> Iterator[bytes]:
    for piece in pieces:
        for k in range(0, len(piece), STEP):
            yield piece[k : k + STEP]


class Inflated:
    """What gzip or zlib data expands to, in pieces: all members that follow each
    other, and of a broken one what comes before the fault."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.end, self.broken = pieces, 0, False

    def __iter__(self) -> Iterator[bytes]:
        inflate, at = zlib.decompressobj(47), 0
        for part in steps(self.pieces):
            while part:
                if inflate is None:
                    at += len(part) - len(part := part.lstrip(b"\0"))
                    if not part:
                        break
                    inflate = zlib.decompressobj(47)
                before = inflate.copy()
                try:
                    out = inflate.decompress(part)
                except zlib.error:
                    yield from self.rest(before, part)
                    return
                used = len(part) - len(inflate.unused_data)
                at, part = at + used, part[used:]
                if out:
                    yield out
                if inflate.eof:
                    self.end, inflate = at, None
        self.broken = inflate is not None

    @staticmethod
    def rest(inflate, part: bytes) -> Iterator[bytes]:
        for k in range(len(part)):
            try:
                out = inflate.decompress(part[k : k + 1])
            except zlib.error:
                return
            if out:
                yield out


class Beyond(Exception):
    """More than a document may expand to."""


def as_text(data: bytes) -> str:
    return data.decode(errors="surrogateescape")


def byte_offsets(text: str) -> np.ndarray:
    """Where each character of as_text(data) begins in data, and where the last one ends."""
    if text.isascii():
        return np.arange(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = 1 + (code > 0x7F) + (code > 0x7FF).astype(np.int64) + (code > 0xFFFF)
    wide[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return np.append(0, np.cumsum(wide))


def byte_places(text: str) -> Callable[[int], int]:
    """From a position in as_text(data) to that in data."""
    at = byte_offsets(text)
    return lambda k: int(at[k])


class Scan:
    """All spans of one text: kind -> smallest depth at which it was found."""

    def __init__(self, text: str, max_expanded: int | None = None):
        self.spans: dict[tuple[int, int, int], int] = {}
        self.unfinished = False
        self.left = max_expanded
        self.seen = {(self.key(text), (0, len(text)))}
        self.work: list[Callable[[], None]] = []
        self.enter(text, None, 0)
        while self.work:
            self.work.pop()()

    @staticmethod
    def key(text: str) -> bytes:
        return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def enter(self, text: str, places: Chain, depth: int) -> None:
        runs = [m.span() for m in LONG.finditer(text)]
        for a, b, kind in matches(text, runs):
            self.spans.setdefault((*original(places, a, b), kind), depth)
        wrapped = [m.span() for m in WRAPPED.finditer(text) if m.end() - m.start() > 16]
        if runs or wrapped or "%" in text or "\\" in text:
            self.work.append(lambda: self.unwrap(text, places, depth, runs, wrapped))

    def layer(self, text: str, places: Chain, depth: int) -> None:
        key = self.key(text), original(places, 0, len(text)) if text else (0, 0)
        if key not in self.seen:
            self.seen.add(key)
            self.enter(text, places, depth)

    def unwrap(self, text: str, places: Chain, depth: int, runs: list[Span], wrapped: list[Span]) -> None:
        for found in (percent(text) if "%" in text else (), escapes(text) if "\\" in text else ()):
            if new := in_place(text, found):
                self.layer(new[0], (new[1], places), depth + 1)
        for first, last in runs:
            self.decode(text[first:last], lambda k, f=first: f + k, places, depth + 1)
        for first, last in wrapped:
            code, at = unbroken(text, first, last)
            self.decode(code, at, places, depth + 1)

    def decode(self, code: str, at: Callable[[int], int], places: Chain, depth: int) -> None:
        """Layers of a base64 run; at: where each of its characters stands."""
        code = code.translate({45: 43, 95: 47})
        n = len(code)
        for k in range(min(4, n - 1)):
            m = n - k - ((n - k) % 4 == 1)
            data = base64.b64decode(code[k : k + m] + "=" * (-m % 4))
            text = as_text(data)
            inner: list[Callable[[int], int]] = []

            def own(a: int, b: int, k: int = k, text: str = text, inner: list = inner) -> Span:
                if not inner:
                    inner.append(byte_places(text))
                return at(k + inner[0](a) // 3 * 4), at(min(n, k - (-inner[0](b) // 3) * 4) - 1) + 1

            self.layer(text, (own, places), depth)
            if data.count(0) >= ZEROS:
                self.narrow(data, own, text, places, depth)
            self.packed(data, lambda p, k=k: original(places, at(k + p // 3 * 4), at(n - 1) + 1), depth)

    def narrow(self, data: bytes, own: Places, text: str, places: Chain, depth: int) -> None:
        """The layer of the bytes that aren't zero; where it stands in text, which has them."""
        whole = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(whole)
        thin = as_text(whole[at].tobytes())
        byte, character = byte_places(thin), np.repeat(np.arange(len(text)), np.diff(byte_offsets(text)))
        self.layer(thin, (lambda a, b: own(int(character[at[byte(a)]]), int(character[at[byte(b) - 1]]) + 1), places), depth)

    def packed(self, data: bytes, stretch: Callable[[int], Span], depth: int, more: bool = False) -> None:
        """Layers of the gzip or zlib data in data; stretch: the original's part
        from a position in data on; more: data goes on after its end."""
        if data.isascii():
            return
        end = 0
        for m in PACKED.finditer(data):
            p = m.start()
            if p < end or data[p] != 0x1F and (len(data) < p + 7 or (data[p] << 8 | data[p + 1]) % 31):
                continue
            inflated = Inflated(data[q : q + (1 << 20)] for q in range(p, len(data), 1 << 20))
            before = self.left
            try:
                self.expand(self.limited(iter(inflated)), stretch(p), depth)
            except Beyond:
                self.unfinished, self.left = True, before
            if more and inflated.broken:
                self.unfinished = True
            end = p + inflated.end

    def limited(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        for piece in pieces:
            if self.left is not None:
                if len(piece) > self.left:
                    raise Beyond
                self.left -= len(piece)
            yield piece

    def expand(self, pieces: Iterator[bytes], span: Span, depth: int) -> None:
        """A layer of decompressed data, all of which comes from span."""
        parts, size = [], 0
        for piece in pieces:
            parts.append(piece)
            size += len(piece)
            if size > WHOLE:
                return self.stream(b"".join(parts), pieces, span, depth)
        if size:
            data = b"".join(parts)
            self.layer(as_text(data), (lambda a, b: span, None), depth)
            if data.count(0) >= ZEROS:
                self.layer(as_text(data.replace(b"\0", b"")), (lambda a, b: span, None), depth)
            self.work.append(lambda: self.again(data, span, depth + 1))

    def again(self, data: bytes, span: Span, depth: int) -> None:
        key = blake2b(data, digest_size=16).digest() + b"bytes", span
        if key not in self.seen:
            self.seen.add(key)
            self.packed(data, lambda p: span, depth)

    def stream(self, head: bytes, pieces: Iterator[bytes], span: Span, depth: int) -> None:
        """The same for much data: chunk by chunk, each begins with the end of the one before."""
        if PACKED.match(head) and next(iter(Inflated(iter([head]))), None) is not None:
            return self.expand(self.limited(iter(Inflated(chain([head], pieces)))), span, depth + 1)
        parts, size = [head], len(head)
        while True:
            for piece in pieces:
                parts.append(piece)
                size += len(piece)
                if size >= CHUNK + OVERLAP:
                    break
            else:
                pieces = None
            data = b"".join(parts)
            self.layer(as_text(data), (lambda a, b: span, None), depth)
            if data.count(0) >= ZEROS:
                self.layer(as_text(data.replace(b"\0", b"")), (lambda a, b: span, None), depth)
            self.packed(data, lambda p: span, depth + 1, more=pieces is not None)
            # layers of this chunk before the next one is held
            others, self.work = self.work, []
            while self.work:
                self.work.pop()()
            self.work = others
            if pieces is None:
                return
            keep = min(len(data.rstrip(TOKEN)), len(data) - OVERLAP)
            if len(data) - keep > WHOLE:
                self.unfinished, keep = True, len(data) - OVERLAP
            parts = [data[keep:]]
            size = len(parts[0])


SPANS = "array<struct<kind:string,start:int,end:int,depth:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_expanded: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, spans by start, kind and end (depth 0:
    in the text as it is; more: so many layers below), unfinished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8_000_000):
            spans, unfinished = [], []
            for text in part.column("text").to_pylist():
                scan = Scan(text or "", max_expanded)
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "depth": d} for (a, b, k), d in sorted(scan.spans.items(), key=lambda x: (x[0][0], x[0][2], x[0][1]))])
                unfinished.append(scan.unfinished)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, ARROW_SPANS), pa.array(unfinished)], ["doc_id", "spans", "unfinished"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id long, spans {SPANS}, unfinished boolean")


def masked(text: str, mask: str, max_expanded: int | None = None) -> str:
    parts, done = [], 0
    for a, b, _ in sorted(Scan(text, max_expanded).spans):
        if a >= done:
            parts += [text[done:a], mask]
        done = max(done, b)
    return "".join([*parts, text[done:]]) if parts else text


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", max_expanded: int | None = None) -> DataFrame:
    """docs with every span of text_col replaced by mask; all other columns, null
    texts and clean texts stay as they are."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, mask, max_expanded) if isinstance(t, str) else None)

    return docs.withColumn(text_col, redact(F.col(text_col)))
