"""Secret scans with a worklist of decoded layers.

A text's own matches come first. Then every layer is unwrapped: URL escapes, Unicode escapes, base64 runs (also over line ends, at all four alignments) and
all that they hold compressed, in any number of members and levels, each give a new layer, which is scanned and unwrapped again until nothing new
appears; a layer seen before is not taken twice, which ends cycles. Each layer knows the span of the original
text that each of its characters came from, so that all spans are places in that text.

What is compressed is read as a stream, of any size, in windows that end where no encoded run does; what is compressed
again in it is found in the same way, by inflating the stream once more up to its place. So memory is bounded by the
window, and nothing is left out but parts of a single encoded run that is longer than a window; `read_whole` tells.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hyperloom.llm.columnar import by_batch, id_and_text

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Least lengths: the assigned value, the whole access key.
VALUE, KEY = 6, 20
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
#: Runs that line ends part, as `base64` and MIME write them.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r?\n|\r)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
STANDARD = str.maketrans("-_", "+/")
#: Where a gzip, bzip2 or zlib member may start; bytes that one call inflates; bytes that tell that a start is none.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\x78[\x01\x5e\x9c\xda]")
STEP, PROBE, LEAST_MEMBER = 1 << 20, 512, 8
#: Decompressed bytes that are held at once, a window, and those that two windows share; a byte that no encoded run has; blanks that stand for more.
MOST_EXPANDED, OVERLAP = 16 << 20, 1 << 16
BREAK = re.compile(rb"[^A-Za-z0-9+/_=%\\\s-]")
BLANKS = re.compile(rb"\x20{1024,}")
MASK = "[secret]"

Span = tuple[int, int, int]  # start, place in KINDS, end


def scan(text: str) -> list[Span]:
    """The matches in one text, leftmost and without overlaps for each kind; those that are too short are left out."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= KEY]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Layer:
    """A decoded text, and the span of the original text behind each of its characters (the same place if None)."""

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None, span: tuple[int, int] | None = None):
        self.text, self.first, self.last, self.span = text, first, last, span

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Where text[start:end] came from."""
        if self.span is not None:
            return self.span
        return (start, end) if self.first is None else (int(self.first[start:end].min()), int(self.last[start:end].max()))

    def part(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer of `text`, whose characters came from these spans of this one."""
        if self.first is None:
            return Layer(text, starts, ends, self.span)
        return Layer(text, self.first[starts], self.last[np.maximum(ends - 1, starts)])

    def digest(self) -> bytes:
        """Equal for layers of equal text and places."""
        places = repr(self.span).encode() if self.span is not None or self.first is None else self.first.tobytes()
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass") + places).digest()


def _text_of(raw: bytes) -> tuple[str, np.ndarray]:
    """Bytes as text, each byte that is not UTF-8 as a lone surrogate, and the byte where each character starts."""
    text = raw.decode("utf-8", "surrogateescape")
    if len(text) == len(raw):
        return text, np.arange(len(raw))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes < 0xDD00)] = 1
    return text, np.cumsum(sizes) - sizes


class Inflated:
    """The content of the member that some chunks of bytes start with, and of members right behind it, as chunks; `end` is where the last whole one ends."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.taken, self.end = iter(chunks), 0, 0

    def _next(self) -> bytes | None:
        chunk = next(self.chunks, None)
        self.taken += len(chunk or b"")
        return chunk

    def __iter__(self) -> Iterator[bytes]:
        rest = self._next()
        while rest is not None:
            made = bz2.BZ2Decompressor() if rest[:1] == b"B" else zlib.decompressobj(47)
            try:
                while not made.eof:
                    held = made.decompress(rest, STEP)
                    rest = getattr(made, "unconsumed_tail", b"")
                    if held:
                        yield held
                    elif not rest and not made.eof and (rest := self._next()) is None:
                        return
            except (zlib.error, OSError, EOFError):
                return
            rest = made.unused_data
            self.end = self.taken - len(rest)
            rest = rest.lstrip(b"\0")
            while len(rest) < PROBE and (more := self._next()) is not None:
                rest = (rest + more).lstrip(b"\0")
            if not MAGIC.match(rest):
                return


def _from(chunks: Iterator[bytes], at: int) -> Iterator[bytes]:
    """The chunks without their first `at` bytes."""
    for chunk in chunks:
        if at < len(chunk):
            yield chunk[at:]
        at = max(0, at - len(chunk))


def _source(raw: bytes, path: tuple[int, ...]) -> Iterator[bytes]:
    """Bytes, or for each place of the path what is compressed there, as chunks."""
    out: Iterator[bytes] = iter([raw])
    for at in path:
        out = iter(Inflated(_from(out, at)))
    return out


def _starts(raw: bytes) -> list[int]:
    """Where members may start: what follows can be inflated as far as PROBE goes."""
    out = []
    for m in MAGIC.finditer(raw):
        made = bz2.BZ2Decompressor() if m[0][:1] == b"B" else zlib.decompressobj(47)
        try:
            made.decompress(raw[m.start() : m.start() + PROBE])
            out.append(m.start())
        except (zlib.error, OSError, EOFError):
            pass
    return out


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """A stream in windows that overlap, and whether each one ends where no encoded run is cut."""
    held, shared = b"", 0  # bytes not handed on yet, and those of them that the last window had too
    for chunk in chunks:
        held = BLANKS.sub(b" " * 1024, held + chunk)
        if len(held) >= MOST_EXPANDED:
            end = next((m.start() + 1 for lo in range(len(held) - OVERLAP, -OVERLAP, -OVERLAP) for m in reversed(list(BREAK.finditer(held, max(0, lo), lo + OVERLAP)))), 0)
            whole = end > shared
            end = end if whole else len(held)
            yield held[:end], whole
            kept = max(0, end - OVERLAP)
            held, shared = held[kept:], end - kept
    if len(held) > shared:
        yield held, True


def packed(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """The windows of all that bytes hold compressed, in any number of members and levels; equal contents are read once."""
    if len(raw) < LEAST_MEMBER or not MAGIC.search(raw):
        return
    seen: set[bytes] = set()
    todo: list[list] = [[(), iter(_starts(raw)), 0]]  # the path of a source, the starts in it, and how far it is read
    while todo:
        path, starts, read = todo[-1]
        at = next((x for x in starts if x >= read), None)
        if at is None:
            todo.pop()
            continue
        stream = Inflated(_from(_source(raw, path), at))
        digest, inner, length, tail = hashlib.sha256(), [], 0, b""

        def taken(chunks=stream, digest=digest, inner=inner):
            nonlocal length, tail
            for chunk in chunks:
                digest.update(chunk)
                both = tail + chunk
                inner.extend(x + length - len(tail) for x in _starts(both) if x + 16 > len(tail))
                length += len(chunk)
                tail = both[-16:]
                yield chunk

        yield from _windows(taken())
        todo[-1][2] = at + max(1, stream.end)
        if length and digest.digest() not in seen:
            seen.add(digest.digest())
            todo.append([(*path, at), iter(sorted(set(inner))), 0])


def _escapes(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all runs of an escape decoded; runs that can't be stay as they are."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        made = decode(m[0])
        if made is None:
            continue
        text, first, last = made
        plain = np.arange(at, m.start())
        parts += [layer.text[at : m.start()], text]
        starts += [plain, m.start() + first]
        ends += [plain + 1, m.start() + last]
        at = m.end()
    if not parts:
        return None
    plain = np.arange(at, len(layer.text))
    return layer.part("".join([*parts, layer.text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]))


def _url(run: str) -> tuple[str, np.ndarray, np.ndarray]:
    raw = bytes.fromhex(run.replace("%", ""))
    text, at = _text_of(raw)
    return text, 3 * at, 3 * np.append(at[1:], len(raw))


def _unicode(run: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    units = [(int(m[1] or m[2] or m[3], 16), m.start(), m.end()) for m in ONE_ESCAPE.finditer(run)]
    out: list[tuple[str, int, int]] = []
    for code, a, b in units:
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            out[-1] = (chr(0x10000 + ((ord(out[-1][0]) - 0xD800) << 10) + code - 0xDC00), out[-1][1], b)
        elif code > 0x10FFFF:
            return None
        else:
            out.append((chr(code), a, b))
    text = "".join(c if not 0xD800 <= ord(c) < 0xE000 else "�" for c, _, _ in out)
    return text, np.array([a for _, a, _ in out]), np.array([b for _, _, b in out])


def _bytes_of(layer: Layer) -> Iterator[tuple[bytes, int, int]]:
    """The bytes of escaped runs that can hold something compressed, and the runs' spans."""
    if "%" in layer.text:
        yield from ((bytes.fromhex(m[0].replace("%", "")), *m.span()) for m in URL.finditer(layer.text) if len(m[0]) >= 3 * LEAST_MEMBER)
    if "\\" in layer.text:
        for m in UNICODE.finditer(layer.text):
            units = [int(x[1] or x[2] or x[3], 16) for x in ONE_ESCAPE.finditer(m[0])]
            if len(units) >= LEAST_MEMBER and max(units) < 256:
                yield bytes(units), *m.span()


def unwrap(layer: Layer, found: set[Span], whole: list[bool]) -> Iterator[Layer]:
    """The layers that one step of decoding finds in a layer.

    What is compressed has one span, so it is read until all kinds are in `found` there; `whole` gets False if an
    encoded run in it was cut.
    """

    def unpacked(raw: bytes, start: int, end: int) -> Iterator[Layer]:
        a, b = layer.origin(start, end)
        for window, uncut in takewhile(lambda _: not all((a, k, b) in found for k in range(len(KINDS))), packed(raw)):
            whole[0] &= uncut
            yield Layer(window.decode("utf-8", "surrogateescape"), span=(a, b))

    if "%" in layer.text and (made := _escapes(layer, URL, _url)):
        yield made
    if "\\" in layer.text and (made := _escapes(layer, UNICODE, _unicode)):
        yield made
    for raw, start, end in _bytes_of(layer):
        yield from unpacked(raw, start, end)
    for chars, places, start, end in _runs(layer.text):
        for shift in range(4):
            n = len(chars) - shift
            n -= n % 4 == 1
            if n < 2:
                continue
            raw = binascii.a2b_base64(chars[shift : shift + n] + "=" * (-n % 4))
            yield from unpacked(raw, start, end)
            text, at = _text_of(raw)
            first, last = shift + at * 4 // 3, np.minimum(shift + -(-np.append(at[1:], len(raw)) * 4 // 3), len(chars))
            yield layer.part(text, places[first], places[last - 1] + 1)


def _runs(text: str) -> list[tuple[str, np.ndarray, int, int]]:
    """Base64 runs, alone and joined over line ends: the characters, the place of each, and the span of all."""
    out = []
    for m in BASE64.finditer(text):
        chars = m[0].rstrip("=")
        out.append((chars, m.start() + np.arange(len(chars)), m.start(), m.end()))
    for m in WRAPPED.finditer(text) if "\n" in text or "\r" in text else ():
        lines = [(x[0], m.start() + np.arange(*x.span())) for x in RUN.finditer(m[0])]
        chars = "".join(x for x, _ in lines)
        if len(chars) >= 16:
            out.append((chars, np.concatenate([x for _, x in lines]), m.start(), m.end()))
    return [(chars.translate(STANDARD), *rest) for chars, *rest in out]


def search(text: str) -> tuple[list[Span], list[Span], bool]:
    """The text's own spans, and all spans with those of its decoded layers, both by start, kind and end; and whether all layers were read whole."""
    base = sorted(scan(text))
    found, whole = set(base), [True]
    first = Layer(text)
    work, seen = [unwrap(first, found, whole)], {first.digest()}
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        digest = layer.digest()
        if digest in seen:
            continue
        seen.add(digest)
        for start, kind, end in scan(layer.text):
            a, b = layer.origin(start, end)
            found.add((a, kind, b))
        work.append(unwrap(layer, found, whole))
    return base, sorted(found), whole[0]


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """The text's own spans, and all spans with those of its decoded layers."""
    return search(text)[:2]


def shown(spans: list[Span]) -> str:
    """Spans as kind:start:end, joined by commas."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCHEMA = "k long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, read_whole boolean"


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of each text's own spans, and all spans; one row per input row.

    A null text is an empty one, without spans. Places are code points, ends exclusive. `read_whole` is false where a
    single encoded run in decompressed content was longer than a window and so decoded in parts. Other columns are not read.
    """

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in part.column(1).to_pylist():
            base, spans, whole = search(value or "")
            counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
            rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), whole))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return by_batch(id_and_text(df, key, text), make, SCHEMA).withColumnRenamed("k", key)


def masked(text: str, spans: list[Span], mask: str = MASK) -> str:
    """The text with every stretch that spans cover replaced by `mask`."""
    out, at, end = [], 0, -1
    for start, _, stop in sorted(spans):
        if start > end:
            out += [text[at:start], mask]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """`df`, all rows and columns, with the secrets in `text` masked; `length`, if given, is a column of its code points.

    A null text stays null.
    """
    at = df.columns.index(text)

    def masking(part: pa.RecordBatch) -> pa.RecordBatch:
        new = [v if v is None or not (spans := find_secrets(v)[1]) else masked(v, spans) for v in part.column(at).to_pylist()]
        cols = list(part.columns)
        cols[at] = pa.array(new, part.schema.field(at).type)
        if length is not None:
            k = part.schema.names.index(length)
            cols[k] = pa.array([old if v is None else len(v) for v, old in zip(new, part.column(k).to_pylist(), strict=True)], part.schema.field(k).type)
        return pa.RecordBatch.from_arrays(cols, part.schema.names)

    return by_batch(df, masking, df.schema, at)
