"""Secret scans with a recursive decoding worklist.

A text is a layer; so is everything that URL escapes, Unicode escapes, base64 or compression wrap inside a layer, at any depth.
Each layer keeps, for each of its characters, the span of the original text that it comes from. The worklist holds what is still
to be unwrapped, the innermost first, until no new layer turns up; a layer whose content and place were seen before isn't taken
again, so chains that decode to themselves end. Each layer is scanned with the same patterns and what is found is mapped to the
original text. Streams are unwrapped piece by piece, so one that holds very much takes time but not memory.

A run of base64 letters may be glued to other letters and broken over lines: it is decoded from each of its first four letters,
by itself and joined with the runs of the lines around it, and whatever is text or a compressed stream in there is a layer.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import map_arrow

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: Runs that may be base64 have so many letters; the shortest match (token=abcdef) has so many characters, and 16 letters of base64.
MIN_BASE64, MIN_STRETCH = 16, 12
#: A decompressor may take so many bytes of memory.
MAX_UNWRAPPED = 1 << 28
#: What a compressed stream holds is scanned in pieces of so many bytes, each with so many of the piece before it.
PIECE, OVERLAP = 1 << 23, 1 << 20

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
_LINE_BREAK = r"[ \t]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*+"
_BREAK = re.compile(_LINE_BREAK)
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_LINE_BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
_BROKEN = re.compile(rb"[A-Za-z0-9+/_-][ \t]*+[\r\n]")
_STANDARD = str.maketrans("-_", "+/")
_CHARACTERS = rb"(?:[\t\n\r\x20-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
_STRETCH = re.compile(_CHARACTERS + b"{%d,}+" % MIN_STRETCH)
_PACKED = re.compile(rb"(\x1f\x8b\x08)|(\x78[\x01\x5e\x9c\xda])|(BZh[1-9])|(\xfd7zXZ\x00)|(\x28\xb5\x2f\xfd)")
#: Bytes written with URL escapes, a plus for a blank, or with backslashes, and how compressed streams begin in these.
_URL_BYTES = re.compile(r"%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/!*'()+-]")
_SLASH_BYTES = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|[0-7]{1,3}|[abtnvfr'\"\\])|[\x20-\x5b\x5d-\x7e]")
_NAMED = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "'": 39, '"': 34, "\\": 92}

#: The first bytes of compressed streams: gzip, zlib, bzip2, xz and zstandard.
_HEADS = ([b"\x1f", b"\x8b", b"\x08"], [b"x", b"\x01^\x9c\xda"], [b"B", b"Z", b"h", b"123456789", b"1", b"A", b"Y"], [b"\xfd", b"7", b"z", b"X", b"Z", b"\0"], [b"(", b"\xb5", b"/", b"\xfd"])


def _head(token: re.Pattern, escapes: tuple[str, ...], named: dict[int, str]) -> re.Pattern:
    """Finds the first bytes of compressed streams, each written as one of the escapes or, where a token may be that, as itself."""
    one = lambda b: "|".join([*(e % b for e in escapes), *([named[b]] if b in named else []), *([re.escape(chr(b))] if token.fullmatch(chr(b)) else [])])
    return re.compile("|".join("".join(f"(?:{'|'.join(map(one, sorted(x)))})" for x in head) for head in _HEADS), re.IGNORECASE)


_URL_HEAD, _SLASH_HEAD = _head(_URL_BYTES, ("%%%02x",), {}), _head(_SLASH_BYTES, (r"\\x%02x", r"\\u00%02x", r"\\%03o"), {b: re.escape("\\" + k) for k, b in _NAMED.items()})

_TYPES = {"doc_id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_layers": pa.int64()}
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, leftmost and without overlap for each kind, in order of start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass
class Layer:
    text: str
    starts: np.ndarray  # of each character, where its source starts in the original text
    ends: np.ndarray

    def spans(self) -> list[Span]:
        return [(int(self.starts[a]), k, int(self.ends[b - 1])) for a, k, b in base_spans(self.text)]

    def key(self) -> bytes:
        at = f"{self.starts[0]}:{self.ends[-1]}:" if len(self.starts) else ""
        return hashlib.blake2b(at.encode() + self.text.encode(errors="surrogatepass"), digest_size=16).digest()


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:  # noqa: ANN001
    """The layer with all matches replaced by what they decode to; every letter of it comes from its part of the match."""
    texts, starts, ends, last = [], [], [], 0
    for m in pattern.finditer(layer.text):
        pieces = decode(m[0])
        if pieces is None:
            continue
        texts.append(layer.text[last : m.start()])
        starts.append(layer.starts[last : m.start()])
        ends.append(layer.ends[last : m.start()])
        for letter, a, b in pieces:
            texts.append(letter)
            starts.append(layer.starts[m.start() + a : m.start() + a + 1])
            ends.append(layer.ends[m.start() + b - 1 : m.start() + b])
        last = m.end()
    if not last:
        return None
    texts.append(layer.text[last:])
    return Layer("".join(texts), np.concatenate([*starts, layer.starts[last:]]), np.concatenate([*ends, layer.ends[last:]]))


def _url(run: str) -> list[tuple[str, int, int]] | None:
    """Letters of a run of %XX with their places in it; a byte that isn't UTF-8 stays as it is written."""
    raw, out, i = bytes.fromhex(run.replace("%", "")), [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if 0xC2 <= raw[i] < 0xE0 else 3 if 0xE0 <= raw[i] < 0xF0 else 4 if 0xF0 <= raw[i] < 0xF5 else 0
        try:
            out.append((raw[i : i + n].decode(), 3 * i, 3 * (i + n)) if n else ("", 0, 0))
        except UnicodeDecodeError:
            n = 0
        if not n:
            out = out[:-1] if out and not out[-1][0] else out
            out += [(run[3 * i + j], 3 * i + j, 3 * i + j + 1) for j in range(3)]
        i += n or 1
    return out


def _unicode(match: str) -> list[tuple[str, int, int]] | None:
    body = match[2:-1] if match[0] == "&" else match[2:]
    code = int(body[1:], 16) if match[0] == "&" and body[0] in "xX" else int(body) if match[0] == "&" else int(body, 16)
    return [(chr(code), 0, len(match))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class _Stream(io.RawIOBase):
    """What compressed members that follow each other hold; one that is cut or damaged ends where it is."""

    def __init__(self, kind: int, source: io.BufferedReader) -> None:
        self.source, self.rest, self.broken = source, b"", False
        self.make = (
            lambda: zlib.decompressobj(31),
            zlib.decompressobj,
            bz2.BZ2Decompressor,
            lambda: lzma.LZMADecompressor(memlimit=MAX_UNWRAPPED),
            None,
        )[kind]
        if self.make:
            self.now = self.make()
        else:
            import zstandard

            self.frames = zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(source, read_across_frames=True)

    def readable(self) -> bool:
        return True

    def _next(self, n: int) -> bytes:
        if not self.make:
            return self.frames.read(n)
        while True:
            if self.now.eof:
                self.rest = self.now.unused_data or self.source.read1(1 << 14)
                if not self.rest:
                    return b""
                self.now = self.make()
            elif not self.rest and getattr(self.now, "needs_input", True):
                self.rest = self.source.read1(1 << 14)
                if not self.rest:
                    self.broken = True
                    return self.now.flush() if hasattr(self.now, "flush") else b""
            out = self.now.decompress(self.rest, n)
            self.rest = getattr(self.now, "unconsumed_tail", b"")
            if out:
                return out

    def readinto(self, into: memoryview) -> int:
        try:
            out = b"" if self.broken else self._next(len(into))
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            out, self.broken = b"", True
        except Exception as e:  # zstandard's own error, without importing it for all texts
            if type(e).__name__ != "ZstdError":
                raise
            out, self.broken = b"", True
        into[: len(out)] = out
        return len(out)


def _unpacked(data: bytes) -> tuple[Iterator[bytes], _Stream]:
    """Pieces of what the stream at the start of data holds, through all compression, and the outermost stream."""
    source, outer = io.BufferedReader(io.BytesIO(data)), None
    while m := _PACKED.match(source.peek(8)[:8]):
        head, stream = source.peek(1 << 12)[: 1 << 12], _Stream(m.lastindex - 1, source)
        source, outer = io.BufferedReader(stream, 1 << 16), outer or stream
        if source.peek(1 << 12)[: 1 << 12] == head:
            break  # it holds itself

    def pieces() -> Iterator[bytes]:
        held = b""
        while got := source.read(PIECE):
            held = held[-OVERLAP:] + got
            yield held

    return pieces(), outer


def _packed(data: bytes, place: Callable[[int], np.ndarray], end: np.ndarray) -> Iterator[Layer]:
    """Layers of the text of all compressed streams in data; place(i) is where byte i comes from, end where data ends."""
    done = set()
    for m in _PACKED.finditer(data):
        if m.lastindex in done:
            continue  # a later member of a stream that was read to its end
        pieces, stream = _unpacked(data[m.start() :])
        a = place(m.start())
        for piece in pieces:
            for text, _ in _stretches(piece, True):
                yield Layer(text, np.broadcast_to(a, len(text)), np.broadcast_to(end, len(text)))
        if not stream.broken and m.lastindex != 2:
            done.add(m.lastindex)


def _url_byte(token: str) -> int:
    return int(token[1:], 16) if token[0] == "%" else 32 if token == "+" else ord(token)


def _slash_byte(token: str) -> int:
    if token[0] != "\\" or len(token) == 1:
        return ord(token)
    kind = token[1]
    return int(token[2:], 16) if kind in "xX" else int(token[4:], 16) if kind in "uU" else _NAMED[kind] if kind in _NAMED else int(token[1:], 8) & 255


def _escaped_bytes(layer: Layer, head: re.Pattern, token: re.Pattern, value: Callable[[str], int]) -> Iterator[Layer]:
    """Layers of compressed streams whose bytes are escaped one by one: from a stream's first byte to the end of the quotes that it stands in or, without quotes, of such bytes other than blanks."""
    last = 0
    for m in head.finditer(layer.text):
        if m.start() < last:
            continue
        data, places, last = bytearray(), array("q"), m.start()
        quote = layer.text[last - 1] if last and layer.text[last - 1] in "'\"" else "\"' "
        while (t := token.match(layer.text, last)) and t[0] not in quote:
            data.append(value(t[0]))
            places.append(last)
            last = t.end()
        yield from _packed(bytes(data), lambda i, places=places: layer.starts[places[i]], layer.ends[last - 1])


def _text(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if any(c < " " and c not in "\t\n\r" for c in text) else text


def _stretches(data: bytes, short: bool = False) -> Iterator[tuple[str, int]]:
    """The stretches of text that are long enough for a match, and where each starts; all of data, however short, if asked for."""
    if short and len(data) < 4 * MIN_STRETCH and (text := _text(data)):
        yield text, 0
    else:
        for m in _STRETCH.finditer(data):
            yield m[0].decode(), m.start()


def _runs(text: str) -> Iterator[tuple[str, np.ndarray, int, bool]]:
    """Runs of base64 letters, the place of each letter, where the run ends, and False for the part of a longer one."""
    wrapped, inside = [m for m in _WRAPPED.finditer(text) if len(m[0]) >= MIN_BASE64], set()
    for w in wrapped:
        run = w[0].rstrip("=")
        cuts = [0, *(x for m in _BREAK.finditer(run) for x in m.span()), len(run)]
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        inside.update(w.start() + a for a, _ in spans)
        letters = "".join(run[a:b] for a, b in spans)
        if len(letters) >= MIN_BASE64:
            yield letters, w.start() + np.concatenate([np.arange(a, b) for a, b in spans]), w.end(), True
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield run, np.arange(m.start(), m.start() + len(run)), m.end(), m.start() not in inside


def _base64(layer: Layer) -> Iterator[Layer]:
    """Layers of the text, and of compressed streams' text, in base64 runs."""
    for run, at, end, whole in _runs(layer.text):
        for k in range(min(4, len(run) - MIN_BASE64 + 1)):
            part = run[k : len(run) - ((len(run) - k) % 4 == 1)].translate(_STANDARD)
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            for text, begin in _stretches(data, k == 0):
                sizes = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
                stop = begin + np.cumsum(sizes)
                first, last = k + (stop - sizes) * 8 // 6, k + np.minimum(-(-stop * 8 // 6), len(part))
                yield Layer(text, layer.starts[at[first]], layer.ends[at[last - 1]])
            if whole:
                yield from _packed(data, lambda i, k=k, at=at: layer.starts[at[k + i * 8 // 6]], layer.ends[end - 1])


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """What one step of decoding makes of a layer."""
    if "%" in layer.text:
        if found := _in_place(layer, _URL, _url):
            yield found
        yield from _escaped_bytes(layer, _URL_HEAD, _URL_BYTES, _url_byte)
    if "\\" in layer.text or "&#" in layer.text:
        if found := _in_place(layer, _UNICODE, _unicode):
            yield found
        yield from _escaped_bytes(layer, _SLASH_HEAD, _SLASH_BYTES, _slash_byte)
    yield from _base64(layer)


def layers(text: str) -> Iterator[Layer]:
    """The text and all that is wrapped in it. Of layers that come one by one from a stream, one is held at a time."""
    at = np.arange(len(text))
    work, seen = [iter([Layer(text, at, at + 1)])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            yield layer
            work.append(unwrapped(layer))


def _holds(run: str) -> bool:
    at = np.arange(len(run))
    return next(_base64(Layer(run, at, at + 1)), None) is not None


def plain(utf8: bytes) -> bool:
    """True if a text can't hold a match nor an encoded layer: the words that could are too short, and the signs are missing."""
    if b"%" in utf8 and re.search(rb"%[0-9A-Fa-f]{2}", utf8) or b"\\" in utf8 or b"&#" in utf8 or b"AKIA" in utf8:
        return False
    low = utf8.lower()
    if any(k in low for k in KEYS):
        return False
    for w in utf8.split():
        if len(w) >= MIN_BASE64 and not w.isalpha():
            if _BASE64.search(w.decode()) or HEX.search(w.decode()):
                return False
        elif len(w) >= MIN_BASE64 and (len(w) >= MIN_HEX and HEX.search(w.decode()) or _holds(w.decode())):
            return False
    if _BROKEN.search(utf8):
        return not any(len(m[0]) >= MIN_BASE64 and _holds(m[0]) for m in _WRAPPED.finditer(utf8.decode()))
    return True


def scan(text: str) -> tuple[list[Span], list[Span], int]:
    """The base spans, all spans and how many layers there are besides the text."""
    base, found, n = base_spans(text), set(), -1
    for layer in layers(text):
        found.update(layer.spans())
        n += 1
    return base, sorted(found | set(base)), n


def _scanned(utf8: bytes) -> tuple[list[Span], list[Span], int]:
    return ([], [], 0) if plain(utf8) else scan(utf8.decode())


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of each row of docs, and n_layers, how many layers were unwrapped.

    Null and empty texts have no spans. Repeated rows give the same spans each; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows. Offsets are code points of the whole text, ends exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                base, found, n = _scanned(text.as_py() or b"")
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(told(base).encode()).hexdigest(), told(found), n))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, list(_TYPES.values())[1:], strict=True))], names=list(_TYPES))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, SCHEMA)


def hidden(utf8: bytes) -> bytes:
    """A text with each stretch of spans that touch or overlap replaced by the name of its first kind in brackets."""
    _, found, _ = _scanned(utf8)
    if not found:
        return utf8
    text, out, last, i = utf8.decode(), [], 0, 0
    while i < len(found):
        start, kind, end = found[i]
        i += 1
        while i < len(found) and found[i][0] <= end:
            end = max(end, found[i][2])
            i += 1
        out += [text[last:start], f"[{KINDS[kind]}]"]
        last = end
    return "".join([*out, text[last:]]).encode()


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in the texts replaced by [kind]; where docs has n_chars, it follows the new text of changed rows.

    Null texts stay null and empty ones empty; every row stays, repeated ones too, and equal texts change alike; other columns stay
    as they are, whatever their names. An empty table gives no rows.
    """
    at, n_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [t if t is None else hidden(t.encode()).decode() for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if n_at is not None:
                columns[n_at] = pa.array([n if t == u else len(u) for n, t, u in zip(b.column(n_at).to_pylist(), old, new, strict=True)], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_arrow(docs, run, docs.schema)
