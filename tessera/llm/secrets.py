"""Secret scans with a recursive decoding worklist.

The base rules read the text itself.  Then a worklist unwraps what is nested in it: percent-encoded and
Unicode-escaped lines, base64 runs (standard and URL-safe, wrapped or not) and compressed blobs inside
them (gzip, zlib, zstandard, bzip2, xz, several in a row too).  Lines of base64 are read as one blob and as several.  Each decoded layer is scanned by the same rules and unwrapped
again until nothing new comes out; a layer that repeats one of its ancestors, or one already unwrapped
at the same place, ends its branch.  Spans found in a layer are mapped to the code points of the text
that they came from: exactly for escapes, by groups of four for base64, to the blob for compressed data.

Defined results: null and empty texts have no spans; spans found twice count once; repeated rows give
repeated results; other columns of the input are not read, whatever their names.

Bounds: a blob that unpacks to more than UNPACKED bytes is read in blocks of BLOCK bytes that overlap by OVERLAP,
each block a layer of its own, up to LAYERS bytes.  What one run or line of the text decodes to is read up to LAYERS
code points.  Neither bound touches another blob, run or line.  Where one was met, the row's `stopped` is true, and
redact() replaces the whole blob, run or line by `<undecoded>`, as something in it may not have been read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import lean, lots

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]{1,15})?={0,2}")

#: How compressed blobs begin in base64: gzip, zstandard, bzip2, xz; zlib, whose two letters are common, behind a separator alone.
_PACKED = re.compile(r"H4sI|KLUv|Qlpo|/Td6W|(?<=[/_+-])e[AFJN]")

#: A blob's largest size in bytes that is unpacked at once, and the most that is decoded of one run or line of a text.
UNPACKED, LAYERS = 1 << 24, 1 << 27
#: Larger blobs are read in blocks: bytes of a block, and of its overlap with the next one; bytes unpacked in a step; compressions in each other that are looked through.
BLOCK, OVERLAP, STEP, DEEP = 1 << 22, 1 << 20, 1 << 16, 64
ROWS = 256
#: The shortest line that is tried as a base64 blob; the last line of a wrapped one may be shorter.
SHORTEST = 16
#: The shortest printable stretch of a layer that is no text throughout: a key of five characters, a sign and a value of six.
STRETCH = 12
_STRETCH, _WIDE = re.compile(rb"[\x20-\x7e]{%d}" % STRETCH), re.compile(rb"(?:[\x20-\x7e]\0){%d}" % STRETCH)
_CONTROL, _SURROGATE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), re.compile(r"[\ud800-\udfff]")

Span = tuple[int, int, int]  # start, the kind's place in KINDS, end: the order of the result


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) by the base rules: leftmost, not overlapping per kind; failing matches are dropped after matching."""
    low = text.lower()
    if any(w in low for w in _WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield 0, m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield 1, m.start(), m.end()
    for m in _HEX.finditer(text):
        yield 2, m.start(), m.end()


class Layer:
    """A decoded text and where it comes from.

    A piece is (start in the layer, start in the parent, end in the parent), in order of start.  It is verbatim if it
    is as long in both; else its whole range in the parent stands for each of its code points.
    """

    def __init__(self, text: str, pieces: list[tuple[int, int, int]], parent: Layer | None):
        self.text, self.pieces, self.parent = text, pieces, parent
        self.starts = [p[0] for p in pieces]

    def up(self, start: int, end: int) -> tuple[int, int]:
        """A range of this layer as a range of the text at the root."""
        layer = self
        while layer.parent is not None:
            start, end = layer.one(start)[0], layer.one(end - 1)[1]
            layer = layer.parent
        return start, end

    def one(self, at: int) -> tuple[int, int]:
        i = bisect_right(self.starts, at) - 1
        first, a, b = self.pieces[i]
        close = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
        if close - first == b - a:  # verbatim
            return a + at - first, a + at - first + 1
        return a, b

    def repeats(self) -> bool:
        layer = self.parent
        while layer is not None:
            if layer.text == self.text:
                return True
            layer = layer.parent
        return False


def substituted(layer: Layer, line: tuple[int, int], pattern: re.Pattern, decode) -> Layer | None:
    """A line of the layer with what the pattern finds decoded; None if nothing is."""
    text, out, pieces, at, size = layer.text, [], [], line[0], 0

    def put(s: str, a: int, b: int) -> None:
        nonlocal size
        if s:
            pieces.append((size, a, b))
            out.append(s)
            size += len(s)

    changed = False
    for m in pattern.finditer(text, *line):
        found = decode(m[0])
        if found is None:
            continue
        changed = True
        put(text[at : m.start()], at, m.start())
        place = m.start()
        for s, width in found:
            put(s, place, place + width)
            place += width
        at = m.end()
    put(text[at : line[1]], at, line[1])
    return Layer("".join(out), pieces, layer) if changed and out else None


def percent(run: str) -> list[tuple[str, int]] | None:
    text = bytes.fromhex(run.replace("%", "")).decode(errors="surrogateescape")
    found = [(shown(c), 3 * width_of(c, 1)) for c in text]
    return None if all(c == "\ufffd" for c, _ in found) else found


def escape(run: str) -> list[tuple[str, int]] | None:
    if run.startswith("&#"):
        value = int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])
    else:
        value = int(run[2:].strip("{}"), 16)
    if value == 0 or value > 0x10FFFF or 0xD800 <= value < 0xE000:
        return None
    return [(chr(value), len(run))]


class TooLarge(ValueError):
    pass


class Source:
    """Bytes that come in chunks, with a look ahead."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.ahead = iter(chunks), b""

    def head(self, n: int) -> bytes:
        parts, size = [self.ahead], len(self.ahead)
        while size < n and (more := next(self.chunks, None)) is not None:
            parts.append(more)
            size += len(more)
        self.ahead = b"".join(parts)
        return self.ahead[:n]

    def take(self, n: int) -> bytes:
        found = self.head(n)
        self.ahead = self.ahead[n:]
        return found


def decompressor(head: bytes):
    """A decompressor for what begins so; None if that is no compressed data."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj(47)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def inflated(source: Source) -> Iterator[bytes]:
    """The content of compressed blobs that follow each other, in chunks of bounded size, an empty one behind each blob; nothing if there is none."""
    while (out := decompressor(source.head(6))) is not None:
        limited = not type(out).__module__.startswith("zstandard")  # zstandard bounds no output: it gets little at a time
        data = b""
        while not out.eof:
            if not data and getattr(out, "needs_input", True):
                data = source.take(STEP if limited else 256)
                if not data:
                    return
            found = out.decompress(data, STEP) if limited else out.decompress(data)
            data = getattr(out, "unconsumed_tail", b"")
            if found:
                yield found
        source.ahead = out.unused_data + source.ahead
        yield b""


def unpacked(data: bytes) -> tuple[bytes, int] | None:
    """The content of the compressed blobs that data begins with, and their bytes, 0 if the first has no end; None if there are none."""
    if decompressor(data[:6]) is None:
        return None
    source, parts, size, whole, used = Source([data]), [], 0, 0, 0
    try:
        for part in inflated(source):
            parts.append(part)
            size += len(part)
            if size > UNPACKED:
                raise TooLarge(data)
            if not part:
                whole, used = len(parts), len(data) - len(source.ahead)
    except TooLarge:
        raise
    except Exception:  # noqa: BLE001 - each library has errors of its own: no further blob
        if not whole:
            return None
        parts = parts[:whole]
    return b"".join(parts), used


def blocks(data: bytes) -> Iterator[bytes]:
    """The content of a compressed blob, however large, in overlapping blocks; compressed content is looked through."""
    source = Source(quietly(inflated(Source([data]))))
    for _ in range(DEEP):
        if next(quietly(inflated(Source([source.head(STEP)]))), None) is None:
            break
        source = Source(quietly(inflated(source)))
    block, total = source.take(BLOCK), 0
    while block:
        total += len(block)
        more = source.take(BLOCK - OVERLAP) if total < LAYERS else b""
        yield block
        block = block[-OVERLAP:] + more if more else b""


def quietly(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks up to an error."""
    try:
        yield from chunks
    except Exception:  # noqa: BLE001 - each library has errors of its own
        return


def characters(block: bytes) -> bytes:
    """A block of UTF-8 without the parts of characters that its ends cut."""
    first = next((i for i in range(min(4, len(block))) if block[i] & 0xC0 != 0x80), 0)
    for i in range(1, min(4, len(block)) + 1):
        if block[-i] >= 0xC0:
            width = 2 if block[-i] < 0xE0 else 3 if block[-i] < 0xF0 else 4
            return block[first : len(block) - i] if i < width else block[first:]
        if block[-i] < 0x80:
            break
    return block[first:]


def readable(data: bytes) -> Iterator[tuple[str, int, int]]:
    """The texts in data, each with its first byte and its unit's bytes (1 for UTF-8, 2 for UTF-16).

    UTF-8 without control characters is one, however short.  Else what has a stretch of STRETCH printable ASCII
    characters is one: no rule finds anything in shorter ones.  Bytes that are no UTF-8 become U+FFFD.
    """
    try:
        text = data.decode()
        whole = not _CONTROL.search(text)
    except UnicodeDecodeError:
        whole = False
    if whole:
        if text:
            yield text, 0, 1
        return
    if _STRETCH.search(data):
        yield data.decode(errors="surrogateescape"), 0, 1
    wide = data + b"\0"
    if m := _WIDE.search(wide):  # big-endian text reads as little-endian from the next byte on
        first = m.start() % 2
        yield wide[first : len(wide) - (len(wide) - first) % 2].decode("utf-16-le", "surrogatepass"), first, 2


def width_of(c: str, unit: int) -> int:
    """A character's bytes; a byte that is no UTF-8 stands as a surrogate."""
    if unit == 2:
        return 4 if ord(c) > 0xFFFF else 2
    return 1 if 0xDC80 <= ord(c) <= 0xDCFF else len(c.encode())


def shown(text: str) -> str:
    """The text with U+FFFD for surrogates."""
    return _SURROGATE.sub("\ufffd", text)


def six_bits(run: str, both: bool = False) -> tuple[list[int], bytes | None]:
    """The places of a base64 run's letters, and the bytes they stand for; None if it is no such run, or mixes the two alphabets unless `both` may be."""
    places = [i for i, c in enumerate(run) if c not in "\r\n="]
    body = "".join([run[i] for i in places])
    if not both and ("-" in body or "_" in body) and ("+" in body or "/" in body):
        return places, None
    if len(body) % 4 == 1:
        body = body[:-1]
        places.pop()
    try:
        return places, base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except binascii.Error:
        return places, None


def packed_layers(layer: Layer, start: int, run: str) -> tuple[list[Layer], int] | None:
    """The texts in the compressed blobs that a base64 run begins with, and where they end in the run, 0 if they don't; None if there are none."""
    places, data = six_bits(run, True)
    if data is None or (found := unpacked(data)) is None:
        return None
    packed, used = found
    end = len(run) if used in (0, len(data)) else places[min((used * 8 + 5) // 6, len(places)) - 1] + 1
    texts = list(readable(packed))
    while (inner := unpacked(packed)) is not None and inner[0] != packed:
        packed = inner[0]
        texts += readable(packed)
    return [Layer(shown(text), [(0, start, start + end)], layer) for text, _, _ in texts], end if used else 0


def text_layers(layer: Layer, start: int, run: str, glued: bool = False) -> Iterator[Layer]:
    """The texts that a base64 run holds; of a run whose first letters may not belong to it, only what has a printable stretch."""
    places, data = six_bits(run, glued)
    if data is None or glued and not (_STRETCH.search(data) or _WIDE.search(data + b"\0")):
        return
    for text, byte, unit in readable(data):
        pieces = []
        for at, c in enumerate(text):  # byte i comes from six-bit units 4 i / 3 and on
            width = width_of(c, unit)
            a, b = byte * 4 // 3, ((byte + width) * 4 + 2) // 3
            pieces.append((at, start + places[min(a, len(places) - 1)], start + places[min(b, len(places)) - 1] + 1))
            byte += width
        yield Layer(shown(text), pieces, layer)


def lines_of(run: str) -> list[tuple[int, int]]:
    """The lines of a base64 run, from and to."""
    out, at = [], 0
    for line in run.split("\n"):
        out.append((at, at + len(line.rstrip("\r"))))
        at += len(line) + 1
    return out


def wrapped(lines: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Lines that may be one blob, from and to: lines of one length and a shorter one behind them."""
    i = 0
    while i < len(lines):
        j, width = i + 1, lines[i][1] - lines[i][0]
        while j < len(lines) and lines[j][1] - lines[j][0] == width:
            j += 1
        if j < len(lines) and lines[j][1] - lines[j][0] < width:
            j += 1
        yield lines[i][0], lines[j - 1][1]
        i = j


def begins(head: bytes | None) -> bool:
    """Whether the first bytes of a blob are compressed data as far as they go."""
    if head is None or (out := decompressor(head[:6])) is None:
        return False
    try:
        out.decompress(head)
    except Exception:  # noqa: BLE001 - each library has errors of its own
        return False
    return True


def blob_starts(run: str, lines: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(place, line, the line's end) where compressed blobs may begin: at lines, and behind letters that a run is glued to."""
    out = [(a, i, b) for i, (a, b) in enumerate(lines)]
    firsts = [a for a, _ in lines]
    for m in _PACKED.finditer(run):
        i = bisect_right(firsts, m.start()) - 1
        if firsts[i] < m.start() and begins(six_bits(run[m.start() : m.start() + 64], True)[1]):
            out.append((m.start(), i, lines[i][1]))
    return sorted(out)


def blob_layers(layer: Layer, start: int, run: str) -> Iterator[Layer | tuple[int, int]]:
    """What the blobs in a base64 run hold: it is one blob in lines, or has several, of a line or more each.

    Compressed blobs may begin at each line and say where they end.  Text is sought in the whole run, in what looks
    like a wrapped blob, and in each line, as a value that runs on into the next blob's text would hide that one's.
    Where letters before a blob are glued to it, as a path is, the blob begins one, two, three or no letters behind
    a multiple of four, and one of these readings of the run has its text.
    """
    lines, after = lines_of(run), 0
    for a, i, b in blob_starts(run, lines):
        head = six_bits(run[a : min(a + 8, b)], True)[1]
        if a < after or head is None or decompressor(head) is None:
            continue
        n = 1
        while True:  # twice the lines until the blobs end in them
            to = lines[min(i + n, len(lines)) - 1][1]
            try:
                found = packed_layers(layer, start + a, run[a:to])
            except TooLarge:
                yield start + a, start + len(run)
                for block in blocks(six_bits(run[a:], True)[1] or b""):
                    for part, _, _ in readable(characters(block)):
                        yield Layer(shown(part), [(0, start + a, start + len(run))], layer)
                break
            if found and found[1] or i + n >= len(lines):
                if found:
                    after = a + found[1]
                    yield from found[0]
                break
            n *= 2
    tried = set()
    whole = lines[:-1] if lines[-1][1] - lines[-1][0] < SHORTEST else lines  # a short last line may be the blob's or not
    for a, b in [(0, len(run)), (0, whole[-1][1]), *wrapped(lines), *wrapped(whole), *lines]:
        if b - a < SHORTEST or (a, b) in tried:
            continue
        tried.add((a, b))
        yield from text_layers(layer, start + a, run[a:b])
    for off in range(4):
        if len(run) - off >= SHORTEST:
            yield from text_layers(layer, start + off, run[off:], True)


def children(layer: Layer) -> Iterator[Layer | tuple[int, int]]:
    """The layers in a layer, and the places of blobs that are too large to be read whole."""
    text = layer.text
    for pattern, decode, marks in ((_PERCENT, percent, ("%",)), (_ESCAPE, escape, ("\\", "&#"))):
        at = min([i for i in map(text.find, marks) if i >= 0], default=len(text))
        while m := pattern.search(text, at):
            line = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            line = line[0], len(text) if line[1] < 0 else line[1]
            found = substituted(layer, line, pattern, decode)
            if found:
                yield found
            at = line[1]
    for m in _BASE64.finditer(text):
        yield from blob_layers(layer, m.start(), m[0])


def unwound(text: str) -> tuple[list[Span], set[Span], int, set[tuple[int, int]]]:
    """The base spans, all spans, the number of layers decoded, and the places in the text where a bound was met.

    Depth first, one layer of each depth at a time, each child of the text with a bound of its own.
    """
    base = sorted((s, k, e) for k, s, e in base_spans(text))
    spans, done, layers, undecoded, size = set(base), set(), 0, set(), 0
    root = Layer(text, [], None)
    work = [(root, children(root))]
    while work:
        layer, found = work[-1]
        child = next(found, None)
        if child is None:
            work.pop()
            continue
        if layer is root:
            size = 0
        if isinstance(child, tuple):
            undecoded.add(layer.up(*child))
            continue
        place = child.up(0, len(child.text))
        key = place, hashlib.sha256(child.text.encode("utf-8", "surrogatepass")).digest()
        if key in done or child.repeats():
            continue
        size += len(child.text)
        if size > LAYERS:
            undecoded.add(place if layer is root else work[1][0].up(0, len(work[1][0].text)))
            del work[1:]
            continue
        done.add(key)
        layers += 1
        for k, s, e in base_spans(child.text):
            a, b = child.up(s, e)
            spans.add((a, k, b))
        work.append((child, children(child)))
    return base, spans, layers, undecoded


def scan(text: str) -> tuple[list[Span], set[Span], int, bool]:
    """The base spans, all spans, the number of layers decoded, and whether a bound was met."""
    base, spans, layers, undecoded = unwound(text)
    return base, spans, layers, bool(undecoded)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans, undecoded=()) -> str:
    """The text with each maximal run of overlapping spans replaced by the first one's kind; places that stay undecoded go whole."""
    spans = [x for x in spans if not any(a <= x[0] and x[2] <= b for a, b in undecoded)] + [(a, len(KINDS), b) for a, b in undecoded]
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{(*KINDS, 'undecoded')[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, stopped boolean"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, stopped) of each row."""
    kept = df.select(id_col, text_col)
    schema = T.StructType([kept.schema[0], *T._parse_datatype_string(RESULT).fields])
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]

    def of(text: str | None) -> tuple:
        base, spans, layers, stopped = scan(text or "")
        counts = [sum(k == i for _, k, _ in base) for i in range(3)]
        return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), layers, stopped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, 1, ROWS):
            rows = [of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], schema.names)

    return kept.mapInArrow(lean(run), schema)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, secrets in the text replaced by `<kind>`, what a bound leaves undecoded by `<undecoded>`; the length column, if there is one, follows the changed texts."""
    at, length_at = df.columns.index(text_col), df.columns.index(length_col) if length_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lots(batches, at, ROWS):
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else redacted(t, *unwound(t)[1::2]) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            if length_at is not None:
                sizes = columns[length_at].to_pylist()
                columns[length_at] = pa.array([n if c == t else len(c) for n, t, c in zip(sizes, texts, clean, strict=True)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(lean(run), df.schema)
