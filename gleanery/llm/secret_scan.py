"""Secret scan with a recursive decoding worklist.

Every text is scanned for secrets, then unwrapped: percent-escapes, Unicode escapes, base64 tokens and
compressed data inside them give new layers, which are scanned and unwrapped in turn until no new layer
appears. Base64 may be wrapped over lines, and stand behind or before other characters of its alphabet.
Escapes within escapes are undone one level and then all levels at once, so that deep nesting takes linear
time. Each distinct layer is opened once, which ends cycles. Each layer maps its characters back to all
places that it comes from, so that a find is reported wherever it lies in the original text.

Compressed data is read in pieces. A layer that unpacks to more than LAYER_BYTES is scanned and unwrapped in
windows of WINDOW_BYTES that overlap by OVERLAP_BYTES, one after the other, whatever its size. Its place is
reported as `opaque` besides, since something longer than the overlap may be cut at a window's edge.
Positions are code points, ends exclusive.

Null texts count as empty. Repeated rows are reported each. An empty table gives an empty result. Columns
other than doc_id and text don't matter.
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
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, small_batches

LAYER_BYTES = 32 << 20
WINDOW_BYTES = 8 << 20
OVERLAP_BYTES = 1 << 20

#: The strict kinds, in order, with the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex")

#: Further kinds that the method adds.
MORE = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    "hosted": re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
}
ESCAPES = ("url-", "unicode-", "escapes-")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
#: A run of base64 characters that may go on over line breaks, its lines, and what can be read in noise.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LEAST_LINE = 16
STRING = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){16,}")
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")

Span = tuple[str, int, int]


def strict(text: str) -> list[Span]:
    """The spans of the strict kinds."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def further(text: str) -> list[Span]:
    out: list[Span] = []
    if "-----BEGIN" in text:
        out += [("pem", *m.span()) for m in MORE["pem"].finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in MORE["jwt"].finditer(text)]
    if "gh" in text:
        out += [("hosted", *m.span()) for m in MORE["hosted"].finditer(text)]
    return out


class Origin:
    """Where the characters of a layer come from: runs that were copied or replaced."""

    def __init__(self, runs: list[tuple[int, int, int, int, bool]]):
        self.runs = runs  # (start, end) in the layer, (start, end) in the text, copied character by character?
        self.ends = [r[1] for r in runs]

    def touched(self, start: int, end: int) -> Iterator[tuple[int, int, int, int, bool]]:
        for i in range(bisect_right(self.ends, start), len(self.runs)):
            if self.runs[i][0] >= end:
                return
            yield self.runs[i]

    def span(self, start: int, end: int) -> tuple[int, int]:
        lo, hi = None, 0
        for a, b, x, y, copied in self.touched(start, end):
            lo = (x + max(start, a) - a if copied else x) if lo is None else lo
            hi = x + min(end, b) - a if copied else y
        return lo or 0, hi

    def through(self, outer: Origin) -> Origin:
        """The origin in the text of a layer with this origin in a layer that has `outer`."""
        runs: list[tuple[int, int, int, int, bool]] = []
        for a, b, x, y, copied in self.runs:
            if not copied:
                runs.append((a, b, *outer.span(x, y), False))
                continue
            for c, d, u, v, same in outer.touched(x, y):  # split where the outer runs end
                lo, hi = max(c, x), min(d, y)
                runs.append((a + lo - x, a + hi - x, u + lo - c if same else u, u + hi - c if same else v, same))
        return Origin(runs)


def joined(pieces: Iterable[tuple[str, int, int, bool]]) -> tuple[str, Origin]:
    """The text of pieces (text, start, end, copied) and its origin. Adjoining copied pieces are one run."""
    out: list[str] = []
    runs: list[tuple[int, int, int, int, bool]] = []
    size = 0
    for text, start, end, copied in pieces:
        if not text:
            continue
        if copied and runs and runs[-1][4] and runs[-1][3] == start:
            runs[-1] = (runs[-1][0], size + len(text), runs[-1][2], end, True)
        else:
            runs.append((size, size + len(text), start, end, copied))
        out.append(text)
        size += len(text)
    return "".join(out), Origin(runs)


def replaced(layer: str, pattern: re.Pattern, decode: Callable[[str], Iterable[tuple[str, int, int, bool]]]) -> tuple[str, Origin] | None:
    """The layer with its matches decoded and its origin in the layer, None if nothing changes."""

    def pieces() -> Iterator[tuple[str, int, int, bool]]:
        at = 0
        for m in pattern.finditer(layer):
            yield layer[at : m.start()], at, m.start(), True
            for text, start, end, copied in decode(m[0]):
                yield text, m.start() + start, m.start() + end, copied
            at = m.end()
        yield layer[at:], at, len(layer), True

    text, origin = joined(pieces())
    return None if text == layer else (text, origin)


def unpercent(s: str) -> Iterator[tuple[str, int, int, bool]]:
    """The valid UTF-8 in a run of percent-escapes decoded, invalid bytes as they stand."""
    at = 0
    for part in re.split("([\udc80-\udcff]+)", bytes.fromhex(s.replace("%", "")).decode("utf-8", "surrogateescape")):
        size = 3 * len(part.encode("utf-8", "surrogateescape"))
        bad = part[:1] >= "\udc80" and part[:1] <= "\udcff"
        yield (s[at : at + size] if bad else part), at, at + size, bad
        at += size


def unescape(s: str) -> Iterator[tuple[str, int, int, bool]]:
    yield b"".join(bytes.fromhex(x) for x in s.split("\\u")[1:]).decode("utf-16-be", "surrogatepass"), 0, len(s), False


HEXDIGITS = frozenset("0123456789abcdefABCDEF")


def settled(layer: str) -> tuple[str, Origin]:
    """The layer with percent- and Unicode escapes undone until none is left, in one pass: what an escape
    gives is put before the text behind it and may complete an escape that began earlier."""
    stack: list[tuple[str, int, int, bool]] = []  # characters; bytes that are no character yet as \udc80 to \udcff

    def put(char: str, start: int, end: int, copied: bool) -> None:
        while True:
            stack.append((char, start, end, copied))
            if "\udc80" <= char <= "\udcff" and not copied:
                k = len(stack) - 1
                while k > 0 and len(stack) - k < 4 and "\udc80" <= stack[k - 1][0] <= "\udcff" and not stack[k - 1][3]:
                    k -= 1
                for i in range(k, len(stack) - 1):
                    try:
                        char = "".join(x[0] for x in stack[i:]).encode("utf-8", "surrogateescape").decode()
                    except UnicodeDecodeError:
                        continue
                    start, copied = stack[i][1], False
                    del stack[i:]
                    stack.append((char, start, end, False))
                    break
                return
            if char not in HEXDIGITS:
                return
            if len(stack) >= 3 and stack[-3][0] == "%" and stack[-2][0] in HEXDIGITS:
                n, value = 3, int(stack[-2][0] + char, 16)
                new = chr(value) if value < 128 else chr(0xDC00 + value)
            elif len(stack) >= 6 and stack[-6][0] == "\\" and stack[-5][0] == "u" and all(x[0] in HEXDIGITS for x in stack[-4:]):
                n, value = 6, int("".join(x[0] for x in stack[-4:]), 16)
                new = chr(value)
                if 0xDC00 <= value <= 0xDFFF:  # the second half of a pair, or a lone one: never a byte
                    high = ord(stack[-7][0]) if len(stack) >= 7 and len(stack[-7][0]) == 1 else 0
                    if not 0xD800 <= high <= 0xDBFF:
                        return
                    n, new = 7, chr(0x10000 + ((high - 0xD800) << 10) + value - 0xDC00)
            else:
                return
            start = stack[-n][1]
            del stack[-n:]
            char, copied = new, False

    def pieces() -> Iterator[tuple[str, int, int, bool]]:
        for text, start, end, copied in stack:
            if not copied and "\udc80" <= text[:1] <= "\udcff":
                text = f"%{ord(text) - 0xDC00:02X}"  # an invalid byte, or one of several levels
            yield text, start, end, copied

    for m in re.finditer(r"[%\\]|[^%\\]+", layer):
        at, end = m.span()
        while at < end and (layer[at] in "%\\" or any(x[0] in "%\\" for x in stack[-5:])):
            put(layer[at], at, at + 1, True)
            at += 1
        if at < end:  # no escape is open: the rest is taken whole
            stack.append((layer[at:end], at, end, True))
    return joined(pieces())


FORMATS = (
    ("zip", (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"), lambda: zlib.decompressobj(47)),
    ("bz2", (b"BZh",), bz2.BZ2Decompressor),
    ("xz", (b"\xfd7zXZ",), lzma.LZMADecompressor),
)
PIECE = 1 << 16


def format_of(head: bytes) -> tuple[str, Callable] | None:
    return next(((name, make) for name, magic, make in FORMATS if head.startswith(magic)), None)


def pieces_of(data: bytes | memoryview) -> Iterator[bytes]:
    for at in range(0, len(data), PIECE):
        yield bytes(data[at : at + PIECE])


def drained(member, data: bytes) -> Iterator[bytes]:
    """What the decompressor makes of data, PIECE bytes at a time."""
    yield member.decompress(data, PIECE)
    while not member.eof and (tail := getattr(member, "unconsumed_tail", b"")):
        yield member.decompress(tail, PIECE)
    while not member.eof and not getattr(member, "needs_input", True):
        yield member.decompress(b"", PIECE)
    while hasattr(member, "unconsumed_tail") and not member.eof and (rest := member.decompress(b"", PIECE)):
        yield rest


def members(pieces: Iterator[bytes], ends: list[int]) -> Iterator[bytes]:
    """The data of all members, up to the first fault; `ends` gets where the last whole one ends."""
    held, read = b"", 0
    while True:
        while len(held) < 6 and (more := next(pieces, b"")):
            held, read = held + more, read + len(more)
        kind = format_of(held[:6])
        if kind is None:
            return
        member = kind[1]()
        try:
            while not member.eof:
                if not held:
                    held = next(pieces, b"")
                    read += len(held)
                    if not held:
                        return
                yield from drained(member, held)
                held = b""
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        held = member.unused_data
        ends[:] = [read - len(held)]
        while not held.strip(b"\0") and (more := next(pieces, b"")):  # members may be padded
            held, read = held + more, read + len(more)
        held = held.lstrip(b"\0")


def inflate(data: bytes | memoryview) -> tuple[str, bytes, int, Iterator[bytes]] | None:
    """The name of the compression, the data of all members (the first LAYER_BYTES or some more), where they
    end (0 if not known) and the rest of the data. None if there is none."""
    kind = format_of(bytes(data[:6]))
    if kind is None:
        return None
    ends: list[int] = []
    rest = members(pieces_of(data), ends)
    parts, size = [], 0
    for part in rest:
        parts.append(part)
        size += len(part)
        if size > LAYER_BYTES:
            break
    return (kind[0], b"".join(parts), ends[-1] if ends else 0, rest) if size else None


def kinds_within(head: bytes, rest: Iterator[bytes]) -> set[str]:
    """The kinds of secrets in data that is too large to be held, which may be compressed again."""
    pieces, prefix, heads = chain([head], rest), "", set()
    while (kind := format_of(head[:6])) and digest(head[:4096]) not in heads:
        heads.add(digest(head[:4096]))
        prefix += f"{kind[0]}-"
        pieces = members(pieces, [])
        head = next(pieces, b"")
        pieces = chain([head], pieces)
    found: set[str] = set()
    held = b""

    def look() -> None:
        text = held.decode("utf-8", "replace")
        found.update(s[0] for s in strict(text) + hidden(text))

    for piece in pieces:
        for at in range(0, len(piece), WINDOW_BYTES):
            held += piece[at : at + WINDOW_BYTES]
            if len(held) >= WINDOW_BYTES:
                look()
                held = held[-OVERLAP_BYTES:]
    look()
    return {prefix + k for k in found}


def readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text) else None


def unbase64(token: str) -> bytes | None:
    token = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(token) % 4 == 1:
        return None
    try:
        return base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
    except binascii.Error:
        return None


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def unpacked(data: bytes, name: str = "base64-") -> tuple[str, str | set[str]] | None:
    """The names of the wrappings of data and the text in it; the kinds of secrets for data that is too large."""
    packed = set()
    opened_once = name != "base64-"
    while (inner := readable(data)) is None:
        key = digest(data)
        found = None if key in packed else inflate(data)
        if found is None:  # compressed data is meant to be read, even if it isn't all text
            return (name, data.decode("utf-8", "replace")) if opened_once and data else None
        if len(found[1]) > LAYER_BYTES:
            return name, {f"{found[0]}-{k}" for k in kinds_within(found[1], found[3])}
        packed.add(key)
        name, data, opened_once = f"{name}{found[0]}-", found[1], True
    return name, inner


def single(size: int, start: int, end: int) -> Origin:
    return Origin([(0, max(1, size), start, end, False)])


def tokens(layer: str, m: re.Match) -> Iterator[tuple[str, str | set[str], Origin]]:
    """What a run of base64 decodes to: name, text (or kinds of secrets, if too large), origin in the layer.

    The run is taken whole, its lines joined. If that gives nothing, its lines are taken each, and all four
    alignments are searched for texts and compressed data, so that words around a token don't hide it."""
    lines = [x.span() for x in LINE.finditer(layer, *m.span())]
    joined = "".join(layer[a:b] for a, b in lines).rstrip("=")
    data = unbase64(joined)
    if data is not None and (found := unpacked(data)) is not None:
        name, inner = found
        if len(lines) == 1 or name != "base64-" or isinstance(inner, set):
            yield name, inner, single(len(inner), *m.span())
        else:
            yield name, inner, placed(lines, data, 0, 0, len(data), m.end())
        return
    whole = []  # lines that are read already
    for a, b in lines if len(lines) > 1 else []:
        line = unbase64(layer[a:b]) if b - a >= LEAST_LINE else None
        if line is not None and (found := unpacked(line)) is not None:
            whole.append((a, b))
            yield found[0], found[1], single(len(found[1]), a, b)
    for k in range(4):
        data = unbase64(joined[k : len(joined) - ((len(joined) - k) % 4 == 1)])
        if not data:
            continue
        for x in STRING.finditer(data):
            origin = placed(lines, data, k, *x.span())
            text = x[0].decode("utf-8", "ignore")
            place = origin.span(0, len(text))
            if not any(a <= place[0] and place[1] <= b for a, b in whole):
                yield "base64-", text, origin
        done = 0
        for x in PACKED.finditer(data):
            if x.start() < done:
                continue
            end = len(data)
            got = inflate(memoryview(data)[x.start() :])
            if got is None:
                continue
            if got[2]:
                done = end = x.start() + got[2]
            place = placed(lines, data, k, x.start(), end).span(0, len(data))
            if len(got[1]) > LAYER_BYTES:
                yield "base64-", {f"{got[0]}-{kind}" for kind in kinds_within(got[1], got[3])}, single(0, *place)
                break
            found = unpacked(got[1], f"base64-{got[0]}-")
            if found is not None and not any(a <= place[0] and place[1] <= b for a, b in whole):
                yield found[0], found[1], single(len(found[1]), *place)


def placed(lines: list[tuple[int, int]], data: bytes, k: int, start: int, end: int, to: int | None = None) -> Origin:
    """The origin of the text of data[start:end], decoded from the k-th character of the joined lines on: a run
    for each line. `to` is where the last line ends if its padding counts."""
    runs, before, at, size = [], 0, start, 0
    for a, b in lines:
        after = before + b - a
        stop = min(end, max(at, -(-(after - k) * 3 // 4)))  # bytes whose first character is before `after`
        if at < stop:
            text = data[at:stop].decode("utf-8", "ignore")
            lo, hi = k + at * 8 // 6, k + (stop * 8 - 1) // 6 + 1
            first = a + lo - before
            last = a + hi - before if hi <= after else next((c + hi - after for c, _ in lines if c >= b), b)
            runs.append((size, size + max(1, len(text)), first, to if to is not None and stop == end else last, False))
            size, at = size + len(text), stop
        before = after
    return Origin(runs)


def opened(layer: str, decoded: bool) -> tuple[list[Span], list[tuple[str, str, Origin]]]:
    """The spans that the layer shows, and the layers in it: name, text, origin in the layer. Of a layer that
    comes of escapes (`decoded`), all further escapes are undone at once."""
    spans, inside = strict(layer) + further(layer), []
    if decoded:
        if PERCENT.search(layer) or ESCAPE.search(layer):
            new = settled(layer)
            if new[0] != layer:
                inside.append(("escapes-", *new))
    else:
        if "%" in layer and (new := replaced(layer, PERCENT, unpercent)):
            inside.append(("url-", *new))
        if "\\u" in layer and (new := replaced(layer, ESCAPE, unescape)):
            inside.append(("unicode-", *new))
    for m in BASE64.finditer(layer):
        for name, inner, origin in tokens(layer, m):
            if isinstance(inner, set):
                spans += [(f"{name}{kind}", *origin.span(0, 1)) for kind in sorted(inner | {"opaque"})]
            else:
                inside.append((name, inner, origin))
    return spans, inside


def hidden(text: str) -> list[Span]:
    """Spans that only show in decoded layers, as kind `layer-...-kind`, plus the further kinds of the text.

    Each distinct layer is opened once; its finds are reported at every place that it comes from."""
    out = dict.fromkeys(further(text))
    plain = {(a, b) for _, a, b in strict(text)} | {(a, b) for _, a, b in out}
    key = lambda layer: digest(layer.encode("utf-8", "surrogatepass"))
    root = key(text)
    layers: dict[bytes, tuple[list[Span], list[tuple[str, bytes, Origin]]]] = {}
    unopened = {root: (text, False)}
    while unopened:
        at, layer = unopened.popitem()
        spans, inside = opened(*layer)
        layers[at] = spans, [(name, key(inner), origin) for name, inner, origin in inside]
        for (_, k, _), (name, inner, _) in zip(layers[at][1], inside):
            if k not in layers:
                unopened[k] = inner, name in ESCAPES

    work = [(root, Origin([(0, len(text), 0, len(text), True)]), "")]
    seen: set[tuple] = set()  # layers with their places: a layer within itself has the same place again
    while work:
        at, origin, names = work.pop()
        if (at, *origin.runs) in seen:
            continue
        seen.add((at, *origin.runs))
        spans, inside = layers[at]
        for kind, a, b in spans:
            place = origin.span(a, b)
            if "-" in kind or (names and place not in plain):
                out[(f"{names}{kind}", *place)] = None
        work += [(k, inner.through(origin), names + name) for name, k, inner in inside]
    return list(out)


def listing(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank.get(s[0], len(rank)), s[0], s[2])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added for each row of docs."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")}
            for text in batch.column("text").to_pylist():
                base, more = strict(text), hidden(text)
                for kind in KINDS:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(listing(base).encode()).hexdigest())
                out["spans"].append(listing(base + more))
                out["n_added"].append(len(more))
            kinds = {n: pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in out}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds[n]) for n, v in out.items())], ["doc_id", *out])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        return cut(rows.mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"), "secrets")
