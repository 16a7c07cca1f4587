"""Secret scan with a recursive decoding worklist.

Every text is searched for three kinds of secrets. Then the text is unwrapped: percent escapes, Unicode escapes, base64
runs and compressed bytes each give a new layer, which is searched in turn and may hold further layers, until none is
left. A layer that was seen before over the same stretch of the document (a cycle, such as an archive that unpacks to
itself) isn't opened again. Spans found in a layer are mapped back to code points of the document.

A base64 run is decoded from each of its first four characters, so that what is glued to it doesn't matter; lines of a run
that is wrapped are decoded together and, unless they hold a compressed stream, alone. Of a compressed stream that is cut or
broken what can be unpacked counts, streams that follow each other are all unpacked, and one that unpacks to more than
``block_bytes`` is searched in blocks as it is unpacked: blocks overlap by OVERLAP characters, and longer runs of spaces count
as that many, so that each base match lies in a block, however large the layer; a nested run that is longer than the overlap
may be opened in parts.

Defined cases: a null text counts as empty; an empty text gives zero counts, the digest of nothing and no spans; rows
are independent, so ties and repeated rows give equal answers; texts of any length are searched whole; an empty table gives
no rows; the input's columns stay, but for those with the names made here, which are replaced; n_large counts the layers that
were searched in blocks.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import boxed, unboxed, without

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ia:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these is in the lower-cased text wherever ASSIGN can match.
STEMS = ("passw", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}"
    r"|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+\r?\n)+[A-Za-z0-9+/_-]++={0,2}")
URLSAFE = bytes.maketrans(b"-_", b"+/")
STOPS = np.ones(256, bool)
STOPS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = False
#: Bytes in escapes, among which characters that need none stand bare: URLs, and literals of strings.
PACKED = (
    re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])+"),
    re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|[\x20-\x5b\x5d-\x7e])+"),
)
UNIT = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\.|.", re.S)
SHORT = dict(zip("abfnrtv0\\'\"", b"\x07\x08\x0c\n\r\t\x0b\x00\\'\"", strict=True))
#: Where a compressed stream can begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Compressed bytes that are unpacked at a time.
STEP = 1 << 10
#: Characters that two blocks of a large layer share.
OVERLAP = 1 << 16
SPACE_RUN = re.compile("\x20{%d,}" % (OVERLAP // 4))
#: UTF-16 text in bytes: eight characters or more of which one byte is zero.
UTF16 = re.compile(rb"(?:[^\x00]\x00){8,}|(?:\x00[^\x00]){8,}")

RESULT = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_layers", T.LongType()),
        T.StructField("n_large", T.LongType()),
    ]
)


_ARROW = pa.struct([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in RESULT])


class Layer(NamedTuple):
    """A decoded text; character i comes from code points first[i] to last[i] of the document."""

    text: str
    first: np.ndarray
    last: np.ndarray


def has_long_run(text: str) -> bool:
    """Whether 16 or more base64 characters follow each other, without which there is no key, hex or base64 run."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    edges = np.concatenate(([-1], np.flatnonzero(STOPS[data]), [len(data)]))
    return bool(np.diff(edges).max() > 16)


def find(text: str, long_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each secret; long_run: what has_long_run() says, if that is known."""
    found = []
    low = text.lower()
    if any(stem in low for stem in STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 12]
    if not long_run:
        return found
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _spliced(layer: Layer, pieces: list[tuple[int, int, str, list[int]]]) -> Layer:
    """The layer with each [start, end) replaced by a text; its i-th character comes from source bounds[i] to bounds[i + 1]."""
    text, first, last, at = [], [], [], 0
    for start, end, new, bounds in pieces:
        text += [layer.text[at:start], new]
        first += [layer.first[at:start], layer.first[[start + b for b in bounds[:-1]]]]
        last += [layer.last[at:start], layer.last[[start + b - 1 for b in bounds[1:]]]]
        at = end
    text.append(layer.text[at:])
    first.append(layer.first[at:])
    last.append(layer.last[at:])
    return Layer("".join(text), np.concatenate(first), np.concatenate(last))


def _unpercent(layer: Layer) -> Layer | None:
    pieces = []
    for m in PERCENT.finditer(layer.text):
        new = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        bounds = [0]
        for c in new:
            bounds.append(bounds[-1] + 3 * len(c.encode("utf-8", "surrogateescape")))
        pieces.append((m.start(), m.end(), new, bounds))
    return _spliced(layer, pieces) if pieces else None


def _code_point(escape: str) -> int:
    if escape.startswith("&#"):
        body = escape[2:-1]
        return int(body[1:], 16) if body[0] in "xX" else int(body)
    if len(escape) == 12 and escape.startswith("\\u"):
        return 0x10000 + ((int(escape[2:6], 16) - 0xD800) << 10) + int(escape[8:], 16) - 0xDC00
    return int(escape[2:].strip("{}"), 16)


def _unescape(layer: Layer) -> Layer | None:
    pieces = []
    for m in ESCAPE.finditer(layer.text):
        code = _code_point(m[0])
        if code <= 0x10FFFF:
            pieces.append((m.start(), m.end(), chr(code), [0, len(m[0])]))
    return _spliced(layer, pieces) if pieces else None


def _zlib_step():
    return zlib.decompressobj(47)


def _lzma_step():
    return lzma.LZMADecompressor(lzma.FORMAT_XZ)


def _zstd_step():
    return zstandard.ZstdDecompressor().decompressobj()


def _kind(data: bytes) -> tuple[bytes, Callable] | None:
    """The bytes with which a stream of this kind begins, and what makes its decompressor."""
    if data[:3] == b"\x1f\x8b\x08":
        return data[:2], _zlib_step
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return data[:2], _zlib_step
    if data[:3] == b"BZh":
        return b"BZh", bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return b"\xfd7zXZ\x00", _lzma_step
    return (b"\x28\xb5\x2f\xfd", _zstd_step) if data[:4] == b"\x28\xb5\x2f\xfd" else None


def inflate(chunks: Iterable[bytes], done: list[bool]) -> Iterator[bytes]:
    """The bytes of streams of one kind that follow each other, as far as they can be unpacked; done gets whether they ended
    well. Nothing if the first chunk, of 6 bytes at least, doesn't begin with a stream."""
    kind = step = None
    rest = b""  # of the chunk before, where it might be the head of another stream
    for chunk in chunks:
        data, at, rest = rest + chunk, 0, b""
        kind = kind or _kind(data)
        if kind is None:
            return
        while at < len(data):
            if step is None:
                while done and kind[0][0] == 0xFD and at < len(data) and data[at] == 0:  # padding between streams
                    at += 1
                if len(data) - at < len(kind[0]) and kind[0].startswith(data[at:]):
                    rest = data[at:]
                    break
                if not data.startswith(kind[0], at):
                    return
                step = kind[1]()
            piece = data[at : at + STEP]
            at += len(piece)
            try:
                out = step.decompress(piece)
            except (zlib.error, ValueError, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
                done.append(False)
                return
            if out:
                yield out
            if step.eof:
                at -= len(step.unused_data)
                step = None
                done.append(True)
    if step is not None:
        done.append(False)


def decompress(data: bytes, limit: int) -> tuple[bytes, bool, bool] | None:
    """(unpacked bytes, whether the stream ended well, whether there is more than limit bytes); None if nothing can be
    unpacked."""
    out, size, done = [], 0, []
    for piece in inflate([data], done):
        out.append(piece)
        size += len(piece)
        if size > limit:
            return b"", True, True
    return (b"".join(out), all(done), False) if size or (done and all(done)) else None


class Unpacked(NamedTuple):
    """The innermost bytes, whether they were compressed at all, whether all streams ended well; or blocks of a large layer."""

    data: bytes
    packed: bool
    well: bool
    blocks: Iterator[bytes] | None


def _unpack(data: bytes, limit: int) -> Unpacked:
    seen, well = set(), True
    while (digest := hashlib.sha256(data).digest()) not in seen:
        seen.add(digest)
        found = decompress(data, limit)
        if found is None:
            break
        inner, ended, large = found
        well = well and ended
        if large:
            return Unpacked(b"", True, well, _inner_blocks(data))
        data = inner
    return Unpacked(data, len(seen) > 1, well, None)


def _inner_blocks(data: bytes) -> Iterator[bytes]:
    """The bytes of a large stream, unpacked again while they begin with another stream."""
    chunks: Iterator[bytes] = inflate([data], [])
    while True:
        head = b""
        for piece in chunks:
            head += piece
            if len(head) >= 16:
                break
        chunks = itertools.chain([head], chunks)
        if _kind(head) is None:
            return chunks
        chunks = inflate(chunks, [])


def _blocks(layer: Layer, start: int, end: int, chunks: Iterator[bytes], size: int) -> Iterator[Layer]:
    """Layers of a large stream, each size characters and OVERLAP more; their characters all come from [start, end)."""
    held = ""
    for piece in chunks:
        held += piece.decode("latin-1")
        if len(held) >= size:
            held = SPACE_RUN.sub("\x20" * (OVERLAP // 4), held)
        if len(held) >= size:
            yield from _whole(layer, start, end, held.encode("latin-1"))
            held = held[-OVERLAP:]
    if held:
        yield from _whole(layer, start, end, held.encode("latin-1"))


def _whole(layer: Layer, start: int, end: int, data: bytes) -> list[Layer]:
    """Layers whose characters all come from [start, end)."""
    first, last = layer.first[start], layer.last[end - 1]
    return [Layer(t, np.broadcast_to(first, len(t)), np.broadcast_to(last, len(t))) for t, _, _ in _texts(data)]


def _texts(data: bytes) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The texts in bytes, with the first byte of each character and the one behind it: UTF-8, or else a character for each
    byte, and runs of UTF-16 beside it."""
    try:
        text = data.decode("utf-8")
        ends = np.cumsum(np.array([len(c.encode()) for c in text], dtype=np.int64))
    except UnicodeDecodeError:
        text = data.decode("latin-1")
        ends = np.arange(1, len(data) + 1, dtype=np.int64)
    out = [(text, np.concatenate(([0], ends[:-1])).astype(np.int64), ends)]
    for m in UTF16.finditer(data):
        begin = np.arange(m.start(), m.end(), 2, dtype=np.int64)
        out.append((m[0].replace(b"\x00", b"").decode("latin-1"), begin, begin + 2))
    return out


Found = tuple[list[Layer], list[Iterator[Layer]]]


def _opened(layer: Layer, start: int, end: int, data: bytes, limit: int, found: Found) -> bool:
    """Adds the layers of a compressed stream at the head of data; whether there is one that ended well."""
    inner = _unpack(data, limit)
    if inner.blocks is not None:
        found[1].append(_blocks(layer, start, end, inner.blocks, limit))
    elif inner.packed:
        found[0].extend(_whole(layer, start, end, inner.data))
    return inner.packed and inner.well


def _packed_within(layer: Layer, data: bytes, places: np.ndarray, end: int, limit: int, found: Found) -> None:
    """Adds the layers of compressed streams that begin anywhere in data; byte i was written from places[i] on, the last up to
    end."""
    for m in MAGIC.finditer(data):
        _opened(layer, int(places[m.start()]), end, data[m.start() :], limit, found)


def _unbase64_run(layer: Layer, start: int, run: str, limit: int, found: Found) -> bool:
    """Adds the layers of a run; whether the run as it stands is a compressed stream."""
    every = [i for i, c in enumerate(run) if c not in "=\r\n"]
    end = start + len(run)
    for k in range(4):
        places = every[k:]
        raw = "".join(run[i] for i in places).encode().translate(URLSAFE)
        raw = raw[: len(raw) - (len(raw) % 4 == 1)]
        data = base64.b64decode(raw + b"=" * (-len(raw) % 4))
        at = np.array(places, dtype=np.int64) + start
        if k == 0 and _opened(layer, start, end, data, limit, found):
            return True
        for text, begin, stop in _texts(data):
            first, last = at[begin // 3 * 4], at[np.minimum((stop - 1) // 3 * 4 + 3, len(at) - 1)]
            found[0].append(Layer(text, layer.first[first], layer.last[last]))
        tried = 1 if k == 0 else 0  # the head has been tried
        _packed_within(layer, data[tried:], at[np.arange(len(data)) // 3 * 4][tried:], end, limit, found)
    return False


def _unbase64(layer: Layer, limit: int, found: Found) -> None:
    opened = []
    for m in WRAPPED.finditer(layer.text):
        if _unbase64_run(layer, m.start(), m[0], limit, found):
            opened.append(m.span())
    for m in BASE64.finditer(layer.text):
        if not any(a <= m.start() < b for a, b in opened):
            _unbase64_run(layer, m.start(), m[0], limit, found)


def _percent_packed(layer: Layer, limit: int, found: Found) -> None:
    """Adds the layers of compressed bytes that are written as percent or \\x escapes, bare characters among them."""
    for pattern, sign in zip(PACKED, ("%", "\\x"), strict=True):
        if sign not in layer.text:
            continue
        for m in pattern.finditer(layer.text):
            if sign not in m[0]:
                continue
            units = list(UNIT.finditer(m[0]))
            whole = [u[0] for u in units]
            if sign == "%":
                data = bytes(int(u[1:], 16) if len(u) == 3 else ord(u) for u in whole)
                tried = [data, bytes(0x20 if u == "+" else b for u, b in zip(whole, data, strict=True))] if "+" in whole else [data]
            else:
                tried = [bytes(int(u[2:], 16) if len(u) == 4 else SHORT[u[1]] if len(u) == 2 else ord(u) for u in whole)]
            places = np.array([u.start() for u in units], dtype=np.int64) + m.start()
            for data in tried:
                _packed_within(layer, data, places, m.end(), limit, found)


def unwrap(text: str, limit: int, long_run: bool = True) -> tuple[set[tuple[int, int, int]], int, int]:
    """Mapped spans of all layers below the text, the number of layers, and of those that were searched in blocks."""
    spans: set[tuple[int, int, int]] = set()
    n_layers = n_large = 0
    seen: set[tuple[bytes, int, int]] = set()
    if not (long_run and BASE64.search(text) or "%" in text or "\\" in text or "&#" in text):
        return spans, 0, 0
    place = np.arange(len(text), dtype=np.int64)
    work: deque[Layer] = deque([Layer(text, place, place + 1)])
    large: deque[Iterator[Layer]] = deque()
    while work or large:
        if not work:
            block = next(large[0], None)
            if block is None:
                large.popleft()
                continue
            work.append(block)
        layer = work.popleft()
        if not layer.text:
            continue
        key = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), int(layer.first[0]), int(layer.last[-1]))
        if key in seen:
            continue
        seen.add(key)
        if len(seen) > 1:  # the text itself has been searched already
            n_layers += 1
            spans.update((int(layer.first[a]), kind, int(layer.last[b - 1])) for a, kind, b in find(layer.text))
        work.extend(x for x in (_unpercent(layer), _unescape(layer)) if x)
        found: Found = ([], [])
        _unbase64(layer, limit, found)
        _percent_packed(layer, limit, found)
        work.extend(found[0])
        large.extend(found[1])
        n_large += len(found[1])
    return spans, n_layers, n_large


def scan(text: str | None, limit: int) -> dict:
    text = text or ""
    long_run = has_long_run(text)
    base = find(text, long_run)
    count = [0, 0, 0]
    for _, kind, _ in base:
        count[kind] += 1
    spans, n_layers, n_large = unwrap(text, limit, long_run)
    line = written(base)
    return {
        "n_assign": count[0], "n_access": count[1], "n_hex": count[2], "base_sha256": hashlib.sha256(line.encode()).hexdigest(),
        "spans": written(list(spans.union(base))) if spans else line, "n_layers": n_layers, "n_large": n_large,
    }


def scan_secrets(docs: DataFrame, text: str = "text", block_bytes: int = 1 << 22) -> DataFrame:
    """docs with the columns of RESULT; one pass without a shuffle, memory bounded by a batch of rows."""

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t.as_py(), block_bytes) for t in texts], _ARROW)

    rest = without(docs.columns, RESULT.names)
    return docs.select(*boxed(rest), scanned(F.col(text)).alias("_secrets")).select(*unboxed(rest), "_secrets.*")
