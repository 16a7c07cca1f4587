"""Codecs of one frame as NumPy arrays and bytes, for frames too large to be relations.

An encoder turns samples into (payload, error); a decoder turns a payload and the number of samples back. A frame has at
most 131072 samples, so each call's memory is bounded. Fourier transforms are computed in double precision and stored in
single precision.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from seriesmith.functions.scalar import DECIMALS, smooth_sizes

CODECS = ("noop", "fft", "idw", "constant", "polynomial", "auto", "rle")
#: Fixed values of the stored format: ordinal of each codec, first byte of each payload, ordinal of each bitdepth.
ORDINALS = {"noop": 0, "fft": 1, "idw": 2, "constant": 3, "polynomial": 4, "auto": 5, "rle": 6}
TAGS = {"noop": 250, "fft": 15, "idw": 1, "constant": 30, "polynomial": 0, "rle": 60}
DEPTHS = {"F64": 0, "I32": 1, "I16": 2, "U8": 3}
AUTO = ("fft", "polynomial", "rle")
PAD_FROM = 128
_SMOOTH = np.array(smooth_sizes())


# numbers


def put_mixed(values: np.ndarray, raw: np.ndarray) -> bytes:
    """Each number as so many raw bytes, little end first, where raw isn't 0; else as one byte below 251, or a marker and two,
    four or eight bytes."""
    v, raw = np.asarray(values, np.uint64), np.asarray(raw, np.int64)
    width = np.where(raw > 0, raw, np.select([v < 251, v < 1 << 16, v < 1 << 32], [1, 3, 5], 9))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    at = ends - width
    single = (raw == 1) | ((raw == 0) & (width == 1))
    out[at[single]] = v[single]
    for marker, size in ((251, 2), (252, 4), (253, 8)):
        for here, first in (((raw == 0) & (width == size + 1), 1), (raw == size, 0)):
            if first:
                out[at[here]] = marker
            octets = v[here].astype("<u8").view(np.uint8).reshape(-1, 8)
            for k in range(size):
                out[at[here] + first + k] = octets[:, k]
    return out.tobytes()


def put_unsigned(values: np.ndarray) -> bytes:
    """Each number as one byte below 251, else a marker and two, four or eight bytes."""
    v = np.asarray(values, np.uint64)
    return put_mixed(v, np.zeros(len(v), np.int64))


def zigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def put_signed(values: np.ndarray) -> bytes:
    return put_unsigned(zigzag(values))


@dataclass
class Reader:
    """A cursor over stored bytes."""

    data: bytes
    at: int = 0

    def take(self, fmt: str) -> tuple:
        size = struct.calcsize(fmt)
        if self.at + size > len(self.data):
            raise ValueError("the stored bytes end early")
        out = struct.unpack_from(fmt, self.data, self.at)
        self.at += size
        return out

    def unsigned(self) -> int:
        (first,) = self.take("<B")
        if first < 251:
            return first
        return self.take({251: "<H", 252: "<I", 253: "<Q"}[first])[0]

    def many(self, n: int) -> np.ndarray:
        """The next n unsigned numbers."""
        data, at, out = self.data, self.at, []
        try:
            for _ in range(n):
                first = data[at]
                if first < 251:
                    out.append(first)
                    at += 1
                    continue
                size = 1 << (first - 250)
                if at + 1 + size > len(data) or size > 8:
                    raise IndexError
                out.append(int.from_bytes(data[at + 1 : at + 1 + size], "little"))
                at += 1 + size
        except IndexError:
            raise ValueError("the stored bytes end early") from None
        self.at = at
        return np.array(out, np.uint64)

    def signed(self, n: int) -> np.ndarray:
        u = self.many(n)
        return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)

    def raw(self, n: int, dtype: str) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if self.at + size > len(self.data):
            raise ValueError("the stored bytes end early")
        out = np.frombuffer(self.data, dtype, n, self.at)
        self.at += size
        return out


def depth_of(x: np.ndarray) -> str:
    if (x != np.floor(x)).any():
        return "F64"
    low, high = x.min(), x.max()
    for name, a, b in (("U8", 0, 255), ("I16", -(2**15), 2**15 - 1), ("I32", -(2**31), 2**31 - 1)):
        if a <= low and high <= b:
            return name
    return "F64"


def put_values(x: np.ndarray, depth: str) -> bytes:
    if depth == "U8":
        return x.astype(np.uint8).tobytes()
    return x.astype("<f8").tobytes() if depth == "F64" else put_signed(x.astype(np.int64))


def take_values(r: Reader, n: int, depth: str) -> np.ndarray:
    if depth == "U8":
        return r.raw(n, "u1").astype(float)
    return r.raw(n, "<f8") if depth == "F64" else r.signed(n).astype(float)


def round_half_away(x: np.ndarray, decimals: int = DECIMALS) -> np.ndarray:
    scaled = x * 10.0**decimals
    return np.sign(scaled) * np.floor(np.abs(scaled) + 0.5) / 10.0**decimals


def mape(a: np.ndarray, b: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.mean(np.abs((b - a) / a)))


# codecs


def noop_encode(x: np.ndarray) -> bytes:
    whole = np.clip(round_half_away(x, 0), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return bytes([TAGS["noop"]]) + put_unsigned(np.array([len(x)])) + put_signed(whole)


def noop_decode(payload: bytes, n: int) -> np.ndarray:
    r = Reader(payload, 1)
    return r.signed(r.unsigned()).astype(float)


def constant_encode(x: np.ndarray) -> bytes:
    depth = depth_of(x)
    return bytes([TAGS["constant"], DEPTHS[depth]]) + put_values(x.min(keepdims=True), depth)


def _depth(r: Reader) -> str:
    code = r.unsigned()
    return next(k for k, v in DEPTHS.items() if v == code)


def constant_decode(payload: bytes, n: int) -> np.ndarray:
    r = Reader(payload, 1)
    return np.full(n, take_values(r, 1, _depth(r))[0])


def rle_encode(x: np.ndarray) -> bytes:
    """For each value, in the order of its bits: the value, its number of runs, and their starts."""
    depth = depth_of(x)
    starts = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
    bits = x[starts].view(np.uint64)
    order = np.argsort(bits, kind="stable")
    values, first, count = np.unique(bits[order], return_index=True, return_counts=True)
    head = first + 2 * np.arange(len(values))  # of each value's numbers among all
    numbers = np.empty(len(starts) + 2 * len(values), np.uint64)
    raw = np.zeros(len(numbers), np.int64)
    as_float = values.view(np.float64)
    numbers[head] = values if depth == "F64" else as_float.astype(np.uint64) if depth == "U8" else zigzag(as_float.astype(np.int64))
    raw[head] = {"F64": 8, "U8": 1}.get(depth, 0)
    numbers[head + 1] = count
    rest = np.ones(len(numbers), bool)
    rest[head] = rest[head + 1] = False
    numbers[rest] = starts[order]
    return bytes([TAGS["rle"], DEPTHS[depth]]) + put_unsigned(np.array([len(values)])) + put_mixed(numbers, raw)


def rle_decode(payload: bytes, n: int) -> np.ndarray:
    r = Reader(payload, 1)
    depth = _depth(r)
    values, starts = [], []
    for _ in range(r.unsigned()):
        values.append(take_values(r, 1, depth)[0])
        starts.append(r.many(r.unsigned()).astype(np.int64))
    each = np.repeat(values, [len(s) for s in starts])
    at = np.concatenate(starts)
    order = np.argsort(at)
    return np.repeat(each[order], np.diff(np.append(at[order], n)))


def key_positions(n: int, step: int) -> np.ndarray:
    at = np.arange(0, n, step)
    return at if at[-1] == n - 1 else np.append(at, n - 1)


def catmull_rom(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Values at 0 to n - 1: cubic between keys that have another on both sides, else linear."""
    x = np.arange(n)
    k = np.clip(np.searchsorted(at, x, side="right") - 1, 0, max(len(at) - 2, 0))
    if len(at) == 1:
        return np.full(n, v[0], float)
    h = (at[k + 1] - at[k]).astype(float)
    t = (x - at[k]) / h
    out = v[k] + (v[k + 1] - v[k]) * t
    inner = (k > 0) & (k + 2 < len(at))
    i, s, w = k[inner], t[inner], h[inner]
    m1 = (v[i + 1] - v[i - 1]) / (at[i + 1] - at[i - 1]) * w
    m2 = (v[i + 2] - v[i]) / (at[i + 2] - at[i]) * w
    s2, s3 = s * s, s * s * s
    out[inner] = v[i] * (2 * s3 - 3 * s2 + 1) + m1 * (s3 - 2 * s2 + s) + v[i + 1] * (3 * s2 - 2 * s3) + m2 * (s3 - s2)
    return out


def _weighed(x: np.ndarray, at: np.ndarray, v: np.ndarray, block: int = 1024) -> np.ndarray:
    """The mean of v at each x, weighed by 1 / distance**2 to all keys, a block of samples at a time; NaN at keys."""
    out = np.empty(len(x))
    for low in range(0, len(x), block):
        d = (x[low : low + block, None] - at[None, :]).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = 1 / (d * d)
            out[low : low + block] = (w * v).sum(axis=1) / w.sum(axis=1)
    return out


def _convolved(at: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What _weighed() gives at 0 to n - 1 and what the two may differ by, for keys at every step-th sample and at the last.

    Samples as far behind a key as others form a row, and a row's sums are a convolution of the keys by 1 / distance**2.
    """
    step, last = int(at[1]), int(at[-1] % at[1] != 0)
    m = len(at) - last
    size = 1 << (2 * m - 1).bit_length()
    middle = v.min() / 2 + v.max() / 2
    u = v - middle
    offsets = np.concatenate([np.arange(size // 2), np.arange(-(size // 2), 0)])
    kernel = 1.0 / (offsets * step + np.arange(1, step)[:, None]).astype(float) ** 2
    sums = np.fft.irfft(np.fft.rfft(kernel) * np.fft.rfft(u[:m], size), size)[:, :m]
    before = np.cumsum(kernel[:, :m], axis=1, dtype=np.longdouble)
    after = np.cumsum(kernel[:, : size // 2 - 1 : -1], axis=1, dtype=np.longdouble)[:, : m - 1]
    weights = (before + np.concatenate([np.zeros((step - 1, 1)), after], axis=1)[:, ::-1]).astype(float)
    unit = np.finfo(float).eps
    slack = 2 * unit * np.log2(size) * np.sqrt((kernel * kernel).sum(axis=1) * (u * u).sum())[:, None] / weights
    if last:
        with np.errstate(divide="ignore", invalid="ignore"):
            w = 1 / (np.arange(m) * step + np.arange(1, step)[:, None] - at[-1]).astype(float) ** 2
        sums, weights = sums + w * u[-1], weights + w
    out, off = np.full((m, step), np.nan), np.zeros((m, step))
    with np.errstate(invalid="ignore"):
        out[:, 1:], off[:, 1:] = (middle + sums / weights).T, slack.T + 64 * unit * np.abs(v).max()
    return out.ravel()[:n], off.ravel()[:n]


#: Pairs of a sample and a key beyond which a frame is convolved.
PAIRS = 1 << 20


def inverse_distance(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Values at 0 to n - 1 weighed by 1 / distance**2; exact at keys.

    Large frames are convolved; samples whose value rounded to DECIMALS isn't certain then are summed key by key, so the
    rounded values are the same.
    """
    if len(at) == n:
        return v.astype(float)
    if n * len(at) <= PAIRS or not np.array_equal(at[:-1], at[1] * np.arange(len(at) - 1)) or at[-1] != n - 1:
        out = _weighed(np.arange(n), at, v)
    else:
        with np.errstate(over="ignore", invalid="ignore"):
            out, off = _convolved(at, v, n)
            scaled = np.abs(out) * 10.0**DECIMALS
            certain = np.abs(scaled - np.floor(scaled) - 0.5) > off * 10.0**DECIMALS + 4 * np.finfo(float).eps * scaled
        certain[at] = True
        x = np.flatnonzero(~certain)
        out[x] = _weighed(x, at, v)
    out[at] = v
    return out


METHODS: dict[str, Callable[[np.ndarray, np.ndarray, int], np.ndarray]] = {"polynomial": catmull_rom, "idw": inverse_distance}


def _keyed(x: np.ndarray, step: int, codec: str) -> np.ndarray:
    at = key_positions(len(x), step)
    return np.clip(round_half_away(METHODS[codec](at, x[at], len(x))), x.min(), x.max())


def keyed_payload(x: np.ndarray, step: int, codec: str) -> bytes:
    depth = depth_of(x)
    low, high = x.min(), x.max()
    v = x[:0] if low == high else x[key_positions(len(x), step)]
    step = 0 if low == high else step
    head = bytes([TAGS[codec], DEPTHS[depth]]) + put_unsigned(np.array([len(v)]))
    return head + put_values(v, depth) + struct.pack("<ddB", low, high, step)


def default_points(n: int) -> int:
    return max(3, n // 100)


def rungs(first: int, large: int, small: int) -> Iterator[int]:
    """23 counts: first, then 17 times larger by large and 5 times by small, at least by one."""
    count = first
    for k in range(23):
        yield count
        count += max(large if k < 17 else small, 1)


def keyed_encode(x: np.ndarray, codec: str, bound: float | None = None, points: int | None = None) -> tuple[bytes, float]:
    """With a bound, the first rung of the ladder within it, or all samples (then the error counts as 0)."""
    n = len(x)
    if x.min() == x.max():
        return keyed_payload(x, 1, codec), 0.0
    if bound is None:
        step = max(n // (points or default_points(n)), 1)
        return keyed_payload(x, step, codec), mape(x, _keyed(x, step, codec))
    target, tried = float(round_half_away(np.float64(bound), 3)), None
    for count in rungs(default_points(n), n // 10, n // 100):
        step = max(n // count, 1)
        if len(key_positions(n, step)) == n:
            break
        if step == tried:
            continue
        tried, error = step, mape(x, _keyed(x, step, codec))
        if not target < float(round_half_away(np.float64(error), 4)):  # also where the error is NaN
            return keyed_payload(x, step, codec), error
    return keyed_payload(x, 1, codec), 0.0


def keyed_decode(payload: bytes, n: int) -> np.ndarray:
    r = Reader(payload)
    codec = "idw" if r.unsigned() == TAGS["idw"] else "polynomial"
    depth = _depth(r)
    v = np.array(take_values(r, r.unsigned(), depth))
    low, high, step = r.take("<ddB")
    if low == high:
        return np.full(n, high)
    return np.clip(round_half_away(METHODS[codec](key_positions(n, step), v, n)), low, high)


def padded_size(n: int) -> int:
    return int(_SMOOTH[np.searchsorted(_SMOOTH, n, side="right")]) if n >= PAD_FROM else n


def pad(x: np.ndarray) -> np.ndarray:
    added = padded_size(len(x)) - len(x)
    return np.pad(x, (added // 2, added - added // 2), mode="edge")


def strongest(spectrum: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k bins of largest norm, lower ones first among equals, without zeros; one bin is the mean's."""
    if k == 1:
        return np.array([0])
    size = np.abs(spectrum)
    order = np.lexsort((np.arange(len(size)), -size))[:k]
    return order[size[order] > 0]


def _synthesis(spectrum: np.ndarray, kept: np.ndarray, n: int, low: float, high: float) -> np.ndarray:
    some = np.zeros(n // 2 + 1, complex)
    some[kept] = spectrum[kept]
    return np.clip(round_half_away(np.fft.irfft(some, n)), low, high)


def fft_encode(x: np.ndarray, bound: float | None = None, points: int | None = None, most: int | None = None) -> tuple[bytes, float]:
    """With a bound, the first rung of the ladder below it in thousandths, or the last rung.

    most: bytes beyond which the result isn't wanted; the ladder ends there, with an infinite error.
    """
    low, high = float(np.float32(x.min())), float(np.float32(x.max()))
    tail = struct.pack("<ff", high, low)
    if low == high:
        return bytes([TAGS["fft"]]) + put_unsigned(np.array([0])) + tail, 0.0
    y = pad(x)
    n = len(y)
    spectrum = np.fft.rfft(y.astype(np.float32).astype(float)).astype(np.complex64)
    first = default_points(len(x))
    counts = [points or first] if bound is None else rungs(first, first // 2, first // 10)
    for count in counts:
        kept = strongest(spectrum, count)
        if most is not None and 9 * (len(kept) + 1) > most:
            return b"", float("inf")
        error = mape(y, _synthesis(spectrum, kept, n, low, high))
        if bound is None or np.isnan(error) or int(bound * 1000) >= int(min(error, 1e6) * 1000):
            break
    numbers = np.stack([kept.astype(np.uint64), spectrum[kept].astype("<c8").view("<u8")], axis=1).ravel()
    return bytes([TAGS["fft"]]) + put_unsigned(np.array([len(kept)])) + put_mixed(numbers, np.tile([0, 8], len(kept))) + tail, error


def fft_decode(payload: bytes, n: int) -> np.ndarray:
    r = Reader(payload, 1)
    at = [(r.unsigned(), *r.take("<ff")) for _ in range(r.unsigned())]
    high, low = r.take("<ff")
    if low == high:
        return np.full(n, high)
    size = padded_size(n)
    spectrum = np.zeros(size // 2 + 1, complex)
    for p, re, im in at:
        spectrum[p] = complex(re, im)
    before = (size - n) // 2
    return np.clip(round_half_away(np.fft.irfft(spectrum, size)), low, high)[before : before + n]


def encode(x: np.ndarray, codec: str, bound: float) -> tuple[bytes, float]:
    """(payload, error) by one codec; those that take a bound keep to it where they can."""
    if codec == "noop":
        return noop_encode(x), mape(x, round_half_away(x, 0))
    if codec == "constant":
        return constant_encode(x), 0.0
    if codec == "rle":
        return rle_encode(x), 0.0
    return fft_encode(x, bound) if codec == "fft" else keyed_encode(x, codec, bound)


def decode(payload: bytes, codec: str, n: int) -> np.ndarray:
    by = {"noop": noop_decode, "constant": constant_decode, "rle": rle_decode, "fft": fft_decode, "polynomial": keyed_decode, "idw": keyed_decode}
    return by[codec](payload, n)


def choose(x: np.ndarray, bound: float, sample: int | None = None) -> tuple[str, bytes, float]:
    """(codec, payload, error): a constant, or the smallest candidate within the bound, or the smallest if none is.

    With a sample, the codec that is best for as many leading samples encodes all of them.
    """
    if x.min() == x.max():
        return "constant", *encode(x, "constant", bound)
    if sample and len(x) >= sample:
        codec, _, _ = _smallest(x[:sample], bound)
        return codec, *encode(x, codec, bound)
    return _smallest(x, bound)


def _reached(x: np.ndarray, codec: str, payload: bytes) -> float:
    """The mean error of the samples as they come back; one that comes back as it was has none, also where it is 0."""
    y = decode(payload, codec, len(x))
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.mean(np.where(y == x, 0, np.abs((y - x) / x))))


def _smallest(x: np.ndarray, bound: float) -> tuple[str, bytes, float]:
    """Runs are always within the bound, so a Fourier ladder that has become larger than the best of the others can end.

    A Fourier error is that of the padded frame, and a polynomial of all samples rounds them, so the frame itself must be
    within the bound too.
    """
    others = [(c, *encode(x, c, bound)) for c in AUTO[1:]]
    most = min(len(payload) for _, payload, error in others if error <= bound)
    tried = [("fft", *fft_encode(x, bound, most=most)), *others]
    within = sorted((t for t in tried if t[2] <= bound), key=lambda t: len(t[1]))
    return next(t for t in within if t[0] == "rle" or _reached(x, t[0], t[1]) <= bound)
