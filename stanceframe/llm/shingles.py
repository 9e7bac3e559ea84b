"""Vectorised words, shingles and min-wise signatures over flat arrays."""

from __future__ import annotations

import numpy as np

from .common import mix64

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RANDOM = np.random.default_rng(20_240_501)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.r_[_U(1), np.full(255, _BASE)], dtype=np.uint64)
_MIX = _RANDOM.integers(1, 1 << 62, 64, dtype=np.uint64) * _U(2) + _U(1)


def powers(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= len(_POWERS) else np.cumprod(np.r_[_U(1), np.full(n - 1, _BASE)], dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased, cut at ASCII white space), and the number of words of each text."""
    raw = [t.encode() for t in texts]
    flat = _LOWER[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    space = _SPACE[flat]
    head = ~space
    head[1:] &= space[:-1]
    starts = np.flatnonzero(head)
    ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, np.r_[0, ends]))
    letters = flat[~space]
    if not len(letters):
        return np.zeros(0, _U), counts
    at = np.flatnonzero(head[~space])
    sizes = np.diff(np.r_[at, len(letters)])
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    values = _BYTE[letters] * powers(int(sizes.max()))[place]
    return mix64(np.add.reduceat(values, at) + sizes.astype(_U)), counts


def word_shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; of fewer words than ``width``, the whole sequence is one."""
    words, counts = word_hashes(texts)
    n = len(words)
    windows = np.zeros(max(0, n - width + 1), _U)
    for k in range(width):
        windows += words[k : k + len(windows)] * _MIX[k]
    windows = mix64(windows)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(windows[at : at + c - width + 1]))
        elif c:
            out.append(mix64((words[at : at + c] * _MIX[:c]).sum(dtype=_U, keepdims=True) + np.array([c], _U) * _MIX[width]))
        else:
            out.append(np.zeros(0, _U))
        at += c
    return out


def char_shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all lines in one array, repeated ones too, and the number of each line; none is empty.

    A line of fewer characters than ``width`` is one shingle.
    """
    sizes = np.array([len(x) for x in lines], np.int64)
    if not len(lines):
        return np.zeros(0, _U), sizes
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.maximum(1, sizes - width + 1)
    out, ends, lo = np.empty(int(counts.sum()), _U), np.cumsum(sizes), 0
    put = np.cumsum(counts)
    while lo < len(lines):  # pieces that stay in the processor's cache
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + 16_384, side="right")))
        part = codes[base : int(ends[hi - 1])].astype(_U)
        part += _U(1)
        hashes = np.zeros(len(part), _U)
        if len(part) >= width:
            found = _windows(part, width)
            hashes[: len(found)] = found
        long = np.repeat(sizes[lo:hi], sizes[lo:hi])
        place = np.arange(len(part)) - np.repeat(ends[lo:hi] - base - sizes[lo:hi], sizes[lo:hi])
        found = mix64(hashes[(place <= long - width) | (place == 0)])  # a short line has one place, filled below
        first = int(put[lo - 1]) if lo else 0
        for i in np.flatnonzero(sizes[lo:hi] < width):
            s = codes[int(ends[lo + i] - sizes[lo + i]) : int(ends[lo + i])].astype(_U) + _U(1)
            found[int(put[lo + i]) - 1 - first] = mix64((s * _MIX[: len(s)]).sum(dtype=_U, keepdims=True) + np.array([len(s) + 1], _U) * _MIX[width])[0]
        out[first : first + len(found)] = found
        lo = hi
    return out, counts


def _windows(x: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every window, from hashes of windows half as wide."""
    if width == 1:
        return x
    half = width // 2
    h = _windows(x, half)
    doubled = h[: len(x) - 2 * half + 1] * powers(half + 1)[half] + h[half : len(x) - half + 1]
    return doubled if width % 2 == 0 else doubled[: len(x) - width + 1] * _BASE + x[width - 1 :]


class MinWise:
    """Signatures under linear permutations of 32-bit words, and their band keys.

    ``both`` keeps the minimum and the maximum under every permutation (two values for one hash evaluation).
    """

    def __init__(self, bands: int, rows: int, both: bool, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.both = bands, rows, both
        n = bands * rows // (1 + both)
        self.a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def signatures(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row per set, ``bands * rows`` wide; every set has a shingle."""
        out = np.empty((len(counts), self.bands * self.rows), np.uint32)
        x = (shingles >> _U(32)).astype(np.uint32)
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(counts):  # pieces that stay in the processor's cache
            base = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + 32_768, side="right")))
            part = x[base : int(ends[hi - 1])]
            heads = ends[lo:hi] - counts[lo:hi] - base
            y = np.empty_like(part)
            for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                np.multiply(part, a, out=y)
                np.add(y, b, out=y)
                if self.both:
                    out[lo:hi, 2 * k] = np.minimum.reduceat(y, heads)
                    out[lo:hi, 2 * k + 1] = np.maximum.reduceat(y, heads)
                else:
                    out[lo:hi, k] = np.minimum.reduceat(y, heads)
            lo = hi
        return out

    def keys(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Band keys as bigint, one row per set: 48 bits and zeros, which take less room; strangers that meet are told apart later."""
        values = self.signatures(shingles, counts).astype(_U).reshape(len(counts), self.bands, self.rows)
        keys = np.tile(np.arange(self.bands, dtype=_U) * _MIX[40], (len(counts), 1))
        for k in range(self.rows):
            keys = mix64(keys ^ (values[:, :, k] * _MIX[41 + k]))
        return (keys & ~_U(0xFFFF)).view(np.int64)
