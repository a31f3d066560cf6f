"""Words of many texts as numpy arrays: code points, runs, 64-bit hashes of runs, and a memory of them.

Runs are told apart by 64-bit hashes (a polynomial over mixed code points); two of a million remembered runs and ten
thousand million others meet by chance with a probability of about 0.0005.
"""

from __future__ import annotations

import functools

import numpy as np

_M, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, scrambled."""
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


@functools.cache
def _mixed_codes() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64))


#: Powers of an odd number and of its inverse.
_powers = [np.ones((2, 1), np.uint64)]


def _power(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd number, and of its inverse."""
    if _powers[0].shape[1] < n:
        size = 1 << max(6, (n - 1).bit_length())
        powers = np.ones((2, size), np.uint64)
        for row, factor in zip(powers, (_M2, np.uint64(pow(int(_M2), -1, 1 << 64))), strict=True):
            row[1:] = factor
            np.cumprod(row, out=row)
        if n > 1 << 16:  # of a very long run; not kept
            return powers
        _powers[0] = powers
    return _powers[0]


def codes_of(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """A 64-bit hash (never 0) of each run of ``codes``; the runs tile it.

    Runs that begin within ``block`` codes are summed at once, with powers by the place in the block; a run's sum is
    then brought back to powers from its start."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + block))
        b = int(starts[j - 1] + lens[j - 1])
        up, down = _power(b - a)
        x = _mixed_codes()[codes[a:b]]
        x *= up[: b - a]
        first = starts[i:j] - a
        out[i:j] = np.add.reduceat(x, first)
        out[i:j] *= down[first]
        i = j
    out = mixed(out)
    out[out == 0] = 1
    return out


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    ends = np.cumsum(lens)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]))


class Known:
    """Numbers of 64-bit hashes, from 0 in the order they were added: open addressing in two arrays, half full at most."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.keys, self.numbers = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it isn't known."""
        slot = self._slots(h)
        key = self.keys[slot]
        hit = key == h
        out = np.where(hit, self.numbers[slot], np.int32(-1))
        left = np.flatnonzero(~hit & (key != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot]
            hit = key == h[left]
            out[left[hit]] = self.numbers[slot[hit]]
            more = ~hit & (key != 0)
            left, slot = left[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Remember distinct hashes that aren't known."""
        if 2 * (self.n + len(h)) > 1 << self.bits:
            keys, numbers = self.keys, self.numbers
            self._make(max(self.bits + 1, (4 * (self.n + len(h))).bit_length()))
            self._put(keys[keys != 0], numbers[keys != 0])
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        slot = self._slots(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            done = self.keys[slot] == h
            self.numbers[slot[done]] = numbers[done]
            h, numbers, slot = h[~done], numbers[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)


class Lists:
    """Growing lists of numbers, each of any length, one after another in one array."""

    def __init__(self, kind=np.uint32):
        self.flat, self.starts, self.lens, self.n, self.held = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), 0, 0

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        for name, need in (("flat", self.held + len(flat)), ("starts", self.n + len(lens)), ("lens", self.n + len(lens))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old) // 2), old.dtype)]))
        self.flat[self.held : self.held + len(flat)] = flat
        self.starts[self.n : self.n + len(lens)] = self.held + np.cumsum(lens) - lens
        self.lens[self.n : self.n + len(lens)] = lens
        self.held, self.n = self.held + len(flat), self.n + len(lens)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers, one after another, and their lengths."""
        lens = self.lens[which]
        return self.flat[spread(self.starts[which], lens)], lens


def sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the parts of ``x`` that end at ``ends``; a part may be empty."""
    total = np.concatenate([np.zeros((1, *x.shape[1:]), np.int64 if x.dtype.kind in "iub" else x.dtype), np.cumsum(x, 0, dtype=np.int64 if x.dtype.kind in "iub" else None)])
    return np.diff(total[np.r_[0, ends]], axis=0)
