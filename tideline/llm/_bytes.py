"""Vectorised work on UTF-8 bytes of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates: all but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words made of digits, letters and everything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (one more offset at the end); null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 22):
    """Ranges [i, j) of texts of at most `limit` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, wordlike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; a run never passes the end of a text."""
    n = len(buf)
    mask = wordlike[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last[:-1] &= ~mask[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(1 << 20, n)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=U64)
    return _tables["up"][:n], _tables["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span; spans are in order of start and don't nest."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + (1 << 20))))
        s, e = starts[a:b], ends[a:b]
        base, top = int(s[0]), int(e.max())
        up, down = powers(top - base + 1)
        sums = np.zeros(top - base + 1, U64)
        np.cumsum((buf[base:top].astype(U64) + U64(1)) * up[: top - base], out=sums[1:])
        out[a:b] = mix((sums[e - base] - sums[s - base]) * down[s - base] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        a = b
    return out


def numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, equal for just those whose bytes are equal, and for each number a span that has it.

    Hashes sort the spans; the bytes of all that share a hash are compared, and those that differ are told apart by them."""
    keys, first, which = np.unique(hashes(buf, starts, ends), return_index=True, return_inverse=True)
    again = np.flatnonzero(first[which] != np.arange(len(which)))
    lengths = ends - starts
    wrong = again[lengths[again] != lengths[first[which[again]]]]
    again = again[lengths[again] == lengths[first[which[again]]]]
    at = np.concatenate(([0], np.cumsum(lengths[again])))
    i = 0
    while i < len(again):  # some MB at a time; a longer span by itself
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 22), "right")) - 1)
        own = again[i:j]
        if j == i + 1:
            k, rep = own[0], first[which[own[0]]]
            bad = own if not np.array_equal(buf[starts[k] : ends[k]], buf[starts[rep] : ends[rep]]) else own[:0]
        else:
            unlike = buf[ranges(starts[own], lengths[own])] != buf[ranges(starts[first[which[own]]], lengths[own])]
            bad = own[np.unique(np.searchsorted(at[i : j + 1] - at[i], np.flatnonzero(unlike), "right") - 1)] if unlike.any() else own[:0]
        wrong = np.concatenate((wrong, bad))
        i = j
    if len(wrong):
        fresh: dict[bytes, int] = {}
        extra = []
        for k in np.sort(wrong).tolist():
            data = buf[starts[k] : ends[k]].tobytes()
            if data not in fresh:
                fresh[data] = len(keys) + len(fresh)
                extra.append(k)
            which[k] = fresh[data]
        first = np.concatenate((first, np.array(extra, first.dtype)))
    return which, first


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of [start, start + length) for each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Lookup:
    """Values by 64-bit key: open addressing, probed for whole arrays at once; exact."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length() - 1)
        self.mask = U64(size - 1)
        self.keys, self.values = np.zeros(size, U64), np.zeros((size, *values.shape[1:]), values.dtype)
        self.used = np.zeros(size, bool)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = ((keys[left] + U64(self.probes)) & self.mask).astype(np.int64)
            free = ~self.used[slot]
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            at, who = slot[first], left[first]
            self.used[at], self.keys[at], self.values[at] = True, keys[who], values[who]
            left = np.delete(left, first)
            self.probes += 1

    def __call__(self, keys: np.ndarray, missing) -> np.ndarray:
        out = np.full((len(keys), *self.values.shape[1:]), missing, self.values.dtype)
        left = np.arange(len(keys))
        for probe in range(self.probes):
            slot = ((keys[left] + U64(probe)) & self.mask).astype(np.int64)
            used = self.used[slot]
            hit = used & (self.keys[slot] == keys[left])
            out[left[hit]] = self.values[slot[hit]]
            left = left[used & ~hit]
            if not len(left):
                break
        return out
