"""Texts of an Arrow batch as flat arrays: words, rolling hashes, and runs of windows that share a minimiser.

All functions look at whole texts. Hashes are polynomials modulo 2**64 over randomised unit values, finished by a
mixing step, so that a hash of any span comes from two prefix sums.
"""

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE_VALUES = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
#: White space of all word contracts: space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Windows scanned at once; the arrays of a piece stay in the processor's cache.
PIECE = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of spans of a sequence of 64-bit values."""

    _powers: dict = {}

    def __init__(self, values: np.ndarray, base: int = 0):
        up, self.down = self._tables(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    @classmethod
    def _tables(cls, base: int, n: int):
        kept = cls._powers.get(base)
        if kept is None or len(kept[0]) < n:
            size, b = max(n, PIECE + 4096), _BASES[base]
            tables = []
            for factor in (b, pow(b, -1, 1 << 64)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
            kept = cls._powers[base] = tuple(tables)
        return kept[0][:n], kept[1][:n]

    def hash(self, start, end) -> np.ndarray:
        """The hash of each span start..end; slices or index arrays."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :] if len(column) else [0]
    offsets = np.asarray(offsets, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, offsets in words of each text) of all words; a word is a run without white space.

    Works through the bytes in pieces that end between two words, so that memory stays near that of the result.
    """
    if not len(offsets) or offsets[0] == offsets[-1]:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    hashes, starts, ends = [], [], []
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(at + limit, stop)
        while end < stop:
            # Cut after white space or between two texts; a longer word makes a longer piece.
            gap = np.flatnonzero(IS_SPACE[data[at:end]])
            k = int(np.searchsorted(offsets, end, "right")) - 1
            cut = max(at + int(gap[-1]) + 1 if len(gap) else at, int(offsets[k]))
            if cut > at:
                end = cut
                break
            end = min(end + limit, stop)
        piece = data[at:end]
        inside = ~IS_SPACE[piece]
        before = np.empty(len(piece), bool)
        before[0], before[1:] = False, inside[:-1]
        inner = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, end, "left")] - at
        before[inner] = False
        s = np.flatnonzero(inside & ~before)
        after = np.empty(len(piece), bool)
        after[-1], after[:-1] = False, inside[1:]
        after[inner[inner > 0] - 1] = False
        e = np.flatnonzero(inside & ~after) + 1
        spans = Spans(BYTE_VALUES[piece])
        hashes.append(spans.hash(s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, offsets, "left")


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n, step = len(key) - width + 1, 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return np.minimum(key[:n], key[width - step : width - step + n])


def runs(values_of, offsets: np.ndarray, window: int, gram: int, hot: np.ndarray):
    """Runs of consecutive windows that share a minimiser.

    A window is ``window`` neighbouring units of one text; its minimiser is the leftmost smallest hash of ``gram``
    units in it. ``values_of(a, b)`` gives the 64-bit values of units a..b, ``offsets`` the units of each text.
    Equal windows have the same minimiser at the same place, whatever stands around them.

    Windows whose minimiser is in the sorted array ``hot`` come as runs of one window, keyed by a hash of the whole
    window: they spread where a common passage would gather them.

    Returns arrays (key, signature, text, first window in the text, number of windows). The signature covers all
    units of the run and where its minimiser lies: runs with the same key and signature hold the same windows.
    """
    found, total, width = [], int(offsets[-1]), window - gram + 1
    for at in range(int(offsets[0]), total, PIECE):
        end = min(at + PIECE, total)
        n = min(end, total - window + 1) - at
        if n <= 0:
            break
        values = values_of(at, at + n + window - 1)
        first, last = np.searchsorted(offsets, [at, at + n - 1], "right") - 1
        inner = np.r_[at, offsets[first + 1 : last + 1], at + n]
        text = np.repeat(np.arange(first, last + 1), np.diff(inner))
        valid = np.arange(at + window, at + window + n) <= offsets[text + 1]
        grams = Spans(values)
        m = n + width - 1
        names = grams.hash(slice(0, m), slice(gram, gram + m))
        low = np.uint64((1 << 20) - 1)
        least = sliding_min((names & ~low) | np.arange(m, dtype=np.uint64), width) & low
        anchor = np.where(valid, least.astype(np.int64), -1)
        change = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        length = np.diff(np.r_[change, n])
        keep = anchor[change] >= 0
        start, length = change[keep], length[keep]
        key = names[anchor[start]]
        if len(hot) and len(start):
            place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            single = hot[place] == key
            if single.any():
                start = np.concatenate([start[~single], _each(start[single], length[single])])
                length = np.concatenate([length[~single], np.ones(len(start) - int((~single).sum()), np.int64)])
                spread = np.r_[np.zeros(int((~single).sum()), bool), np.ones(len(start) - int((~single).sum()), bool)]
                key = names[anchor[start]]
                key[spread] = mixed(grams.hash(start[spread], start[spread] + window))
        sign = Spans(values, 1).hash(start, start + length + window - 1)
        sign = mixed(sign + (anchor[start] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found.append((key, sign, text[start], start + at - offsets[text[start]], length))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _each(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges start..start+length."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def ranges(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the maximal runs of consecutive numbers in sorted distinct ``places``."""
    cut = np.flatnonzero(np.r_[True, np.diff(places) > 1]) if len(places) else np.zeros(0, np.int64)
    return places[cut], np.diff(np.r_[cut, len(places)])


def covered(starts, lengths, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The union, as sorted disjoint (start, end), of ranges of windows that reach ``reach`` units further."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none
    order = np.argsort(starts, kind="stable")
    s = np.asarray(starts, np.int64)[order]
    e = np.minimum(np.maximum.accumulate(s + np.asarray(lengths, np.int64)[order] + reach), size)
    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    firsts, lasts = s[cut], e[np.r_[cut[1:] - 1, len(s) - 1]]
    keep = firsts < lasts
    return firsts[keep], lasts[keep]
