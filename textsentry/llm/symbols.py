"""Numpy primitives on texts as sequences of symbols: rolling fingerprints and window anchors.

A symbol is a byte or a word, each stood for by 64 random-looking bits. Prefix
sums of symbols times powers of an odd base give the fingerprint of any range
(Rabin-Karp, modulo 2**64) in constant time. Texts are worked on in buffers of
bounded size; a longer text goes through several, which overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Symbols (or bytes) in a buffer; anchor positions take 22 bits.
BUFFER = 1 << 20
_SPAN = 1 << 22
# Words of more bytes are told apart by a digest.
LONG_WORD = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, up to ``n`` at least."""
    have = max(_POWERS, default=0)
    if have < n:
        size = max(BUFFER + 4096, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            p = np.empty(size, np.uint64)
            p[0] = 1
            p[1:] = _U(base)
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = tuple(both)
        have = size
    return _POWERS[have]


class Prints:
    """Fingerprints of ranges of one buffer of symbols."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * power[: len(symbols)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def every(self, size: int) -> np.ndarray:
        """Those of all ranges of ``size`` symbols."""
        last = len(self.sums) - size
        return (self.sums[size:] - self.sums[:last]) * self.inverse[:last]


def second(symbols: np.ndarray) -> np.ndarray:
    """Other bits for the same symbols, for an independent fingerprint."""
    return mix(symbols + _U(0xA0761D6478BD642F))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width``: two scans over blocks of that width."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Scheme:
    """Windows of ``window`` symbols, anchored at their least run of ``gram`` symbols."""

    words: bool
    window: int
    gram: int


@dataclass
class Buffer:
    """Pieces of texts next to one another: ``row`` of each, its offset there, start and end here."""

    symbols: np.ndarray
    row: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray


def byte_slices(offsets: np.ndarray, limit: int = 8 * BUFFER) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes; a longer text is a run by itself."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary column without nulls, and the row offsets."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and the first word of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    after_gap = np.empty(len(data), bool)
    after_gap[0] = True
    np.logical_not(solid[:-1], out=after_gap[1:])
    after_gap[edges] = True
    before_gap = np.empty(len(data), bool)
    before_gap[-1] = True
    before_gap[:-1] = after_gap[1:]
    before_gap[:-1] |= ~solid[1:]
    starts = np.flatnonzero(solid & after_gap)
    ends = np.flatnonzero(solid & before_gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word.

    Long words get a digest: modulo 2**64 there are pairs of texts, the longer
    the easier, whose fingerprints agree for any odd base.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(int(np.searchsorted(ends, base + BUFFER, side="right")), first + 1)
        if ends[last - 1] - base <= BUFFER:
            prints = Prints(_BYTES[data[base : ends[last - 1]]])
            out[first:last] = mix(prints.of(starts[first:last] - base, ends[first:last] - base))
        first = last
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def buffers(scheme: Scheme, data: np.ndarray, offsets: np.ndarray, shortest: int) -> Iterator[Buffer]:
    """The texts of one slice as buffers of symbols; texts of fewer than ``shortest`` symbols are left out."""
    if scheme.words:
        starts, ends, at = word_bounds(data, offsets)
        symbols = word_symbols(data, starts, ends)
    else:
        symbols, at = data, offsets
    rows = np.flatnonzero(np.diff(at) >= shortest)
    group: list[tuple[int, int, int, int]] = []
    size = 0
    for row in rows.tolist():
        first, last = int(at[row]), int(at[row + 1])
        for offset in range(0, max(last - first - scheme.window + 1, 1), BUFFER):
            end = min(first + offset + BUFFER + scheme.window - 1, last)
            length = end - first - offset
            if group and size + length > BUFFER:
                yield _pack(scheme, symbols, group)
                group, size = [], 0
            group.append((row, offset, first + offset, end))
            size += length
    if group:
        yield _pack(scheme, symbols, group)


def _pack(scheme: Scheme, symbols: np.ndarray, group: list[tuple[int, int, int, int]]) -> Buffer:
    row, offset, first, last = np.array(group, np.int64).T
    parts = np.concatenate([symbols[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    if not scheme.words:
        parts = _BYTES[parts]
    ends = np.cumsum(last - first)
    return Buffer(parts, row, offset, ends - (last - first), ends)


@dataclass
class Anchors:
    """Runs of window starts that share an anchor."""

    row: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    gram: np.ndarray
    text: np.ndarray
    text2: np.ndarray
    anchor: np.ndarray


def anchors(scheme: Scheme, buffer: Buffer) -> Anchors:
    """Cut a buffer into phrases: runs of windows whose least gram is the same one.

    The least gram depends on the window's own symbols only, so equal windows
    are anchored alike wherever they stand.
    """
    width = scheme.window - scheme.gram + 1
    prints = Prints(buffer.symbols)
    grams = mix(prints.every(scheme.gram))
    keyed = (grams & ~_U(_SPAN - 1)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(keyed, width) & _U(_SPAN - 1)).astype(np.int64)
    # Window starts that leave room for the window in their piece.
    inside = np.zeros(len(buffer.symbols) + 1, np.int8)
    fits = buffer.end - buffer.start >= scheme.window
    np.add.at(inside, buffer.start[fits], 1)
    np.add.at(inside, buffer.end[fits] - scheme.window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, *[none.astype(np.uint64)] * 3, none)
    at = least[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(starts)))
    lo = starts[first]
    piece = np.searchsorted(buffer.start, lo, side="right") - 1
    end = lo + n - 1 + scheme.window
    return Anchors(
        buffer.row[piece],
        lo - buffer.start[piece] + buffer.offset[piece],
        n,
        grams[at[first]],
        mix(prints.of(lo, end) + n.astype(np.uint64)),
        mix(Prints(second(buffer.symbols)).of(lo, end)),
        at[first] - lo,
    )


def reaches(scheme: Scheme, steps: int) -> np.ndarray:
    """Lengths to either side of an anchor's gram at which its surroundings are compared."""
    return np.unique(np.linspace(0, scheme.window - scheme.gram, steps + 1).astype(np.int64)[1:])


def surroundings(
    scheme: Scheme, buffer: Buffer, row: np.ndarray, gram: np.ndarray, steps: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the grams at places ``gram`` of rows with what lies to their left, or right, up to each reach.

    Returns the gram's index, the side and reach as a number, and the
    fingerprint; ranges that leave the text are left out.
    """
    which, kinds, prints = [], [], []
    own = Prints(buffer.symbols)
    left = np.searchsorted(row, buffer.row, side="left")
    right = np.searchsorted(row, buffer.row, side="right")
    for k in np.flatnonzero(right > left).tolist():
        mine = np.arange(left[k], right[k])
        low, size = buffer.offset[k], buffer.end[k] - buffer.start[k]
        at = gram[mine] - low
        for j, reach in enumerate(reaches(scheme, steps).tolist()):
            for side, a, b in ((0, at - reach, at + scheme.gram), (1, at, at + scheme.gram + reach)):
                # A gram may lie in two buffers; the one its reach fits in has it, or both with equal prints.
                ok = (a >= 0) & (b <= size) & (at >= 0)
                if ok.any():
                    which.append(mine[ok])
                    kinds.append(np.full(int(ok.sum()), 2 * j + side))
                    prints.append(own.of(a[ok] + buffer.start[k], b[ok] + buffer.start[k]) + _U(2 * j + side + 1))
    if not which:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(which), np.concatenate(kinds), mix(np.concatenate(prints))


def window_prints(
    scheme: Scheme, buffer: Buffer, row: np.ndarray, lo: np.ndarray, n: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the windows that start in the runs ``[lo, lo + n)`` of rows.

    Runs are sorted by row and place; of each, the part in this buffer is taken.
    Returns the run's index, the window's place in its row, and two fingerprints.
    """
    which, places, here = [], [], []
    left = np.searchsorted(row, buffer.row, side="left")
    right = np.searchsorted(row, buffer.row, side="right")
    for k in np.flatnonzero(right > left).tolist():
        runs = np.arange(left[k], right[k])
        low = buffer.offset[k]
        high = min(low + BUFFER, low + buffer.end[k] - buffer.start[k] - scheme.window + 1)
        a = np.maximum(lo[runs], low)
        size = np.maximum(np.minimum(lo[runs] + n[runs], high) - a, 0)
        total = int(size.sum())
        if total:
            inner = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            place = np.repeat(a, size) + inner
            which.append(np.repeat(runs, size))
            places.append(place)
            here.append(place - low + buffer.start[k])
    if not which:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    i = np.concatenate(here)
    one = mix(Prints(buffer.symbols).of(i, i + scheme.window))
    two = mix(Prints(second(buffer.symbols)).of(i, i + scheme.window))
    return np.concatenate(which), np.concatenate(places), one, two


def covered(length: int, lo: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which of ``length`` symbols lie in a window that starts in one of the runs."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, np.minimum(lo + n - 1 + window, length), -1)
    return np.cumsum(step[:length]) > 0
