"""Vectorised work on whole batches of texts, as UTF-8 bytes in numpy.

A batch is one byte buffer and row offsets. Every function works in slices of
about ``SLICE`` bytes, so its temporary arrays stay small whatever the length
of a text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
PIECE = 1 << 17  # bytes whose 64-bit numbers stay near the processor
U64 = np.uint64

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = int(_rng.integers(2**62, 2**63)) * 2 + 1
MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that never belong to a word of letters and digits: ASCII controls, spaces and punctuation.
NON_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER_ASCII = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    size = max([1 << max(10, int(n - 1).bit_length()), *(k for k in _powers if k <= 2 * SLICE)])
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            steps = np.full(size, U64(base))
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=U64))
        _powers[size] = (both[0], both[1])
    up, down = _powers[size]
    return up[:n], down[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len + 1 row offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes; a longer row is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def cuts(data: np.ndarray, breaks: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about limit bytes that end after a byte of the table breaks, or as far as needed."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + limit)
        while end < n:
            ahead = np.flatnonzero(breaks[data[end - 1 : end - 1 + limit]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(n, end + limit)
        yield start, end
        start = end


def lowered(data: np.ndarray, latin: bool) -> np.ndarray:
    """A-Z in lower case; with latin, also the two-byte capitals from U+00C0 to U+00DE."""
    out = LOWER_ASCII[data]
    if latin and len(out) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 0x20
    return out


def separators(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which bytes separate words; if the table isn't SPACES, also U+0080-U+00BF and U+2000-U+207F."""
    out = table[data]
    if table is SPACES or len(data) < 2:
        return out
    two = np.flatnonzero(data == 0xC2)
    out[two] = True
    out[np.minimum(two + 1, len(data) - 1)] = True
    if len(data) > 2:
        three = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81)))
        for k in range(3):
            out[three + k] = True
    return out


class Words:
    """Words of a batch in order: row, hash, length in bytes, start in the row's text, and hashes of prefixes if asked for."""

    def __init__(self, row, hashes, lengths, starts, prefixes):
        self.row, self.hash, self.length, self.start, self.prefix = row, hashes, lengths, starts, prefixes

    def bounds(self, rows: int) -> np.ndarray:
        """Offsets of each row's words."""
        return np.searchsorted(self.row, np.arange(rows + 1))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NON_WORD, latin: bool = True, prefixes: tuple[int, ...] = ()) -> Words:
    """Every word of every row. prefixes: lengths in characters; a shorter word's prefix is the word itself."""
    parts: list[tuple] = []
    for first, last in row_groups(offsets, PIECE):
        piece, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        for low, high in cuts(piece, table, PIECE) if last == first + 1 else [(0, len(piece))]:
            inner = np.clip(at, low, high) - low
            row, h, length, start, short = _words(piece[low:high], inner, table, latin, prefixes)
            parts.append((row + first, h, length, start + low - at[row], short))
    if not parts:
        parts = [(np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64), [np.empty(0, U64) for _ in prefixes])]
    return Words(*(np.concatenate([p[k] for p in parts]) for k in range(4)), [np.concatenate([p[4][k] for p in parts]) for k in range(len(prefixes))])


def _words(data: np.ndarray, at: np.ndarray, table: np.ndarray, latin: bool, prefixes: tuple[int, ...]) -> tuple:
    n = len(data)
    low = lowered(data, latin)
    word = ~separators(data, table)
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = at[1:-1]
    begins = begins[begins < n]
    first[begins] = word[begins]  # a word never goes on in the next row
    starts = np.flatnonzero(first)
    stop = ~word
    stop[begins] = True
    stops = np.append(np.flatnonzero(stop), n)
    ends = stops[np.searchsorted(stops, starts, "right")]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[low] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    short = []
    if prefixes:
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), n)  # character starts
        nth = np.searchsorted(heads, starts)
        for k in prefixes:
            cut = np.minimum(heads[np.minimum(nth + k, len(heads) - 1)], ends)
            short.append(mix((total[cut] - total[starts]) * down[starts]))
    return np.searchsorted(at, starts, "right") - 1, hashes, ends - starts, starts, short


def shingles(found: Words, width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of width words; a row of fewer words has one, of all of them, if asked for."""
    row, h = found.row, found.hash
    n = len(row) - width + 1
    if n > 0:
        keep = row[:n] == row[width - 1 :]
        value = np.zeros(n, U64)
        for k in range(width):
            value += h[k : k + n] * MULTIPLIERS[k]
        out_row, out = row[:n][keep], mix(value[keep])
    else:
        out_row, out = np.empty(0, np.int64), np.empty(0, U64)
    if whole_if_short and len(row):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        counts = np.diff(np.append(starts, len(row)))
        few = counts < width
        if few.any():
            starts, counts = starts[few], counts[few]
            value = counts.astype(U64) * MULTIPLIERS[width + 1]
            for k in range(width - 1):
                has = counts > k
                value[has] += h[starts[has] + k] * MULTIPLIERS[k]
            out_row, out = np.concatenate([out_row, row[starts]]), np.concatenate([out, mix(value)])
    return out_row, out


def distinct_pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ordered by both."""
    order = np.lexsort((h, row)) if len(row) else np.empty(0, np.int64)
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


class Lookup:
    """Positions of 64-bit hashes in a sorted list of them; a bit table lets most absent ones go at once."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(np.asarray(known, U64))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.known >> U64(46)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each in known, -1 if absent."""
        out = np.full(len(h), -1, np.int64)
        if len(self.known):
            at = np.flatnonzero(self.maybe[(h >> U64(46)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
            hit = self.known[slot] == h[at]
            out[at[hit]] = slot[hit]
        return out
