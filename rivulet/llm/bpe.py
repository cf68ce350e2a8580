"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by the usual pattern (contractions, then runs of
letters, digits, other characters, each with one leading space, then white
space). The cut is a pass over byte classes in numpy, not a regular expression.
Each pre-token is then resolved in two tiers:

1. a minimal perfect hash over the vocabulary finds pre-tokens that are tokens;
2. the others are merged: bytes in a linked list, candidate pairs in a heap by
   (rank, position). Results are remembered per worker, up to a fixed number.

Nulls and empty texts give no ids. Any bytes can be encoded, as each single
byte is a token; decoding joins the tokens' bytes, so it gives the input back.
A single pre-token (letters without a space, say) may have any length; those of
over two million bytes take wider integers.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, small_batches
from .text import MULTIPLIERS, U64, mix, row_groups, utf8

REMEMBERED = 200_000
SPACE, LETTER, DIGIT, OTHER = range(4)
#: Unicode's White_Space property. Fixed values.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank, of a file with a base64 token and a rank a line."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have to be 0, 1, 2, ...")
    return [t for _, t in pairs]


_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """SPACE, LETTER, DIGIT or OTHER for every code point."""
    if not _classes:
        kinds = {"L": LETTER, "N": DIGIT}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACE
        _classes.append(table)
    return _classes[0]


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second eight bytes of each piece as integers, zero beyond its end. data: padded by 16 bytes at least."""
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    second = np.clip(lengths - 8, 0, 8)
    return eight[starts] & masks[np.minimum(lengths, 8)], np.where(second > 0, eight[np.minimum(starts + 8, len(eight) - 1)] & masks[second], U64(0))


def key_hash(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(first * MULTIPLIERS[40] ^ mix(second * MULTIPLIERS[41] + lengths.astype(U64) * MULTIPLIERS[42]))


class PerfectHash:
    """A minimal perfect hash of pieces of 1 to 16 bytes: buckets, largest first, are displaced until all slots are free; buckets of one take any slot left."""

    def __init__(self, pieces: list[bytes], values: np.ndarray):
        n = self.n = len(pieces)
        data = np.frombuffer(b"".join(pieces) + bytes(16), np.uint8)
        lengths = np.array([len(p) for p in pieces], np.int64)
        first, second = packed(data, np.cumsum(lengths) - lengths, lengths)
        h = key_hash(first, second, lengths)
        if len(np.unique(h)) != n:
            raise ValueError("pieces are repeated, or their hashes are")
        self.buckets = max(1, n // 4)
        bucket = (h % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)  # a displacement, or -1 - slot
        slot_of, free = np.full(n, -1, np.int64), np.ones(n, bool)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            rows, base = order[bounds[b] : bounds[b + 1]], 0
            while True:
                tried = self._slots(h[rows][None, :], np.arange(base, base + 128)[:, None])
                ok = free[tried].all(1)
                for k in np.flatnonzero(ok):
                    if len(set(tried[k].tolist())) == len(rows):
                        self.shift[b], slot_of[rows] = base + k, tried[k]
                        free[tried[k]] = False
                        break
                else:
                    base += 128
                    continue
                break
        ones = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)
        self.shift[ones] = -1 - left
        slot_of[order[bounds[ones]]] = left
        at = np.argsort(slot_of)
        self.first, self.second, self.length, self.value = first[at], second[at], lengths[at], np.asarray(values)[at]

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift.astype(U64) * MULTIPLIERS[43]) % U64(self.n)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The value of each piece, -1 if it isn't there; lengths over 16 never are."""
        h = key_hash(first, second, lengths)
        shift = self.shift[(h % U64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(h, shift))
        same = (self.first[slot] == first) & (self.second[slot] == second) & (self.length[slot] == lengths)
        return np.where(same, self.value[slot], -1)


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the texts between offsets; the last offset is len(data)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    classes = char_classes()
    kind = classes[:256][data]
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        b = data[wide]
        point = np.full(len(wide), 0xFFFD, np.uint32)
        for low, high, size in ((0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4)):
            at = (b >= low) & (b <= high)
            code = padded[wide[at]] & (0xFF >> (size + 1))
            for k in range(1, size):
                code = code << 6 | padded[wide[at] + k] & 0x3F
            point[at] = np.minimum(code, 0x10FFFF)
        kind[wide] = classes[point]
        inner = wide[(b & 0xC0) == 0x80]
        for _ in range(3):
            kind[inner[inner > 0]] = kind[inner[inner > 0] - 1]
    bounds = np.unique(offsets[:-1][offsets[:-1] < n])
    edge = np.zeros(n + 1, bool)
    edge[bounds] = edge[n] = True
    run = np.append(True, kind[1:] != kind[:-1]) | edge[:-1]
    begin = np.flatnonzero(run)
    end = np.append(begin[1:], n)
    white = kind[begin] == SPACE
    token = run.copy()
    spaced = begin[~white & ~edge[begin]]
    token[spaced[data[spaced - 1] == 0x20]] = False
    last = end[white & ~edge[end]] - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    token[last] = True
    quote = begin[(data[begin] == 0x27) & token[begin]]
    one, two = padded[quote + 1], padded[np.minimum(quote + 2, n + 3)]
    inside = ~edge[np.minimum(quote + 1, n)]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    long = inside & ~edge[np.minimum(quote + 2, n)] & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    for at, size in ((quote[short], 2), (quote[long], 3)):
        token[at + 1] = False
        after = at + size
        token[after[after < n]] = True
    return np.flatnonzero(token)


def safe_cuts(data: np.ndarray, limit: int) -> list[int]:
    """Ends of slices of about limit bytes, each before a space between ASCII letters, where a pre-token always starts."""
    out, at, n = [], 0, len(data)
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    while n - at > limit:
        look = at + limit
        while look < n - 1:
            b = data[look - 1 : look + limit + 1]
            found = np.flatnonzero(letter[b[:-2]] & (b[1:-1] == 0x20) & letter[b[2:]])
            if len(found):
                look += int(found[0])
                break
            look += limit
        if look >= n - 1:
            break
        out.append(look)
        at = look
    return [*out, n]


class Codec:
    """Encodes and decodes by a list of tokens in order of rank. It can be pickled; Spark sends it to the workers as a broadcast of a few MB."""

    def __init__(self, tokens: list[bytes]):
        if {bytes([b]) for b in range(256)} - set(tokens):
            raise ValueError("each single byte has to be a token")
        self.tokens = tokens
        self.table = PerfectHash([t for t in tokens if len(t) <= 16], np.array([i for i, t in enumerate(tokens) if len(t) <= 16]))
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths
        known = {t: i for i, t in enumerate(tokens) if len(t) <= 2}
        self.singles = np.array([known[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.array([known.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.ranks: dict[bytes, int] = {}
        self.memory: dict[bytes, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"ranks": {}, "memory": {}}

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces that the perfect hash doesn't have. All first pairs are ranked in one look-up; then each piece has its own heap of rank, start and end in one integer."""
        if not self.ranks:
            self.ranks = {t: i for i, t in enumerate(self.tokens)}
        ranks = self.ranks
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pair = np.append(self.pairs[data[:-1] << 8 | data[1:]], -1)
        real = (pair >= 0) & (place + 1 < np.repeat(sizes, sizes))
        codes = (pair << 42 | place << 21 | place + 2)[real].tolist()
        bounds = np.append(0, np.cumsum(real))[np.append(0, np.cumsum(sizes))].tolist()
        singles, at, out = self.singles[data].tolist(), 0, []
        pop, push = heapq.heappop, heapq.heappush
        for k, piece in enumerate(pieces):
            n = len(piece)
            if n > 16 and piece in ranks:
                out.append([ranks[piece]])
                at += n
                continue
            bits, mask = 21, (1 << 21) - 1
            heap = codes[bounds[k] : bounds[k + 1]]
            ids = singles[at : at + n]
            kind = list
            if n > mask - 2:  # too long for one machine word
                bits = n.bit_length()
                mask = (1 << bits) - 1
                own = np.flatnonzero(real[at : at + n])
                heap = [rank << 2 * bits | i << bits | i + 2 for rank, i in zip(pair[at + own].tolist(), own.tolist(), strict=True)]
                kind = functools.partial(array.array, "q")
            heap.sort()
            at += n
            stop = kind(range(1, n + 1))  # the part at i ends here; 0: merged into one before it
            before = kind(range(-1, n))
            while heap:
                code = pop(heap)
                i, end = code >> bits & mask, code & mask
                middle = stop[i]
                if not middle or middle >= end or stop[middle] != end:
                    continue
                stop[i], stop[middle], ids[i] = end, 0, code >> 2 * bits
                if end < n:
                    before[end] = i
                    right = stop[end]
                    rank = ranks.get(piece[i:right])
                    if rank is not None:
                        push(heap, rank << 2 * bits | i << bits | right)
                if i:
                    left = before[i]
                    rank = ranks.get(piece[left:end])
                    if rank is not None:
                        push(heap, rank << 2 * bits | left << bits | end)
            out.append([x for x, s in zip(ids, stop, strict=True) if s])
        return out

    def remembered(self, pieces: list[bytes]) -> list[list[int]]:
        memory = self.memory
        out = [memory.get(p) for p in pieces]
        new = [k for k, ids in enumerate(out) if ids is None]
        if new:
            if len(memory) + len(new) > REMEMBERED:
                memory.clear()
            for k, ids in zip(new, self.merged([pieces[k] for k in new]), strict=True):
                out[k] = ids
                if len(pieces[k]) <= 32 and len(memory) < REMEMBERED:
                    memory[pieces[k]] = ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a buffer, and the offsets of each text's ids."""
        starts = token_starts(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        first, second = packed(padded, starts, lengths)
        ids = self.table.find(first, second, lengths)
        counts = np.ones(len(starts), np.int64)
        miss = np.flatnonzero(ids < 0)
        if len(miss):
            h = key_hash(first[miss], second[miss], lengths[miss])
            order = np.argsort(h)
            new = np.append(True, h[order][1:] != h[order][:-1])
            sample, group = miss[order[new]], np.empty(len(miss), np.int64)
            group[order] = np.cumsum(new) - 1
            same = (lengths[miss] <= 16) & (first[miss] == first[sample[group]]) & (second[miss] == second[sample[group]]) & (lengths[miss] == lengths[sample[group]])
            raw = data.tobytes()
            odd = np.flatnonzero(~same)  # over 16 bytes: each looked up by its own bytes
            group[odd] = len(sample) + np.arange(len(odd))
            sample = np.concatenate([sample, miss[odd]])
            pieces = self.remembered([raw[s : s + k] for s, k in zip(starts[sample].tolist(), lengths[sample].tolist(), strict=True)])
            sizes = np.array([len(p) for p in pieces], np.int64)
            flat = np.fromiter((x for p in pieces for x in p), np.int64, int(sizes.sum()))
            counts[miss] = sizes[group]
            begin = np.cumsum(counts) - counts
            out = np.empty(int(counts.sum()), np.uint32)
            hit = ids >= 0
            out[begin[hit]] = ids[hit]
            size = counts[miss]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(begin[miss], size) + step] = flat[np.repeat((np.cumsum(sizes) - sizes)[group], size) + step]
        else:
            out = ids.astype(np.uint32)
        ends = np.append(0, np.cumsum(counts))
        return out, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id outside the vocabulary raises IndexError."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise IndexError("no such token")
        size = self.lengths[ids]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.at[ids], size) + step].tobytes()

    def encode_slices(self, data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) for texts in order, in slices; a long text gives several."""
        for low, high in row_groups(offsets, limit):
            piece, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            if high - low > 1 or len(piece) <= 2 * limit:
                ids, bounds = self.encode(piece, at)
                for row in range(high - low):
                    yield low + row, ids[bounds[row] : bounds[row + 1]]
            else:
                begin = 0
                for end in safe_cuts(piece, limit):
                    yield low, self.encode(piece[begin:end], np.array([0, end - begin]))[0]
                    begin = end


def encoded(df: DataFrame, column: str, codec: Codec, ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256 (of the bytes that decoding gives), and token_ids if asked for; columns of these names are replaced.

    Narrow: no shuffle, each text is encoded where it is read.
    """
    small_batches(df.sparkSession)
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>"} if ids else {})
    df = df.drop(*made)
    sent = df.sparkSession.sparkContext.broadcast(codec)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(column))
            n = batch.num_rows
            counts, hashes = np.zeros(n, np.int64), [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
            lists: list[list] = [[] for _ in range(n)]
            for row, part in sent.value.encode_slices(data, offsets):
                counts[row] += len(part)
                hashes[row][0].update(part.astype("<u4").tobytes())
                hashes[row][1].update(sent.value.decode(part))
                if ids:
                    lists[row].extend(part.tolist())
            columns = [pa.array(counts), *(pa.array([h[k].hexdigest() for h in hashes]) for k in range(2))] + ([pa.array(lists, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made])

    return df.mapInArrow(work, extended(df, made))
