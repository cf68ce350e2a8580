"""Join of documents whose sets of word n-grams have a Jaccard similarity of p percent or more.

Parity sketches: a set's elements are dealt over m segments, and in each an
element flips one bit of 2**32 (XOR). Each element in one set only flips one
bit, so the Hamming distance, and all the more the number of segments that
differ, is at most the symmetric difference d. At similarity J that is at most
(1 - J) / (1 + J) * (a + b) for sizes a and b. Sizes go in bands, and m is fixed
in a band, so segments can be joined by key: a hash of the segment's odd bits.

Of n segments with an odd bit, n - d at least agree with a partner's (pigeonhole).
So with keys in one order for all sets, the first that two sets share is among
the first d + 1 of either, and only these are joined. A set with no more than d
segments that aren't zero (a very small one, as m is chosen by size) is dealt
again with another hash: what counts is one dealing in which either of a pair
has enough. What is left after ``DEALINGS`` joins its zero segments as well.

Of the documents that share a key, the one that shares most keys with others is
the center. Each document is compared with the center that it meets most often
(one pair a document). Groups that this leaves in several components are split
by the segments of a second, fixed-size sketch if they are large. Components that meet are
compared as wholes first: the distance of their smallest members' sketches,
less each component's radius, bounds the difference of any two members from
below; this runs in numpy on blocks of bounded size. Of the pairs that pass, a
block gives a forest that connects the same members, so never more rows than it
read; documents that forests connect are a group, each in one. A group's
documents are compared again, in blocks that hold the sets, and of its links
between different components a block again gives a forest. So no group's pairs
are listed, and no link between different components is missed. Comparisons of
documents too first bound the difference by the fixed sketch, and by a second
one as wide as large sets need, then intersect the sets.

Rows with equal sets are one class from the start. A null or empty text has no
shingles and no links. Rows with one id are one node, linked as any of its
texts is. A row with a null id has no links and a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_batches, stored
from .components import components
from .text import MULTIPLIERS, SPACES, U64, distinct_pairs, mix, row_groups, shingles, utf8, words

#: Times that a small set is dealt anew, at most.
DEALINGS = 4
#: Groups over LARGE rows are split; blocks of at most about BLOCK components are compared at once.
LARGE, BLOCK = 4096, 2048
#: A block's sets have about this many elements, at most, unless one has more.
BLOCK_ELEMENTS = 1 << 22
FILTER_BITS = 2048


def bands(percent: int, largest: int) -> np.ndarray:
    """Lower ends of the size bands up to largest, each about J ** -3 times the one before."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] / (percent / 100) ** 3)))
    return np.array(out, np.int64)


def differing(percent: int, total: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of two sets of total elements together at this similarity."""
    return (100 - percent) * total // (100 + percent)


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) of each text; words are runs of bytes other than ASCII white space, A-Z in lower case."""
    return distinct_pairs(*shingles(words(data, offsets, SPACES, latin=False), width))


def parity(group: np.ndarray, h: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros(groups, U64)
    np.bitwise_xor.at(out, group, U64(1) << (h >> U64(58)))
    return out


def segments_of(percent: int, top: np.ndarray) -> np.ndarray:
    """The number of segments in bands of sizes up to top: few enough for several elements each, and enough that more than the differing ones aren't zero."""
    f = max(0.02, (100 - percent) / (100 + percent) * (1 + 100 / percent))  # differing elements for each one of a set, at most
    part = min(1.5 * f, (1 + f) / 2)
    return np.maximum(differing(percent, 2 * top) + 2, np.ceil(top / (1.5 * (1 / part - 1))).astype(np.int64))


def segment_keys(row: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for joining; sizes: of each row's set."""
    edges = bands(percent, int(sizes.max(initial=0)))
    edges = np.append(edges, max(edges[-1] + 1, int(edges[-1] / (percent / 100) ** 3)))
    band = np.searchsorted(edges, sizes, "right") - 1
    keys: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, U64))]
    for up in (0, 1):
        inside = sizes > 0
        if up:  # also in the next band, if a partner can be there
            inside &= 100 * sizes >= percent * edges[np.minimum(band + 1, len(edges) - 1)]
        chosen = np.flatnonzero(inside)
        top = edges[np.minimum(band[chosen] + up + 1, len(edges) - 1)] - 1
        most = differing(percent, sizes[chosen] + np.minimum(top, sizes[chosen] * 100 // percent))
        able = most > 0  # others are linked with equal sets only
        chosen, top, most = chosen[able], top[able], most[able]
        for salt in range(DEALINGS):
            if not len(chosen):
                break
            at, m = band[chosen] + up, segments_of(percent, top)
            begin = np.cumsum(m) - m
            index = np.full(len(sizes), -1, np.int64)
            index[chosen] = np.arange(len(chosen))
            own = index[row]
            g = mix(h[own >= 0] * MULTIPLIERS[20 + salt])
            own = own[own >= 0]
            word = np.zeros(int(m.sum()), U64)
            np.bitwise_xor.at(word, begin[own] + (g % m[own].astype(U64)).astype(np.int64), mix((g >> U64(32)) * MULTIPLIERS[29]))
            owner = np.repeat(np.arange(len(chosen)), m)
            segment = np.arange(len(word)) - begin[owner]
            few = np.bincount(owner[word != 0], minlength=len(chosen)) <= most
            used = word != 0
            if salt == DEALINGS - 1:
                used |= few[owner]
            owner, segment, word = owner[used], segment[used], word[used]
            key = mix(word ^ mix(at[owner].astype(U64) * MULTIPLIERS[30] + segment.astype(U64) * MULTIPLIERS[31] + U64(salt) * MULTIPLIERS[32]))
            order = np.lexsort((key, owner))
            place = np.arange(len(order)) - np.searchsorted(owner, np.arange(len(chosen)))[owner]
            order = order[(place <= most[owner]) | few[owner]]
            keys.append((chosen[owner[order]], key[order]))
            chosen, top, most = chosen[few], top[few], most[few]
    return np.concatenate([k for k, _ in keys]), np.concatenate([k for _, k in keys])


def binary(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.Array:
    """Slices of values between bounds as binaries, or lists of kind."""
    if kind is not None:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


class Sketches:
    """The sketches of rows: a fixed one of FILTER_BITS, and for large sets one of 2**k words, 8 to 16 bits for each element that may differ."""

    def __init__(self, fixed: pa.Array, wide: pa.Array):
        self.fixed = utf8(fixed)[0].view(U64).reshape(len(fixed), -1)
        data, offsets = utf8(wide)
        self.wide, self.begin = data.view(U64), offsets[:-1] // 8
        self.words = np.diff(offsets) // 8

    def rows(self, at: np.ndarray, words: int, to: int) -> np.ndarray:
        """Wide sketches of words words, folded: halves are flipped over each other, which moves bits as a smaller sketch would."""
        out = self.wide[self.begin[at][:, None] + np.arange(words)]
        while words > to:
            words //= 2
            out = out[:, :words] ^ out[:, words:]
        return out


def apart(a: Sketches, x: np.ndarray, b: Sketches, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hamming distances of rows x of a and y of b by the fixed sketch, and by the wide one, at the smaller size of the two (-1 where one has none)."""
    fixed = np.bitwise_count(a.fixed[x] ^ b.fixed[y]).sum(1).astype(np.int64)
    wide = np.full(len(x), -1, np.int64)
    m, n = a.words[x], b.words[y]
    sizes = m * (1 << 32) + n
    for size in np.unique(sizes[(m > 0) & (n > 0)]):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), 1024):
            some = at[k : k + 1024]
            to = int(min(m[some[0]], n[some[0]]))
            wide[some] = np.bitwise_count(a.rows(x[some], int(m[some[0]]), to) ^ b.rows(y[some], int(n[some[0]]), to)).sum(1)
    return fixed, wide


def wide_words(percent: int, sizes: np.ndarray) -> np.ndarray:
    """Words of the wide sketches of sets; 0 where the fixed one is as good."""
    most = differing(percent, sizes + sizes * 100 // percent)
    words = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(1, 8 * most / 64))).astype(np.int64))
    return np.where(words * 64 > FILTER_BITS, words, 0)


def sketches_of(row: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[pa.Array, pa.Array]:
    """The fixed and the wide sketches of sets with these (row, element)."""
    n, per = len(sizes), FILTER_BITS // 64
    g = mix(h * MULTIPLIERS[12])
    sketch = parity(row * per + (g % U64(per)).astype(np.int64), g, n * per)
    w = wide_words(percent, sizes)
    ends = np.cumsum(w)
    large = w[row] > 0
    at, v = row[large], g[large]
    wide = np.zeros(int(ends[-1]), U64)
    np.bitwise_xor.at(wide, (ends - w)[at] + ((v >> U64(6)) % w[at].astype(U64)).astype(np.int64), U64(1) << (v & U64(63)))
    return binary(sketch, np.arange(n + 1) * per), binary(wide, np.append(0, ends))


def sketched(df: DataFrame, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, n, fa, fb, sketch, wide, keys) for each row: set size, two hashes of the set, its sketches, and the keys for joining."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in row_groups(offsets):
                n = high - low
                row, h = sets_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                sizes = np.bincount(row, minlength=n)
                prints = np.zeros((2, n), U64)
                for k in range(2):
                    np.add.at(prints[k], row, mix(h * MULTIPLIERS[10 + k]))
                of, key = segment_keys(row, h, sizes, percent)
                order = np.argsort(of, kind="stable")
                bounds = np.searchsorted(of[order], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(sizes, pa.int64()), *(pa.array(p.view(np.int64)) for p in prints), *sketches_of(row, h, sizes, percent), binary(key[order].view(np.int64), bounds, pa.int64())], names=["id", "n", "fa", "fb", "sketch", "wide", "keys"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(work, "id long, n long, fa long, fb long, sketch binary, wide binary, keys array<long>")


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow the similarity. nodes: node, n, sketch, wide."""
    left, right = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"), F.col("wide").alias(f"w{k}")) for k in "ab")
    sized = pairs.join(left, "a").join(right, "b").filter(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                fixed, wide = apart(Sketches(batch.column(4), batch.column(6)), every, Sketches(batch.column(5), batch.column(7)), every)
                near = np.maximum(fixed, wide) <= differing(percent, batch.column(2).to_numpy() + batch.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return sized.select("a", "b", "na", "nb", "sa", "sb", "wa", "wb").mapInArrow(work, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, as arrays of distinct elements, are that similar."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(both) - shared)


def verified(pairs: DataFrame, df: DataFrame, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids, those whose sets really are that similar; stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in row_groups(offsets):
                row, h = sets_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], binary(h, np.searchsorted(row, np.arange(high - low + 1)))], names=["node", "elements"])

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = df.select(F.col(id_column).cast("long").alias("node"), F.col(text).alias("text")).join(wanted, "node", "left_semi")
    sets = stored(texts.mapInArrow(work, "node long, elements binary"), "sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                keep[i] = similar(*(np.frombuffer(e.as_buffer(), U64) for e in (x, y)), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    left, right = (sets.select(F.col("node").alias(k), F.col("elements").alias(f"e{k}")) for k in "ab")
    out = stored(pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "eb").mapInArrow(count, "a long, b long").distinct(), "verified")
    discard(sets)
    return out


def split_by_sketch(rows: DataFrame, percent: int, small: int = LARGE) -> DataFrame:
    """rows (key, node, part, n, sketch, members) with keys of large groups replaced by a key for each segment of the fixed sketch; two sets similar enough still share one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            key, n, members = (batch.column(k).to_numpy() for k in (0, 3, 5))
            bits = np.unpackbits(utf8(batch.column(4))[0].reshape(count, -1), axis=1)
            most = differing(percent, n + n * 100 // percent) + 1  # the partner may be larger
            of, out = [], []
            for i in range(count):
                if members[i] <= small:
                    of.append(np.array([i]))
                    out.append(key[i : i + 1].view(U64))
                    continue
                # all partners have to cut alike, so cut by powers of two that cover the difference at either size
                for m in {1 << int(np.ceil(np.log2(x))) for x in (most[i], max(1, differing(percent, n[i] * percent // 100 + n[i]) + 1))}:
                    m = min(m, FILTER_BITS)
                    words = np.packbits(np.pad(bits[i].reshape(m, -1), ((0, 0), (0, -(FILTER_BITS // m) % 8))), axis=1).astype(U64)
                    value = (words * MULTIPLIERS[np.arange(words.shape[1]) % 64]).sum(1, dtype=U64) if m <= FILTER_BITS // 2 else np.ones(1, U64)
                    value = mix(value ^ mix(np.arange(len(value), dtype=U64) * MULTIPLIERS[50] + U64(m) * MULTIPLIERS[51] + key[i : i + 1].view(U64)))[(value != 0) | (np.count_nonzero(value) < most[i])]  # zero ones only where too few others are sure to agree
                    of.append(np.full(len(value), i))
                    out.append(value)
            index = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(batch.column(k).take(index) for k in (1, 2, 3))], names=["key", "node", "part", "n"])

    return rows.select("key", "node", "part", "n", "sketch", "members").mapInArrow(work, "key long, node long, part long, n long")


def once(rows: DataFrame, member: str) -> DataFrame:
    """rows (key, member, ...) of one key for each set of members that keys have: what several keys bring together is compared once. Keys with one member go."""
    sets = rows.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64(member)).alias("x"), F.bit_xor(F.xxhash64(member, F.lit(1))).alias("y")).filter("c > 1")
    return rows.join(sets.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def opened(cut: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect all nodes of different parts that share a key of cut (key, node, part, n), but those that sketches, centers and radii exclude; stored. Two such nodes needn't be a pair themselves."""
    own = ["sketch", "wide"]
    inside = cut.select("node", "part", "n").distinct().join(sketches.select("node", *own), "node")
    centers = sketches.select(F.col("node").alias("part"), F.col("sketch").alias("center"), F.col("wide").alias("center_wide"))

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                at = np.flatnonzero(~np.asarray(batch.column(4).is_null()))
                far, far_wide = np.full(n, FILTER_BITS), np.full(n, 1 << 40)  # a part whose smallest id has no sketch of its own is never excluded
                if len(at):
                    rows = pa.array(at)
                    member, center = (Sketches(batch.column(k).take(rows), batch.column(k + 1).take(rows)) for k in (2, 4))
                    far[at], wide = apart(member, np.arange(len(at)), center, np.arange(len(at)))
                    # a smaller sketch than the center's says less than the center's would
                    far_wide[at] = np.where((wide >= 0) & (member.words >= center.words), wide, 1 << 40)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far.astype(np.int64)), pa.array(far_wide)], names=["part", "n", "far", "far_wide"])

    measured = inside.join(centers, "part", "left").select("part", "n", *own, "center", "center_wide").mapInArrow(radius, "part long, n long, far long, far_wide long")
    spread = measured.groupBy("part").agg(F.max("far").alias("far"), F.max("far_wide").alias("far_wide"), F.min("n").alias("low"), F.max("n").alias("high"))
    lone = inside.groupBy("part").agg(F.min("node").alias("only"), F.max("node").alias("last")).filter("only = last").select("part", "only")
    width = FILTER_BITS // 8
    empty = {"center": F.coalesce("center", F.lit(bytes(width))), "center_wide": F.coalesce("center_wide", F.lit(b""))}
    parts = stored(spread.join(centers, "part", "left").join(lone, "part", "left").withColumns(empty | {"lone": F.col("only").isNotNull()}).drop("only"), "parts")
    columns = ["key", "id", "part", "lone", "far", "far_wide", "low", "high", "sketch", "wide"]
    whole = once(cut.select("key", "part").distinct(), "part").join(parts, "part").withColumn("id", F.col("part")).withColumnsRenamed({"center": "sketch", "center_wide": "wide"})
    close = stored(compared_in_blocks(whole.select(*columns), percent), "meeting")
    # parts of one row each are a pair by themselves; the rows of others are compared one by one
    named = close.join(lone.select(F.col("part").alias("a"), F.col("only").alias("x")), "a", "left").join(lone.select(F.col("part").alias("b"), F.col("only").alias("y")), "b", "left")
    named = stored(named, "named")
    wide = named.filter("x is null or y is null")
    several = wide.select(F.col("a").alias("part")).union(wide.select("b")).distinct()
    none = F.lit(0).cast("long")
    rows = once(cut.join(several, "part", "left_semi").distinct(), "node").join(sketches.select("node", *own), "node")
    single = rows.withColumns({"id": F.col("node"), "lone": F.lit(True), "far": none, "far_wide": none, "low": F.col("n"), "high": F.col("n")}).select(*columns)
    pairs = named.filter("x is not null and y is not null").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = stored(pairs.union(compared_in_blocks(single, percent)).distinct(), "left")
    discard(parts, close, named)
    return out


class Forest:
    """Which of some rows are connected so far."""

    def __init__(self, root: np.ndarray):
        self.root = root

    def join(self, x: np.ndarray, y: np.ndarray, linked=None) -> list[tuple[int, int]]:
        """Of the pairs (x, y), in order, those that connect rows that weren't connected; with linked, those only for which it holds."""
        out = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if self.root[a] != self.root[b] and (linked is None or linked(a, b)):
                self.root[self.root == self.root[b]] = self.root[a]
                out.append((a, b))
        return out


def compared_in_blocks(rows: DataFrame, percent: int, elements: bool = False) -> DataFrame:
    """Pairs (a, b) of ids that connect all ids of different parts in rows (key, id, part, lone, far, far_wide, low, high, sketch, wide) that share a key and may be similar: the distance of their sketches, less what each may be off (far), is no more than sizes up to high allow.

    Each key's rows are dealt over blocks of bounded size, and pairs of blocks are
    groups that stream through numpy. Of a group's pairs only a forest becomes
    rows; pairs of lone ids have a forest of their own. With elements (rows have
    a further column of sets), sets are intersected, and pairs are links that connect parts.
    """
    columns = ["key", "i", "j", "id", "part", "lone", "far", "far_wide", "low", "high", "sketch", "wide", *(["elements"] if elements else [])]
    size = F.greatest(F.count("*") / BLOCK, F.sum(F.length("elements") / 8) / BLOCK_ELEMENTS) if elements else F.count("*") / BLOCK
    sizes = rows.groupBy("key").agg(F.count("*").alias("c"), F.ceil(size).cast("int").alias("blocks")).filter("c > 1").select("key", "blocks")
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    dealt = rows.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["key", "i", "j"]
    placed = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*columns)
    streamed = placed.repartition(*group).sortWithinPartitions(*group)

    def compared(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        table = table.slice(0, int(bounds[-1]))
        ids, part, lone, far, far_wide, low, high = (table.column(k).to_numpy() for k in range(3, 10))
        sketch = Sketches(table.column(10), table.column(11))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found, linked = [np.empty((0, 2), np.int64)], None
        if elements:
            data, offsets = utf8(table.column(12))
            sets, offsets = data.view(U64), offsets // 8
            linked = lambda a, b: similar(sets[offsets[a] : offsets[a + 1]], sets[offsets[b] : offsets[b + 1]], percent)
            forests = [Forest(np.unique(np.column_stack([group, part]), axis=0, return_inverse=True)[1].ravel())] * 2
        else:
            forests = [Forest(np.arange(len(group))) for _ in range(2)]
        i, step = np.arange(int(bounds[-1])), 0
        while len(i):  # all pairs at a distance of step rows in one go, over all groups
            step += 1
            i = i[i + step < len(group)]
            i = i[group[i + step] == group[i]]
            for x in (i[k : k + 4096] for k in range(0, len(i), 4096)):
                y = x + step
                both = lone[x] & lone[y]
                able = (part[x] != part[y]) & (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
                able &= np.where(both, forests[0].root[x] != forests[0].root[y], forests[1].root[x] != forests[1].root[y])
                x, y, both = x[able], y[able], both[able]
                if len(x):
                    fixed, wide = apart(sketch, x, sketch, y)
                    most = differing(percent, high[x] + high[y])
                    near = (fixed - far[x] - far[y] <= most) & (wide - far_wide[x] - far_wide[y] <= most)
                    for forest, some in ((forests[0], near & both), (forests[1], near & ~both)):
                        new = np.array(forest.join(x[some], y[some], linked), np.int64).reshape(-1, 2)
                        found.append(np.sort(ids[new], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def starts(table: pa.Table) -> np.ndarray:
        code = np.column_stack([table.column(k).to_numpy() for k in range(3)])
        return np.append(0, np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            begin = starts(table)
            if len(begin) > 1:  # the last group may go on
                yield compared(table, begin)
                held = table.slice(int(begin[-1])).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield compared(table, np.append(starts(table), table.num_rows))

    return streamed.mapInArrow(work, "a long, b long").distinct()


def linked_in_groups(near: DataFrame, found: DataFrame, df: DataFrame, id_column: str, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all parts (found: node, component) with similar nodes among those that the pairs near connect; stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for low, high in row_groups(offsets):
                row, h = sets_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                n = np.bincount(row, minlength=high - low)
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[low:high] for k in range(2)), pa.array(n, pa.int64()), *sketches_of(row, h, n, percent), binary(h, np.searchsorted(row, np.arange(high - low + 1)))], names=["key", "id", "n", "sketch", "wide", "elements"])

    groups = stored(components(near).select(F.col("node").alias("id"), F.col("component").alias("key")), "groups")
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).join(groups, "id").select("key", "id", "text")
    sets = stored(texts.mapInArrow(work, "key long, id long, n long, sketch binary, wide binary, elements binary").filter("n > 0"), "sets")
    none = F.lit(0).cast("long")
    own = {"part": F.coalesce("component", "id"), "lone": F.lit(True), "far": none, "far_wide": none, "low": F.col("n"), "high": F.col("n")}
    rows = sets.join(found.withColumnRenamed("node", "id"), "id", "left").withColumns(own)
    out = stored(compared_in_blocks(rows, percent, elements=True), "verified")
    discard(groups, sets)
    return out


def jaccard_components(df: DataFrame, id_column: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df: set size, and the smallest id reachable by links of percent or more.

    percent: from 60 (below, the differing elements may be as many as a set's own) to 100.
    Shuffles keys of 8 bytes, never texts but those in a candidate pair. Other columns of df are not read.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent: from 60 to 100")
    spark = df.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    made = stored(sketched(df, id_column, text, width, percent), "sketches")
    every = stored(made.select("id", "n", "fa", "fb"), "rows")
    real = made.filter("n > 0 and id is not null")
    classes = stored(real.groupBy("n", "fa", "fb").agg(F.min("id").alias("node")), "classes")
    first = real.join(classes.select(F.col("node").alias("id"), "fa", "fb"), ["id", "fa", "fb"], "left_semi")
    nodes = stored(first.select(F.col("id").alias("node"), "n", "fa", "sketch", "wide", "keys").dropDuplicates(["node", "fa"]), "nodes")
    discard(made)
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n")
    of_key = Window.partitionBy("key")
    shared = keyed.withColumns({"low": F.min("node").over(of_key), "high": F.max("node").over(of_key)}).filter("low <> high")
    met = stored(shared.select("key", "node", "n").distinct(), "met")
    degrees = met.groupBy("node").agg(F.count("*").alias("degree"))
    centers = met.join(degrees, "node").groupBy("key").agg(F.min(F.struct(-F.col("degree"), "node")).alias("first")).select("key", F.col("first.node").alias("center"))
    members = stored(met.join(centers, "key"), "members")
    discard(met)
    # ids with several texts
    several = every.filter("n > 0 and id is not null").groupBy("id").agg(F.min("fa").alias("x"), F.max("fa").alias("y")).filter("x <> y").select("id")
    sketches = nodes.select("node", "n", "sketch", "wide")
    meetings = members.filter("node <> center").groupBy("node", "center").agg(F.count("*").alias("c"))
    usual = meetings.groupBy("node").agg(F.min(F.struct(-F.col("c"), "center")).alias("first")).select(F.col("first.center").alias("a"), F.col("node").alias("b"))
    star = stored(alike(usual, sketches, percent), "pairs")
    sure = verified(star, df, id_column, text, width, percent)
    own = every.join(several, "id", "left_semi").join(classes, ["n", "fa", "fb"]).select(F.col("id").alias("a"), F.col("node").alias("b")).filter("a <> b")
    links = stored(sure.union(own), "links")
    found = stored(components(links), "components")
    discard(star, sure, links)

    # groups that hold several components still
    part = F.coalesce("component", "node")
    placed = members.join(found, "node", "left").select("key", "node", "n", part.alias("part"))
    open_keys = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("members")).filter("x <> y").select("key", "members")
    rest = placed.join(open_keys, "key").select("key", "node", "part", "members").join(sketches, "node")
    cut = stored(split_by_sketch(rest, percent), "open")
    discard(members)
    left = opened(cut, sketches, percent)
    discard(cut, nodes)
    if left.limit(1).count():
        extra = linked_in_groups(left, found, df, id_column, text, width, percent)
        if extra.limit(1).count():
            before = found
            found = stored(components(before.select(F.col("node").alias("a"), F.col("component").alias("b")).union(extra)), "components")
            discard(before)
        discard(extra)
    discard(left)
    labelled = every.join(classes, ["n", "fa", "fb"], "left").join(found, "node", "left")
    return labelled.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component_id"))
