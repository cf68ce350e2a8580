"""Removal of byte strings of a given length that occur earlier, by suffix arrays.

"Earlier" is a smaller id, or an earlier start in the same text. Null ids come
first. Rows with one id and different texts are documents in order of a hash
of the text; rows equal in id and text are one document and get equal results.
Null and short texts lose nothing.

1. Every string of ``length`` bytes is assigned to an anchor, the smallest of
   the hashed k-grams in it, so equal strings have equal anchors. The starts of
   one anchor are adjacent: with it they form a piece of text. Pieces, as
   hashes, are grouped by anchor; anchors that occur once are done.
2. Equal pieces are put together: all but the first are removed.
3. Of anchors with several different pieces, the text of each different piece
   goes to a shard (an anchor with very many pieces to several). Each shard
   builds its suffix array by Larsson-Sadakane refinement and Kasai's common
   prefixes, and finds all equal strings.
4. Strings of an anchor that lies in several shards are merged: sorted runs of
   the shards, dealt by ranges of the key, are searched in each other (binary
   search) for the earliest start, two by two, so the number of shards counts
   by its logarithm.
5. The runs of starts found are joined to the texts, once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, extended, small_batches, stored
from .text import BYTE_VALUES, MULTIPLIERS, U64, mix, powers, row_groups, utf8

#: Bytes of text that a shard gets, about; pieces of one anchor that a shard gets at most.
SHARD_BYTES, ANCHOR_PIECES = 1 << 18, 1 << 11
#: Bytes of text whose 64-bit numbers stay near the processor while anchors are chosen.
NEAR = 1 << 16
#: Shards that a task gets, about. Adaptive execution would deal them by size into few tasks.
TASK_SHARDS = 32
#: at = hash of the text << 39 | start << 7 | number of starts
START_BITS, COUNT_BITS = 39, 7


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Suffixes are sorted by eight bytes; then groups of equal ones are sorted by the rank of what follows, twice as far each round (Larsson and Sadakane)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(U64)
    order = np.argsort(key)  # the order of equal ones is settled below
    ordered = key[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    tail = (order >= n - 7) & ~(new & np.append(new[1:], True))  # zero bytes that only pad sort before real ones: the shorter suffix first
    if tail.any():
        ranked = np.lexsort((np.minimum(n - order, 8), np.cumsum(new)))
        order, new = order[ranked], new[ranked]
        size = np.minimum(n - order, 8)
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (size[1:] != size[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ends = np.append(new[1:], True)
    open_slots = np.flatnonzero(~(new & ends))
    step = 8
    while len(open_slots):
        member = order[open_slots]
        after = member + step
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        place = np.argsort(rank[member] << 32 | following, kind="stable")
        own, following, member = rank[member][place], following[place], member[place]
        order[open_slots] = member
        new = np.append(True, (own[1:] != own[:-1]) | (following[1:] != following[:-1]))
        rank[member] = np.maximum.accumulate(np.where(new, open_slots, 0))
        open_slots = open_slots[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each slot, bytes that its suffix shares with that of the slot before (0 for the first).

    Kasai's observation, start + common prefix never falls from one start to the
    next, so only starts whose preceding bytes differ are compared; a running
    maximum gives the rest.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    other = np.full(n, -1, np.int64)
    other[order[1:]] = order[:-1]
    before = other - 1
    at = np.flatnonzero((other >= 0) & ((np.arange(n) == 0) | (before < 0) | (data[np.arange(n) - 1] != data[np.maximum(before, 0)])))
    reach = np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(n + 1, "<u8", padded, strides=(1,))
    i, j, todo = at.copy(), other[at], np.arange(len(at))
    while len(todo):
        x, y = eight[np.minimum(i, n)], eight[np.minimum(j, n)]
        diff = x ^ y
        same = np.where(diff == 0, 8, np.bitwise_count((diff & (~diff + U64(1))) - U64(1)).astype(np.int64) // 8)
        same = np.minimum(same, n - np.maximum(i, j))
        reach[at[todo]] = i + same
        go = (same == 8) & (np.maximum(i, j) + 8 < n)
        i, j, todo = i[go] + 8, j[go] + 8, todo[go]
    shared = np.maximum.accumulate(reach) - np.arange(n)
    shared[other < 0] = 0
    return shared[order]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, piece, start, count) of every piece, starts in the row's text. data: under 2**20 bytes."""
    k = max(1, length // 3 - 1)
    n = len(data)
    none = tuple(np.empty(0, t) for t in (np.int64, U64, U64, np.int64, np.int64))
    if n < length:
        return none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=total[1:])
    gram = mix((total[k:] - total[:-k]) * down[: n + 1 - k])
    low = (gram & ~U64((1 << 20) - 1)) | np.arange(len(gram), dtype=U64)
    span, width = length - k + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    chosen = (low & U64((1 << 20) - 1)).astype(np.int64)  # for each start of length bytes
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    valid = np.arange(len(chosen)) + length <= offsets[row + 1]
    start = np.flatnonzero(valid)
    if not len(start):
        return none
    chosen, row = chosen[start], row[start]
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]))
    begin = start[new]
    count = np.diff(np.append(np.flatnonzero(new), len(start)))
    piece = mix((total[begin + count + length - 1] - total[begin]) * down[begin] + count.astype(U64) * MULTIPLIERS[3] + (chosen[new] - begin).astype(U64) * MULTIPLIERS[4])
    return row[new], gram[chosen[new]], piece, begin - offsets[row[new]], count


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, piece, doc, at) for docs (doc, tag, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (1 << 20) - 1
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for low, high in row_groups(offsets, NEAR):
                begin, end = offsets[low], offsets[high]
                for cut in range(begin, max(begin + 1, end - length + 1), limit - length + 1):
                    stop = min(end, cut + limit) if high == low + 1 else end
                    part = anchors(data[cut:stop], np.clip(offsets[low : high + 1], cut, stop) - cut, length)
                    index = pa.array(low + part[0])
                    tag = batch.column(1).take(index).to_numpy(zero_copy_only=False).astype(np.int64)
                    at = tag << START_BITS | (part[3] + (cut - begin)) << COUNT_BITS | part[4]
                    yield pa.RecordBatch.from_arrays([pa.array(part[1].view(np.int64)), pa.array(part[2].view(np.int64)), batch.column(0).take(index), pa.array(at)], names=["anchor", "piece", "doc", "at"])
                    if high > low + 1:
                        break

    return docs.select("doc", "tag", "text").mapInArrow(work, "anchor long, piece long, doc long, at long")


def piece_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (doc, tag, list of anchor, at, shard, parts) with each piece's bytes: (shard, anchor, parts, doc, at, body)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            data, offsets = utf8(texts)
            inner, bounds = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            at = inner.field("at").to_numpy()
            start = (at >> COUNT_BITS) & ((1 << (START_BITS - COUNT_BITS)) - 1)
            size = (at & ((1 << COUNT_BITS) - 1)) + length - 1
            raw, where = data.tobytes(), (offsets[row] + start).tolist()
            body = pa.array([raw[a : a + s] for a, s in zip(where, size.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([inner.field("shard"), inner.field("anchor"), inner.field("parts"), batch.column(0).take(pa.array(row)), inner.field("at"), body], names=["shard", "anchor", "parts", "doc", "at", "body"])

    return docs.join(wanted, ["doc", "tag"]).select("doc", "text", "list").mapInArrow(work, "shard long, anchor long, parts long, doc long, at long, body binary")


#: Stands for a null id, so it comes first.
NULL_ID = -(2**63)


def joined(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single starts (without a count) as runs of adjacent starts."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (at - at[head]) % 64 == 0
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at))[: len(begin)] - 1
    return doc[begin], at[begin] << COUNT_BITS | (at[last] - at[begin] + 1)


def shard_repeats(length: int):
    def work(table: pa.Table) -> pa.Table:
        """Equal strings among a shard's pieces: kind 0 rows are starts to remove, kind 1 the first of each string that other shards may have."""
        data, offsets = utf8(table.column("body"))
        order = suffix_array(data)
        same = common_prefixes(data, order) >= length
        piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        fits = (offsets[piece + 1] - np.arange(len(data)) >= length)[order]
        group, where = np.cumsum(~same)[fits], order[fits]
        owner = piece[where]
        doc = table.column("doc").to_numpy()[owner]
        at0 = table.column("at").to_numpy()[owner]
        at = (at0 >> COUNT_BITS) + (where - offsets[owner])  # text and start
        new = np.append(True, group[1:] != group[:-1]) if len(group) else np.empty(0, bool)
        single = new & np.append(new[1:], True)[: len(new)]
        # one string can be in one place twice: by pieces that overlap at a cut; then it's one occurrence
        several = np.flatnonzero(~single)
        several = several[np.lexsort((at[several], doc[several], group[several]))]
        first = new[np.flatnonzero(~single)]  # groups keep their places
        head = several[np.maximum.accumulate(np.where(first, np.arange(len(several)), 0))]
        late = several[(doc[several] != doc[head]) | (at[several] != at[head])]
        shared = np.concatenate([np.flatnonzero(single), several[first]])
        shared = shared[table.column("parts").to_numpy()[owner[shared]] > 1]
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
        key = mix((total[where[shared] + length] - total[where[shared]]) * down[where[shared]])
        late_doc, late_at = joined(doc[late], at[late])
        n = len(late_at)
        out_at, kind = np.concatenate([late_at, at[shared]]), np.repeat([0, 1], [n, len(shared)])
        out_doc = np.concatenate([late_doc, doc[shared]])
        anchor = np.concatenate([np.zeros(n, np.int64), table.column("anchor").to_numpy()[owner[shared]]])
        keys = np.concatenate([np.zeros(n, U64), key]).view(np.int64)
        return pa.table({"kind": pa.array(kind, pa.int64()), "shard": pa.array(np.full(len(kind), table.column("shard")[0].as_py()), pa.int64()), "anchor": anchor, "key": keys, "doc": pa.array(out_doc, pa.int64()), "at": out_at})

    return work


def merged(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Two runs (code, doc, at), each sorted by codes that differ, as one with the earlier place of each code, and the later places (doc, at)."""
    slot = np.minimum(np.searchsorted(one[0], two[0]), len(one[0]) - 1)
    found = one[0][slot] == two[0]
    hit, slot = np.flatnonzero(found), slot[found]
    d0, a0, d1, a1 = one[1][slot], one[2][slot], two[1][hit], two[2][hit]
    older = (d0 < d1) | (d0 == d1) & (a0 < a1)
    other = (d0 != d1) | (a0 != a1)
    late = [np.where(older, d1, d0)[other], np.where(older, a1, a0)[other]]
    one[1][slot], one[2][slot] = np.where(older, d0, d1), np.where(older, a0, a1)
    every = [np.concatenate([x, y[~found]]) for x, y in zip(one, two, strict=True)]
    order = np.argsort(every[0], kind="stable")
    return [x[order] for x in every], late


def merge_runs(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows (shard, anchor, key, doc, at), each shard's strings different: those that another shard has earlier. Shards' sorted runs are merged two by two until one is left, so a row is moved as often as the number of shards has binary digits."""
    code = mix(frame["key"].to_numpy().view(U64) ^ mix(frame["anchor"].to_numpy().view(U64)))
    shard = frame["shard"].to_numpy()
    order = np.lexsort((code, shard))
    bounds = np.flatnonzero(np.diff(shard[order])) + 1
    columns = (code, frame["doc"].to_numpy(), frame["at"].to_numpy())
    runs = [list(x) for x in zip(*(np.split(c[order], bounds) for c in columns), strict=True)]
    late = [[np.empty(0, np.int64)] * 2]
    while len(runs) > 1:
        made = [merged(a, b) for a, b in zip(runs[::2], runs[1::2], strict=False)]
        late += [x for _, x in made]
        runs = [x for x, _ in made] + runs[len(made) * 2 :]
    doc, at = (np.concatenate(x) for x in zip(*late, strict=True))
    return pd.DataFrame({"doc": doc, "at": at})


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """(doc, tag, runs) for docs (doc, tag, text) that lose bytes; runs: list of (start, count) of starts of repeated strings."""
    every = stored(pieces(docs, length), "pieces")
    again = every.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    kept = stored(every.join(again, "anchor", "left_semi"), "repeated")
    discard(every)
    place = F.struct("doc", "at")
    firsts = stored(kept.groupBy("anchor", "piece").agg(F.min(place).alias("first"), F.count("*").alias("c")), "firsts")
    copies = firsts.filter("c > 1").select("anchor", "piece", "first")
    later = kept.select("anchor", "piece", place.alias("own")).join(copies, ["anchor", "piece"]).filter("own <> first").select("own.doc", "own.at")

    several = firsts.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor", F.ceil(F.col("c") / ANCHOR_PIECES).cast("long").alias("parts"))
    open_pieces = stored(firsts.join(several, "anchor").select("anchor", "piece", "parts", "first.*"), "open")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), open_pieces.count() * 2 * length // SHARD_BYTES)
    shard = F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("piece"), "parts")), F.lit(shards)).alias("shard")
    wanted = open_pieces.select("doc", F.shiftright("at", START_BITS).alias("tag"), F.struct("anchor", "at", shard, "parts").alias("x"))
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list("x").alias("list"))  # a document's own pieces
    bodies = stored(piece_texts(docs, lists, length), "bodies")
    dealt = bodies.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // TASK_SHARDS), "shard")
    found = stored(dealt.groupBy("shard").applyInArrow(shard_repeats(length), "kind long, shard long, anchor long, key long, doc long, at long"), "found")
    local = found.filter("kind = 0").select("doc", "at")
    shared = found.filter("kind = 1")
    ranges = max(1, shared.count() >> 17)
    ranged = shared.withColumn("range", F.pmod(F.xxhash64("anchor", "key"), F.lit(ranges)))
    across = ranged.select("range", "shard", "anchor", "key", "doc", "at").groupBy("range").applyInPandas(merge_runs, "doc long, at long").select("doc", F.shiftleft("at", COUNT_BITS).bitwiseOR(F.lit(1)).alias("at"))
    runs = later.union(local).union(across)
    out = stored(runs.groupBy("doc", F.shiftright("at", START_BITS).alias("tag")).agg(F.collect_list("at").alias("runs")), "runs")
    discard(kept, firsts, open_pieces, bodies, found)
    return out


def spans(runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the bytes that runs (at) of starts cover, joined where they touch."""
    start = (runs >> COUNT_BITS) & ((1 << (START_BITS - COUNT_BITS)) - 1)
    end = start + (runs & ((1 << COUNT_BITS) - 1)) + length - 1
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def without_repeats(df: DataFrame, id_column: str, text: str, length: int = 100, whole_characters: bool = False) -> DataFrame:
    """df with n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, as a string if whole_characters, which then keeps characters cut in two).

    length: bytes, from 16 to 150.
    """
    if not 16 <= length <= 150:
        raise ValueError("length: from 16 to 150")
    spark = df.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    made = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "string" if whole_characters else "binary"}
    df = df.drop(*made)
    tag = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 24))
    docs = df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("doc"), tag.alias("tag"), F.col(text).alias("text"))
    runs = repeats(docs, length).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("runs").alias("__runs"))
    keys = df.withColumns({"__doc": F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)), "__tag": tag})
    joined = keys.join(runs, ["__doc", "__tag"], "left").select(*df.columns, "__runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            data, offsets = utf8(batch.column(names.index(text)))
            lists = batch.column(names.index("__runs"))
            out: dict[str, list] = {name: [] for name in made}
            for i in range(batch.num_rows):
                own, run = data[offsets[i] : offsets[i + 1]], lists[i].values
                keep, n = np.ones(len(own), bool), 0
                if run is not None and len(run):
                    begin, end = spans(run.to_numpy(), length)
                    n = len(begin)
                    edge = np.zeros(len(own) + 1, np.int64)
                    edge[begin], edge[end] = edge[begin] + 1, edge[end] - 1
                    keep = np.cumsum(edge[:-1]) == 0
                    if whole_characters:
                        head = np.cumsum((own & 0xC0) != 0x80) - 1
                        keep = (np.bincount(head, keep) > 0)[head]
                left = own[keep].tobytes()
                for name, value in zip(made, (len(own), int((~keep).sum()), n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if whole_characters else left), strict=True):
                    out[name].append(value)
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in names if c != "__runs"), *(pa.array(out[n], types[k]) for n, k in made.items())], names=[*(c for c in names if c != "__runs"), *made])

    return joined.mapInArrow(work, extended(df, made))
