"""How the words of each source differ from those of the other sources of its language.

Terms are runs of letters of ASCII and of bytes above it, A to Z in lower case.
They are found by a table of byte classes over the texts of a batch, put one
after the other. Their slices are grouped by XXH64 (computed in numpy for all
slices of a length at once); every slice is compared with the first of its group
byte by byte, and a group with two different slices is grouped anew by the bytes.
A batch becomes a sparse matrix of documents by terms, of which sums over runs
give occurrences and documents for each (lang, source, term).

Spark adds these up and keeps, in each language, the terms in enough of its
documents. Shares are whole numbers of 10^-9, by long division in 64 bits: exact
while a language has fewer than 9 * 10^15 occurrences. Divergences between two
sources are computed from blocks of terms and sources, as sparse rows summed over
runs, and added. A term that a source lacks has the source's least share there;
only stored counts are visited, the rest is a product.

Null texts, languages and sources count as ''. Repeated rows count as often as
they occur. Groups without terms and empty texts have all shares at their least.
An empty table gives no rows. Ties are broken by the item's bytes. Texts may have
any length: a long one is a batch of its own. Only the three named columns are
read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .text import LOWER_ASCII, U64, row_groups, utf8

SCALE_STEPS = 3  # three times 1,000 is the scale of shares
TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: The primes of XXH64. Fixed values.
PRIMES = [U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def rolled(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def xxh64(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """XXH64 with seed 0 of all slices of one length under 32 bytes. data: padded by 8 bytes at least."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    four = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    one, two, three, fourth, fifth = PRIMES
    with np.errstate(over="ignore"):
        h = np.full(len(starts), fifth + U64(length))
        at = 0
        while at + 8 <= length:
            h = rolled(h ^ (rolled(eight[starts + at] * two, 31) * one), 27) * one + fourth
            at += 8
        if at + 4 <= length:
            h = rolled(h ^ (four[starts + at].astype(U64) * one), 23) * two + three
            at += 4
        while at < length:
            h = rolled(h ^ (data[starts + at].astype(U64) * fifth), 11) * one
            at += 1
        h = (h ^ (h >> U64(33))) * two
        h = (h ^ (h >> U64(29))) * three
        return h ^ (h >> U64(32))


def hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 of every slice of padded data."""
    out = np.empty(len(starts), U64)
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(lengths[order]) != 0, True)) + 1 if len(order) else []
    at = 0
    for end in ends:
        rows, n = order[at:end], int(lengths[order[at]])
        if n < 32:
            out[rows] = xxh64(data, starts[rows], n)
        else:
            import xxhash

            out[rows] = [xxhash.xxh64_intdigest(data[s : s + n].tobytes()) for s in starts[rows].tolist()]
        at = end
    return out


def grouped(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): equal bytes, not only equal hashes. data: padded by 8 bytes."""
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    same = lengths == lengths[first[group]]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    longest, at = int(lengths.max(initial=0)), 0
    live = np.flatnonzero(same)
    while at < longest and len(live):
        mask = masks[np.minimum(lengths[live] - at, 8)]
        same[live] &= ((eight[starts[live] + at] ^ eight[starts[first[group[live]]] + at]) & mask) == 0
        at += 8
        live = live[lengths[live] > at]
    if not same.all():  # slices of one hash that differ: by their bytes
        known: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(np.isin(group, group[~same])).tolist():
            body = data[starts[i] : starts[i] + lengths[i]].tobytes()
            if body not in known:
                known[body] = len(first) + len(extra)
                extra.append(i)
            group[i] = known[body]
        first = np.concatenate([first, np.array(extra, np.int64)])
        used, group = np.unique(group, return_inverse=True)
        first = first[used]
    return group, first


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of every term of rows of lowered bytes; a term never goes on in the next row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    term = TERM[data]
    first = term.copy()
    first[1:] &= ~term[:-1]
    stop = ~term
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = term[inner]
    stop[inner] = True
    starts = np.flatnonzero(first)
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, "right")]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends - starts


def summed_runs(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of values over equal keys."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    return [k[new] for k in keys], [np.add.reduceat(v[order], new) for v in values]


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row with term null for every group."""
    small_batches(docs.sparkSession, 2000)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
            kinds: dict[tuple, int] = {}
            of = np.array([kinds.setdefault((p["lang"], p["source"]), len(kinds)) for p in pair.to_pylist()], np.int64)
            langs, sources = pa.array([k[0] for k in kinds], pa.string()), pa.array([k[1] for k in kinds], pa.string())
            yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(kinds), pa.string()), pa.array([0] * len(kinds), pa.int64()), pa.array([0] * len(kinds), pa.int64())], names=names)
            data, offsets = utf8(batch.column("text"))
            for a, b in row_groups(offsets, 2 << 20):
                own = np.append(LOWER_ASCII[data[offsets[a] : offsets[b]]], np.zeros(16, np.uint8))
                row, starts, lengths = slices(own[:-16], offsets[a : b + 1] - offsets[a])
                if not len(row):
                    continue
                group, first = grouped(own, starts, lengths, hashed(own, starts, lengths))
                # the sparse matrix of rows by terms, then its sums for each pair of language and source
                (r, term), (n,) = summed_runs([row, group], [np.ones(len(row), np.int64)])
                (kind, term), (n, seen) = summed_runs([of[a:b][r], term], [n, np.ones(len(n), np.int64)])
                words = pa.array([own[s : s + k].tobytes() for s, k in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(kind)), sources.take(pa.array(kind)), words.take(pa.array(term)), pa.array(n), pa.array(seen)], names=names)

    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    counts = own.mapInArrow(work, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, lower: Column, prior: int = 5) -> Column:
    """1 + floor(10^9 (count + prior) / lower), by long division; lower is a total with prior for each term."""
    divided = lambda x: F.call_function("div", x, lower)
    upper = count + prior
    out, rest = divided(upper), upper % lower
    for _ in range(SCALE_STEPS):
        out, rest = out * 1000 + divided(rest * 1000), (rest * 1000) % lower
    return out + 1


def shares(count: np.ndarray, lower: np.ndarray, prior: int = 5) -> np.ndarray:
    """share() in numpy."""
    rest = count + prior
    out, rest = rest // lower, rest % lower
    for _ in range(SCALE_STEPS):
        out, rest = out * 1000 + rest * 1000 // lower, rest * 1000 % lower
    return out + 1


def block_divergences(source: np.ndarray, term: np.ndarray, count: np.ndarray, lower: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of differences over the block's terms) for a of left, b of right (b after a if the two are the same).

    source, term, count: the block's stored counts, terms from 0; lower: each
    source's denominator.
    """
    terms = int(term.max(initial=-1)) + 1
    order = np.lexsort((term, source))
    source, term, value = source[order], term[order], shares(count[order], lower[source[order]])
    starts = np.searchsorted(source, np.arange(len(lower) + 1))
    least = shares(np.zeros(len(lower), np.int64), lower)
    out: list[tuple] = []
    inner = np.flatnonzero(np.isin(source, right))
    rows, columns, stored_value = source[inner], term[inner], value[inner]
    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, np.int64)
    for a in left.tolist():
        others = right[right > a] if same else right
        own = np.full(terms, least[a])
        mine = slice(starts[a], starts[a + 1])
        own[term[mine]] = value[mine]
        total = np.abs(least[:, None] - value[mine][None]).sum(1) + (terms - (starts[a + 1] - starts[a])) * np.abs(least - least[a])
        if len(rows):
            more = np.abs(stored_value - own[columns]) - np.abs(least[rows] - own[columns])
            total[rows[heads]] += np.add.reduceat(more, heads)
        out.append((np.full(len(others), a), others, total[others]))
    return tuple(np.concatenate([np.empty(0, np.int64), *(o[k] for o in out)]) for k in range(3))


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50, term_block: int = 1024, source_block: int = 128) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' has the divergence from every other source of the language, part 'term' the top terms by excess over the language."""
    counts = stored(term_counts(docs, text, lang, source), "terms")
    words = counts.filter("term IS NOT NULL")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n")).filter(F.col("in_docs") >= least_docs).drop("in_docs")
    own = stored(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    in_lang = own.select("lang", "term", "lang_n").groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_n"))
    of_group = own.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(in_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["terms", "lang_n", "group_n"])
    n_sources = counts.filter("term IS NULL").groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(n_sources, "lang").select("lang", "source", "terms", (F.col("group_n") + 5 * F.col("terms")).alias("lower"), (F.col("lang_n") + 5 * F.col("terms")).alias("lang_lower"), F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("long").alias("term_blocks"), F.ceil(F.col("sources") / source_block).cast("long").alias("source_blocks"))
    groups = stored(groups, "groups")  # a row a group: Spark sees its size and broadcasts it only if small

    known = own.join(groups, ["lang", "source"])
    excess = known.withColumn("value", share(F.col("n"), F.col("lower")) - share(F.col("lang_n"), F.col("lang_lower"))).filter("value > 0")
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = excess.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    pairs = divergences(known, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(place))
    return pairs.union(terms)


def divergences(known: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    block_of = F.pmod(F.xxhash64("source", F.lit(3)), "source_blocks")
    meets = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1), lambda k: F.struct(F.least(k, F.col("sb")).alias("i"), F.greatest(k, F.col("sb")).alias("j"))))
    keys = ["lang", "block", "i", "j"]
    cells = known.withColumn("sb", block_of).withColumn("block", F.pmod(F.xxhash64("term", F.lit(5)), "term_blocks")).withColumn("m", meets).select("lang", "block", "m.i", "m.j", "source", "term", "n")
    sides = groups.withColumn("sb", block_of).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))).withColumn("m", meets).select("lang", "block", "m.i", "m.j", "source", "sb", "terms", "lower")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        sources = right.column("source").to_pylist()
        sb, lower = right.column("sb").to_numpy(), right.column("lower").to_numpy()
        i, j, lang = right.column("i")[0].as_py(), right.column("j")[0].as_py(), right.column("lang")[0].as_py()
        sides = np.flatnonzero(sb == i), np.flatnonzero(sb == j)
        if right.column("terms")[0].as_py():
            at = {s: k for k, s in enumerate(sources)}
            rows = np.array([at[s] for s in left.column("source").to_pylist()], np.int64)
            term = left.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) if left.num_rows else np.empty(0, np.int64)
            a, b, value = block_divergences(rows, term, left.column("n").to_numpy().astype(np.int64), lower, *sides, i == j)
            least, seen = shares(np.zeros(len(lower), np.int64), lower), int(term.max(initial=-1)) + 1
        else:
            a, b = (x.ravel() for x in np.meshgrid(*sides, indexing="ij"))
            a, b = (a[a < b], b[a < b]) if i == j else (a, b)
            value, least, seen = np.zeros(len(a), np.int64), np.zeros(len(lower), np.int64), 0
        names = pa.array(sources, pa.string())
        total = right.column("terms")[0].as_py()
        columns = [pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value), pa.array(np.abs(least[a] - least[b])), pa.array(np.full(len(a), seen)), pa.array(np.full(len(a), total))]
        return pa.table(columns, names=["lang", "a", "b", "value", "apart", "seen", "terms"])

    found = cells.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(work, "lang string, a string, b string, value long, apart long, seen long, terms long")
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("apart").alias("apart"), F.sum("seen").alias("seen"), F.max("terms").alias("terms"))
    # terms that neither of the two sources' blocks holds
    both = summed.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("p"), (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("apart")).alias("value"))
    return both.select("lang", "p.source", "p.item", "value")
