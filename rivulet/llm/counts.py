"""Token counts of texts of any length, by overlap resynchronisation.

A text up to ``chunk`` bytes is encoded as it is. A longer one is cut into
chunks of so many characters, each with an overlap into the next, and the
chunks are dealt to all tasks and encoded with offsets. Two neighbours are
spliced at the first proven boundary of their overlap, and only the tokens
between a chunk's two splices count.

A boundary between two characters is proven if no piece of the vocabulary holds
them side by side: merging only ever makes pieces of the vocabulary, so no merge
crosses it, and what stands left and right of it is encoded independently,
wherever the text was cut. Both chunks see both characters, so both find the
same boundary, which is checked when the counts meet. Where an overlap holds
none, the text is cut again with wider chunks and overlaps, at last into one.

The proof needs a model that merges pairs and changes no character; for others
every text is encoded in one.

Nulls and empty texts have no bytes and no tokens. Repeated rows, ids that are
null or repeated, are rows like others: one row comes out for each. Other
columns take no part, so their names can't clash. Ties don't occur.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

WIDER = 16
SPACE_MARK = "▁"
CHUNKS = "key string, chunk long, last boolean, start long, core long, next long, body string"


class Pieces:
    """A sentencepiece model and the pairs of characters that its pieces hold side by side (None: nothing can be proven)."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_proto=content)
        spec = sentencepiece_model_pb2.ModelProto.FromString(content)
        normal, merges = spec.normalizer_spec, spec.trainer_spec.model_type == 2
        own = {p.type for p in spec.pieces} & {4, 5}  # symbols of a user, unused pieces
        plain = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        self.joined = {pair for p in spec.pieces if p.type == 1 for pair in zip(p.piece, p.piece[1:], strict=False)} if merges and plain and not own else None

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, return_type="numpy", num_threads=1)] if texts else []

    def proven(self, before: str, after: str) -> bool:
        mark = lambda c: SPACE_MARK if c == " " else c
        return self.joined is not None and (mark(before), mark(after)) not in self.joined

    def begins(self, text: str) -> list[int]:
        """The character at which each token begins; the bytes of one character begin together."""
        return [a for a, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]]


@functools.lru_cache(maxsize=2)
def loaded(content: bytes) -> Pieces:
    return Pieces(content)


def pieces_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, bool, int, int, int, str]]:
    """(number, is last, start, core, next, body): body starts one character before its core, so that a boundary at the core can be proven."""
    n = max(1, -(-len(text) // chunk))
    for k in range(n):
        core, following = k * chunk, min(len(text), (k + 1) * chunk)
        start = max(0, core - 1)
        yield k, k == n - 1, start, core, following, text[start : following + overlap]


def spliced(pieces: Pieces, body: str, start: int, core: int, following: int, first: bool, last: bool) -> tuple[int | None, int | None, int]:
    """(left splice, right splice, tokens between) of a chunk, as positions in the whole text; None where no boundary is proven."""
    begins = pieces.begins(body)

    def boundary(at: int) -> int | None:
        seen = -1
        for p in begins:
            if p != seen and p >= at - start and 0 < p < len(body) and pieces.proven(body[p - 1], body[p]):
                return p + start
            seen = p
        return None

    left = 0 if first else boundary(core)
    right = start + len(body) if last else boundary(following)
    if left is None and last and core >= start + len(body):
        left = right
    if left is None or right is None:
        return left, right, 0
    return left, right, sum(left <= p + start < right for p in begins) if not (first and last) else len(begins)


def counted(docs: DataFrame, id_column: str, text: str, model_path: str, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text, by the sentencepiece model at model_path."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary: its size has nothing to do with the texts
    own = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["id"]
    counts_schema = T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(loaded(sent.value).counts(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    short = own.filter(F.octet_length("text") <= chunk).mapInArrow(whole, counts_schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex for _ in range(batch.num_rows)], pa.string()), *batch.columns], names=["key", *batch.schema.names])

    # keys are drawn at random and stored at once, so a repeated task can't change them
    left = stored(own.filter(F.octet_length("text") > chunk).mapInArrow(keyed, T.StructType([T.StructField("key", T.StringType()), *own.schema.fields])), "long-texts")
    long, found = left, []
    pieces = Pieces(sent.value)
    size, over = (chunk, overlap) if pieces.joined is not None else (1 << 31, 0)
    while not left.isEmpty():
        met = stored(_met(left, sent, size, over), "counts")
        found.append(met.filter("aligned"))
        unmet = met.filter("NOT aligned").select("key")
        if unmet.isEmpty():
            break
        left, size, over = left.join(unmet, "key", "left_semi"), size * WIDER, over * WIDER
    if not found:
        return short
    every = functools.reduce(DataFrame.union, (f.select("key", "n_tokens") for f in found))
    return short.union(long.select("key", "id", F.octet_length("text").cast("long").alias("n_bytes")).join(every, "key").select("id", "n_bytes", "n_tokens"))


def _met(texts: DataFrame, sent, size: int, over: int) -> DataFrame:
    """(key, n_tokens, aligned) of texts (key, text) cut into chunks of size characters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                rows, held = [], 0
                for row in pieces_of(text.as_py(), size, over):
                    rows.append((key, *row))
                    held += len(row[-1])
                    if held > 1 << 21:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right, n = spliced(loaded(sent.value), r["body"], r["start"], r["core"], r["next"], r["chunk"] == 0, r["last"])
                out.append((r["key"], r["chunk"], r["last"], left, right, n))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "chunk", "last", "left", "right", "n"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = texts.select("key", "text").mapInArrow(cut, CHUNKS).repartition(parts)
    done = chunks.mapInArrow(encode, "key string, chunk long, last boolean, left long, right long, n long")
    # a chunk's right splice has to be the next one's left splice: the sums cancel if all are
    one = F.when(F.col("chunk") > 0, F.xxhash64("chunk", "left")).otherwise(0)
    other = F.when(~F.col("last"), F.xxhash64(F.col("chunk") + 1, F.col("right"))).otherwise(0)
    whole = F.bool_and(F.col("left").isNotNull() & F.col("right").isNotNull())
    return done.groupBy("key").agg(F.sum("n").alias("n_tokens"), (whole & (F.bit_xor(one) == F.bit_xor(other))).alias("aligned"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["key", "chunk", "last", "start", "core", "next", "body"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
