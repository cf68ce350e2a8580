"""Token counts against the library, chunks and splices."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from rivulet.llm import counts
from rivulet.llm.queries import op12_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    draw = random.Random(3)
    words = ["the", "Straße", "été", "日本語", "x" * 30, "  ", "\t", "\n\n", "▁", "<s>", "</s>", "<unk>", "<0x41>", "a\u0000b", "😀", "　", "0123456789", "é", "'s"]
    mixed = [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 7, 60, 400, 3000)]
    glued = ["".join(draw.choice(words) for _ in range(n)) for n in (5, 500, 2000)]
    return [None, "", " ", "a", "a" * 5000, " " * 3000, "日" * 4000, "aqzx" * 1500, "\u0000" * 300, *mixed, *glued]


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 4), (333, 40), (1 << 16, 1 << 10)])
def test_counts_equal_the_librarys(spark, library, chunk, overlap):
    texts = odd_texts()
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)] + [(1, "repeated row", "y")] * 3
    frame = spark.createDataFrame(rows, "name long, text string, n_tokens string")  # a column whose name clashes
    out = counts.counted(frame, "name", "text", MODEL, chunk, overlap).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows)
    assert sorted((-1 if r.id is None else r.id, r.n_bytes, r.n_tokens) for r in out) == want


def test_query_counts_every_document(spark, library):
    folder = "/root/testdata/sf0.1"
    out = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op12_counts(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    sizes = [len(x) for x in library.encode([r.text or "" for r in docs], num_threads=4)]
    assert out == {r.doc_id: (len((r.text or "").encode()), n, n > 4096) for r, n in zip(docs, sizes, strict=True)}
    assert max(n for n, _, _ in out.values()) > 1 << 16  # some are cut


def test_splices_meet_and_widen():
    pieces = counts.Pieces(open(MODEL, "rb").read())
    text = "one two three four five six seven eight nine ten " * 20
    rows = list(counts.pieces_of(text, 100, 20))
    met = [counts.spliced(pieces, body, start, core, following, k == 0, last) for k, last, start, core, following, body in rows]
    assert all(a[1] == b[0] for a, b in zip(met, met[1:], strict=False)) and sum(m[2] for m in met) == len(pieces.model.encode(text))
    assert counts.spliced(pieces, "a" * 120, 0, 0, 100, True, False)[1] is None  # nothing proven: the overlap has to widen
    assert not pieces.proven("t", "h") and pieces.proven("e", " ")


def test_no_rows(spark):
    assert counts.counted(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", MODEL).count() == 0


def test_a_model_without_a_proof_encodes_in_one(spark, library, monkeypatch):
    monkeypatch.setattr(counts.Pieces, "proven", lambda *a: False)
    frame = spark.createDataFrame([(1, "some words " * 50)], "doc_id long, text string")
    row = counts.counted(frame.withColumn("text", F.col("text")), "doc_id", "text", MODEL, 100, 10).first()
    assert row.n_tokens == len(library.encode("some words " * 50))
