import hashlib
import random

import pyarrow as pa
import pytest

from rivulet.llm import bpe
from rivulet.llm.text import utf8

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

PARTS = ["a", "'", "s", "t", " ", "  ", "\n", "\t", "re", "ll", "ve", "d", "m", "1", "٣", "é", "!", "?", " ", "　", "😀", "'s", " 't", "日", "\x85", "ª", "_", "\x00", "\x1c", "wordsmith"]
FIXED = ["", " ", "   a", "a  ", "it's 'tis don't we'll", "'re're\n's\n\n's", "  x　y", "supercalifragilistic" * 30, " " * 100 + "x", "0" * 100, "<|endoftext|>"]


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(tokens):
    return bpe.Codec(tokens)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def texts(n):
    draw = random.Random(5)
    return FIXED + ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 30))) for _ in range(n)]


def encode(codec, rows, limit=1 << 19):
    out = [[] for _ in rows]
    for row, ids in codec.encode_slices(*utf8(pa.array(rows, pa.string())), limit):
        out[row].extend(ids.tolist())
    return out


def test_same_ids_as_the_library_and_round_trip(codec, library):
    rows = texts(1500)
    for text, ids in zip(rows, encode(codec, rows), strict=True):
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_slices_of_a_long_text_do_not_change_its_ids(codec, library):
    long = " ".join(texts(3000))
    assert encode(codec, [long], 1 << 10)[0] == library.encode_ordinary(long)


def test_pieces_of_over_two_million_bytes(codec, library):
    draw = random.Random(7)
    part = "".join(draw.choice("aeinrst") for _ in range(9_973))
    rows = ["it's", part * 220, "it's"]
    assert len(rows[1]) > 1 << 21
    short, long, again = encode(codec, rows)
    assert short == again == library.encode_ordinary("it's")
    assert long == library._encode_single_piece(rows[1])  # its pattern takes no text of this length


def test_perfect_hash_is_minimal_and_exact(codec, tokens):
    table = codec.table
    assert sorted(table.value.tolist()) == [i for i, t in enumerate(tokens) if len(t) <= 16]


def test_decode_rejects_unknown_ids(codec):
    with pytest.raises(IndexError):
        codec.decode([len(codec.tokens)])


def test_query_rows(spark, codec):
    rows = [(1, "it's", "x"), (2, None, "y"), (3, "", None), (None, "it's", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {r.doc_id: r for r in bpe.encoded(df, "text", codec, ids=True).collect()}
    assert out[1].n_tokens == len(out[1].token_ids) == out[None].n_tokens
    assert out[1].decoded_sha256 == hashlib.sha256(b"it's").hexdigest()
    assert out[2].n_tokens == 0 and out[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encoded(df.limit(0), "text", codec).count() == 0
