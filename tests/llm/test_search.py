"""Decontamination, nearest neighbours, archives, and the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import ann, decontam, warc

# --- decontamination -------------------------------------------------------


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            row[j], last = (last + 1 if a == b else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_common_subsequence():
    draw = np.random.default_rng(1)
    for _ in range(50):
        x, y = draw.integers(0, 6, draw.integers(0, 40)), draw.integers(0, 6, draw.integers(0, 40))
        assert decontam.common_subsequence(x, y) == lcs(x.tolist(), y.tolist())


def test_rows_are_added_as_one_by_one():
    draw = np.random.default_rng(3)
    for n in (0, 1, 4000):
        to, of, rows = draw.integers(0, 60, n) ** 2 // 60, draw.integers(0, 90, n), draw.normal(size=(90, 16)).astype(np.float32)
        one, all_at_once = np.zeros((2, 60, 16), np.float32)
        np.add.at(one, to, rows[of])
        decontam.add_rows(all_at_once, to, of, rows)
        assert (one == all_at_once).all()  # the same order of sums, so the same bits


def test_leaks_and_clean_documents(spark):
    draw = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "oru", "ite", "eso", "ubi", "alo", "ens", "imo")]
    rare = [f"rare{k}x" for k in range(900)]
    text = lambda n: " ".join(draw.choice(words + rare[300:]) for _ in range(n))
    items = [(i, " ".join(draw.choice(words) if draw.random() < 0.5 else rare[10 * i + draw.randrange(10)] for _ in range(draw.choice([12, 30, 70])))) for i in range(30)]
    docs, true = [], set()
    for d in range(200):
        body = text(draw.choice([5, 60, 300]))
        if d % 5 == 0:
            i, item = draw.choice(items)
            parts = item.split(" ")
            if d % 10 == 0:  # a paraphrase: some words changed
                for _ in range(len(parts) // 6):
                    parts[draw.randrange(len(parts))] = draw.choice(words)
            body = f"{body} {'; '.join(parts)}. {text(40)}"
            true.add((d, i))
        docs.append((d, body))
    frame = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items + [(77, None), (78, ""), (79, "too few words")], "item_id long, text string")
    out = {(r.id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert true <= out and {d for d, _ in out} == {d for d, _ in true}
    blocks = {(r.id, r.item_id) for r in decontam.contaminated(frame, bench, block_items=10).collect()}
    assert true <= blocks and {d for d, _ in blocks} == {d for d, _ in true}
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0 == decontam.contaminated(frame.limit(0), bench).count()


def test_paraphrases_of_hot_items_and_short_items(spark):
    draw = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "oru", "ite", "eso", "ubi", "alo", "ens", "imo")]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    item = ["bana", "onlyx", "coru", "dite", "feso", "onlyy", "gubi", "halo", "jens", "onlyz", "kimo", "lana"]
    changed = [draw.choice(words) if w.startswith("only") else w for w in item]
    docs = [(d, f"{text(200)} {' '.join(item if d < 30 else changed if d == 30 else [])} {text(150)}") for d in range(60)]
    docs += [(70, f"{text(40)} Zeta, eta theta! {text(9)}"), (71, f"zeta {text(3)} eta theta"), (72, "zeta eta"), (73, "theta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "zeta eta theta"), (3, "")], "item_id long, text string")
    out = {(r.id, r.item_id): r for r in decontam.contaminated(frame, bench).collect()}
    assert set(out) == {(d, 1) for d in range(31)} | {(70, 2)}
    assert abs(out[30, 1].overlap - 0.75) < 0.18 and out[70, 2].overlap == out[70, 2].answer == 1
    assert {(r.id, r.item_id) for r in decontam.contaminated(frame, bench.filter("item_id > 1")).collect()} == {(70, 2)}


# --- nearest neighbours ----------------------------------------------------
def vectors(n, seed=0):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(12, 16))
    return [(i, (centers[i % 12] + draw.normal(size=16) * 0.7).astype(np.float32).tolist()) for i in range(n)]


def test_every_query_finds_its_ten(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(600)] + [(600 + i, (draw.normal(size=8) * 40).astype(np.float32).tolist()) for i in range(20)]
    index = ann.Index(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", share=0.3)
    found = index.search(index.rows, 10).groupBy("query_id").count()
    assert found.count() == 620 and found.filter("count <> 10").count() == 0
    few = ann.Index(spark.createDataFrame(rows[:4], "id long, v array<float>"), "id", "v")
    assert few.search(few.rows, 10).count() == 12


def test_recall_of_the_query(spark):
    index = ann.Index(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    queries = index.rows.filter("id % 100 = 0")
    assert ann.recall(index, queries, 10) >= 0.93
    print(index.parts, "parts, share scanned", ann.scanned(index, queries, 10))


def test_recall_and_exact_scores(spark):
    rows = vectors(1500)
    rows += [(5000 + i, rows[7][1]) for i in range(60)]  # many copies of one
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [1.0]), (9005, [float("inf")] * 16), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    index = ann.Index(df, "vec_id", "embedding", parts=8, group=300)
    queries = index.rows.filter("id % 50 = 0")
    assert ann.recall(index, queries, 10) >= 0.9
    found = index.search(queries, 10).collect()
    x = {i: np.array(v, np.float64) for i, v in rows}
    assert all(r.score == np.sqrt(((x[r.query_id] - x[r.id]) ** 2).sum()) and r.query_id != r.id for r in found)
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.score, r.id))
    for hits in by.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11)) and [h[1:] for h in hits] == sorted(h[1:] for h in hits)
    assert all(len(hits) == 10 for hits in by.values())
    copies = sorted(r.id for r in found if r.query_id == 5000 and r.score == 0)
    assert copies[:3] == [7, 5001, 5002] and len(copies) == 10


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame(vectors(5), "vec_id long, embedding array<float>")
    index = ann.Index(df, "vec_id", "embedding")
    assert index.search(index.rows, 10).count() == 20
    empty = ann.Index(df.limit(0), "vec_id", "embedding")
    assert empty.search(empty.rows, 10).count() == 0


def test_parts_are_balanced():
    x = np.array([v for _, v in vectors(600)])
    part = ann.balanced_parts(ann.neighbour_graph(x, 8), 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(600 / 6 * 1.05)


# --- archives --------------------------------------------------------------
def digest(s):
    return base64.b32encode(hashlib.sha1(s).digest()).decode()


def test_round_trip(spark):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b\r\nX: y", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n"), (None, "u", "<p>é</p>"), (7, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = warc.salvaged(warc.archived(df), payloads=True).collect()
    assert {r.kind for r in out} == {"record"} and len(out) == len(rows)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i][:2] == (len(data), digest(data))
    assert got[1][2:] == ("revisit", 2) == got[None][2:] and got[2][2:] == ("response", None)
    assert got[3][2:] == ("revisit", 4) and got[4][2] == "response"
    assert next(r.payload for r in out if r.page_id == 7) == b"z" * 300_000
    assert warc.salvaged(warc.archived(df.limit(0))).count() == 0
    least = warc.salvaged(warc.archived(df, min_bytes=1)).filter("page_id = 3").first()
    assert least.record_type == "response"


def read(data):
    s = warc.Salvage(data)
    rows = [(h.get("warc-record-id"), p) for _, h, p, _, _ in s.records()]
    return rows, s.gaps


def test_payloads_that_hold_records():
    inner = warc.member(warc.record(7, "u", b"inner"))
    plain = [warc.record(0, "u", b"before"), warc.record(1, "u", b"<" + inner + b">" + warc.record(8, "v", b"plain")), warc.record(2, "u", b"after")]
    sound = [(f"<urn:page:{k}>", t) for k, t in enumerate((b"before", b"<" + inner + b">" + warc.record(8, "v", b"plain"), b"after"))]
    assert read(b"".join(plain)) == (sound, [])
    assert read(b"".join(warc.member(p) for p in plain)) == (sound, [])
    damaged = plain[0].replace(b"before", b"bef0re") + plain[2]
    assert read(damaged) == (sound[2:], [(0, len(plain[0]), "payload digest differs")])


def test_members_that_are_not_held():
    texts = [b"", b"short", bytes(range(256)) * 9000, b"x" * 3_000_000]
    records = [warc.record(k, "u", t) for k, t in enumerate(texts)] + [warc.record(9, "u", b"other", 1), warc.record(None, None, b"y")]
    for data in (b"".join(warc.member(r) for r in records), warc.member(b"".join(records))):
        small, whole = (warc.Salvage(data, most) for most in (1000, 1 << 30))
        a, b = list(small.records()), list(whole.records())
        assert [(h, n, d) for _, h, _, n, d in a] == [(h, n, d) for _, h, _, n, d in b] and not small.gaps and not whole.gaps
        assert len(a) == 6 and any(p is None for _, _, p, _, _ in a)
    wrong = warc.record(3, "u", texts[3]).replace(b"xxx", b"xyx", 1)
    reader = warc.Salvage(warc.member(records[1]) + warc.member(wrong) + warc.member(records[0]), 1000)
    assert [h["warc-record-id"] for _, h, *_ in reader.records()] == ["<urn:page:1>", "<urn:page:0>"]
    assert [g[2] for g in reader.gaps] == ["payload digest differs"]
    cut = warc.Salvage(warc.member(records[3])[:-40] + warc.member(records[1]), 1000)
    assert [h["warc-record-id"] for _, h, *_ in cut.records()] == ["<urn:page:1>"] and len(cut.gaps) == 1


def test_salvage_of_damaged_archives():
    texts = [f"page {k} " .encode() * 50 for k in range(5)]
    plain = [warc.record(k, "u", t) for k, t in enumerate(texts)]
    packed = [warc.member(p) for p in plain]
    sound = [(f"<urn:page:{k}>", t) for k, t in enumerate(texts)]
    assert read(b"".join(packed)) == (sound, [])
    assert read(b"".join(plain)) == (sound, [])
    whole = b"".join(packed)
    for k in range(5):  # a byte is changed, bytes are lost, junk is added
        begin = sum(map(len, packed[:k]))
        middle = begin + len(packed[k]) // 2
        for bad in (whole[:middle] + bytes([whole[middle] ^ 255]) + whole[middle + 1 :], whole[:middle] + whole[middle + 5 :]):
            rows, gaps = read(bad)
            assert rows == sound[:k] + sound[k + 1 :] and len(gaps) == 1 and gaps[0][0] == begin
        rows, gaps = read(whole[:begin] + b"junk\x1f\x8b\x08junk" + whole[begin:])
        assert rows == sound and gaps[0][0] == begin and gaps[-1][1] == begin + 11
    cut = b"".join(plain)
    at = len(plain[0]) + 300
    rows, gaps = read(cut[:at] + cut[at + 40 :])
    assert rows == sound[:1] + sound[2:] and gaps[0][0] == len(plain[0])
    rows, gaps = read(whole[:-30])
    assert rows == sound[:4] and gaps[0][2].startswith("truncated")
    assert read(b"") == ([], []) and read(b"nothing here")[0] == []
    swapped = plain[1].replace(b"page 1 page", b"page 2 page", 1)
    rows, gaps = read(b"".join([packed[0], warc.member(swapped), packed[2]]))
    assert [r for r, _ in rows] == ["<urn:page:0>", "<urn:page:2>"] and gaps[0][2] == "payload digest differs"
    rows, gaps = read(warc.member(plain[0] + b"damage\r\n" + plain[1]))
    assert [r for r, _ in rows] == ["<urn:page:0>", "<urn:page:1>"] and len(gaps) == 1


def whole(data, most):
    s, rows = warc.Salvage(data, most), []
    for at, h, p, n, d in s.records():
        rows.append((at, s.inner, h, b"".join(s.pieces()) if p is None else p, n, d))
    return rows, s.gaps, s.inside


@pytest.mark.parametrize("seed", range(2))
def test_large_members_are_salvaged_like_small_ones(seed):
    draw = random.Random(seed)
    texts = [draw.randbytes(draw.choice([0, 10, 5000, 1 << 20, 1_500_000])) + b"\r\nWARC/1.1 in a text" for _ in range(8)]
    plain = [warc.record(k, "u", t) for k, t in enumerate(texts)] + [warc.record(8, "u", texts[0], 0)]
    after = warc.member(warc.record(99, "u", b"after"))
    for k in range(len(plain)):
        at = sum(map(len, plain[:k]))
        damages = [plain[k].replace(b"Content-Length", b"Content-Lengsh", 1).replace(b"Payload-Digest: sha1:", b"Payload-Digest: sha1:X", 1), plain[k][:-3], b"X" + plain[k][1:], plain[k].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9999", 1)]
        for bad in damages:
            if k == 8 and bad == damages[0]:
                continue
            body = b"".join(plain[:k]) + bad + b"\r\n" + b"".join(plain[k + 1 :])
            data = warc.member(body) + after
            small, large = whole(data, 1000), whole(data, 1 << 30)
            assert small == large
            rows, gaps, inside = large
            assert [r[2].get("warc-record-id") for r in rows] == [f"<urn:page:{j}>" for j in [*range(k), *range(k + 1, 9), 99]]
            assert all(r[3] == texts[j] for r, j in zip(rows, [*range(k), *range(k + 1, 8)], strict=False))
            assert {g[:2] for g in gaps} == {(0, len(data) - len(after))} and inside[0][0] == at and inside[-1][1] == at + len(bad) + 2


def test_long_headers_and_blocks_without_a_head():
    long = b"WARC/1.1\r\nWARC-Type: resource\r\nX: " + b"y" * 3_000_000 + b"\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    odd = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 3000000\r\n\r\n" + b"z" * 3_000_000 + b"\r\n\r\n"
    false = b"WARC/1.1\r\n" + b"no header " * 300_000
    data = warc.member(long + odd + false + b"\r\n" + long)
    small, large = whole(data, 1000), whole(data, 1 << 30)
    assert small == large and [r[3][:5] for r in large[0]] == [b"hello", b"zzzzz", b"hello"] and large[0][1][4] == 3_000_000
    assert len(large[1]) == 1 and large[2] == [(len(long + odd), len(long + odd + false) + 2)]
    assert whole(warc.member(odd.replace(b"3000000", "²".encode())), 1000)[1][0][2] == "no block length"


def test_payloads_in_pieces(spark, tmp_path):
    text = random.Random(4).randbytes(2_500_000)
    wrong = warc.record(2, "u", b"wrong").replace(b"wrong", b"wr0ng")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.member(warc.record(1, "u", text) + wrong + warc.record(3, "u", b"last")))
    out = warc.salvaged(spark.createDataFrame([(str(path),)], "path string"), payloads=True, most=100_000).collect()
    assert [(r.page_id, r.payload_bytes, r.payload) for r in out if r.kind == "record"] == [(1, len(text), None), (3, 4, b"last")]
    pieces = sorted((r for r in out if r.kind == "piece"), key=lambda r: r.piece)
    assert b"".join(r.payload for r in pieces) == text and {(r.first, r.inner) for r in pieces} == {(0, 0)}
    gap = next(r for r in out if r.kind == "gap")
    assert gap.reason == "payload digest differs" and gap.inner_end - gap.inner == len(wrong)


# --- pipeline --------------------------------------------------------------
@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(2000)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows, labels = [], []
    for d in range(260):
        toxic = d % 4 == 0
        body = text(70)
        if toxic:
            body += " vilex grumt snarb vilex"
        rows.append((d, body))
        labels.append((d, 1, int(toxic)))
    item, passage, base = text(40), text(60), text(120)
    rows += [(300, base), (301, base), (302, base + " changed"), (303, text(30) + " " + item + " " + text(30)), (304, text(20) + " " + passage), (305, text(25) + " " + passage), (306, None), (307, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), dict(rows), passage


def test_pipeline(spark, small):
    import corpus_pipeline

    folder, texts, passage = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    toxic = {d for d in range(260) if d % 4 == 0}
    assert not toxic & set(kept[0]) and set(kept[0]) == set(texts) - toxic
    assert set(kept[1]) == set(kept[0]) - {301, 302}
    assert set(kept[2]) == set(kept[1])
    assert kept[2][304] == texts[304] and passage not in kept[2][305] and kept[2][305] == texts[305].replace(" " + passage, "")
    assert kept[2][306] is None and kept[2][307] == ""
    assert set(kept[3]) == set(kept[2]) - {303}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == set(kept[3])
    assert all(r.decoded_sha256 == hashlib.sha256((kept[3][d] or "").encode()).hexdigest() for d, r in out.items())
    empty = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    _ = F
