"""Good and rejected lines add up to the input, in batches and on streams."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.sources import quarantine

GOOD = b'{"t":"flow","src":"1.1.1.1","dst":"2.2.2.2","sport":1,"dport":2,"proto":17,"flags":0,"len":60,"hook":1}'
BAD = {
    b"junk": "no JSON object", b'{"t":"flow",': "no JSON object", b"": "empty", b"   ": "empty", b'{"a":1}': "no kind", b'{"t":"other"}': "unknown kind",
    b'{"t":"flow","sport":"x"}': "bad sport", b'{"t":"flow","len":[1]}': "bad len", b'{"t":"flow","src":"\xff\xfe"}': "not UTF-8", b"[1,2]": "no JSON object",
}


def written(folder, files=3, seed=2):
    """What each rejected line should say, by place; and how many good lines and lines of another kind there are."""
    draw, want, good, other = random.Random(seed), {}, 0, 0
    (folder / "in").mkdir()
    for f in range(files):
        body = b""
        for k in range(200):
            line = GOOD if k == 199 else draw.choice([GOOD, GOOD + b" " * draw.randrange(50), b'{"t":"metrics","xdp_pkts":5}', *BAD])
            if line in BAD:
                want[f"{f}.txt", len(body)] = BAD[line]
            good, other = good + line.startswith(GOOD), other + (b"metrics" in line)
            body += line + draw.choice([b"\n", b"\r\n"])
        (folder / "in" / f"{f}.txt").write_bytes(body if f else body.rstrip())
    return want, good, other


@pytest.mark.parametrize("parts", [1, 13])
def test_counts_add_up_and_places_are_right(spark, tmp_path, parts):
    want, good, other = written(tmp_path)
    rows = quarantine.lines(spark, str(tmp_path / "in"), parts=parts)
    assert rows.count() == 600
    judged = quarantine.judged(rows, "flow")
    records, rejected = quarantine.split(judged)
    assert {(r.path.rsplit("/", 1)[1], r.offset): r.reason for r in rejected.collect()} == want
    assert records.count() == good and good + len(want) + other == 600 and records.filter("len = 60 AND proto = 17").count() == good
    tally = {r.reason: r.rows for r in quarantine.tallied(judged).collect()}
    assert tally[None] == good and sum(tally.values()) == 600 - other


def test_csv_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,2.5\nx,1\n"3",4,5\n\n-1,1\n7,8\n')
    check = lambda r: F.when(r["a"] < 0, "a below 0")
    judged = quarantine.judged_csv(quarantine.lines(spark, str(tmp_path / "x.csv")), "a int, b double", "a,b", check)
    records, rejected = quarantine.split(judged)
    assert sorted((r.a, r.b) for r in records.collect()) == [(1, 2.5), (7, 8.0)]
    assert sorted((r.offset, r.reason) for r in rejected.collect()) == [(10, "fields don't fit"), (14, "fields don't fit"), (22, "empty"), (23, "a below 0")]


def test_stream(spark, tmp_path):
    want, good, other = written(tmp_path)
    stream = quarantine.judged(quarantine.stream_lines(spark, str(tmp_path / "in"), 1), "flow")
    query = quarantine.routed(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check"))
    query.awaitTermination(200)
    assert query.exception() is None and spark.read.parquet(str(tmp_path / "good")).count() == good
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert bad.count() == len(want) and {r.reason for r in bad.collect()} == set(want.values())


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        quarantine.judged(spark.createDataFrame([], quarantine.LINES), "nothing")


def test_first_lines_of_each_file(spark, tmp_path):
    for name, n in (("a", 5), ("b", 2), ("c", 0)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(n)))
    out = quarantine.first_lines(quarantine.lines(spark, str(tmp_path), parts=3), 3).collect()
    assert sorted(r.line for r in out) == ["a0", "a1", "a2", "b0", "b1"]
