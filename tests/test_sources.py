"""Sources, sinks, streams and experiments."""

import struct

import pytest
from pyspark.sql import functions as F

from rivulet.operators import folds
from rivulet.plans import experiments
from rivulet.sources import capture, labelled, ndjson, sinks
from rivulet.streaming import stateful


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_five_tuple_csv(spark, tmp_path):
    path = write(tmp_path / "a" / "x.csv", " Source IP, Source Port, Destination IP, Destination Port, Protocol, Total Length of Fwd Packets, Label\n1.1.1.1,5,2.2.2.2,80,6,0,BENIGN\n1.1.1.1,5,2.2.2.2,80,6,0,BENIGN\n3.3.3.3,9,4.4.4.4,0,17,99999,DDoS\n5.5.5.5,1,6.6.6.6,1,6,nan,DDoS\n")
    out = {r.src_ip: r for r in labelled.flow_records(labelled.raw(spark, str(tmp_path / "a"))).collect()}
    assert path and set(out) == {"1.1.1.1", "3.3.3.3"}
    assert (out["1.1.1.1"].label, out["1.1.1.1"].proto, out["1.1.1.1"].pkt_len, out["1.1.1.1"].family) == (0, "TCP", 64, "benign")
    assert (out["3.3.3.3"].label, out["3.3.3.3"].proto, out["3.3.3.3"].pkt_len, out["3.3.3.3"].family) == (1, "UDP", 65535, "ddos")


def test_statistics_only_csv(spark, tmp_path):
    write(tmp_path / "x.csv", "Rate,syn_flag_number,ack_flag_number,fin_flag_number,rst_flag_number,psh_flag_number,TCP,UDP,ICMP,HTTP,HTTPS,DNS,Tot size,label\n1000,1,0,0,0,1,1,0,0,0,1,0,120,DDoS-SYN\n0.5,0,1,0,0,0,0,1,0,0,0,1,60,BenignTraffic\n")
    out = sorted(labelled.flow_records(labelled.raw(spark, str(tmp_path))).collect(), key=lambda r: r.label)
    assert (out[1].src_ip, out[1].dst_ip, out[1].dst_port, out[1].tcp_flags, out[1].proto) == ("10.99.6.8", "10.99.255.1", 443, 10, "TCP")
    assert (out[0].src_ip, out[0].dst_port, out[0].proto, out[0].family) == ("10.99.0.4", 53, "UDP", "benign")
    assert labelled.inspected(spark, str(tmp_path)).first().verdict == "OK"


def test_binary_label_and_category(spark, tmp_path):
    write(tmp_path / "x.csv", "srcip,sport,dstip,dsport,proto,sbytes,attack_cat,label\n1.1.1.1,1,2.2.2.2,2,tcp,10,Fuzzers,1\n1.1.1.2,1,2.2.2.2,2,udp,10,-,1\n1.1.1.3,1,2.2.2.2,2,udp,10,-,0\n")
    assert {r.src_ip: r.family for r in labelled.flow_records(labelled.raw(spark, str(tmp_path))).collect()} == {"1.1.1.1": "fuzzers", "1.1.1.2": "attack", "1.1.1.3": "benign"}
    with pytest.raises(ValueError):
        labelled.mapping(["a", "b"])
    assert labelled.normal_header("﻿ \"Flow_Duration\" ") == "flow duration"


def test_loader_lines(spark):
    lines = spark.createDataFrame([('{"t":"flow","src":"1.1.1.1","dst":"2.2.2.2","sport":1,"dport":2,"proto":17,"flags":0,"len":60,"hook":1}',), ('{"t":"metrics","xdp_pkts":5}',), ("junk",), ("{bad",), (None,)], "value string")
    flow = ndjson.records(ndjson.parsed(lines, "flow")).collect()
    assert len(flow) == 1 and flow[0].proto == "UDP" and flow[0].label is None
    assert ndjson.parsed(lines, "metrics").first().xdp_pkts == 5
    assert ndjson.parsed(lines, "status").count() == 0


def test_capture(spark, tmp_path):
    ip = bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, 6, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8])
    tcp = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x50, 0x02, 0, 0, 0)
    frame = bytes(12) + b"\x08\x00" + ip + tcp
    other = bytes(12) + b"\x86\xdd" + bytes(40)
    body = b"".join(struct.pack("<4I", 10, 500_000, len(f), len(f)) + f for f in (frame, other))
    (tmp_path / "x.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body + b"\0\1")
    (tmp_path / "y.pcap").write_bytes(b"no capture")
    out = capture.read(spark, str(tmp_path)).collect()
    assert [(r.ts, r.src_ip, r.dst_port, r.proto, r.tcp_flags) for r in out] == [(10.5, "1.2.3.4", 80, "TCP", 2)]


def test_simulation_is_fixed_by_its_options(spark):
    one = sorted(map(tuple, sinks.make_source(spark, "sim", rows=3000, attack_prob=0.01).collect()))
    two = sorted(map(tuple, sinks.make_source(spark, "sim", rows=3000, attack_prob=0.01).collect()))
    assert one == two and len(one) == 3000 and {r[-2] for r in one} == {0, 1}
    with pytest.raises(ValueError):
        sinks.make_source(spark, "other")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 86_400_000_001), (2, 0.25, 5)], "seq long, score double, us long")
    sinks.append_events(df, str(tmp_path / "events"))
    sinks.append_events(df.limit(1), str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).filter("day = 1").count() == 2
    assert {r.score for r in sinks.decision_lines(df).collect()} == {"0.500000", "0.250000"}
    sinks.write_csv(sinks.evaluation(df.agg(F.count("*").alias("n"))), str(tmp_path / "csv"), True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().value == "2"


def streamed(spark, df, folder, make):
    df.repartition(3).write.parquet(str(folder / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(folder / "in"))
    query = make(stream).writeStream.format("memory").queryName("out").option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table("out")


def test_stream_fold_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k % 5, n, float((n * 37) % 11 > 7)) for n in range(200) for k in (n,)], "src long, us long, label double")

    def step(s, row):
        s = folds.trust_step(s, row["label"])
        return s, {"us": row["us"], "a": s["a"], "b": s["b"]}

    schema = "us long, a double, b double"
    batch = sorted(map(tuple, folds.fold(df, ["src"], ["us"], folds.trust_start, step, schema).collect()))
    live = sorted(map(tuple, streamed(spark, df, tmp_path, lambda s: stateful.stream_fold(s, ["src"], ["us"], folds.trust_start, step, schema)).collect()))
    assert live == batch


def test_routing_isolates_failures(spark, tmp_path):
    df = spark.createDataFrame([(1, "critical", "DROP"), (2, "low", "MIRROR"), (3, "info", "PASS")], "seq long, severity string, action string")
    df.write.parquet(str(tmp_path / "in"))
    got = []

    def broken(_):
        raise RuntimeError("down")

    query, failed = stateful.to_sinks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), {"pager": lambda b: got.extend(r.seq for r in b.collect()), "siem": broken}, str(tmp_path / "check"))
    query.awaitTermination(120)
    assert got == [1] and failed[0][1:] == ("siem", "down")


@pytest.mark.parametrize("name", list(experiments.EXPERIMENTS))
def test_experiments_pass(name):
    assert all(ok for *_, ok in experiments.EXPERIMENTS[name]())
