"""Labelled CSV exports with tolerant headers, as flow records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flow as fx

#: Header spellings of each field; the first that is present counts. Fixed values.
ALIASES = {
    "src_ip": ["source ip", "src ip", "srcip", "id.orig h", "saddr", "ip src"],
    "dst_ip": ["destination ip", "dst ip", "dstip", "id.resp h", "daddr", "ip dst"],
    "src_port": ["source port", "src port", "sport", "id.orig p", "sports"],
    "dst_port": ["destination port", "dst port", "dsport", "dport", "id.resp p", "dports"],
    "proto": ["protocol", "proto", "protocol type"],
    "length": ["total length of fwd packets", "flow bytes/s", "fwd packet length mean", "average packet size", "packet length mean", "total fwd packets", "tot size", "avg", "total size", "sbytes", "orig bytes", "bytes", "pkt len"],
    "rate": ["rate", "srate", "flow packets/s"],
    "iat": ["iat", "flow iat mean"],
    "duration": ["duration", "flow duration"],
    "syn": ["syn flag number"],
    "ack": ["ack flag number"],
    "fin": ["fin flag number"],
    "rst": ["rst flag number"],
    "psh": ["psh flag number"],
    "is_tcp": ["tcp"],
    "is_udp": ["udp"],
    "is_icmp": ["icmp"],
    "is_http": ["http"],
    "is_https": ["https"],
    "is_dns": ["dns"],
    "label": ["label", "labels", "attack label", "class", "attack", "is attack", "marker", "outcome", "result", "attack cat", "attack category", "attack type", "category", "type", "traffic type"],
    "family": ["attack cat", "attack category", "attack type", "category", "subcategory", "type", "traffic type"],
}


def normal_header(name: str) -> str:
    """Lower case, without byte order mark and quotes; _ and - are spaces, runs of white space one space."""
    plain = name.replace("﻿", "").strip().strip("\"'").lower()
    return re.sub(r"\s+", " ", re.sub("[_-]", " ", plain)).strip()


def mapping(columns: list[str]) -> dict[str, str]:
    """Field -> column. Without a label column this raises ValueError."""
    known = {}
    for c in reversed(columns):
        known[normal_header(c)] = c
    out = {field: known[alias] for field, names in ALIASES.items() for alias in reversed(names) if alias in known}
    if "label" not in out:
        raise ValueError(f"no label column among {columns}")
    return out


def raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, of a file or of all .csv files below a folder."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("mode", "PERMISSIVE").option("multiLine", False).csv(path)


def flow_records(df: DataFrame, clean: bool = True, unique: bool = True) -> DataFrame:
    """df (text columns) as records: src_ip, dst_ip, src_port, dst_port, proto, pkt_len, tcp_flags, label, family.

    Only mapped columns are read (the scan is pruned). Repeated header lines, and
    with clean rows with a dirty mapped cell, go; with unique, repeated rows too.
    """
    fields = mapping(df.columns)
    col = lambda k: F.col(f"`{fields[k]}`") if k in fields else F.lit(None).cast("string")
    number = lambda k: F.coalesce(col(k).try_cast("double"), F.lit(0.0))
    if unique:
        df = df.dropDuplicates()
    rows = df.filter(F.coalesce(F.lower(F.trim(col("label"))) != normal_header(fields["label"]), F.lit(True)))
    if clean:
        for c in set(fields.values()):
            rows = rows.filter(~fx.is_dirty(F.col(f"`{c}`")))
    label = F.lower(F.trim(F.coalesce(col("label"), F.lit(""))))
    benign = fx.is_benign(label)
    source = F.nullif(F.trim(F.coalesce(col("src_ip"), F.lit(""))), F.lit(""))
    target = F.nullif(F.trim(F.coalesce(col("dst_ip"), F.lit(""))), F.lit(""))
    surrogate = fx.surrogate_source(number("rate"), number("syn"), number("ack"), number("fin"), number("rst"))
    named = fx.protocol(col("proto"))
    hot = fx.protocol_of_flags(number("is_tcp"), number("is_udp"), number("is_icmp"))
    port = F.coalesce(F.nullif(number("dst_port").cast("int"), F.lit(0)), fx.default_port(number("is_https"), number("is_http"), number("is_dns")))
    family: Column = fx.family(label, F.lower(F.trim(F.coalesce(col("family"), F.lit("")))))
    flags = number("fin") * 1 + number("syn") * 2 + number("rst") * 4 + number("psh") * 8 + number("ack") * 16
    return rows.select(
        F.coalesce(source, surrogate).alias("src_ip"),
        F.when(source.isNull(), fx.SURROGATE_TARGET).otherwise(F.coalesce(target, F.lit("0.0.0.0"))).alias("dst_ip"),
        number("src_port").cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"),
        F.when(named.isin("OTHER", "0"), hot).otherwise(named).alias("proto"),
        fx.packet_length(col("length")).alias("pkt_len"),
        flags.cast("int").alias("tcp_flags"),
        F.when(benign, 0).otherwise(1).alias("label"),
        F.when(benign, "benign").otherwise(family).alias("family"),
    )


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """Label counts and a verdict (FAIL: one class; WARNING: skewed; OK) before a run; the whole input is counted."""
    df = raw(spark, path)
    rows = flow_records(df, clean=False, unique=False)
    n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("malicious"))
    ratio = F.col("benign") / F.nullif(F.col("malicious"), F.lit(0).cast("long"))
    verdict = F.when((F.col("benign") == 0) | (F.col("malicious") == 0), "FAIL").when((ratio >= 10) | (ratio <= 0.1), "WARNING").otherwise("OK")
    return n.select("*", fx.imbalance_warning(ratio).alias("imbalance"), verdict.alias("verdict"))


def native_columns(df: DataFrame) -> list[str]:
    """Columns that may be features: not labels or identities."""
    taken = {normal_header(a) for k in ("src_ip", "dst_ip", "src_port", "label", "family") for a in ALIASES[k]}
    return [c for c in df.columns if normal_header(c) not in taken]
