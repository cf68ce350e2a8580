"""Lines of JSON from a packet loader: flows, metrics and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {
    "flow": "t string, src string, dst string, sport int, dport int, proto int, flags int, len int, hook int",
    "metrics": "t string, xdp_pkts long, xdp_bytes long, xdp_pass long, xdp_drop long, tc_pkts long, tc_bytes long, lsm_connect long, rb_punts long, rb_miss long, punt_starve long, cg_connect long, xdp_rate long, xdp_redir long, heavy_hitter long, fanout_cardinality double",
    "status": "t string, xdp int, tc int, lsm int, ifindex int",
}


def parsed(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Records of a kind from lines (batch or stream); lines that aren't JSON objects or of another kind are skipped."""
    text = F.trim(F.col(column))
    row = F.from_json(text, KINDS[kind])
    return lines.filter(text.startswith("{") & (F.get_json_object(text, "$.t") == kind)).select(row.alias("r")).select("r.*").drop("t")


def records(flows: DataFrame) -> DataFrame:
    """Loader flows as flow records without labels."""
    proto = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").when(F.col("proto") == 1, "ICMP").otherwise("OTHER")
    return flows.select(F.current_timestamp().alias("ts"), F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("sport").alias("src_port"), F.col("dport").alias("dst_port"), proto.alias("proto"), F.col("len").alias("pkt_len"), F.col("flags").alias("tcp_flags"), F.lit(None).cast("int").alias("label"))
