"""Simulated labelled traffic as a Python data source: spark.read.format("rivulet_sim"), or
readStream.

Options: rows (10000), seed (42), attack_prob (0.0015 a benign record), rate_hz
(400), partitions (4). Each partition simulates its own stretch of time, so
rows don't depend on the cluster, only on the options.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, pkt_len int, tcp_flags int, label int, family string"
#: Number of outside hosts.
OUTSIDE = 2000
FAMILIES = ["portscan", "synflood", "ddos", "exfil"]


def simulated(first: int, rows: int, seed: int, attack_prob: float, rate_hz: float, begin: float) -> Iterator[tuple]:
    """Benign records between inside hosts and outside ones, with bursts of 40 to 120 attack records."""
    draw = np.random.default_rng([seed, first])
    numbers = np.random.default_rng(seed).integers([11, 0, 0, 0], [223, 255, 255, 255], (OUTSIDE, 4))
    outside = [".".join(map(str, row)) for row in numbers.tolist()]
    inside = lambda: f"10.0.{draw.integers(0, 4)}.{draw.integers(1, 40)}"
    now, left, family, attacker, victim = begin, 0, "", "", ""
    for k in range(rows):
        if not left and draw.random() < attack_prob:
            left, family = int(draw.integers(40, 121)), FAMILIES[draw.integers(0, 4)]
            attacker, victim = outside[draw.integers(0, len(outside))], inside()
        now += (0.4 if left else 1.0) / rate_hz
        if left:
            left -= 1
            src, dst = (victim, attacker) if family == "exfil" else (outside[draw.integers(0, len(outside))] if family == "ddos" else attacker, victim)
            port = int(draw.integers(1, 1024)) if family == "portscan" else 443 if family == "exfil" else 80
            length = int(draw.integers(1200, 1500)) if family == "exfil" else int(draw.integers(40, 60))
            flags = 24 if family == "exfil" else 2
            yield first + k, now, src, dst, int(draw.integers(1024, 65536)), port, "UDP" if family == "ddos" else "TCP", length, flags, 1, family
        else:
            yield first + k, now, inside(), outside[draw.integers(0, len(outside))], int(draw.integers(1024, 65536)), int(draw.choice([80, 443, 53, 22, 8080])), str(draw.choice(["TCP", "TCP", "UDP"])), int(draw.integers(60, 1500)), int(draw.choice([16, 24, 2])), 0, "benign"


class Part(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts = int(options.get("rows", 10_000)), int(options.get("partitions", 4))
        self.seed, self.prob, self.rate = int(options.get("seed", 42)), float(options.get("attack_prob", 0.0015)), float(options.get("rate_hz", 400))

    def partitions(self) -> list[InputPartition]:
        cut = np.linspace(0, self.rows, max(1, self.parts) + 1).astype(int)
        return [Part(int(a), int(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from simulated(partition.first, partition.rows, self.seed, self.prob, self.rate, 1_700_000_000 + partition.first / self.rate)


class Stream(DataSourceStreamReader):
    """Batches of batch_rows records without end (or up to rows, if given); the offset is the number of records so far."""

    def __init__(self, options: dict):
        self.batch, self.parts = int(options.get("batch_rows", 1000)), int(options.get("partitions", 4))
        self.most = int(options["rows"]) if "rows" in options else None
        self.inner, self.sent = Reader(options), 0

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        self.sent += self.batch
        if self.most is not None:
            self.sent = min(self.sent, self.most)
        return {"seq": self.sent}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.sent = max(self.sent, end["seq"])
        cut = np.linspace(start["seq"], end["seq"], max(1, self.parts) + 1).astype(int)
        return [Part(int(a), int(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.inner.read(partition)


class SimulatedFlows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rivulet_sim"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)
