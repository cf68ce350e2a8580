"""The tables behind a dashboard or an API, as DataFrames: one method for each thing that is asked for. Serving them is the caller's."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import alerts, engine, mesh, metrics


@dataclass(frozen=True)
class Settings:
    """Settings that can change while a process runs. Values out of range are refused."""

    budget: float = 0.02
    mirror: float = 0.05
    dedup_us: int = 3_000_000
    discovery: float = 0.1
    watt_budget: float = 0.0
    mesh: bool = False
    node: str = ""
    seeds: tuple[str, ...] = ()
    suspect: float = 8.0
    dead: float = 12.0

    def __post_init__(self) -> None:
        if not (0 < self.budget < 1 and 0 <= self.mirror < 1 and 0 < self.discovery < 1 and self.dedup_us >= 0 and self.watt_budget >= 0 and 0 < self.suspect <= self.dead):
            raise ValueError("a setting is out of range")

    @classmethod
    def of(cls, values: Mapping[str, str], prefix: str = "RIVULET_") -> Settings:
        """From text such as RIVULET_BUDGET=0.05; values may be os.environ. Sharing with other nodes is off unless RIVULET_MESH=1."""
        made = {}
        for f in fields(cls):
            text = values.get(prefix + f.name.upper())
            if text is not None:
                kind = type(f.default)
                made[f.name] = tuple(s.strip() for s in text.split(",") if s.strip()) if kind is tuple else text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        return cls(**made)

    def changed(self, **values) -> Settings:
        return replace(self, **values)


@dataclass
class Console:
    """Tables over decided flows (seq, us, src, action, severity, score, label, len, ...), alerts made of them, members, shared records, and rules."""

    decided: DataFrame
    settings: Settings = field(default_factory=Settings)
    members: DataFrame | None = None
    intel: DataFrame | None = None
    rules: DataFrame | None = None

    def alerts(self) -> DataFrame:
        return alerts.process(self.decided.filter("action <> 'PASS'"), self.settings.dedup_us, self.settings.discovery)

    def metrics(self, rule_hit: Column | None = None) -> DataFrame:
        return engine.snapshot(self.decided, self.alerts(), rule_hit if rule_hit is not None else F.lit(False), self.settings.budget)

    def report(self) -> DataFrame:
        """Rates of the decisions against the labels."""
        from ..functions import flow as fx

        return metrics.rates(metrics.confusion(self.decided, flagged=F.col("action").isin(*fx.ENFORCING), label=F.col("label")))

    def history(self, n: int = 400) -> DataFrame:
        return alerts.recent(self.decided, n)

    def campaigns(self) -> DataFrame:
        return alerts.campaigns(self.alerts())

    def cluster(self) -> DataFrame:
        return mesh.health(self.members)

    def shared(self, now: Column, ttl_us: int = 900_000_000) -> DataFrame:
        return mesh.live_intel(self.intel, now, ttl_us)

    def approved(self, *numbers: int) -> DataFrame:
        """The rules with approved: only rules that someone named are to be enforced."""
        return self.rules.withColumn("approved", F.col("number").isin(*numbers) if numbers else F.lit(False))
