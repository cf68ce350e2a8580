"""The whole decision loop as one fold: calibrate, fuse, modulate by trust, decide, learn.

``start`` and ``step`` couple the states of folds.py. Folding by a constant key
gives the exact loop, in which every source shares calibration, fusion and
thresholds (one task: for tests and small replays). Folding by context gives a
loop for each context in parallel. For large data, ``epoch`` scores rows with
frozen parameters, and the parameters are refitted between batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flow as fx
from . import alerts, detectors, folds, mesh, metrics, windows
from .lineage import cut, stored


class Calibration:
    """Recent benign scores of a detector."""

    def __init__(self, window: int = 2000, warm: int = 50):
        self.recent, self.warm = folds.Recent(window), warm

    def p(self, score: float) -> float:
        n = len(self.recent)
        return 1 / (1 + math.exp(3 * (score - 0.5))) if n < self.warm else (1 + self.recent.at_least(score)) / (n + 1)

    def add(self, score: float) -> None:
        self.recent.add(score)


def action_of(score: float, high: float, low: float, suspicion: float, unknown: bool) -> str:
    """flow.choose_action for one row."""
    if unknown and score > low:
        return "REDIRECT"
    if score > high:
        firm = suspicion > 0.6 and score - high > 0.12
        return ("QUARANTINE" if suspicion > 0.85 else "DROP") if firm else "RATE_LIMIT"
    return "MIRROR" if score > low else "PASS"


def coin(seq: int, share: float) -> bool:
    """A fixed pseudo-random draw for a row."""
    return (seq * 1103515245 + 12345) % 2147483648 < share * 2147483648


def start(detectors: list[str]):
    return lambda: {"cal": {d: Calibration() for d in detectors}, "w": folds.hedge_start(len(detectors))(), "trust": {}, "tau": {}, "budget": {}}


def step(detectors: list[str], mirror: float = 0.05, budget: float = 0.02):
    """Rows need seq, src, proto, label (or null), unknown and a column for each detector."""

    def run(s: dict, row: dict) -> tuple[dict, dict]:
        src, ctx = row["src"], row["proto"]
        signals = [1 - s["cal"][d].p(row[d]) for d in detectors]
        raw = sum(w * x for w, x in zip(s["w"]["w"], signals, strict=True))
        trust = s["trust"].get(src, folds.trust_start())
        n = trust["a"] + trust["b"]
        suspicion = min(1.0, trust["b"] / n + 0.4 * math.sqrt(math.log(trust["seen"] + 2) / n))
        score = min(1.0, max(0.0, raw * (1 + 0.6 * (suspicion - 0.5))))
        tau = s["tau"].get(ctx, folds.threshold_start())
        high, low = tau["tau"], max(0.05, tau["tau"] - 0.08)
        action = action_of(score, high, low, suspicion, bool(row.get("unknown")))
        drop = action in fx.DROPPING
        seen, weight = (not drop) or coin(row["seq"], mirror), 1 / max(0.05, mirror) if drop else 1.0
        label = row["label"]
        known = label is not None and label == label
        teach = known or (seen and (score < low or score > high))
        allowed = False
        if teach:
            s["budget"][src], allowed = folds.budget_step(s["budget"].get(src, folds.budget_start()))
        if allowed and known:
            s["w"] = folds.hedge_step(s["w"], signals, label)
            if seen and label < 0.5:
                for d in detectors:
                    s["cal"][d].add(row[d])
                s["tau"][ctx] = folds.threshold_step(tau, raw, weight, budget)
            s["trust"][src] = folds.trust_step(trust, label)
        elif allowed and score < low:
            for d in detectors:
                s["cal"][d].add(row[d])
            s["tau"][ctx] = folds.threshold_step(tau, raw, 0.3 * weight, budget)
            s["trust"][src] = folds.trust_step(trust, 0.0, 0.2)
        elif allowed:
            s["trust"][src] = folds.trust_step(trust, min(score, 0.9), 0.3)
        return s, {"seq": row["seq"], "score": score, "raw": raw, "high": high, "low": low, "suspicion": suspicion, "action": action}

    return run


SCHEMA = "seq long, score double, raw double, high double, low double, suspicion double, action string"


def decisions(df: DataFrame, detectors: list[str], by: list[str]) -> DataFrame:
    return folds.fold(df.select("seq", "us", "src", "proto", "label", *detectors), by, ["us", "seq"], start(detectors), step(detectors), SCHEMA)


def epoch(df: DataFrame, signals: list[str], weights: list[float], high: float, low: float, trust: DataFrame | None, keep: list[str] | None = None) -> DataFrame:
    """Decisions with frozen weights, thresholds and trust (src, suspicion; None: df has suspicion): declarative, fully parallel. keep: further columns of df that stay. A null signal (a detector that was skipped) leaves the fusion, and the others' weights grow."""
    used = dict.fromkeys(["seq", "src", "label", *signals, *(keep or []), *(c for c in ("unknown", "suspicion") if c in df.columns and (c == "unknown" or trust is None))])
    out = windows.conformal_each(df.select(*used), F.col("label") == 0, signals)
    pairs = list(zip(weights, signals, strict=True))
    there = sum((F.when(F.col(d).isNotNull(), w).otherwise(0.0) for w, d in pairs), F.lit(0.0))
    raw = sum((F.when(F.col(d).isNotNull(), w * (1 - F.col(f"p_{d}"))).otherwise(0.0) for w, d in pairs), F.lit(0.0)) / F.when(there > 0, there).otherwise(1.0) * sum(weights)
    out = out.withColumn("raw", raw)
    out = (out if trust is None else out.join(trust, "src", "left")).withColumn("suspicion", F.coalesce("suspicion", F.lit(0.5)))
    out = out.withColumn("fused", fx.trust_modulated(F.col("raw"), F.col("suspicion")))
    d = fx.choose_action(F.col("fused"), F.lit(high), F.lit(low), F.col("suspicion"), F.col("unknown") if "unknown" in df.columns else F.lit(False))
    return out.withColumn("d", d).select("seq", *(keep or []), F.col("fused").alias("score"), "raw", "suspicion", "d.action", "d.severity")


#: The features that the whole process scores.
FEATURES = ["f_len", "f_iat", "f_syn", "f_fanout", "f_entropy", "f_bytes", "f_pps"]


def processed(flows: DataFrame, span_us: int = 2_000_000, iat_scale: float = 50.0, full_rate: float = 300.0, high: float = 0.6, low: float = 0.52, watts: Column | None = None, watt_budget: float = 0.0) -> DataFrame:
    """One call from flows (seq, us, src, dst, port, proto, len, flags, label) to decisions: features, detector bank, energy gate, calibration, fusion, trust, action. alerts.process makes alerts of them.

    Parameters are frozen for the batch; the head and prototypes learn from its
    labelled rows. With watts and a budget, costly detectors (rrcf, sr, sup) don't
    count for unsuspicious rows over the budget.
    """
    trust = folds.trust_final(flows.filter(F.col("label").isNotNull()), "src", F.col("label")).select(F.col("src").alias("__src"), fx.suspicion(F.col("a"), F.col("b"), F.col("seen")).alias("__s"))
    made = windows.features(flows, span_us, iat_scale, full_rate)
    gated = watts is not None and watt_budget > 0
    kept = [c for c in ("us", "src", "dst", "port", "proto", "label", "family") if c in flows.columns]
    rows = made.select("seq", *kept, *FEATURES, *([watts.alias("__watts")] if gated else []))
    seen = stored(rows.join(trust, F.col("src") == F.col("__src"), "left").drop("__src"))
    scored = detectors.bank(seen, FEATURES, "label", "src", F.col("f_pps") + 0.3 * F.col("f_fanout"))
    if gated:
        skip = mesh.energy_gate(F.col("__watts"), F.coalesce("__s", F.lit(0.5)), watt_budget)
        scored = scored.withColumns({d: F.when(~skip, F.col(d)) for d in ("rrcf", "sr", "sup")})
    share = 1 / len(detectors.BANK)
    return epoch(scored.withColumnRenamed("__s", "suspicion"), detectors.BANK, [share] * len(detectors.BANK), high, low, None, kept)


def snapshot(decided: DataFrame, shown: DataFrame, rule_hit: Column, budget: float = 0.02) -> DataFrame:
    """One row with the state of an engine: traffic, detection, false positives against the budget, alerts and rules. decided: rows with action, severity, label, len; shown: what alerts.process made of them."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    drop, flagged, label = F.col("action").isin(*fx.DROPPING), F.col("action").isin(*fx.ENFORCING), F.col("label")
    weight = 1 / fx.propensity(drop)
    benign = F.sum(F.when(label == 0, weight).otherwise(0.0))
    fpr = metrics.ratio(F.sum(F.when((label == 0) & flagged, weight).otherwise(0.0)), benign)
    seconds = (F.max("us") - F.min("us")) / 1e6
    traffic = decided.agg(
        F.count("*").alias("packets"), count(drop).alias("dropped"), count(F.col("action") == "QUARANTINE").alias("quarantined"),
        metrics.ratio(F.count("*"), seconds).alias("pps"), metrics.ratio(F.sum("len") * 8, seconds).alias("bps"),
        fpr.alias("realized_fpr"), (fpr / budget).alias("budget_ratio"), metrics.ratio(count(rule_hit), F.count("*")).alias("rule_hit_ratio"),
        count(flagged & (label == 1)).alias("tp"), count(flagged & (label == 0)).alias("fp"), count(~flagged & (label == 0)).alias("tn"), count(~flagged & (label == 1)).alias("fn"))
    made = shown.agg(F.count("*").alias("alerts"), F.count_distinct("src").alias("active_campaigns"))
    return metrics.rates(traffic.join(made))
