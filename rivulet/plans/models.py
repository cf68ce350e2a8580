"""Queries over detectors that learn, and the whole decision loop; checked against plain numpy in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alerts, detectors, engine, folds, lineage
from ..streaming import learner
from . import experiments
from .tables import DAY, flows, query, table


def _points(spark, sf):
    u = F.col("uid")
    return flows(spark, sf).select("seq", "us", "src", "proto", "label", "score", (F.col("port") / 100.0).alias("b"), ((u % 97) / 97.0).alias("c"))


@query()
def hdc_bundle(spark, sf):
    x = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), (F.col("label") < 5).cast("int").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))
    columns = [f"x{i}" for i in range(64)]
    codes = detectors.standardised(x, columns, detectors.Codes(64))
    return detectors.hyperdimensional(x, columns, detectors.bundled(x, columns, "label", codes), codes).select("seq", F.round("hdc", 6).alias("hdc"))


@query()
def spectral_residual(spark, sf):
    return detectors.spectral_residual(_points(spark, sf), "src", F.col("score")).select("seq", F.round("sr", 6).alias("sr"))


@query()
def random_cuts(spark, sf):
    return detectors.random_cuts(_points(spark, sf), "src", ["score", "b", "c"]).select("seq", F.round("rrcf", 6).alias("rrcf"))


@query()
def supervised_head(spark, sf):
    return detectors.prequential(_points(spark, sf), ["proto"], ["us", "seq"], ["score", "b", "c"], "label").select("seq", F.round("sup", 9).alias("sup"))


@query()
def detector_bank(spark, sf):
    """All detectors of the bank on all rows."""
    out = detectors.bank(_points(spark, sf), ["score", "b", "c"], "label")
    return out.select("seq", *(F.round(d, 6).alias(d) for d in detectors.BANK))


def _processed(spark, sf):
    return engine.processed(flows(spark, sf), DAY, 1 / 86400, 0.001, watts=F.col("len"), watt_budget=120.0)


@query()
def engine_process(spark, sf):
    """Flows to decisions in one call."""
    return _processed(spark, sf).select("seq", F.round("score", 6).alias("score"), F.round("suspicion", 6).alias("suspicion"), "action", "severity")


@query()
def engine_alerts(spark, sf):
    """Flows to alerts in one call."""
    out = alerts.process(engine.cut(_processed(spark, sf).filter("action <> 'PASS'")), DAY)
    return out.select("seq", "src", "action", "severity", "campaign_count", "alert_id", "fdr_p", "lifecycle")


@query()
def decision_loop(spark, sf):
    """The loop for each context."""
    return engine.decisions(_points(spark, sf), ["score", "b", "c"], ["proto"])


@query()
def decision_epoch(spark, sf):
    """Frozen parameters; trust from the closed form over all rows."""
    from ..functions import flow as fx

    x = _points(spark, sf)
    trust = folds.trust_final(x, "src", F.col("label")).select("src", fx.suspicion(F.col("a"), F.col("b"), F.col("seen")).alias("suspicion"))
    return engine.epoch(x, ["score", "b", "c"], [0.4, 0.3, 0.3], 0.7, 0.62, trust).select("seq", F.round("score", 6).alias("score"), "action", "severity")


@query()
def carried_decisions(spark, sf):
    """Flows in batches of time, each decided by what the batches before it taught; a quarter of the time is a batch."""
    x = _points(spark, sf)
    ends = x.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    if ends.a is None:
        return spark.createDataFrame([], "seq long, score double, high double, action string")
    folder = f"{lineage.shared_folder(spark)}/learned-{uuid.uuid4().hex}"
    out = learner.replayed(x.withColumnRenamed("score", "size").withColumn("us", F.col("us") - ends.a), folder, ["size", "b", "c"], (ends.b - ends.a) // 4 + 1)
    return out.select("seq", F.round("score", 6).alias("score"), F.round("high", 6).alias("high"), "action")


@query()
def experiment_results(spark, sf):
    return experiments.run(spark)


@query()
def simulated_traffic(spark, sf):
    from ..sources.sinks import make_source

    return make_source(spark, "sim", rows=5000, attack_prob=0.003).groupBy("family", "proto").agg(F.count("*").alias("n"), F.round(F.avg("pkt_len"), 3).alias("mean_len"))
