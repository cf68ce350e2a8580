"""Detection quality: confusion counts, rates, ranking metrics and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_totals


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def confusion(df: DataFrame, *keys: str, flagged: Column, label: Column) -> DataFrame:
    """tp, fp, tn, fn; a null label counts nowhere."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    aggs = [count(flagged & (label == 1)).alias("tp"), count(flagged & (label == 0)).alias("fp"), count(~flagged & (label == 0)).alias("tn"), count(~flagged & (label == 1)).alias("fn")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def rates(df: DataFrame, digits: int = 6) -> DataFrame:
    """precision, recall, f1, mcc, accuracy, balanced_accuracy, fpr, tnr, fnr of tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    out = {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "mcc": (tp * tn - fp * fn) / F.when(spread == 0, 1.0).otherwise(spread),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "balanced_accuracy": (recall + ratio(tn, tn + fp)) / 2,
        "fpr": ratio(fp, fp + tn),
        "tnr": ratio(tn, tn + fp),
        "fnr": ratio(fn, fn + tp),
    }
    return df.select("*", *(F.round(c, digits).alias(k) for k, c in out.items()))


def by_score(df: DataFrame, *keys: str) -> DataFrame:
    """Positives and negatives of each score."""
    return df.groupBy(*keys, "score").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve of (score in 0 to 1, label), by ranks with ties shared; null without both classes."""
    run = running_totals(by_score(df), "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("run_neg") - F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return run.agg(F.round(F.when(pairs > 0, wins / F.nullif(pairs, F.lit(0.0))), 6).alias("roc_auc"))


def sweep(df: DataFrame) -> DataFrame:
    """(score, seq, label) from high scores to low, later records first inside a tie, with counts so far."""
    one = df.select("score", "seq", "label", F.lit(1).alias("n"))
    return running_totals(one, "score", ["label", "n"], descending=True, tie=[F.col("seq").desc()]).withColumnsRenamed({"run_label": "tp", "run_n": "seen"})


def average_precision(df: DataFrame) -> DataFrame:
    """The mean of precision at each positive."""
    return sweep(df).filter("label = 1").agg(F.round(F.avg(F.col("tp") / F.col("seen")), 6).alias("pr_auc"))


def best_f1(df: DataFrame) -> DataFrame:
    total = df.agg(F.sum("label").alias("pos"))
    f1 = 2 * F.col("tp") / (F.col("seen") + F.col("pos"))
    return sweep(df).join(F.broadcast(total)).agg(F.round(F.max(f1), 6).alias("best_f1"))


def fpr_at_recall(df: DataFrame, recall: float = 0.8) -> DataFrame:
    """The false-positive rate at the first threshold that reaches the recall."""
    total = df.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    reached = sweep(df).join(F.broadcast(total)).filter(F.col("tp") >= recall * F.col("pos"))
    return reached.agg(F.round(F.min_by((F.col("seen") - F.col("tp")) / F.col("neg"), "seen"), 6).alias("fpr"))


def roc_points(df: DataFrame) -> DataFrame:
    """One point a score: threshold, tpr, fpr, precision."""
    groups = by_score(df)
    total = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    run = running_totals(groups, "score", ["pos", "neg"], descending=True).join(F.broadcast(total))
    return run.select(F.col("score").alias("threshold"), F.round(F.col("run_pos") / F.col("p"), 6).alias("tpr"), F.round(F.col("run_neg") / F.col("q"), 6).alias("fpr"), F.round(F.col("run_pos") / (F.col("run_pos") + F.col("run_neg")), 6).alias("precision"))


def family_metrics(df: DataFrame, flagged: Column) -> DataFrame:
    """Each family against all benign rows: counts, rates, mean score and AUC; benign rows have a line of their own with null rates.

    AUC of all families in one pass: scores are totalled by family and score, and
    benign counts below each score come from one running total.
    """
    # one aggregate of the rows; what follows reads its few totals
    cells = df.groupBy("family", "label", "score").agg(F.count("*").alias("n"), F.count_if(flagged).alias("hits"))
    mean = (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score")
    benign = cells.filter("label = 0").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("n") - F.col("hits")), F.lit(0)).alias("tn"), mean)
    attacks = cells.filter("label = 1").groupBy("family").agg(F.sum("hits").alias("tp"), F.sum(F.col("n") - F.col("hits")).alias("fn"), mean)
    scores = cells.groupBy("score").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("neg"))
    below = running_totals(scores, "score", ["neg"], bounds=(0.0, 1.0)).select("score", (F.col("run_neg") - F.col("neg") / 2).alias("below"))
    wins = cells.filter("label = 1").join(below, "score").groupBy("family").agg(F.sum(F.col("below") * F.col("n")).alias("wins"))
    joined = attacks.join(F.broadcast(benign.select("fp", "tn"))).join(wins, "family")
    out = rates(joined).withColumn("auc", F.round(ratio(F.col("wins"), (F.col("tp") + F.col("fn")) * (F.col("fp") + F.col("tn"))), 6))
    columns = ["family", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "mcc", "auc"]
    line = benign.select(F.lit("(benign)").alias("family"), F.lit(0).cast("long").alias("tp"), "fp", "tn", F.lit(0).cast("long").alias("fn"), F.round(ratio(F.col("tn").cast("double"), F.col("tn") + F.col("fp")), 6).alias("accuracy"), *(F.lit(None).cast("double").alias(c) for c in ("precision", "recall", "f1", "mcc", "auc")), F.round("mean_score", 6).alias("mean_score"))
    return out.select(*columns, F.round("mean_score", 6).alias("mean_score")).unionByName(line)
