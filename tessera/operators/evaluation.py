"""Scores of binary predictions: (y in 0, 1; p between 0 and 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, y: str, p: str, at: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Counts and what follows from them at a threshold."""
    hit = F.col(p) >= at
    c = {"tp": (F.col(y) == 1) & hit, "fp": (F.col(y) == 0) & hit, "fn": (F.col(y) == 1) & ~hit, "tn": (F.col(y) == 0) & ~hit}
    return derived(df.groupBy(*(by or [])).agg(*(F.count_if(v).cast("long").alias(k) for k, v in c.items())))


def derived(rows: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = part(tp, tp + fp), part(tp, tp + fn), part(tn, tn + fp)
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return rows.withColumns({
        "precision": F.round(precision, 6), "recall": F.round(recall, 6), "specificity": F.round(specificity, 6), "f1": F.round(part(2 * tp, 2 * tp + fp + fn), 6),
        "npv": F.round(part(tn, tn + fn), 6), "accuracy": F.round(part(tp + tn, tp + fp + fn + tn), 6), "balanced_accuracy": F.round((recall + specificity) / 2, 6), "mcc": F.round(part(tp * tn - fp * fn, under), 6),
    })


def by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    """Positives and negatives at each distinct score: what the curves need, however many rows there are."""
    return df.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).cast("double").alias("pos"), F.count_if(F.col(y) == 0).cast("double").alias("neg"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """The chance that a positive scores above a negative, ties half."""
    below = F.coalesce(F.sum("neg").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = by_score(df, y, p).withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return rows.agg(F.round(F.sum("won") / (F.sum("pos") * F.sum("neg")), 6).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision at each distinct score, weighted by the recall gained there."""
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    rows = by_score(df, y, p).select("pos", (F.sum("pos").over(down) / F.sum(F.col("pos") + F.col("neg")).over(down)).alias("precision"))
    return rows.agg(F.round(F.sum(F.col("pos") * F.col("precision")) / F.sum("pos"), 6).alias("average_precision"))


def threshold_sweep(df: DataFrame, y: str, p: str, n: int = 50) -> DataFrame:
    """Precision, recall and F1 at n thresholds from 0.01 to 0.99. Rows are first counted by the last threshold they reach, so the sweep
    costs one pass and not one a threshold."""
    step = 0.98 / (n - 1)
    reached = F.least(F.lit(n - 1), F.floor((F.col(p) - 0.01) / step + 1e-9)).cast("int")
    counts = df.select(F.col(y).alias("y"), F.when(F.col(p) < 0.01, -1).otherwise(reached).alias("last")).groupBy("last").agg(F.count_if(F.col("y") == 1).cast("long").alias("pos"), F.count_if(F.col("y") == 0).cast("long").alias("neg"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    hit = lambda c: F.coalesce(F.sum(F.when(F.col("last") >= F.col("i"), F.col(c))), F.lit(0))
    rows = grid.join(F.broadcast(counts)).groupBy("i").agg(hit("pos").cast("long").alias("tp"), hit("neg").cast("long").alias("fp"), F.sum("pos").cast("long").alias("all_pos"))
    rows = rows.select(F.col("i").cast("long").alias("step"), F.round(0.01 + F.col("i") * step, 6).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return rows.withColumns({"precision": F.round(part(tp, tp + fp), 6), "recall": F.round(part(tp, tp + fn), 6), "f1": F.round(part(2 * tp, 2 * tp + fp + fn), 6)})


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the best F1."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def bootstrap(df: DataFrame, y: str, p: str, ident: str, metric: str = "accuracy", times: int = 1000, seed: int = 42, at: float = 0.5) -> DataFrame:
    """The mean and the 2.5 % and 97.5 % percentiles of a confusion metric over resamples.

    A row's number of draws in a resample is Poisson(1), from a seeded hash of resample and id, so resamples are sums over one pass; those
    with a single class are left out."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col(ident)), F.lit(1 << 40)) / float(1 << 40)
    cuts, total, term = [], 0.0, 0.36787944117144233
    for i in range(10):
        total += term
        term /= i + 1
        cuts.append(total)
    draws = sum((u >= c).cast("int") for c in cuts)
    rows = df.select(F.col(y).alias("y"), F.col(p).alias("p"), ident).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("w", draws).where("w > 0")
    hit = F.col("p") >= at
    c = {"tp": (F.col("y") == 1) & hit, "fp": (F.col("y") == 0) & hit, "fn": (F.col("y") == 1) & ~hit, "tn": (F.col("y") == 0) & ~hit}
    counts = rows.groupBy("b").agg(*(F.coalesce(F.sum(F.when(v, F.col("w"))), F.lit(0)).alias(k) for k, v in c.items()))
    scored = derived(counts.where("tp + fn > 0 and fp + tn > 0")).select(F.col(metric).alias("m"))
    return scored.agg(F.lit(metric).alias("metric"), F.count(F.lit(1)).alias("resamples"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
