"""Training on Spark ML: a model zoo, cross-validated predictions, importances, seeded search, what-if changes."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation, features

#: Names of estimators; those that Spark lacks (kernel machines, other boosting libraries) map to the nearest it has.
ZOO = {
    "logistic": lambda **k: LogisticRegression(maxIter=k.pop("maxIter", 100), **k),
    "lasso": lambda **k: LogisticRegression(elasticNetParam=1.0, regParam=k.pop("regParam", 0.01), **k),
    "rf": lambda **k: RandomForestClassifier(numTrees=k.pop("numTrees", 300), seed=42, featureSubsetStrategy="auto", **k),
    "gbdt": lambda **k: GBTClassifier(maxIter=k.pop("maxIter", 100), seed=42, **k),
    "svm": lambda **k: LinearSVC(**k),
}
#: Ranges for the search, sampled by a seeded hash.
SPACE = {"logistic": {"regParam": (1e-4, 1.0)}, "lasso": {"regParam": (1e-4, 1.0)}, "rf": {"numTrees": (20, 200), "maxDepth": (3, 12)}, "gbdt": {"maxIter": (10, 60), "maxDepth": (2, 6)}, "svm": {"regParam": (1e-4, 1.0)}}


def assembled(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df.withColumn("label", F.col(label).cast("double")))


def probability(model: Model, df: DataFrame) -> DataFrame:
    """df with p, the probability of class 1 (for a margin, its logistic)."""
    out = model.transform(df)
    p = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in out.columns else 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1))))
    return out.withColumn("p", p).drop("rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, columns: list[str], label: str, ident: str, name: str = "logistic", k: int = 5, **settings) -> DataFrame:
    """(id, y, p, fold): each row predicted by a model that has not seen its fold."""
    rows = assembled(features.folds(df, label, ident, k), columns, label).select(ident, "label", "features", "fold").persist()
    out = []
    for fold in sorted(r[0] for r in rows.select("fold").distinct().collect()):
        model = ZOO[name](**dict(settings)).fit(rows.where(F.col("fold") != fold))
        out.append(probability(model, rows.where(F.col("fold") == fold)).select(F.col(ident).alias("id"), F.col("label").cast("int").alias("y"), "p", "fold"))
    return reduce(DataFrame.unionByName, out)


def compare(df: DataFrame, columns: list[str], label: str, ident: str, names: list[str], k: int = 5) -> DataFrame:
    """(model, roc_auc) of each model's out-of-fold predictions, best first."""
    scores = [evaluation.roc_auc(out_of_fold(df, columns, label, ident, n, k), "y", "p").select(F.lit(n).alias("model"), "roc_auc") for n in names]
    return reduce(DataFrame.unionByName, scores).orderBy(F.desc("roc_auc"), "model")


def search(df: DataFrame, columns: list[str], label: str, ident: str, name: str, trials: int = 50, k: int = 3, seed: int = 42) -> DataFrame:
    """(trial, settings, roc_auc): settings drawn by a seeded generator from SPACE, best first."""
    import random

    r, rows = random.Random(seed), []
    for i in range(trials):
        drawn = {p: r.randint(lo, hi) if isinstance(lo, int) else lo * (hi / lo) ** r.random() for p, (lo, hi) in SPACE[name].items()}
        auc = evaluation.roc_auc(out_of_fold(df, columns, label, ident, name, k, **drawn), "y", "p").first()[0]
        rows.append((i, str(drawn), auc))
    return df.sparkSession.createDataFrame(rows, "trial int, settings string, roc_auc double").orderBy(F.desc_nulls_last("roc_auc"), "trial")


def importances(model: Model, columns: list[str], df: DataFrame) -> DataFrame:
    """(column, importance): tree importances, or absolute coefficients."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return df.sparkSession.createDataFrame([(c, abs(float(v))) for c, v in zip(columns, values.toArray(), strict=True)], "column string, importance double")


def linear_attribution(model: Model, columns: list[str], df: DataFrame) -> DataFrame:
    """(column, mean_abs): the mean absolute share of each feature in a linear model's margin, against the feature's mean."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    w = model.coefficients.toArray()
    row = df.agg(*(F.avg(F.abs(F.lit(float(w[i])) * (F.col(c) - F.lit(means[c])))).alias(c) for i, c in enumerate(columns)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("mean_abs")) for c in columns))).alias("p")).select("p.*")


def what_if(model: Model, df: DataFrame, columns: list[str], ident: str, cases: DataFrame, k: int = 3, least_gain: float = 1e-6) -> DataFrame:
    """(id, column, was, value, gain, rank): for each case the k single changes that raise p most, one a feature.

    A feature is tried at 0 and 1 if it has no other values, else at its 10 %, 50 % and 90 % quantiles."""
    row = df.agg(*(F.percentile(c, [0.1, 0.5, 0.9]).alias(c) for c in columns), *((F.count_if(~F.col(c).isin(0, 1)) == 0).alias(f"b_{c}") for c in columns)).first()
    tries = [(c, float(v)) for c in columns for v in ([0.0, 1.0] if row[f"b_{c}"] else dict.fromkeys(row[c] or []))]
    options = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(v).alias("value")) for c, v in tries))).alias("t")
    base = probability(model, assembled(cases, columns, columns[0])).select(ident, *columns, F.col("p").alias("p0"))
    changed = base.select("*", options)
    was = reduce(lambda a, c: F.when(F.col("t.column") == c, F.col(c).cast("double")).otherwise(a), columns, F.lit(None).cast("double"))
    changed = changed.withColumn("was", was).withColumns({c: F.when(F.col("t.column") == c, F.col("t.value")).otherwise(F.col(c).cast("double")) for c in columns})
    scored = probability(model, assembled(changed, columns, columns[0])).select(F.col(ident).alias("id"), "t.column", "was", "t.value", (F.col("p") - F.col("p0")).alias("gain")).where(F.col("gain") > least_gain)
    best = scored.groupBy("id", "column").agg(F.max_by(F.struct("was", "value", "gain"), F.struct("gain", -F.col("value"))).alias("b")).select("id", "column", "b.*")
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("gain"), "column"))).where(F.col("rank") <= k)
