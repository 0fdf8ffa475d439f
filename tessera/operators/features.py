"""From study tables to model features: typing, gates, encoding, imputing, scaling, scoring, splitting.

Statistics are aggregates that are joined back as one broadcast row, so a fit and its use are one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.profile import stacked

#: Columns that one_hot makes at most of a column's own values.
MOST_CATEGORIES = 1000
#: A class is ranked in 2 to that power ranges of a hash.
PART_BITS = 10


def feature_types(df: DataFrame, keys: list[str]) -> dict[str, str]:
    """Numeric and boolean columns are numeric, the rest categorical."""
    return {f.name: "numeric" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else "categorical" for f in df.schema.fields if f.name not in keys}


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def dense_columns(df: DataFrame, columns: list[str], most: float) -> list[str]:
    """Columns whose share of null or blank values is at most `most`."""
    row = df.agg(*(F.avg(blank(F.col(c)).cast("double")).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] <= most]


def wide_columns(df: DataFrame, columns: list[str], most: int = 20) -> list[str]:
    """Columns with more distinct values than a category should have."""
    row = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] > most]


def presence(c: Column) -> Column:
    """1 where a text is neither null nor blank."""
    return (~blank(c)).cast("int")


def label_codes(df: DataFrame, column: str, into: str) -> DataFrame:
    """Codes by sorted order of the categories; null becomes _missing_, or -999 in a number."""
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    value = F.coalesce(F.col(column), F.lit(-999) if numeric else F.lit("_missing_"))
    known = df.select(value.alias("_v")).distinct().withColumn(into, (F.row_number().over(Window.orderBy("_v")) - 1).cast("long"))
    return df.withColumn("_v", value).join(known, "_v").drop("_v")


def one_hot(df: DataFrame, column: str, categories: list | None = None) -> DataFrame:
    """A 0/1 column for each category; without a list the categories are the column's values; more than MOST_CATEGORIES are an error."""
    if categories is None:
        categories = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MOST_CATEGORIES + 1).collect()]
        if len(categories) > MOST_CATEGORIES:
            raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories: too many for a column each")
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in categories}).drop(column)


def impute_numeric(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Nulls by the exact median, the mean, or zero of the column; `none` leaves them."""
    if how == "none":
        return df
    if how == "zero":
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    f = F.median if how == "median" else F.avg
    fit = df.agg(*(f(F.col(c).cast("double")).alias(f"_{c}") for c in columns))
    return df.join(F.broadcast(fit)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls by the most frequent value, the least of those on a tie."""
    fit = df.agg(*(F.mode(F.col(c), True).alias(f"_{c}") for c in columns))
    return df.join(F.broadcast(fit)).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def standard_scale(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """Centred and divided by the population deviation, 1 where that is 0; nulls stay. fit_on chooses the rows that are fitted."""
    rows = df if fit_on is None else df.where(fit_on)
    fit = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return df.join(F.broadcast(fit)).withColumns(scaled).drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def anova_f(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, f): between-class over within-class variance of each column, from one aggregation by class."""
    v = lambda c: F.col(c).cast("double")
    parts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.sum(v(c)).alias(f"s_{c}") for c in columns), *(F.sum(v(c) * v(c)).alias(f"q_{c}") for c in columns))

    def measures(c: str) -> list[Column]:
        n, k = F.sum("n"), F.count(F.lit(1))
        total = F.sum(f"s_{c}")
        between = F.sum(F.pow(F.col(f"s_{c}"), 2) / F.col("n")) - F.pow(total, 2) / n
        within = F.sum(f"q_{c}") - F.sum(F.pow(F.col(f"s_{c}"), 2) / F.col("n"))
        return F.when(within > 0, (between / (k - 1)) / (within / (n - k))).alias(c)

    row = parts.agg(*(measures(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("f")) for c in columns))).alias("p")).select("p.*")


def chi2(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, chi2) of non-negative features: observed class sums against those that class shares lead one to expect."""
    sums = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(c) for c in columns))
    long = sums.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("o")) for c in columns))).alias("p")).select("n", "p.*")
    w = Window.partitionBy("column")
    long = long.withColumn("e", F.sum("o").over(w) * F.col("n") / F.sum("n").over(w))
    return long.groupBy("column").agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), 2) / F.col("e"))).alias("chi2"))


def mutual_information(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, mi) of discrete features, in nats."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("x")) for c in columns]
    cells = df.select(F.col(label).alias("y"), F.explode(F.array(*pairs)).alias("p")).select("y", "p.*").groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    n, nx, ny = (F.sum("n").over(Window.partitionBy("column", *by)) for by in ([], ["x"], ["y"]))
    cells = cells.withColumn("part", F.col("n") / n * F.log(F.col("n") * n / (nx * ny)))
    return cells.groupBy("column").agg(F.sum("part").alias("mi"))


def top_ratio(scores: DataFrame, score: str, ratio: float) -> DataFrame:
    """The best int(n ratio) columns, at least one, ties by name."""
    rank, n = F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "column")), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return scores.withColumns({"_r": rank, "_n": n}).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_r", "_n")


def cumulative_share(scores: DataFrame, score: str) -> DataFrame:
    """Rank and running share of the scores, best first."""
    by = Window.orderBy(F.desc(score), "column")
    total = F.sum(score).over(Window.partitionBy(F.lit(0)))
    return scores.withColumns({"rank": F.row_number().over(by).cast("long"), "cumulative": F.round(F.sum(score).over(by.rowsBetween(Window.unboundedPreceding, 0)) / total, 6)})


def time_split(df: DataFrame, day: Column, ident: str, test_share: float = 0.2) -> DataFrame:
    """`split` is test for the latest int(n share) rows, at least one; unknown days (0) come first."""
    n = df.count()
    tests = max(1, int(n * test_share))
    dated = df.withColumn("_day", F.coalesce(day, F.lit(0)))
    last = dated.select("_day", ident).orderBy(F.desc("_day"), F.desc(ident)).limit(tests).select(F.col(ident).alias("_id"), F.lit("test").alias("split"))
    return dated.join(last, dated[ident] == last["_id"], "left").drop("_id", "_day").withColumn("split", F.coalesce("split", F.lit("train")))


def stratified(df: DataFrame, label: str, ident: str, seed: int = 42) -> DataFrame:
    """Adds place (from 0) and n in a seeded order within the class. The order is that of a hash, and a class is ranked in PARTS ranges of it, so
    no task has a whole class."""
    rows = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(ident))).withColumn("_part", F.shiftright("_h", 64 - PART_BITS))
    counts = rows.groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(label).alias("_label"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_c").over(w).alias("n"))
    rows = rows.join(counts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_p")))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", ident)) - 1 + F.col("_before")
    return rows.withColumn("place", place).drop("_h", "_part", "_p", "_label", "_before")


def stratified_split(df: DataFrame, label: str, ident: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """`split`: in each class the first round(n share) rows of a seeded order are the test."""
    rows = stratified(df, label, ident, seed)
    return rows.withColumn("split", F.when(F.col("place") < F.round(F.col("n") * test_share), "test").otherwise("train")).drop("place", "n")


def folds(df: DataFrame, label: str, ident: str, k: int = 5, seed: int = 42) -> DataFrame:
    """`fold`: classes dealt evenly; at most as many folds as the smallest class has rows."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 1
    k = max(2, min(k, least))
    return stratified(df, label, ident, seed).withColumn("fold", (F.col("place") % k).cast("int")).drop("place", "n")


def several(columns: list[str], f) -> Column:
    return reduce(lambda a, b: a & b, map(f, columns))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return stacked(df, columns, {"mean": lambda c: F.avg(c), "sd": lambda c: F.stddev_pop(c)})
