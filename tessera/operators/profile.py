"""Column profiles in one pass over a table: a long form of (column, value) or one row of aggregates that is then stacked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import pseudo_missing


def long_form(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, value) with each value cast to one type."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def stacked(df: DataFrame, columns: list[str], measures: dict[str, object]) -> DataFrame:
    """A row a column from one aggregation: measures maps a name to a function of the column."""
    row = df.agg(*(f(F.col(c)).alias(f"{c}__{m}") for c in columns for m, f in measures.items()))
    each = [F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}__{m}`").alias(m) for m in measures)) for c in columns]
    return row.select(F.explode(F.array(*each)).alias("p")).select("p.*")


def missing(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count, minimum, maximum, mean and sample deviation (0 for one value) of each column."""
    v = lambda c: c.cast("double")
    return stacked(df, columns, {
        "n": lambda c: F.count(F.lit(1)).cast("long"),
        "n_missing": lambda c: F.sum(c.isNull().cast("long")),
        "low": lambda c: F.min(v(c)),
        "high": lambda c: F.max(v(c)),
        "mean": lambda c: F.round(F.avg(v(c)), 4),
        "sd": lambda c: F.round(F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(v(c))), 4),
        "n_unique": lambda c: (F.count_distinct(c) + F.max(c.isNull().cast("int"))).cast("long"),
    })


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing and pseudo-missing counts, distinct values and lengths of each text column."""
    return stacked(df, columns, {
        "n": lambda c: F.count(F.lit(1)).cast("long"),
        "n_missing": lambda c: F.sum(missing(c).cast("long")),
        "n_pseudo": lambda c: F.sum(pseudo_missing(c).cast("long")),
        "n_unique": lambda c: F.count_distinct(c).cast("long"),
        "shortest": lambda c: F.min(F.char_length(c)).cast("long"),
        "longest": lambda c: F.max(F.char_length(c)).cast("long"),
        "mean_length": lambda c: F.round(F.avg(F.char_length(c)), 4),
    })


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Quantiles as the value at place round(q (n - 1)), halves to even, of each group. Rows are first counted by value, so what a task ranks
    grows with a group's distinct values and not with its rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*by, value, upto.alias("_r"), (upto - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    place = lambda q: F.bround(F.lit(q) * (F.col("_n") - 1))
    picks = [F.max(F.when((F.col("_before") <= place(q)) & (place(q) < F.col("_r")), F.col(value))).alias(f"q{round(q * 100)}") for q in quantiles]
    return ranked.groupBy(*by).agg(F.max("_n").cast("long").alias("n"), *picks)


def iqr_outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Values strictly outside the quartiles by more than 1.5 times their distance, counted by group."""
    q = nearest_rank(df, by, value, [0.25, 0.75]).withColumn("iqr", F.col("q75") - F.col("q25"))
    rows = df.select(*by, value).join(q, by)
    out = (F.col(value) < F.col("q25") - 1.5 * F.col("iqr")) | (F.col(value) > F.col("q75") + 1.5 * F.col("iqr"))
    return rows.groupBy(*by, "q25", "q75").agg(F.count_if(out).cast("long").alias("n_outliers"))


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values of each column, nulls aside, ties by value."""
    counts = long_form(df, columns, "string").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, and rows whose key others share; nulls are equal."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").cast("long").alias("n_rows"), F.count(F.lit(1)).cast("long").alias("n_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("n_duplicated"))


def coverage(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Distinct ids of each table, and their share of all tables' ids."""
    ids = reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("table"), F.col(key).alias("id")) for n, t in tables.items()]).where("id is not null").distinct()
    total = ids.agg(F.count_distinct("id").alias("total"))
    per = ids.groupBy("table").agg(F.count(F.lit(1)).cast("long").alias("n_ids"))
    return per.join(F.broadcast(total)).select("table", "n_ids", F.round(F.col("n_ids") / F.col("total"), 6).alias("share"))


def join_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many of the left's distinct keys the right has."""
    mine = left.select(*keys).distinct()
    have = mine.join(right.select(*keys).distinct().withColumn("_in", F.lit(1)), keys, "left")
    return have.agg(F.count(F.lit(1)).cast("long").alias("n_keys"), F.count("_in").cast("long").alias("n_found"))


def variable_stats(df: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """Missing ratio, distinct values, constancy and, of continuous columns, sample variance (0 for at most one value)."""
    n = F.count(F.lit(1))
    common = {"missing_ratio": lambda c: F.round(F.sum(missing(c).cast("long")) / n, 4), "n_unique": lambda c: F.count_distinct(c).cast("long"), "constant": lambda c: F.count_distinct(c) <= 1}
    var = lambda c: F.round(F.when(F.count(c) <= 1, 0.0).otherwise(F.var_samp(c.cast("double"))), 6)
    a = stacked(df, continuous, {"variance": var, **common}).withColumn("kind", F.lit("continuous"))
    b = stacked(df, categorical, {"variance": lambda c: F.max(F.lit(None).cast("double")), **common}).withColumn("kind", F.lit("categorical"))
    return a.unionByName(b)


def problem_variables(stats: DataFrame) -> DataFrame:
    """Variables that are mostly missing, constant, or continuous with next to no variance."""
    still = (F.col("kind") == "continuous") & (F.col("variance") < 1e-10)
    return stats.where((F.col("missing_ratio") > 0.5) | F.col("constant") | F.coalesce(still, F.lit(False)))


def parse_rate(df: DataFrame, column: str, order: str, first: int = 100) -> DataFrame:
    """The share of the first values in order, nulls aside, that parse as JSON."""
    head = df.where(F.col(column).isNotNull()).orderBy(order).limit(first)
    return head.agg(F.count(F.lit(1)).cast("long").alias("n"), F.round(F.avg(F.try_parse_json(column).isNotNull().cast("double")), 6).alias("rate"))


def leakage_buckets(columns: list[str], times: DataFrame) -> DataFrame:
    """Columns with the time at which they become known, T0, T1, T2 or unknown, by a table (variable, time)."""
    names = times.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    return names.join(times, "variable", "left").select("variable", F.when(F.col("time").isin("T0", "T1", "T2"), F.col("time")).otherwise("unknown").alias("bucket"))
