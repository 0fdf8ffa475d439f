"""Filling gaps in records from answers that carry evidence: what is missing, in which batches, what may be written back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def missing_fields(df: DataFrame, key: str, fields: list[str], skip: set[str] = frozenset()) -> DataFrame:
    """(key, fields): names of blank fields in the order given; rows without any are left out."""
    names = F.filter(F.array(*(F.when(blank(F.col(f)), F.lit(f)) for f in fields if f not in skip)), lambda f: f.isNotNull())
    return df.select(key, names.alias("fields")).where(F.size("fields") > 0)


def field_batches(missing: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch, fields): fields cut into batches."""
    return missing.select(key, F.posexplode(A.batches(F.col("fields"), size)).alias("batch", "fields"))


def write_back(df: DataFrame, key: str, answers: DataFrame, sources: DataFrame, fields: list[str]) -> DataFrame:
    """df with blank fields filled from answers (key, field, value, evidence) whose evidence holds in the key's source text.

    Of several valid answers to one field the first by value counts."""
    checked = answers.join(sources.select(key, "source"), key).where(A.evidence_holds(F.col("evidence"), F.col("source")) & ~blank(F.col("value")))
    wide = checked.groupBy(key).agg(*(F.min(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields))
    out = df.join(wide, key, "left")
    return out.withColumns({f: F.when(blank(F.col(f)), F.coalesce(f"_{f}", f)).otherwise(F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))


def fill_from_first(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Blank fields from the first row of the same key, in order, that has a value; so repeated rows are answered once."""
    first = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f: F.when(blank(F.col(f)), F.first(F.when(~blank(F.col(f)), F.col(f)), ignorenulls=True).over(first)).otherwise(F.col(f)) for f in fields})


def backfill_status(base: DataFrame, fresh: DataFrame, key: str, field: str) -> DataFrame:
    """(key, status) of a field between a table and a fresh extract of it."""
    b = base.groupBy(key).agg(F.count_if(~blank(F.col(field))).alias("b_some"), F.count(F.lit(1)).alias("b_rows"))
    f = fresh.groupBy(key).agg(F.count_if(~blank(F.col(field))).alias("f_some"), F.count(F.lit(1)).alias("f_rows"))
    rows = b.join(f, key, "full")
    status = (
        F.when(F.col("b_rows").isNull(), "missing_base")
        .when(F.col("b_some") == F.col("b_rows"), "already_present")
        .when(F.col("f_rows").isNull(), "missing_fresh")
        .when(F.col("f_some") == 0, "needs_reextract")
        .when((F.col("f_some") > 0) & (F.col("b_some") + F.col("f_some") >= F.col("b_rows")), "updated")
        .otherwise("still_missing")
    )
    return rows.select(key, status.alias("status"))


def completeness(tables: dict[str, DataFrame], key: str, errors: DataFrame) -> DataFrame:
    """(key, status): complete_clean with all tables and no error rows, complete with all tables, else partial."""
    seen = reduce(DataFrame.unionByName, [t.select(key).distinct().withColumn("table", F.lit(n)) for n, t in tables.items()])
    per = seen.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(errors.groupBy(key).agg(F.count(F.lit(1)).alias("bad")), key, "left")
    whole = F.col("n") == len(tables)
    return per.select(key, F.when(whole & F.col("bad").isNull(), "complete_clean").when(whole, "complete").otherwise("partial").alias("status"))


def merge_records(df: DataFrame, key: str, ident: str, name: str, order: list[str]) -> DataFrame:
    """A row a key: sorted distinct ids and names, and the shortest name."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(ident)).alias("ids"), F.sort_array(F.collect_set(name)).alias("names"), F.min(F.struct(F.length(name).alias("n"), F.lower(name).alias("low"), F.col(name).alias("name"))).getField("name").alias("name"))
