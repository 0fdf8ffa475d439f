"""Merges, reductions, unions and selections that put study tables together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    known = {c.lower(): c for c in df.columns}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)


def resolve(df: DataFrame, logical: dict[str, list[str]]) -> DataFrame:
    """The logical columns under their names; those without a candidate are left out."""
    found = {name: pick(df, [name, *candidates]) for name, candidates in logical.items()}
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in found.items() if c))


def suffixed(df: DataFrame, keys: list[str], taken: set[str], suffix: str) -> DataFrame:
    """df with a suffix on the columns that are already taken, keys aside."""
    return df.select(*(F.col(f"`{c}`").alias(c + suffix if c in taken and c not in keys else c) for c in df.columns))


def merge_left(base: DataFrame, others: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of tables with a row a key; a column name that is taken gets `_` and the table's name."""
    for name, other in others.items():
        base = base.join(suffixed(other, keys, set(base.columns), f"_{name}"), keys, "left")
    return base


def reduce_to_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row a key: means of numeric columns, else the first value in order that is not null."""
    rest = [f for f in df.schema.fields if f.name not in keys]
    if not rest:
        return df.select(*keys).distinct()
    at = F.struct(*order)
    agg = []
    for f in rest:
        if isinstance(f.dataType, T.NumericType):
            agg.append(F.avg(f.name).alias(f.name))
        else:
            agg.append(F.min_by(f.name, F.when(F.col(f.name).isNotNull(), at)).alias(f.name))
    return df.groupBy(*keys).agg(*agg)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def priority_union(tables: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Tables in order of priority, stacked; of each key the row of the first table that has it."""
    stacked = reduce(DataFrame.unionByName, [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)])
    return keep_first(stacked, keys, [F.col("_table"), *map(F.col, order)]).drop("_table")


def diagonal_union(tables: list[DataFrame]) -> DataFrame:
    """Stacked by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def complete_ids(tables: list[DataFrame], key: str) -> DataFrame:
    """Ids that every table has."""
    return reduce(DataFrame.intersect, [t.select(key) for t in tables])


def supplement(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of another table by all keys that both have; nulls if they share none."""
    common = [k for k in keys if k in df.columns and k in other.columns]
    new = [c for c in columns if c not in df.columns]
    if not common:
        return df.withColumns({c: F.lit(None).cast("string") for c in new})
    return df.join(other.select(*common, *new).dropDuplicates(common), common, "left")


def collected(df: DataFrame, key: str, fields: list[str], into: str, most: int = 20) -> DataFrame:
    """A row a key with the sorted distinct structs of the fields, at most `most`; rows whose fields are all null give none."""
    some = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])
    return df.where(some).groupBy(key).agg(F.slice(F.sort_array(F.collect_set(F.struct(*fields))), 1, most).alias(into))


def nested_records(base: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str, most: int = 20) -> DataFrame:
    """The base with a list of structs for each child table; a key without children has an empty list."""
    for name, (df, fields) in children.items():
        lists = collected(df, key, fields, name, most)
        kind = lists.schema[name].dataType
        base = base.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return base


def marked(df: DataFrame, column: str, ids: DataFrame, into: str) -> DataFrame:
    """Whether the column's value is among the ids."""
    known = ids.select(F.col(ids.columns[0]).alias("_id")).distinct().withColumn(into, F.lit(True))
    return df.join(known, df[column] == known["_id"], "left").drop("_id").withColumn(into, F.coalesce(into, F.lit(False)))


def match_or_first(df: DataFrame, key: str, match: Column, order: list[Column]) -> DataFrame:
    """Of each key the rows that match or, where none does, the first; one sort a key, no join back."""
    by = Window.partitionBy(key)
    rows = df.withColumns({"_match": F.coalesce(match, F.lit(False)), "_row": F.row_number().over(by.orderBy(*order))})
    rows = rows.withColumn("_any", F.max("_match").over(by))
    return rows.where(F.col("_match") | (~F.col("_any") & (F.col("_row") == 1))).drop("_match", "_row", "_any")


def filter_ids(df: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """Rows whose key is among the ids; no ids, no filter."""
    if ids is None or ids.isEmpty():
        return df
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def outcome_label(c: Column, success: list[str], failure: list[str]) -> Column:
    return F.when(c.isin(success), 1).when(c.isin(failure), -1)


def phase_matches(c: Column, wanted: list[str]) -> Column:
    """Whether a phase text has one of the wanted numbers as a word, early phase 1 counting for 1; without numbers, equality."""
    low = F.lower(F.trim(c.cast("string")))
    numbers = sorted({n for w in wanted for n in "".join(ch if ch.isdigit() else " " for ch in w).split()})
    if not numbers:
        return low.isin([w.lower() for w in wanted])
    found = low.rlike(rf"\b(?:{'|'.join(numbers)})\b")
    return found | low.rlike(r"early\s*phase\s*(?:1|one)") if "1" in numbers else found


def several_valued(df: DataFrame, key: str) -> list[str]:
    """Columns with more than one value, null counting as one, within some key."""
    rest = [c for c in df.columns if c != key]
    per_key = df.groupBy(key).agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in rest))
    row = per_key.agg(*(F.max(c).alias(c) for c in rest)).first()
    return [c for c in rest if (row[c] or 0) > 1]


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways, distinct."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct()


def node(kind: Column, ident: Column) -> Column:
    return F.concat(F.coalesce(F.lower(kind), F.lit("unknown")), F.lit(":"), ident.cast("string"))


def within_hops(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """(query, node, hop): nodes reached from each start (query, node) in at most `hops` steps, with the least number."""
    seen = start.select("query", "node", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("query", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("query", "node"), ["query", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")
