"""Results groups: participants, demographics, alignment to arms, endpoint rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as X

# Words of demographic categories, tried in this order. "Caucasian" holds "asian", so white words come first.
RACES = {"white": ["white", "caucasian"], "black": ["black", "african"], "asian": ["asian"], "native": ["native", "indigenous", "alaska"], "pacific": ["pacific", "hawaiian"], "mixed": ["more than one", "multi", "mixed"]}
SEXES = {"female": ["female", "women"], "male": ["male", "men"]}
TOTALS = ["total", "overall", "all participants", "total participants"]
MILESTONES = ["STARTED", "TREATED", "COMPLETED"]


def category(c: Column, words: dict[str, list[str]], other: str = "other") -> Column:
    """The first category that has a word in the title."""
    low, out = F.lower(X.blank_if_null(c)), F.lit(other)
    for name in reversed(words):
        out = F.when(X.has_any(low, words[name]), name).otherwise(out)
    return out


def without_totals(groups: DataFrame, key: list[str], title: str) -> DataFrame:
    """Groups without those that are totals, where there are others."""
    total = F.lower(X.squeeze(F.col(title))).isin(TOTALS)
    n = F.count_if(~total).over(Window.partitionBy(*key))
    return groups.withColumns({"_t": total, "_n": n}).where(~F.col("_t") | (F.col("_n") == 0)).drop("_t", "_n")


def demographics(counts: DataFrame, key: list[str], title: str, value: str, words: dict[str, list[str]]) -> DataFrame:
    """A row a group: the count of each category (null if none was reported), shares as text, and how mixed the group is."""
    kinds = [*words, "other"]
    rows = counts.withColumns({"_k": category(F.col(title), words), "_v": N.first_int(F.col(value).cast("string"))})
    wide = rows.groupBy(*key).agg(*(F.sum(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in kinds))
    total = sum(F.coalesce(k, F.lit(0)) for k in kinds)
    return wide.withColumns({"total": total, "heterogeneity": F.round(N.heterogeneity(F.array(*kinds)), 6)} | {f"{k}_share": N.ratio_text(F.col(k), total) for k in kinds})


def started(flow: DataFrame, key: list[str], milestone: str, value: str) -> DataFrame:
    """The participants of each group by the first milestone, in the order of MILESTONES, that has a number."""
    rank = F.array_position(F.array(*map(F.lit, MILESTONES)), F.upper(F.trim(milestone)))
    rows = flow.withColumns({"_r": F.when(rank > 0, rank), "_v": N.first_int(F.col(value).cast("string"))}).where("_r is not null and _v is not null")
    return rows.groupBy(*key).agg(F.min_by("_v", F.struct("_r", "_v")).alias("started"))


def align(groups: DataFrame, arms: DataFrame, key: str) -> DataFrame:
    """(key, group_id, arm_id, match): each results group with a study's arm: by equal title, by id, by the only number in both titles, by
    description; a group that none fits is an arm of its own, numbered after the study's.

    groups is (key, group_id, title, description), arms is (key, arm_id, title, description)."""
    number = lambda c: F.when(F.size(F.regexp_extract_all(c, F.lit(r"\d+"), 0)) == 1, F.regexp_extract(c, r"\d+", 0))
    g = groups.select(key, F.col("group_id").cast("string").alias("group_id"), X.label_key(F.col("title")).alias("gt"), X.label_key(F.col("description")).alias("gd"), number(X.blank_if_null(F.col("title"))).alias("gn"))
    a = arms.select(key, F.col("arm_id").cast("string").alias("arm_id"), X.label_key(F.col("title")).alias("at"), X.label_key(F.col("description")).alias("ad"), number(X.blank_if_null(F.col("title"))).alias("an"))
    same_number = (F.col("gn") == F.col("an")) & (F.count("an").over(Window.partitionBy(key, "group_id", "an")) == 1)
    pairs = g.join(a, key, "left")
    rule = (
        F.when((F.col("gt") == F.col("at")) & (F.col("gt") != ""), 1)
        .when(F.col("group_id") == F.col("arm_id"), 2)
        .when(same_number, 3)
        .when((F.col("gd") == F.col("ad")) & (F.col("gd") != ""), 4)
        .otherwise(5)
    )
    best = pairs.withColumn("rule", rule).groupBy(key, "group_id").agg(F.min(F.struct("rule", F.when(F.col("rule") < 5, F.col("arm_id")).alias("arm_id"))).alias("b")).select(key, "group_id", "b.*")
    new = F.concat(F.lit("new_"), F.row_number().over(Window.partitionBy(key, F.col("rule") == 5).orderBy("group_id")).cast("string"))
    names = F.element_at(F.array(*map(F.lit, ["title", "id", "number", "description", "new"])), F.col("rule"))
    return best.select(key, "group_id", F.coalesce("arm_id", F.when(F.col("rule") == 5, new)).alias("arm_id"), names.alias("match"))


def match_report(rows: DataFrame, match: str) -> DataFrame:
    return rows.groupBy(match).agg(F.count(F.lit(1)).alias("n"))


def first_outcomes(outcomes: DataFrame, key: str, kind: str, order: str, most: int = 3) -> DataFrame:
    """All primary outcomes, and the first `most` secondary ones in document order."""
    low = F.lower(F.trim(kind))
    place = F.row_number().over(Window.partitionBy(key, low).orderBy(order))
    return outcomes.withColumn("_p", place).where((low == "primary") | ((low == "secondary") & (F.col("_p") <= most))).drop("_p")


def scoped(measures: DataFrame, title: str, targets: list[str]) -> DataFrame:
    """Measures of groups whose title contains a target token, or is contained in one; tokens of fewer than three characters do not count."""
    keys = [t for t in ("".join(ch for ch in t.lower() if ch.isalnum()) for t in targets) if len(t) >= 3]
    own = X.label_key(F.col(title))
    hit = F.lit(not keys)
    for k in keys:
        hit = hit | F.contains(own, F.lit(k)) | ((F.length(own) >= 3) & F.contains(F.lit(k), own))
    return measures.where(hit)
