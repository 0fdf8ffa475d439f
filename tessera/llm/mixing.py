"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sources in code point order, null last, weigh 3, 1, 2, repeating, and share `total` (150 %) of all words by weight; a source's target
stops at `most` (2) times its size, and the excess goes to the others by weight. The closed form of that: sort sources by cap / weight,
and with L_k = (total - caps before k) / (weights from k on) the level is max L_k, a target min(cap, level * weight).

The mix is counted in blocks of `block` words. Sainte-Laguë gives sources integer numbers of blocks, and within a source gives its
shards theirs: the highest quotients votes / (2 k + 1). Only quotients between the seats that votes (seats -+ parties / 2) / sum give, which
bound the result, are ranked: fewer than two a party. A shard holds documents in a seeded order on a line of words; its quota is whole
passes over the line and then a run of blocks from a seeded block on, around the end. A document's share is arithmetic on its prefix sum.

A source is cut into shards by a seeded hash of the document, so a hot source is many groups: of about `shard_words` words, or a SHARDS-th of
the source if that is more, so that ranking a source's shards stays small. A block has `block` words, or fewer where all targets together have
less than BLOCKS blocks of that.

Defined cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own; rows of equal id and text may
differ in what is taken, and reruns give the same rows; ties between quotients go to the source or shard that sorts first; without words all
targets are 0; an empty table gives no rows; a text of any length is counted whole and may be taken in part. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import SPACE, columns, free, materialize, row_key, same_columns, small

WEIGHTS = (3, 1, 2)
BLOCK = 64
SHARD_WORDS = 1 << 20
SHARDS, BLOCKS = 4_096, 4_096
SEED = 20_240_517


def size_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+", -1), "")).cast("long")


def mix_key(source: str = "source") -> Column:
    return F.concat_ws(":", row_key(), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole time that a document is taken, and one with its first words, joined by
    a space, for a part of it. Rows of equal id, text and source are taken as one document as often as all of them."""
    key, taken, size, words = free(docs, "key", "taken", "size", "words")
    shares = mix(docs, **settings).groupBy(F.col("key").alias(key)).agg(F.sum("taken").alias(taken), F.max("size").alias(size)).where(F.col(taken) > 0)
    rows = docs.withColumn(key, mix_key()).dropDuplicates([key]).join(materialize(shares, "shares"), key)
    whole, part = F.floor(F.col(taken) / F.col(size)).cast("int"), (F.col(taken) % F.col(size)).cast("int")
    counts = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn(words, F.explode(counts))
    first = F.concat_ws(" ", F.slice(F.array_remove(F.split("text", f"[{SPACE}]+", -1), ""), 1, F.col(words)))
    rows = rows.withColumn("text", F.when(F.col(words) == 0, F.col("text")).otherwise(first))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(words) == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return same_columns(rows, docs.columns)


def targets(sizes: DataFrame, total: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). The sources, a row each, meet in one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    after, every = by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("l", (F.sum("source_size").over(every) * F.lit(total) - before) / F.sum("weight").over(after))
    level = F.max("l").over(every)
    return rows.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def apportion(parties: DataFrame, votes: str, seats: str, into: str, by: list[str], ties: list[str]) -> DataFrame:
    """Adds `into`: Sainte-Laguë seats of each party within its group `by`, from its votes and the group's seats."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    v, n = F.col(votes).cast("double"), F.count(F.lit(1)).over(group)
    share = v / F.sum(v).over(group)
    sure = F.when(F.sum(v).over(group) > 0, F.floor(F.greatest(F.lit(0.0), F.col(seats) - n / 2) * share + 0.5)).otherwise(F.lit(0))
    top = F.when(F.sum(v).over(group) > 0, F.floor((F.col(seats) + n / 2) * share + 0.5) + 1).otherwise(F.lit(0))
    rows = parties.withColumns({"_sure": sure.cast("long"), "_top": top.cast("long")})
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    same = [*parties.columns, "_sure", "_left"]
    quotients = rows.select(*same, F.explode_outer(F.when(F.col("_top") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_top") - 1))).alias("_k"))
    quotients = quotients.withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(group.orderBy(F.col("_q").desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties), "_k"))
    won = quotients.withColumn("_won", ((rank <= F.col("_left")) & F.col("_q").isNotNull()).cast("long"))
    return won.groupBy(*parties.columns).agg((F.first("_sure") + F.sum("_won")).alias(into))


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """A row for each row of docs: key (shared.row_key and source), doc_id, source, size, source_size, target, taken."""
    docs = columns(docs, ["doc_id", "text", "source"], ["long", "string", "string"])
    rows = docs.select(mix_key().alias("key"), "doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    rows = materialize(rows, "sizes")
    shared = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    shared = shared.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(total / BLOCKS))).cast("long"))
    quotas = apportion(shared.withColumn("blocks", F.round(total / F.col("block")).cast("long")), "target", "blocks", "quota", [], ["source"])
    per_shard = F.greatest(F.lit(shard_words), F.col("source_size") / SHARDS)
    quotas = quotas.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)).cast("long")).drop("blocks")
    quotas = materialize(quotas, "quotas")

    q = small(quotas.withColumnRenamed("source", "_source"))
    dealt = rows.join(q, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod("h", "shards"))
    lines = dealt.groupBy("source", "shard", "quota", "shards").agg(F.sum("size").alias("line"))
    lines = materialize(apportion(lines, "line", "quota", "own", ["source"], ["shard"]), "lines")
    own = small(lines.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "line", "own"))
    dealt = dealt.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))

    line = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size")
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    dealt = dealt.withColumn("a", end - F.col("size"))
    words = F.least(F.col("own") * F.col("block"), 2 * F.col("line"))
    passes = F.when(F.col("line") > 0, F.floor(words / F.col("line"))).otherwise(0).cast("long")
    dealt = dealt.withColumns({"passes": passes, "rest": words - passes * F.col("line")})
    cells = F.greatest(F.lit(1), F.ceil(F.col("line") / F.col("block"))).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), cells) * F.col("block")
    dealt = dealt.withColumn("o", start)
    overlap = lambda lo, hi: F.greatest(F.lit(0).cast("long"), F.least(F.col("a") + F.col("size"), hi) - F.greatest(F.col("a"), lo))
    stop = F.col("o") + F.col("rest")
    part = overlap(F.col("o"), F.least(stop, F.col("line"))) + overlap(F.lit(0).cast("long"), stop - F.col("line"))
    taken = F.col("passes") * F.col("size") + part
    return dealt.select("key", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
