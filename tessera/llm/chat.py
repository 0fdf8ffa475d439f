"""Chat logs: snapshots of one conversation, each a prefix of the next, collapse to the longest before rendering.

Turns are ordered by turn, then role and text. A turn's element is the MD5 of its place, role and text, as four lanes of 32 bits, and a
rolling prefix hash is the running sum of elements modulo 2^32 a lane, so it needs no concatenation and can be summed in parts: a
conversation is cut into runs of CHUNK turn numbers, each summed by itself, and the runs' sums are added up. A conversation goes if a longer
one has its hash as a prefix (an anti-join against distinct proper prefixes), or an equal one has a smaller id.

Defined cases: a null role or text counts as such and differs from an empty one; it renders as an empty text; null turns come first;
rows that repeat in full are turns of their own; rows with a null conv_id are one conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import columns, materialize

CHUNK = 1_000
LANES = 4


def prefixed(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, place, role, text, p0..p3): the turns with their place (from 1) and the rolling prefix hash up to each."""
    turns = columns(turns, ["conv_id", "turn", "role", "text"], ["long", "long", "string", "string"])
    turns = turns.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "chunk": F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62)))})
    counts = turns.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select("conv", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "places")
    order = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = turns.withColumn("_i", F.row_number().over(order)).join(bases, ["conv", "chunk"]).withColumn("place", F.col("base") + F.col("_i"))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    said = F.md5(F.concat_ws("\x1f", F.col("place").cast("string"), F.length(known("role")).cast("string"), known("role"), known("text")).cast("binary"))
    placed = placed.withColumn("said", said)
    lane = lambda i: F.conv(F.substring("said", 1 + 8 * i, 8), 16, 10).cast("long")
    running = Window.partitionBy("conv", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({f"r{i}": F.sum(lane(i)).over(running) for i in range(LANES)})
    sums = placed.groupBy("conv", "chunk").agg(*(F.max(f"r{i}").alias(f"m{i}") for i in range(LANES)))
    bases = sums.select(F.col("conv"), "chunk", *(F.coalesce(F.sum(f"m{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(LANES)))
    out = placed.join(bases, ["conv", "chunk"])
    return out.select("conv", "conv_id", "place", "role", "text", *(((F.col(f"r{i}") + F.col(f"b{i}")) % (1 << 32)).alias(f"p{i}") for i in range(LANES)))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns, n_equal): conversations that no other one extends, of equal ones that with the smallest id, and how many are equal."""
    ends = prefixes.groupBy("conv").agg(F.max("place").alias("n_turns"))
    hashes = [f"p{i}" for i in range(LANES)]
    marked = prefixes.select("conv", "conv_id", "place", *hashes).join(ends, "conv")
    whole = marked.where("place = n_turns").groupBy("place", *hashes)
    whole = whole.agg(F.min_by("conv", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv"), F.count(F.lit(1)).alias("n_equal"))
    proper = marked.where("place < n_turns").select("place", *hashes).distinct()
    return whole.join(proper, ["place", *hashes], "left_anti").select("conv", F.col("place").alias("n_turns"), "n_equal")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """A row for each conversation kept: conv_id, n_turns, n_equal, text (rendered), sha256. A conversation's text meets in one row, as it
    is the result; all that decides what is kept is done on narrow rows."""
    prefixes = materialize(prefixed(turns), "prefixes")
    kept = materialize(maximal(prefixes), "kept")
    said = prefixes.join(kept, "conv", "left_semi").select("conv", "conv_id", F.struct("place", rendered(F.col("role"), F.col("text")).alias("t")).alias("t"))
    texts = said.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.concat_ws("", F.transform(F.sort_array(F.collect_list("t")), lambda t: t["t"])).alias("text"))
    out = texts.join(kept, "conv")
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_equal").cast("long").alias("n_equal"), "text", F.sha2("text", 256).alias("sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
e AS (SELECT *, md5(concat(place, '/', coalesce('=' || role, 'null'), '/', coalesce('=' || text, 'null'))) AS h FROM t),
p AS (SELECT *, md5(string_agg(h, '' ) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)) AS ph FROM e),
w AS (SELECT min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_equal, ph FROM p WHERE place = n GROUP BY ph),
k AS (SELECT * FROM w WHERE ph NOT IN (SELECT ph FROM p WHERE place < n)),
r AS (SELECT e.conv_id, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY place) AS text
      FROM e JOIN k USING (conv_id) GROUP BY e.conv_id)
SELECT k.conv_id, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.n_equal AS BIGINT) AS n_equal, r.text, sha256(r.text) AS sha256
FROM k JOIN r USING (conv_id)
"""
