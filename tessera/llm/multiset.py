"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions only.

A document is the multiset of its paragraphs (lines that are not blank). Each is hashed to a wide vector, and the fingerprint is the sum
of the vectors, lane by lane, modulo powers of two: order does not matter, and adding or taking away a paragraph is adding or taking away
its vector. The vector has two sections:
  8 lanes modulo 2^32 from the paragraph's SHA-256, for equality;
  64 lanes modulo 2^32, the sums of the bits of a 64-bit hash over the paragraph's pieces (clauses, cut every PIECE code points), and one
  lane that counts the pieces, for likeness: with s = 2 * lane - count, the cosine of two such vectors estimates that of the multisets.
A fingerprint is the lanes in hexadecimal, 8 digits each. Equal texts have equal fingerprints.

Defined cases: a null text is empty, its lanes all 0; two empty fingerprints are alike (1), an empty one and another are not (0); repeated
paragraphs count as often as they occur; null ids come first, rows with equal ids follow by the MD5 of their text, and rows that repeat in
full follow each other; the only row is its own next; an empty table gives no rows; a text of any length is hashed whole. Other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import columns, materialize, small

PIECE = 24
EXACT, LIKE = 8, 64
MOD = 1 << 32
#: Rows that a bucket of neighbours in doc_id order is to hold, and quantiles that bound the coarse buckets.
BUCKET_ROWS = 2_000
COARSE = 1_000


def pieces(text: Column) -> Column:
    """Hashes of the pieces."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^.,;:!?|\n]{1,%d}" % PIECE), 0)
    return F.transform(found, lambda p: F.xxhash64(p))


def piece_sums(hashes: Column) -> Column:
    """LIKE / 2 long sums, each with two lanes of 32 bits: bits j and j + 32 of the hashes."""
    low = F.lit(0x0000000100000001).cast("long")
    lane = lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(low))
    return F.array(*(lane(j) for j in range(LIKE // 2)))


def lanes(exact: Column, sums: Column, count: Column) -> Column:
    """All lanes: EXACT, then LIKE, then the count."""
    low = F.transform(sums, lambda s: s.bitwiseAND(F.lit(MOD - 1)))
    high = F.transform(sums, lambda s: F.shiftrightunsigned(s, 32))
    return F.concat(exact, low, high, F.array(count.cast("long") % MOD))


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the lanes of a text column, each step in a projection of its own so that nothing is computed twice."""
    df = df.withColumns({"_h": pieces(F.col(text)), "_e": F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda p: p != ""), lambda p: F.sha2(p, 256))})
    word = lambda i: F.aggregate("_e", F.lit(0).cast("long"), lambda a, h: a + F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")) % MOD
    df = df.withColumns({"_x": F.array(*(word(i) for i in range(EXACT))), "_s": piece_sums(F.col("_h"))})
    return df.withColumn(into, lanes(F.col("_x"), F.col("_s"), F.size("_h"))).drop("_h", "_e", "_x", "_s")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets together, or of the first without the second (sign -1): lanes added modulo 2^32."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(MOD)))


def written(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the likeness sections, 0 where it is negative; 1 for equal fingerprints."""
    signed = lambda v: F.transform(F.slice(v, EXACT + 1, LIKE), lambda x: (2 * x - F.element_at(v, -1)).cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    x, y = signed(a), signed(b)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p)) * total(F.transform(y, lambda p: p * p)))
    return F.when(a == b, 1.0).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(0.0)


def buckets(docs: DataFrame) -> Column:
    """A struct that ascends with doc_id, nulls first, and the MD5 of the text: the quantile a row is in, in large tables an even part of that,
    and for ids that have many rows (and for null) a part by the MD5.

    A bucket holds about BUCKET_ROWS rows where ids lie evenly within a quantile. Reads doc_id alone."""
    low = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", [i / COARSE for i in range(COARSE + 1)], 10 * COARSE).alias("q")).first()
    found = low.q or [0]
    often = {e: -(-k * low.known // (COARSE * BUCKET_ROWS)) for e, k in Counter(found).items() if k > 1 and k * low.known > COARSE * BUCKET_ROWS}
    cuts = sorted(set(found))
    cuts = sorted({*cuts[:: max(1, COARSE * BUCKET_ROWS // max(1, low.n))], *often})
    fine = max(1, -(-low.n // (len(cuts) * BUCKET_ROWS)))
    edges, parts = F.lit(cuts), F.lit([often.get(e, 1) for e in cuts])
    coarse = F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))) - 1, F.lit(-1))
    lo, hi = F.get(edges, F.greatest(coarse, F.lit(0))), F.get(edges, coarse + 1)
    place = F.floor((F.col("doc_id") - lo).cast("double") / F.greatest(F.lit(1), F.coalesce(hi, lo + 1) - lo) * fine)
    step = F.when(coarse < 0, 0).otherwise(F.least(F.lit(fine - 1).cast("long"), place))
    nulls = max(1, -(-(low.n - low.known) // BUCKET_ROWS))
    split = F.when(F.col("doc_id").isNull(), F.lit(nulls)).when(F.col("doc_id") == lo, F.get(parts, F.greatest(coarse, F.lit(0)))).otherwise(F.lit(1)).cast("long")
    part = F.shiftright(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long") * split, 32)
    above = F.coalesce((F.col("doc_id") > lo).cast("int"), F.lit(0))
    return F.struct(coarse.alias("coarse"), F.coalesce(step.cast("long"), F.lit(0).cast("long")).alias("fine"), above.alias("above"), part.alias("part"))


def compared(docs: DataFrame) -> DataFrame:
    """A row for each row of docs, with its fingerprint, that of its edited text, and their likeness: the contract's columns.

    The text is shuffled once, into buckets of neighbours; the next document of a bucket's last is the head of the next bucket that has
    one, found through a narrow table of heads."""
    docs = columns(docs, ["doc_id", "text"], ["long", "string"]).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("bucket", buckets(docs))
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("md5"))
    heads = materialize(docs.select("bucket", place.alias("place")).groupBy("bucket").agg(F.min("place").alias("place")), "heads")
    # The next head is found within a quantile; after a quantile's last bucket comes the head of the next one, of at most COARSE + 2.
    firsts = heads.groupBy("bucket.coarse").agg(F.min(F.struct("bucket", "place")).alias("f")).select("coarse", F.col("f.place").alias("place"))
    round_ = F.coalesce(F.lead("place").over(Window.orderBy("coarse")), F.first("place").over(Window.orderBy("coarse")))
    firsts = materialize(firsts.select("coarse", round_.alias("after")), "firsts")
    within = F.lead("place").over(Window.partitionBy("bucket.coarse").orderBy("bucket"))
    before = heads.select(F.col("bucket").alias("tail"), within.alias("place")).join(F.broadcast(firsts), F.col("tail.coarse") == F.col("coarse"))
    before = before.select("tail", F.coalesce("place", "after").alias("place"))
    tails = docs.select("text", place.alias("place")).join(small(materialize(before, "before")), "place").groupBy("tail").agg(F.max("text").alias("text"))
    tails = materialize(with_fingerprint(tails, "text", "lanes").select(F.col("tail").alias("bucket"), F.struct("text", "lanes").alias("head")), "tails")

    by = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), F.md5(F.col("text").cast("binary")))
    rows = with_fingerprint(docs.repartition("bucket"), "text", "lanes")
    rows = rows.withColumn("next", F.lead(F.struct("text", "lanes")).over(by)).join(small(tails), "bucket", "left")
    rows = rows.withColumns({"next": F.coalesce("next", "head"), "n_chars": F.length("text").cast("long")})
    rows = rows.withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cut)"), F.expr("substring(next.text, 1, cut)"))
    rows = rows.select("doc_id", "n_chars", "lanes", F.col("next.lanes").alias("next_lanes"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_lanes")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("lanes")).alias("fingerprint"), written(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
