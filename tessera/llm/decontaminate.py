"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

The index holds postings (term, document, ascending word positions). Benchmark items are cut into windows; of each window the
rarest terms in the corpus are its anchors, and of each item the two rarest are looked for near each other; only postings of such terms are
stored, so common words cost no disk. The lists of a window's anchors, each shifted by its anchor's offset, are intersected; a start that all
anchors agree on is a candidate. Candidates are then compared word by word with the document, so matches are exact. A proximity match is an
item whose two rarest terms stand at most SLOP words apart in a document.

Defined cases: a null or empty text has no words and no hits; an item with a null or empty text has no windows; repeated items count
one each; rows of equal id and text get equal results, one row each; a null doc_id stays a row; of terms equally rare the first by name is
taken; an item of one distinct word, or with a rarest word that the corpus lacks, has no proximity matches; an empty table gives no rows; a text
of any length is indexed whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import columns, lower_ascii, materialize, row_key, small

#: Runs of these end a word, before A-Z become a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
ANCHORS = 2
SLOP = 8


def words(text: Column) -> Column:
    """Words as they are written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD, -1), "")


def lowered(word: Column) -> Column:
    """A-Z to a-z. Of ASCII words that is what lower() does, and quickly; a whole text is rarely ASCII, most words are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(lower_ascii(word))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, len): the windows of each item as words joined by a space; a shorter item is one window."""
    items = columns(benchmark, ["item_id", "text"], ["string", "string"]).select("item_id", words(lower_ascii(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    cut = items.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("w"))
    return cut.select("item_id", F.concat_ws(" ", "w").alias("phrase"), F.size("w").alias("len")).distinct()


def build_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given terms: (term, key, positions), a row for each document that has the term."""
    tokens = docs.select(row_key().alias("key"), F.posexplode(words(F.col("text"))).alias("pos", "word")).select("key", "pos", lowered(F.col("word")).alias("term"))
    found = tokens.join(small(terms), "term")
    return found.groupBy("term", "key").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often the corpus has each of the terms; those it lacks are left out."""
    tokens = docs.select(F.explode(words(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("term"))
    return tokens.join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchors_of(windows: DataFrame, counts: DataFrame, k: int = ANCHORS) -> DataFrame:
    """(wid, len, term, offset, n_anchors): the k rarest terms of each window; windows with a term that the corpus lacks go."""
    terms = windows.select("wid", "len", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    rated = terms.join(small(counts), "term", "left")
    by = Window.partitionBy("wid")
    ranked = rated.withColumn("lacking", F.max(F.col("n").isNull()).over(by)).withColumn("rank", F.row_number().over(by.orderBy("n", "offset")))
    kept = ranked.where(~F.col("lacking") & (F.col("rank") <= k))
    return kept.select("wid", "len", "term", "offset", F.least(F.col("len"), F.lit(k)).alias("n_anchors"))


def phrase_candidates(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, wid, len, start): starts that the shifted lists of all of a window's anchors have in common."""
    lists = postings.join(small(anchors), "term").select("key", "wid", "len", "n_anchors", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"))
    agreed = lists.where("start >= 0").groupBy("key", "wid", "len", "start", "n_anchors").agg(F.count(F.lit(1)).alias("n"))
    return agreed.where("n = n_anchors").select("key", "wid", "len", "start")


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term): the distinct words of each item."""
    items = columns(benchmark, ["item_id", "text"], ["string", "string"])
    return items.select("item_id", F.explode(F.array_distinct(words(lower_ascii(F.col("text"))))).alias("term")).distinct()


def rarest_two(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, one, two): the two rarest terms of each item, those that the corpus lacks first; items that lack one of them go."""
    by = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "term")
    two = items.join(small(counts), "term", "left").withColumn("rank", F.row_number().over(by)).where("rank <= 2")
    two = two.groupBy("item_id").agg(F.min(F.when(F.col("rank") == 1, F.col("term"))).alias("one"), F.min(F.when(F.col("rank") == 2, F.col("term"))).alias("two"), F.count("n").alias("k"))
    return two.where("k = 2").select("item_id", "one", "two")


def near_pairs(postings: DataFrame, pairs: DataFrame, slop: int = SLOP) -> DataFrame:
    """(key, one, two, distance): documents with both terms of a pair at most slop words apart, and the least distance."""
    asked = pairs.select(F.explode(F.array(F.struct(F.col("one").alias("term"), F.lit(1).alias("r"), "one", "two"), F.struct(F.col("two").alias("term"), F.lit(2).alias("r"), "one", "two"))).alias("a")).select("a.*")
    lists = postings.join(small(materialize(asked, "asked")), "term")
    both = lists.groupBy("key", "one", "two").agg(F.max(F.when(F.col("r") == 1, F.col("positions"))).alias("p"), F.max(F.when(F.col("r") == 2, F.col("positions"))).alias("q")).where("p is not null and q is not null")
    said = lambda c, r: F.transform(c, lambda x: F.struct(x.cast("long").alias("p"), F.lit(r).alias("r")))
    far = F.lit(2**40)
    start = F.struct((-far).alias("one"), far.alias("two"), far.alias("best"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.abs(x["p"] - F.when(x["r"] == 1, acc["two"]).otherwise(acc["one"]))
        return F.struct(F.when(x["r"] == 1, x["p"]).otherwise(acc["one"]).alias("one"), F.when(x["r"] == 2, x["p"]).otherwise(acc["two"]).alias("two"), F.least(acc["best"], gap).alias("best"))

    both = both.withColumn("l", F.sort_array(F.concat(said("p", 1), said("q", 2))))
    return both.select("key", "one", "two", F.aggregate("l", start, step, lambda a: a["best"]).alias("distance")).where(F.col("distance") <= slop)


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP) -> DataFrame:
    """(key, item_id, distance): documents with the two rarest terms of an item at most slop words apart, and the least distance."""
    items = materialize(item_terms(benchmark), "terms")
    two = materialize(rarest_two(items, materialize(term_counts(docs, items.select("term").distinct()), "counts")), "two")
    terms = two.select(F.explode(F.array("one", "two")).alias("term")).distinct()
    near = near_pairs(build_postings(docs, materialize(terms, "near-terms")), two.select("one", "two").distinct(), slop)
    return near.join(small(two), ["one", "two"]).select("key", "item_id", "distance")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """A row for each row of docs: key, doc_id, n_words, n_hit, items and near (ids of items with phrase and with proximity matches, sorted as
    strings), contaminated.

    contaminated: some word is hit, and at least one in `share` words is."""
    docs = columns(docs, ["doc_id", "text"], ["long", "string"])
    owned = materialize(item_windows(benchmark, window), "item-windows")
    windows = materialize(owned.select("phrase", "len").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    vocabulary = materialize(windows.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "vocabulary")
    counts = materialize(term_counts(docs, vocabulary), "term-counts")
    anchors = materialize(anchors_of(windows, counts), "anchors")
    two = materialize(rarest_two(materialize(item_terms(benchmark), "item-terms"), counts), "rarest")
    wanted = anchors.select("term").unionByName(two.select(F.col("one").alias("term"))).unionByName(two.select(F.col("two").alias("term"))).distinct()
    postings = materialize(build_postings(docs, materialize(wanted, "wanted-terms")), "postings")
    near = near_pairs(postings, two.select("one", "two").distinct()).join(small(two), ["one", "two"])
    near = materialize(near.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("near")), "near")
    starts = phrase_candidates(postings, anchors).groupBy("key").agg(F.collect_list(F.struct("wid", "start", "len")).alias("c"))
    starts = materialize(starts, "candidates")

    read = docs.select(row_key().alias("key"), "doc_id", words(F.col("text")).alias("w")).join(small(starts), "key", "left")
    found = F.transform("c", lambda c: F.struct(c["wid"].alias("wid"), c["start"].alias("start"), c["len"].alias("len"), lower_ascii(F.concat_ws(" ", F.slice(F.col("w"), c["start"] + 1, c["len"]))).alias("phrase")))
    rows = materialize(read.select("key", "doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found")), "found")

    seen = rows.where("found is not null").select("key", F.explode("found").alias("f")).select("key", "f.*").distinct()
    exact = materialize(seen.join(small(windows), ["wid", "phrase", "len"]).select("key", "phrase", F.struct("start", "len").alias("at")), "exact")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"))

    hits = exact.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("l")).select("key", F.aggregate("l", zero, cover, lambda a: a["n"]).cast("long").alias("n_hit"))
    items = exact.select("key", "phrase").distinct().join(small(owned), "phrase").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = rows.drop("found").join(hits, "key", "left").join(items, "key", "left").join(small(near), "key", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", none), "near": F.coalesce("near", none)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns, and n_near: how many items have proximity matches."""
    items = F.concat_ws(",", "items")
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))
