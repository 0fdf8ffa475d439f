"""Ranked similarity search over records: token index, tiers, lexical, SimHash, vectors, relations, substrings, names.

All operators take many queries at once, keyed by `query`, and break ties by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as X
from tessera.operators import relational as R

FIELDS = ["condition", "drug", "biomarker", "endpoint"]
WEIGHTS = {"condition": 0.45, "drug": 0.25, "biomarker": 0.20}
#: What a tier asks for, by the first field that a query has; a field with ? is asked for only if the query has it.
TIERS = {
    "condition": [["condition", "?drug", "?biomarker", "?type", "?phase"], ["condition", "?drug", "?type", "?phase"], ["condition", "?type", "?phase"], ["condition", "?type"], ["condition"], ["!endpoint", "endpoint", "?type"]],
    "endpoint": [["endpoint", "?drug", "?biomarker", "?type", "?phase"], ["endpoint", "?drug", "?type", "?phase"], ["endpoint", "?type"]],
    "drug": [["drug", "?biomarker", "?type", "?phase"], ["drug", "?type"]],
    "biomarker": [["biomarker", "?type", "?phase"]],
}


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def token_index(df: DataFrame, ident: str, fields: dict[str, Column]) -> DataFrame:
    """(field, token, id), each once where ids are: an inverted index, written best by field and sorted by token."""
    per = F.array(*(F.struct(F.lit(name).alias("field"), X.token_set(c).alias("tokens")) for name, c in fields.items()))
    rows = df.select(F.col(ident).alias("id"), F.explode(per).alias("p"))
    return rows.select("p.field", F.explode("p.tokens").alias("token"), "id")


def token_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"))


def tiered(index: DataFrame, counts: DataFrame, meta: DataFrame, queries: DataFrame, k: int = 5, min_match: int = 1) -> DataFrame:
    """Structured retrieval: (query, rank, tier, id, score).

    meta is (id, phase, type), queries is (query, id): records of the index that are looked for. Records that share a token with the
    query in some field are scored by weighted Jaccard similarities, and belong to the first tier whose demands they meet; tiers follow each
    other, k rows in all."""
    q = queries.select("query", F.col("id").alias("q_id"))
    mine = q.join(index.withColumnRenamed("id", "q_id"), "q_id").select("query", "q_id", "field", "token")
    sizes = mine.groupBy("query", "field").agg(F.count(F.lit(1)).alias("n_q"))
    over = mine.join(index, ["field", "token"]).where("id <> q_id").groupBy("query", "id", "field").agg(F.count(F.lit(1)).alias("n_o"))
    over = over.join(counts, ["id", "field"]).join(sizes, ["query", "field"])
    over = over.withColumn("j", F.col("n_o") / (F.col("n_q") + F.col("n") - F.col("n_o")))
    wide = over.groupBy("query", "id").agg(*(F.coalesce(F.max(F.when(F.col("field") == f, F.col("j"))), F.lit(0.0)).alias(f) for f in FIELDS))
    has = sizes.groupBy("query").agg(*(F.max(F.when(F.col("field") == f, 1).otherwise(0)).alias(f"has_{f}") for f in FIELDS))
    about = q.join(meta.select(F.col("id").alias("q_id"), F.lower(F.trim(X.blank_if_null(F.col("phase")))).alias("q_phase"), F.lower(F.trim(X.blank_if_null(F.col("type")))).alias("q_type")), "q_id", "left")
    rows = wide.join(has, "query").join(about.select("query", F.coalesce("q_phase", F.lit("")).alias("q_phase"), F.coalesce("q_type", F.lit("")).alias("q_type")), "query")
    rows = rows.join(meta.select("id", F.lower(X.blank_if_null(F.col("phase"))).alias("phase"), F.lower(X.blank_if_null(F.col("type"))).alias("type")), "id", "left")
    meets = {f: F.col(f) > 0 for f in FIELDS} | {"phase": (F.col("q_phase") != "") & (F.col("q_phase") == F.col("phase")), "type": (F.col("q_type") != "") & (F.col("q_type") == F.col("type"))}
    asked = {f: F.col(f"has_{f}") == 1 for f in FIELDS} | {"phase": F.col("q_phase") != "", "type": F.col("q_type") != ""}
    matched = sum((F.col(f) > 0).cast("int") for f in FIELDS)
    scored = rows.where(matched >= min_match).select("query", "id", first_tier(asked, meets).alias("tier"), tier_score({f: F.col(f) for f in FIELDS}, meets["phase"]).alias("score")).where("tier is not null")
    return top_k(scored, k, ["query"], [F.col("tier"), F.desc(F.round("score", 12)), F.col("id")])


def first_tier(asked: dict[str, Column], meets: dict[str, Column]) -> Column:
    """The first tier whose demands are met, null if none; both say it by field, phase and type."""
    tier = F.lit(None).cast("long")
    for lead in reversed(list(TIERS)):
        own = F.lit(None).cast("long")
        for i in range(len(TIERS[lead]), 0, -1):
            met = F.lit(True)
            for want in TIERS[lead][i - 1]:
                name = want.lstrip("?!")
                met = met & (asked[name] if want[0] == "!" else ~asked[name] | meets[name] if want[0] == "?" else meets[name])
            own = F.when(F.coalesce(met, F.lit(False)), i).otherwise(own)
        tier = F.when(asked[lead], own).otherwise(tier)
    return tier.cast("long")


def tier_score(like: dict[str, Column], phase: Column) -> Column:
    return sum(w * like[f] for f, w in WEIGHTS.items()) + F.when(phase, 0.10).otherwise(0.0) + F.when(like["endpoint"] > 0, 0.05).otherwise(0.0)


def with_bit(known: Column) -> Callable[[Column, Column], Column]:
    """Sets the bit that a text's place in known says, if it has one."""

    def add(word: Column, text: Column) -> Column:
        at = F.array_position(known, text)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at - 1).cast("int"))
        return word.bitwiseOR(F.when(at > 0, bit).otherwise(F.lit(0).cast("long")))

    return add


def set_words(df: DataFrame, names: list[str], most: int = 512) -> tuple[DataFrame, int]:
    """df with each named array of texts as a set in 64-bit words (name_0 and so on), a bit for each text that occurs, and how many words there
    are: none, and no columns, if more than `most` texts occur."""
    texts = df.select(F.explode(F.concat(*names)).alias("t")).distinct().limit(most + 1).collect()
    if len(texts) > most:
        return df, 0
    known = sorted(r.t for r in texts if r.t is not None)
    n = max(1, -(-len(known) // 64))
    for c in names:
        for w in range(n):
            part = F.array(*(F.lit(t) for t in known[64 * w : 64 * w + 64])).cast("array<string>")
            df = df.withColumn(f"{c}_{w}", F.aggregate(F.filter(c, lambda t: t.isNotNull()), F.lit(0).cast("long"), with_bit(part)))
    return df, n


def set_jaccard(name: str, words: int) -> Column:
    """The Jaccard similarity of the sets `name` and `q_name`, from their words by set_words() where there are some."""
    if not words:
        return N.jaccard(F.col(f"q_{name}"), F.col(name))
    count = lambda f: sum(F.bit_count(f(F.col(f"q_{name}_{w}"), F.col(f"{name}_{w}"))) for w in range(words))
    both, either = count(lambda a, b: a.bitwiseAND(b)), count(lambda a, b: a.bitwiseOR(b))
    return F.when((count(lambda a, _: a) > 0) & (count(lambda _, b: b) > 0), both / either).otherwise(0.0)


def top_k_by_kind(records: DataFrame, kinds: DataFrame, near: list[str], like: dict[str, Column], apart: list[Column], alike: list[Column], k: int, most: int = 500_000) -> DataFrame:
    """The first k records for each record whose `asked` holds, itself aside: (query, id, o0, o1, ...), by ascending values of an order, then id.

    records is (id, kind, part, asked): kind says all that the order looks at but part, and an equal part must put a record further ahead or
    leave it where it is. kinds has a row of features for each kind, once; q_ and a name is the query's. `like` are columns of a pair, worked out once, that the
    orders use by name; `apart` and `alike` are the order's columns for
    unequal and for equal parts; a first one that is null leaves a pair out. So records of one kind and part have one order, of which the smallest
    k + 1 ids matter; of a kind's records in other parts those matter that are first whatever the part; of equal parts those that are not behind
    the last of these. `near` are columns whose equality finds a bound on it before all pairs are looked at."""
    spark = records.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # AQE would put few rows of many pairs in one
    order = [f"o{i}" for i in range(len(apart))]
    smallest = lambda by: top_k(records, k + 1, by, [F.col("id")]).select("id", "kind", "part")
    first = records.groupBy("kind").agg(F.min("id").alias("least"), F.max("asked").alias("asked"))
    known = kinds.join(first, "kind").drop("asked")
    few = kinds.count() <= most
    other = F.broadcast(known) if few else known
    mine = kinds.join(first.where("asked").select("kind"), "kind")
    mine = mine.select(*(F.col(f"`{c}`").alias(f"q_{c}") for c in kinds.columns))
    once = lambda cs: F.inline(F.array(F.struct(*(c.alias(n) for n, c in cs.items()))))  # noqa: E731  # filters do not move below it and repeat it
    placed = lambda df, by, *keep: df.select(*keep, once(like)).select(*keep, once(dict(zip(order, by, strict=True)))).where("o0 is not null")
    bound = F.struct(*order)
    # The (k + 1)th kind among those near: kinds behind it have k + 1 records before theirs.
    some = placed(mine.join(other, [F.col(f"q_{c}").eqNullSafe(F.col(c)) for c in near]), apart, "q_kind", "least")
    some = top_k(some, k + 1, ["q_kind"], [*map(F.col, order), F.col("least")]).where(F.col("rank") == k + 1).select(F.col("q_kind").alias("b_kind"), bound.alias("most"))
    bounded = mine.join(F.broadcast(some) if few else some, F.col("q_kind") == F.col("b_kind"), "left")
    all_kinds = placed(bounded.repartition(tasks, "q_kind").crossJoin(other), apart, "q_kind", "kind", "least", "most").where(F.col("most").isNull() | (bound <= F.col("most")))
    ahead = top_k(all_kinds, k + 1, ["q_kind"], [*map(F.col, order), F.col("least")]).drop("rank", "least", "most")
    ahead = top_k(ahead.join(smallest(["kind"]), "kind"), k + 1, ["q_kind"], [*map(F.col, order), F.col("id")])
    last = ahead.where(F.col("rank") == k + 1).select(F.col("q_kind").alias("b_kind"), bound.alias("most"))
    asked = records.where("asked").select(F.col("kind").alias("q_kind"), F.col("part").alias("q_part"), F.col("id").alias("query"))
    parts = mine.join(last, F.col("q_kind") == F.col("b_kind"), "left").join(asked.select(F.col("q_kind").alias("a_kind"), "q_part").distinct(), F.col("q_kind") == F.col("a_kind"))
    classes = records.groupBy("kind", "part").agg(F.min("id").alias("least")).join(kinds, "kind")
    classes = F.broadcast(classes) if records.select("kind", "part").distinct().count() <= most else classes
    same = placed(parts.repartition(tasks, "q_kind", "q_part").join(classes, F.col("part") == F.col("q_part")), alike, "q_kind", "q_part", "kind", "part", "least", "most").where(F.col("most").isNull() | (bound <= F.col("most")))
    same = top_k(same, k + 1, ["q_kind", "q_part"], [*map(F.col, order), F.col("least")]).drop("rank", "least", "most")
    same = top_k(same.join(smallest(["kind", "part"]), ["kind", "part"]), k + 1, ["q_kind", "q_part"], [*map(F.col, order), F.col("id")])
    found = asked.join(same.select("q_kind", "q_part", "id", *order), ["q_kind", "q_part"])
    rest = asked.join(ahead.select("q_kind", "id", "part", *order), "q_kind").where(~F.col("part").eqNullSafe(F.col("q_part")) | F.col("part").isNull())
    found = found.unionByName(rest.drop("part")).where("id <> query")
    return top_k(found, k, ["query"], [*map(F.col, order), F.col("id")]).select("query", "rank", "id", *order)


def lexical(index: DataFrame, counts: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, id, overlap, score, rank): Jaccard similarity of token sets of one field; queries is (query, token), each once."""
    sizes = queries.groupBy("query").agg(F.count(F.lit(1)).alias("n_q"))
    over = queries.join(index.select("token", "id"), "token").groupBy("query", "id").agg(F.count(F.lit(1)).alias("overlap"))
    scored = over.join(counts.select("id", "n"), "id").join(sizes, "query")
    score = F.col("overlap") / (F.col("n_q") + F.col("n") - F.col("overlap"))
    return top_k(scored.select("query", "id", "overlap", score.alias("score")), k, ["query"], [F.desc("score"), F.col("id")])


def combined_score(lexical: Column, phase: Column, conditions: Column, endpoint: Column, biomarkers: Column, genes: Column) -> Column:
    """The lexical score of whole records with its bonuses; phase and endpoint are equality flags, the others similarities."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return lexical + 0.15 * flag(phase) + 0.4 * conditions + 0.2 * flag(endpoint) + 0.25 * biomarkers + 0.35 * genes


def simhash(df: DataFrame, ident: str, c: Column) -> DataFrame:
    """(id, sig): 64-bit signatures; bit i is set if the tokens' hashes, by how often they occur, have it at least as often as not. A row at a
    time and without a shuffle: 32 sums of two lanes of 32 bits each count how many hashes have a bit."""
    rows = df.select(F.col(ident).alias("id"), X.tokens(c).alias("tokens")).where(F.size("tokens") > 0)
    rows = rows.select("id", F.transform("tokens", N.hash64).alias("h"))
    low = F.lit(0x0000000100000001).cast("long")
    lane = lambda j: F.aggregate("h", F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(low))
    rows = rows.select("id", F.size("h").alias("n"), *(lane(j).alias(f"s{j}") for j in range(32)))
    sig = F.lit(0).cast("long")
    for i in range(64):
        ones = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) if i < 32 else F.shiftrightunsigned(f"s{i - 32}", 32)
        sig = sig.bitwiseOR(F.when(2 * ones >= F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select("id", sig.alias("sig"))


def simhash_bands(sigs: DataFrame) -> DataFrame:
    """(id, sig, bucket): four bands of 16 bits, the highest first."""
    bands = [F.shiftrightunsigned("sig", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return sigs.select("id", "sig", F.explode(N.band_ids(bands)).alias("bucket"))


def simhash_pairs(sigs: DataFrame, max_distance: int = 8) -> DataFrame:
    """(a, b, distance): ids whose signatures share a band and are near, each pair once. Equal signatures are joined through their smallest
    id, so a group of copies gives a star and not all pairs."""
    reps = sigs.groupBy("sig").agg(F.min("id").alias("id"))
    copies = sigs.join(reps.withColumnRenamed("id", "rep"), "sig").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("distance"))
    x, y = simhash_bands(reps).alias("x"), simhash_bands(reps).alias("y")
    near = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (N.hamming(F.col("x.sig"), F.col("y.sig")) <= max_distance))
    near = near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), N.hamming(F.col("x.sig"), F.col("y.sig")).cast("long").alias("distance")).distinct()
    return near.unionByName(copies)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, group: str | None = None) -> DataFrame:
    """(query, id, score, rank) by inner product of unit vectors, the query's own id aside; with a group its best member counts.

    queries is (query, vector): every vector meets every query, as an exact search has it."""
    q = queries.select("query", N.unit(F.col("vector")).alias("q"))
    v = vectors.where(N.finite(F.col("vector"))).select("id", N.unit(F.col("vector")).alias("v"), *([group] if group else []))
    scored = v.join(q, v["id"] != q["query"]).select("query", "id", *([group] if group else []), F.round(N.dot(F.col("q"), F.col("v")), 6).alias("score"))
    if group:
        scored = scored.groupBy("query", F.col(group).alias("id")).agg(F.max("score").alias("score"))
    return top_k(scored, k, ["query"], [F.desc("score"), F.col("id")])


def related(edges: DataFrame, queries: DataFrame, prefix: str, k: int, hops: int = 3) -> DataFrame:
    """(query, node, hop, score, rank): records reached over relations, nearest first; scored 1 / hop."""
    found = R.within_hops(edges, queries, hops).where(F.col("node").startswith(prefix) & (F.col("node") != F.col("query")))
    scored = found.select("query", "node", F.col("hop").cast("long").alias("hop"), F.round(1 / F.greatest(F.lit(1), F.col("hop")), 4).alias("score"))
    return top_k(scored, k, ["query"], [F.col("hop"), F.col("node")])


def substring(df: DataFrame, ident: str, c: Column, word: str, k: int = 10) -> DataFrame:
    """(id, hits, evidence): texts that contain a word, by how often, with the text about its first occurrence."""
    hits = X.occurrences(c, word)
    rows = df.where(F.lower(X.blank_if_null(c)).contains(word.lower())).select(F.col(ident).alias("id"), hits.alias("hits"), X.window_around(c, F.lit(word)).alias("evidence"))
    return rows.orderBy(F.desc("hits"), "id").limit(k)


def name_lookup(names: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(id, name, score, rank): the id whose name equals the query, with score 1, alone; else ids whose name contains it, of which prefixes and
    names of like length score higher. Of ids with one name the smallest is taken."""
    q = " ".join(query.lower().split())
    found = names.where(F.col("name").contains(q)).withColumn("same", F.col("name") == q)
    any_same = F.broadcast(found.agg(F.coalesce(F.bool_or("same"), F.lit(False)).alias("exact")))  # one row
    score = F.lit(0.6) + F.when(F.col("name").startswith(q), 0.25).otherwise(0.0) + F.greatest(F.lit(0.0), 0.2 - F.abs(F.length("name") - len(q)) / 100)
    scored = found.crossJoin(any_same).where(~F.col("exact") | F.col("same")).select("id", "name", "exact", F.when(F.col("exact"), 1.0).otherwise(F.round(score, 3)).alias("score"))
    best = scored.groupBy("id").agg(F.min_by(F.struct("name", "score", "exact"), F.struct(-F.col("score"), "name")).alias("b")).select("id", "b.*")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    first = best.orderBy(F.desc("score"), "id").limit(k).withColumn("rank", rank.cast("long"))
    return first.where(~F.col("exact") | (F.col("rank") == 1)).drop("exact")


def cascade(relation: DataFrame | None, vector: DataFrame | None, simhash_hits: DataFrame | None, scan: DataFrame, relation_only: bool = False) -> DataFrame:
    """The first access path that has rows: relations, vectors, SimHash, scan."""
    if relation is not None and (relation_only or not relation.isEmpty()):
        return relation
    for found in (vector, simhash_hits):
        if found is not None and not found.isEmpty():
            return found
    return scan


def recommend(current: DataFrame, peers: DataFrame, by: str = "id") -> DataFrame:
    """(id, action): rules on a record's features (randomized, control, strictness, endpoint) against the means of its peers, in a fixed order.

    peers is (query, strictness, endpoint), query being what records have in the column `by`, so records of one group can share their peers; a tie for the most common endpoint goes to the first by name."""
    first = Window.partitionBy("query").orderBy(F.desc("n"), "endpoint")
    common = peers.where("endpoint <> ''").groupBy("query", "endpoint").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(first)).where("r = 1").select("query", F.col("endpoint").alias("common"))
    means = peers.groupBy("query").agg(F.avg("strictness").alias("mean"))
    rows = current.join(means, current[by] == means["query"], "left").drop("query").join(common, current[by] == common["query"], "left").drop("query")
    mean = F.coalesce("mean", F.lit(0.0))
    rules = [
        (~F.col("randomized"), "randomize"),
        (~F.col("control"), "add_control"),
        (F.col("strictness") > mean + 0.1, "loosen_criteria"),
        (F.col("strictness") < mean - 0.1, "review_exclusions"),
        (F.col("common").isNotNull() & (F.lower("endpoint") != F.col("common")), "align_endpoint"),
        (F.col("endpoint") == "", "define_endpoint"),
    ]
    actions = F.filter(F.array(*(F.when(c, a) for c, a in rules)), lambda a: a.isNotNull())
    return rows.select("id", F.explode(actions).alias("action"))
