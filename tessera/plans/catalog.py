"""The queries over the driver's tables, by name: each applies operators of this package to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import fuzzy as Z
from tessera.functions import numeric as N
from tessera.functions import text as X
from tessera.operators import corpus as C
from tessera.operators import evaluation as E
from tessera.operators import features as M
from tessera.operators import fill as L
from tessera.operators import groups as GR
from tessera.operators import modeling as G
from tessera.operators import profile as P
from tessera.operators import relational as R
from tessera.operators import retrieval as S
from tessera.operators import views as V
from tessera.plans import oracles
from tessera.sources import io
from tessera.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
    return f


# Search


def queried(df: DataFrame, ident: str) -> DataFrame:
    """The records that searches take as queries: every one whose id is divisible by 50, at any size of the data."""
    return df.where(F.col(ident) % 50 == 0)


def document_index(t: Tables) -> DataFrame:
    return S.token_index(t.documents, "doc_id", {"text": F.col("text")})


@query
def lexical_topk(t: Tables) -> DataFrame:
    """The ten documents most like benchmark item 0, with their start."""
    q = t.benchmark.where("item_id = 0").select(F.col("item_id").alias("query"), F.explode(X.token_set(F.col("text"))).alias("token"))
    index = document_index(t)
    found = S.lexical(index, S.token_counts(index), F.broadcast(q), 10)
    docs = t.documents.select("doc_id", X.snippet(F.col("text"), 120).alias("snippet"))
    return found.join(docs, found["id"] == docs["doc_id"]).select("doc_id", "rank", F.col("overlap").cast("long").alias("overlap"), F.round("score", 6).alias("score"), "snippet")


@query
def lexical_topk_all(t: Tables) -> DataFrame:
    """The three documents most like each benchmark item."""
    q = t.benchmark.select(F.col("item_id").alias("query"), F.explode(X.token_set(F.col("text"))).alias("token"))
    index = document_index(t)
    return S.lexical(index, S.token_counts(index), q, 3).select("query", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query
def token_index_build(t: Tables) -> DataFrame:
    """Documents in which each token of each source occurs."""
    rows = t.documents.select("source", "doc_id", F.explode(X.token_set(F.col("text"))).alias("token"))
    return rows.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.token_set(F.col("text"))).cast("long").alias("n_tokens"), X.word_count(F.col("text")).alias("n_words"))


@query
def structured_tiered_topk(t: Tables) -> DataFrame:
    """Parts like each queried part: name as condition, type as drug, brand as biomarker, size as phase."""
    records, kinds = part_kinds(t)
    fields = {"condition": "p_name", "drug": "p_type", "biomarker": "p_brand"}
    kinds, n = S.set_words(kinds.select("kind", "p_name", "sized", *(X.token_set(F.col(c)).alias(f) for f, c in fields.items())), list(fields))
    pair = {f"like_{f}": S.set_jaccard(f, n) for f in fields} | {f"has_{f}": F.size(f"q_{f}") > 0 for f in fields} | {"sized": F.col("q_sized")}
    like = {f: F.col(f"like_{f}") for f in fields} | {"endpoint": F.lit(0.0)}
    no, yes = F.lit(False), F.lit(True)
    asked = {f: F.col(f"has_{f}") for f in fields} | {"endpoint": no, "phase": F.col("sized"), "type": no}

    def order(phase) -> list:
        meets = {f: c > 0 for f, c in like.items()} | {"phase": phase, "type": no}
        score = S.tier_score(like, phase)
        return [S.first_tier(asked, meets), -F.round(score, 12), -score]

    found = S.top_k_by_kind(records, kinds, ["p_name"], pair, order(no), order(yes), 5)
    return found.select("query", "rank", F.col("o0").alias("tier"), "id", F.round(-F.col("o2"), 6).alias("score"))


def part_kinds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts for S.top_k_by_kind, the size as part and the rest, and whether there is a size, as kind; and the kinds."""
    named = ["p_name", "p_type", "p_brand", "sized"]
    rows = t.part.withColumn("sized", F.col("p_size").isNotNull())
    rows = rows.select(*named, F.col("p_partkey").alias("id"), F.to_json(F.struct(*named)).alias("kind"), F.col("p_size").alias("part"), F.coalesce(F.col("p_partkey") % 50 == 0, F.lit(False)).alias("asked"))
    return rows.select("id", "kind", "part", "asked"), rows.select("kind", *named).distinct()


@query
def simhash_signatures(t: Tables) -> DataFrame:
    sigs = S.simhash(t.documents, "doc_id", F.col("text"))
    band = lambda i: F.shiftrightunsigned("sig", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).cast("long")
    return sigs.select(F.col("id").alias("doc_id"), *(band(i).alias(f"band{i}") for i in range(4)))


@query
def simhash_lsh_pairs(t: Tables) -> DataFrame:
    return S.simhash_pairs(S.simhash(t.documents, "doc_id", F.col("text")), 8)


@query
def vector_topk(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = queried(t.embeddings, "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return S.vector_top_k(v, q, 10)


@query
def vector_topk_grouped(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = queried(t.embeddings, "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return S.vector_top_k(v, q, 3, "label")


def relation_edges(t: Tables) -> DataFrame:
    n = lambda kind, c: R.node(F.lit(kind), F.col(c))
    edges = t.customer.select(n("Customer", "c_custkey").alias("src"), n("Nation", "c_nationkey").alias("dst"))
    edges = edges.unionByName(t.supplier.select(n("Supplier", "s_suppkey").alias("src"), n("Nation", "s_nationkey").alias("dst")))
    return R.symmetric_edges(edges.unionByName(t.nation.select(n("Nation", "n_nationkey").alias("src"), n("Region", "n_regionkey").alias("dst"))))


@query
def edges_build(t: Tables) -> DataFrame:
    return relation_edges(t)


@query
def khop_related(t: Tables) -> DataFrame:
    """Suppliers related to each queried customer within three hops."""
    start = queried(t.customer, "c_custkey").select(R.node(F.lit("customer"), F.col("c_custkey")).alias("query")).withColumn("node", F.col("query"))
    return S.related(relation_edges(t), start, "supplier:", 5, 3)


@query
def substring_search(t: Tables) -> DataFrame:
    return S.substring(t.documents, "doc_id", F.col("text"), "license", 10).select("id", "hits", "evidence")


@query
def name_lookup(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"))
    return S.name_lookup(names, "red", 5)


@query
def name_lookup_exact(t: Tables) -> DataFrame:
    """The nation whose name is asked for, though others hold that name as well."""
    names = t.nation.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    return S.name_lookup(names, "Nation_1", 5)


@query
def combined_score_scan(t: Tables) -> DataFrame:
    """The ten parts most like each queried part by the whole-record score."""
    records, kinds = part_kinds(t)
    kinds = kinds.select("kind", "p_name", X.token_set(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("tokens"), F.lower("p_type").alias("type"), F.array(F.lower("p_brand")).alias("brand"), F.split(F.lower("p_name"), " ").alias("name"))
    kinds, n = S.set_words(kinds, ["tokens", "name", "brand"])
    pair = {f"like_{c}": S.set_jaccard(c, n) for c in ("tokens", "name", "brand")} | {"same_type": F.col("type") == F.col("q_type")}
    order = lambda same: [-F.round(S.combined_score(F.col("like_tokens"), F.lit(same), F.col("like_name"), F.col("same_type"), F.col("like_brand"), F.lit(0.0)), 6)]
    found = S.top_k_by_kind(records, kinds, ["p_name"], pair, order(False), order(True), 10)
    return found.select("query", F.col("id").alias("p_partkey"), (-F.col("o0")).alias("score"))


# Merges


def line_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return R.reduce_to_key(rows, ["o_orderkey"], ["l_linenumber", "l_returnflag"])


@query
def study_merge(t: Tables) -> DataFrame:
    """Orders with their customer, nation and reduced lines."""
    people = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    merged = R.merge_left(t.orders, {"customer": people}, ["o_custkey"])
    merged = R.merge_left(merged, {"nation": t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")}, ["c_nationkey"])
    merged = R.merge_left(merged, {"lines": line_summary(t)}, ["o_orderkey"])
    return merged.select("o_orderkey", "o_custkey", "c_mktsegment", "n_name", F.round("l_quantity", 6).alias("mean_quantity"), F.round("l_extendedprice", 6).alias("mean_price"), F.col("l_returnflag").alias("first_flag"))


@query
def arm_merge(t: Tables) -> DataFrame:
    """Lines with their order and customer."""
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    merged = R.merge_left(R.merge_left(t.lineitem, {"orders": orders}, ["l_orderkey"]), {"customer": people}, ["o_custkey"])
    return merged.groupBy("c_mktsegment", "o_orderstatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query
def nested_collect(t: Tables) -> DataFrame:
    """Customers with the sorted distinct priorities and statuses of their orders, as text."""
    kids = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    rows = R.nested_records(t.customer.select("c_custkey"), {"orders": (kids, ["o_orderpriority", "o_orderstatus"])}, "c_custkey")
    text = F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderpriority"], F.lit("/"), o["o_orderstatus"])), "; ")
    return rows.select("c_custkey", F.size("orders").cast("long").alias("n_kinds"), text.alias("kinds"))


@query
def left_join_moa(t: Tables) -> DataFrame:
    """Lines with their part, keys cast, summed by brand."""
    part = t.part.select(F.col("p_partkey").cast("string").alias("k"), "p_brand")
    rows = t.lineitem.withColumn("k", F.col("l_partkey").cast("string")).join(part, "k", "left")
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query
def existence_flags(t: Tables) -> DataFrame:
    rows = R.marked(R.marked(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", t.orders.where("o_orderstatus = 'P' and o_totalprice > 300000").select("o_custkey"), "has_order"), "c_nationkey", t.supplier.where("s_acctbal > 5000").select("s_nationkey"), "has_supplier")
    return rows.groupBy("has_order", "has_supplier").agg(F.count(F.lit(1)).alias("n"))


@query
def primary_row_select(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return R.match_or_first(rows, "l_orderkey", F.col("l_returnflag") == "R", [F.col("l_linenumber"), F.col("l_partkey")])


@query
def keep_first_union(t: Tables) -> DataFrame:
    a = t.labels.where("doc_id % 3 = 0").select("doc_id", "quality", F.lit("first").alias("origin"))
    b = t.labels.select("doc_id", "quality", F.lit("second").alias("origin"))
    return R.priority_union([a, b], ["doc_id"], ["quality"])


@query
def diagonal_union(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return R.diagonal_union([a, b])


@query
def consistent_ids(t: Tables) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return R.complete_ids([t.events.where(F.col("event_type") == k).select("user_id") for k in kinds], "user_id")


@query
def supplement_columns(t: Tables) -> DataFrame:
    rows = R.supplement(t.orders.select("o_orderkey", "o_custkey"), t.customer.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey", "arm"], ["c_mktsegment"])
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query
def id_filter(t: Tables) -> DataFrame:
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    rows = R.filter_ids(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", wanted)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query
def excluded_ids(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query
def label_build(t: Tables) -> DataFrame:
    label = R.outcome_label(F.col("o_orderstatus"), ["F"], ["O"])
    return t.orders.select("o_orderkey", label.alias("label"), ((label + 1) / 2).cast("int").alias("target")).where("label is not null")


@query
def phase_filter(t: Tables) -> DataFrame:
    rows = t.part.withColumn("phase", F.concat(F.lit("Phase "), F.col("p_size").cast("string")))
    return rows.where(R.phase_matches(F.col("phase"), ["Phase 1", "phase 2/3"])).select("p_partkey", "phase")


@query
def several_valued_columns(t: Tables) -> DataFrame:
    """Order columns by whether some customer has several values of them."""
    rows = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority", F.lit("x").alias("constant"))
    several = R.several_valued(rows, "o_custkey")
    return t.spark.createDataFrame([(c, c in several) for c in rows.columns if c != "o_custkey"], "`column` string, several boolean")


# Cleaning and text


@query
def fill_unknown(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k")).withColumn("missing", F.get_json_object("props", "$.absent"))
    return rows.select(X.filled(F.when(F.col("k") == "1", "").otherwise(F.col("k"))).alias("k"), X.filled(F.col("missing")).alias("missing")).groupBy("k", "missing").agg(F.count(F.lit(1)).alias("n"))


@query
def yes_no_normalise(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, [" Yes - planned", "None", "", "unknown", "no", "YES", "maybe"])), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select(said.alias("said"), X.yes_no_unknown(said).alias("value")).groupBy("said", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def normalised_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.squeeze(F.col("text")).cast("binary")).alias("squeezed"), X.snippet(F.col("text"), 80).alias("snippet"))


@query
def text_keys(t: Tables) -> DataFrame:
    """Keys, ids and parts of made-up registry texts about each supplier."""
    said = F.concat(F.lit("Arm "), F.col("s_name"), F.lit(" (old): see nct0"), F.col("s_suppkey").cast("string"), F.lit(", NCT7; 2010-123456-12 + Drug-B"))
    rows = t.supplier.select("s_suppkey", said.alias("said"))
    c = F.col("said")
    parts = F.array_join(X.split_list(c), "/")
    return rows.select("s_suppkey", X.label_key(c).alias("label"), X.match_text(c).alias("match"), X.trial_id(c).alias("trial"), X.eudract_id(c).alias("eudract"), parts.alias("parts"), X.primary_drug(c).alias("drug"))


SAID_COUNTRIES = ["United States", "Mexico", "Germany ", "Sweden", "Congo, The Democratic Republic of the", "cote d'ivoire", "Korea, Republic of", "South  Korea", "Czechia", "Israel", "United Kingdom", "Timor-Leste"]


@query
def nation_regions(t: Tables) -> DataFrame:
    """Region of a made-up country of each nation, as a registry's countries are put into five."""
    said = F.element_at(F.array(*map(F.lit, SAID_COUNTRIES)), (F.col("n_nationkey") % len(SAID_COUNTRIES) + 1).cast("int"))
    return t.nation.select("n_nationkey", X.country(said).alias("country"), X.region(said).alias("region"))


@query
def split_sections(t: Tables) -> DataFrame:
    a, b = X.split_sections(F.col("text"), "released", "license")
    return t.documents.select("doc_id", F.md5(a.cast("binary")).alias("first"), F.md5(b.cast("binary")).alias("second"))


@query
def json_extract(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("answer: "), F.col("props"), F.lit(" end"))
    rows = t.events.select("event_type", F.get_json_object(A.outer_json(noisy), "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


@query
def html_fields(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.pages.select("page_id", F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(html, r'<html lang="([a-z]*)"', 1).alias("lang"), F.size(F.regexp_extract_all(html, F.lit("<p>"), 0)).cast("long").alias("n_p"))


@query
def evidence_validate(t: Tables) -> DataFrame:
    """Whole benchmark items, in segments of at most 240 characters, as evidence from all documents."""
    segments = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 240).cast("int") - 1), lambda i: F.trim(F.substring(F.col("text"), i * 240 + 1, F.lit(240))))
    item = t.benchmark.where(F.length("text") > 0).select("item_id", F.array_join(segments, " | ").alias("evidence"), F.trim(F.substring("text", 1, 240)).alias("first"))
    pairs = t.documents.select("doc_id", "text").join(F.broadcast(item), F.contains("text", F.substring_index("first", " | ", 1)))
    return pairs.where(A.evidence_holds(F.col("evidence"), F.col("text"))).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def trial_features(t: Tables) -> DataFrame:
    """Strictness of documents as if they were criteria."""
    words, hits = X.word_count(F.col("text")), X.keyword_hits(F.col("text"), ["license", "token", "released"])
    score = N.strictness(words, hits, F.lit(1.0), F.lit(None).cast("double"))
    return t.documents.select("doc_id", words.alias("n_words"), hits.alias("hits"), score.alias("score"), N.strictness_label(score).alias("label"))


@query
def recommend_rules(t: Tables) -> DataFrame:
    """Rules for every part against the parts of its brand."""
    endpoint = X.endpoint_type(F.col("p_type"))
    feats = t.part.select(F.col("p_partkey").alias("id"), "p_brand", (F.col("p_size") % 2 == 0).alias("randomized"), (F.col("p_size") % 3 == 0).alias("control"), (F.col("p_size") / 50).alias("strictness"), F.lower(endpoint).alias("endpoint"), "p_size")
    peers = feats.select(F.col("p_brand").alias("query"), "strictness", "endpoint")
    return S.recommend(feats, peers, "p_brand").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# Profiles


@query
def column_profile_num(t: Tables) -> DataFrame:
    return P.numeric_profile(t.lineitem, ["l_quantity", "l_discount", "l_linenumber"]).unionByName(P.numeric_profile(t.customer, ["c_acctbal"]))


@query
def column_profile_str(t: Tables) -> DataFrame:
    return P.text_profile(t.customer, ["c_name", "c_mktsegment"]).unionByName(P.text_profile(t.documents, ["lang", "source"]))


@query
def top_values(t: Tables) -> DataFrame:
    return P.top_values(t.orders, ["o_orderstatus", "o_orderpriority"], 3)


@query
def key_duplicates(t: Tables) -> DataFrame:
    return P.duplicate_keys(t.lineitem, ["l_orderkey", "l_returnflag"])


@query
def coverage(t: Tables) -> DataFrame:
    return P.coverage({"customer": t.customer.select(F.col("c_custkey").alias("id")), "orders": t.orders.select(F.col("o_custkey").alias("id")), "events": t.events.select(F.col("user_id").alias("id"))}, "id")


@query
def join_coverage(t: Tables) -> DataFrame:
    return P.join_coverage(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query
def var_stats(t: Tables) -> DataFrame:
    return P.variable_stats(t.part.withColumn("one", F.lit(1)), ["p_size", "p_retailprice", "one"], ["p_brand", "p_type"])


@query
def problem_vars(t: Tables) -> DataFrame:
    rows = t.part.withColumns({"one": F.lit(1), "sparse": F.when(F.col("p_size") > 40, F.col("p_brand"))})
    return P.problem_variables(P.variable_stats(rows, ["p_size", "one"], ["p_brand", "sparse"])).select("column", "kind", "missing_ratio", "n_unique", "constant")


@query
def iqr_outliers(t: Tables) -> DataFrame:
    return P.iqr_outliers(t.events, ["event_type"], "value")


@query
def length_quantiles(t: Tables) -> DataFrame:
    return P.nearest_rank(t.documents.withColumn("n", F.char_length("text").cast("long")), ["lang"], "n", [0.5, 0.9, 0.95, 0.99]).select("lang", "n", "q50", "q90", "q95", "q99")


@query
def json_parse_rate(t: Tables) -> DataFrame:
    return P.parse_rate(t.events, "props", "event_id")


@query
def leakage_buckets(t: Tables) -> DataFrame:
    times = t.spark.createDataFrame([("o_orderdate", "T0"), ("o_totalprice", "T1"), ("o_orderstatus", "T2"), ("o_custkey", "later")], "variable string, time string")
    return P.leakage_buckets(["o_orderdate", "o_totalprice", "o_orderstatus", "o_custkey", "o_orderpriority"], times)


# Gaps


@query
def fill_first_seen(t: Tables) -> DataFrame:
    """Roles blanked on every third turn, filled from the conversation's first."""
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.lit(None)).otherwise(F.col("role")).alias("role"))
    return L.fill_from_first(rows, ["conv_id"], ["turn"], ["role"])


@query
def field_batches(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", *(F.when((F.col("o_orderkey") + i) % 2 == 0, F.lit("x")).alias(f"f{i}") for i in range(9)))
    out = L.field_batches(L.missing_fields(rows, "o_orderkey", [f"f{i}" for i in range(9)], {"f8"}), "o_orderkey", 3)
    return out.select("o_orderkey", F.col("batch").cast("long").alias("batch"), F.array_join("fields", ",").alias("fields"))


@query
def backfill_status(t: Tables) -> DataFrame:
    base = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("v"))
    fresh = t.orders.where("o_orderkey % 2 = 0").select("o_custkey", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("v"))
    return L.backfill_status(base, fresh, "o_custkey", "v").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Features and scores


def labelled(t: Tables) -> DataFrame:
    """(doc_id, y, p, n_chars, n_lines): quality against a score that grows with length."""
    rows = t.labels.join(t.documents.select("doc_id", "text"), "doc_id")
    n = F.char_length("text").cast("double")
    return rows.select("doc_id", F.col("quality").alias("y"), "toxic", F.round(n / (n + 2000), 4).alias("p"), n.alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"), X.occurrences(F.col("text"), "!").cast("double").alias("n_marks"))


@query
def impute_median(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return M.impute_numeric(rows, ["c_acctbal"], "median").select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


@query
def impute_mode(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return M.impute_mode(rows, ["c_mktsegment"])


@query
def standard_scale(t: Tables) -> DataFrame:
    return M.standard_scale(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query
def label_encode(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("segment"))
    return M.label_codes(rows, "segment", "code").select("c_custkey", "code")


@query
def onehot(t: Tables) -> DataFrame:
    rows = M.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    return rows.agg(*(F.sum(c).cast("long").alias(c) for c in rows.columns if c != "o_orderkey"))


@query
def time_split(t: Tables) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    return M.time_split(t.orders.select("o_orderkey", "o_orderdate"), day, "o_orderkey").select("o_orderkey", "split")


@query
def stratified_split(t: Tables) -> DataFrame:
    return M.stratified_split(t.labels, "quality", "doc_id").groupBy("quality", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def anova_f(t: Tables) -> DataFrame:
    return M.anova_f(labelled(t), ["n_chars", "n_lines"], "y").select("column", F.round("f", 6).alias("f"))


@query
def chi2_score(t: Tables) -> DataFrame:
    return M.chi2(labelled(t), ["n_chars", "n_lines"], "y").select("column", F.round("chi2", 4).alias("chi2"))


@query
def mutual_info(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    return M.mutual_information(rows, ["lang", "source", "toxic"], "quality").select("column", F.round("mi", 6).alias("mi"))


@query
def importance_cumulative(t: Tables) -> DataFrame:
    return M.cumulative_share(M.anova_f(labelled(t), ["n_chars", "n_lines", "p"], "y"), "f").select("column", "rank", "cumulative")


@query
def confusion_metrics(t: Tables) -> DataFrame:
    return E.confusion(labelled(t), "y", "p", 0.5)


@query
def roc_auc(t: Tables) -> DataFrame:
    return E.roc_auc(labelled(t), "y", "p")


@query
def avg_precision(t: Tables) -> DataFrame:
    return E.average_precision(labelled(t), "y", "p")


@query
def threshold_sweep(t: Tables) -> DataFrame:
    return E.threshold_sweep(labelled(t), "y", "p").select("step", "tp", "fp", "fn", "precision", "recall", "f1")


@query
def windowed_events(t: Tables) -> DataFrame:
    rows = incremental.windowed_counts(t.events, "ts", "event_type", "value")
    return rows.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# Groups, lists, scalars


@query
def demographics_pivot(t: Tables) -> DataFrame:
    """Customers of each nation by segment, as if segments were categories of a group."""
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("string").alias("n"))
    words = {"cars": ["automobile"], "houses": ["building", "household"], "machines": ["machinery"]}
    return GR.demographics(counts, ["c_nationkey"], "c_mktsegment", "n", words).select("c_nationkey", "cars", "houses", "machines", "other", "total", "heterogeneity")


@query
def outcome_limit(t: Tables) -> DataFrame:
    """All returned lines of an order, and its first three others."""
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.when(F.col("l_returnflag") == "R", "Primary").otherwise("Secondary").alias("kind"))
    return GR.first_outcomes(rows, "l_orderkey", "kind", "at").groupBy("l_orderkey", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def ordered_distinct_join(t: Tables) -> DataFrame:
    """Each customer's order priorities in order of first sight."""
    said = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return said.select("o_custkey", A.distinct_join(F.transform("l", lambda x: x["o_orderpriority"])).alias("priorities"))


@query
def missing_gate(t: Tables) -> DataFrame:
    rows = t.part.select("p_name", F.when(F.col("p_size") > 30, F.col("p_brand")).alias("some"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("most"), F.lit(" ").alias("blank"))
    kept, wide = M.dense_columns(rows, rows.columns, 0.5), M.wide_columns(rows, rows.columns, 20)
    return t.spark.createDataFrame([(c, c in kept, c in wide) for c in rows.columns], "`column` string, kept boolean, wide boolean")


@query
def top_ratio_features(t: Tables) -> DataFrame:
    return M.top_ratio(M.anova_f(labelled(t), ["n_chars", "n_lines", "p"], "y"), "f", 0.7).select("column")


@query
def cv_folds(t: Tables) -> DataFrame:
    return M.folds(t.labels, "quality", "doc_id", 5).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n")).select("quality", F.col("fold").cast("long").alias("fold"), "n")


@query
def best_threshold(t: Tables) -> DataFrame:
    return E.best_threshold(E.threshold_sweep(labelled(t), "y", "p")).select("step", "tp", "fp", "fn", "f1")


@query
def adjacency_lists(t: Tables) -> DataFrame:
    return io.adjacency(relation_edges(t)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query
def upsert_rows(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_acctbal")
    return io.upsert(rows, rows.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])


@query
def resume_anti_join(t: Tables) -> DataFrame:
    """Documents that an index of three sources does not have yet."""
    done = t.documents.where(F.col("source").isin("src0", "src1", "src2")).select("doc_id")
    return t.documents.join(done, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def event_sessions(t: Tables) -> DataFrame:
    """Sessions of users, closed by thirty minutes without an event."""
    rows = incremental.sessions(t.events, "ts", "user_id")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


SAID_AGES = ["18 Years", "6 Months", "90 Days", "N/A", "", "26 Weeks", "2.5 years"]
SAID_MASKING = ["None (Open Label)", "Double (Participant, Investigator)", "Quadruple", "Single", "unknown", "Triple", "other"]


@query
def scalar_parsers(t: Tables) -> DataFrame:
    """Ages, blinding and gender of made-up registry texts."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    age, masking, sex = pick(SAID_AGES), pick(SAID_MASKING), pick(["All", "Female", "Male", "both", "N/A"])
    blinded, level = X.blinding(masking)
    return t.events.select(X.age_years(age).alias("age"), blinded.alias("blinded"), level.alias("level"), X.gender(sex).alias("sex")).groupBy("age", "blinded", "level", "sex").agg(F.count(F.lit(1)).alias("n"))


@query
def focus_lengths(t: Tables) -> DataFrame:
    """Each document's lines as chunks, whole, and their lengths."""
    rows = t.documents.select("lang", F.explode(F.transform(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != ""), lambda p: F.length(X.squeeze(p)))).alias("n"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


@query
def nested_study_records(t: Tables) -> DataFrame:
    """Customers as studies with their orders as outcomes and nations as conditions, as nested records."""
    studies = t.customer.select(F.col("c_custkey").alias("trial_id"), F.col("c_mktsegment").alias("phase"), F.col("c_name").alias("title"))
    outcomes = t.orders.select(F.col("o_custkey").alias("study_id"), F.col("o_orderstatus").alias("overall_status"), F.col("o_orderpriority").alias("outcome_type"))
    conditions = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("study_id"), F.col("n_name").alias("condition_name"))
    records = C.build(studies, {"outcomes": outcomes, "conditions": conditions})
    return records.select("trial_id", F.col("study.phase").alias("phase"), F.size("outcomes").cast("long").alias("n_outcomes"), C.focus_text(records, "condition").alias("condition"))


# Hits, records and answers


@query
def simhash_nearest(t: Tables) -> DataFrame:
    sigs = S.simhash(t.documents, "doc_id", F.col("text"))
    return V.simhash_top(sigs, queried(sigs, "id").withColumnRenamed("id", "query"), 5)


@query
def simhash_search(t: Tables) -> DataFrame:
    """The five documents most like each queried one: the 40 nearest signatures, ranked again by their tokens."""
    sigs = S.simhash(t.documents, "doc_id", F.col("text"))
    found = V.simhash_top(sigs, queried(sigs, "id").withColumnRenamed("id", "query"), 8 * 5)
    words = t.documents.select(F.col("doc_id").alias("id"), X.token_set(F.col("text")).alias("w"))
    pairs = found.select("query", "id").join(words, "id").join(words.select(F.col("id").alias("query"), F.col("w").alias("q")), "query")
    return V.reranked(found, pairs.select("query", "id", F.round(N.jaccard(F.col("w"), F.col("q")), 6).alias("score")), 5)


def answered(t: Tables) -> DataFrame:
    """Orders with an answer of one of seven kinds."""
    kinds = ["not json", '{"error": ""}', '{"error": "slow"}', '{"type": "tool", "tool": "x"}', '{"type": "lookup"}', 'see {"type": "final"} end', '{"type": "other"}']
    return t.orders.withColumn("answer", F.get(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 7).cast("int")))


@query
def response_errors(t: Tables) -> DataFrame:
    return V.response_status(answered(t), ["o_orderpriority"], "answer")


@query
def answer_actions(t: Tables) -> DataFrame:
    asked = answered(t).select(V.action(F.col("answer"), ["search", "lookup"]).alias("a"))
    return asked.groupBy("a.kind", "a.tool").agg(F.count(F.lit(1)).alias("n"))


@query
def json_spans(t: Tables) -> DataFrame:
    text = F.concat(F.lit("note "), F.col("o_orderpriority"), F.lit(' {"k": "a}\\"b", "n": ['), F.col("o_orderkey").cast("string"), F.lit("]} end }"))
    return t.orders.select("o_orderkey", V.balanced(text).alias("span"))


@query
def one_or_list(t: Tables) -> DataFrame:
    return V.one_or_list(t.lineitem, ["l_orderkey"], "l_returnflag", "l_linenumber")


@query
def start_dates(t: Tables) -> DataFrame:
    """The day of each customer's first order."""
    days = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return V.with_start(t.customer.select("c_custkey", "c_mktsegment"), days, "c_custkey", "day")


@query
def missing_order(t: Tables) -> DataFrame:
    rows = t.part.select("p_name", F.when(F.col("p_size") > 30, F.col("p_type")).alias("some"), F.when(F.col("p_size") > 10, F.lit(" ")).alias("blank"))
    return V.missing_rates(rows, rows.columns)


@query
def record_blobs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", V.search_blob(F.col("p_name"), F.when(F.col("p_size") > 30, F.col("p_type")), V.criteria_text(F.col("p_brand"), F.col("p_name"), 12)).alias("blob"))


@query
def record_snippets(t: Tables) -> DataFrame:
    """Customers with an endpoint, with criteria, or with a title alone."""
    kind, none = F.col("c_custkey") % 3, F.lit("")
    end = F.struct(none.alias("primary_endpoint"), F.col("c_name").alias("primary_endpoint_domain"), none.alias("primary_endpoint_subdomain"))
    out = F.array(F.struct(none.alias("outcome_type"), none.alias("why_terminated"), none.alias("overall_status")))
    chosen = V.pick_snippet(F.filter(F.array(end), lambda _: kind == 0), F.when(kind == 1, F.col("c_mktsegment")), none, none, F.lit("title"), out, none)
    return t.customer.select("c_custkey", chosen.alias("snippet"))


@query
def nested_defaults(t: Tables) -> DataFrame:
    study = F.struct(F.when(F.col("p_size") > 30, F.col("p_name")).alias("title"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("phase"))
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, study).alias("study"), F.when(F.col("p_size") > 20, F.array("p_brand")).alias("arms"))
    full = V.with_defaults(rows, {"study.title": "", "study.phase": 0, "arms": []})
    return full.select("p_partkey", "study.title", F.col("study.phase").cast("long").alias("phase"), F.size("arms").cast("long").alias("n_arms"))


# Without an exact counterpart in SQL


@query
def fuzzy_match(t: Tables) -> DataFrame:
    """Customers and suppliers of a nation by name."""
    left = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("l_id"), F.regexp_replace("c_name", "Customer", "Party").alias("l_title"), F.lit("").alias("l_text"))
    right = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("r_id"), F.regexp_replace("s_name", "Supplier", "Party").alias("r_title"), F.lit("").alias("r_text"))
    return Z.best_match(left, right, ["nation"])


@query
def train_lr_cv(t: Tables) -> DataFrame:
    return G.out_of_fold(labelled(t), ["n_chars", "n_lines", "n_marks"], "y", "doc_id", "logistic", 5)


@query
def bootstrap_ci(t: Tables) -> DataFrame:
    return E.bootstrap(labelled(t), "y", "p", "doc_id", "accuracy", 1000)


@query
def whatif(t: Tables) -> DataFrame:
    rows = labelled(t)
    columns = ["n_chars", "n_lines", "n_marks"]
    model = G.ZOO["logistic"](maxIter=30).fit(G.assembled(rows, columns, "y"))
    return G.what_if(model, rows, columns, "doc_id", rows.where("y = 0"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in QUERIES}
