"""Study corpora: nested records from table families, relation edges, focus projections, knowledge-base joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as X
from tessera.operators import relational as R

KEYS = ["study_id", "nct_id", "nctid", "trial_id"]

# The logical columns of each table family.
STUDY = ["study_source", "trial_type", "title", "abstract", "sponsor", "start_year", "recruitment_status", "phase", "actual_accrual", "target_accrual", "min_age", "max_age", "min_age_unit", "max_age_unit", "sex", "healthy_volunteers"]
CHILDREN = {
    "conditions": ["condition_name", "condition_mesh_id", "condition_mesh_type"],
    "drugs": ["drug_moa_id", "drug_name", "rx_normalized_name", "rx_source", "rx_mapping_id", "drugbank_name", "drugbank_id", "drugbank_mesh_id", "drug_source", "fda_approved", "ema_approved", "pmda_approved", "drug_description"],
    "biomarkers": ["biomarker_type", "biomarker_name", "biomarker_genes"],
    "endpoints": ["primary_endpoint", "primary_endpoint_domain", "primary_endpoint_subdomain"],
    "outcomes": ["overall_status", "outcome_type", "why_terminated"],
    "results": ["population", "interventions", "outcomes", "group_type"],
    "disposition": ["intervention_type", "intervention_name", "intervention_description", "group_type", "number_of_subjects"],
    "adverse_events": ["adverse_event_name", "adverse_event_description", "is_serious", "meddra_id", "meddra_id_type"],
}
MECHANISM = ["target_name", "target_class", "gene", "action_type", "moa", "organism"]
FOCUS = {
    "condition": ["conditions.condition_name"],
    "drug": ["drugs.drug_name", "drugs.rx_normalized_name", "drug_moa.moa"],
    "biomarker": ["biomarkers.biomarker_name", "biomarkers.biomarker_genes"],
    "endpoint": ["endpoints.primary_endpoint", "endpoints.primary_endpoint_domain"],
    "study": ["study.title", "study.abstract"],
    "outcome": ["outcomes.outcome_type", "outcomes.why_terminated"],
}
ALIASES = {"conditions": "condition", "drugs": "drug", "biomarkers": "biomarker", "endpoints": "endpoint", "outcomes": "outcome", "title": "study"}


def keyed(df: DataFrame, fields: list[str]) -> DataFrame:
    """(study_id as text, the fields that exist)."""
    own = R.resolve(df, {"study_id": KEYS} | {f: [] for f in fields})
    return own.withColumn("study_id", F.col("study_id").cast("string")).where("study_id is not null")


def build(studies: DataFrame, children: dict[str, DataFrame], mechanisms: DataFrame | None = None, allowed: DataFrame | None = None, most: int = 20) -> DataFrame:
    """Nested records: trial_id, source, study, a list for each child family, and the mechanisms of the drugs.

    Child families are reduced to a row a study before they are joined; studies that repeat count once."""
    base = R.filter_ids(keyed(studies, STUDY), "study_id", allowed)
    fields = [c for c in base.columns if c != "study_id"]
    base = R.keep_first(base, ["study_id"], [F.col(f).asc_nulls_last() for f in fields] or [F.lit(0)])
    base = base.select("study_id", F.struct(*fields).alias("study"))
    own = {n: keyed(df, CHILDREN.get(n, [c for c in df.columns if c.lower() not in KEYS])) for n, df in children.items()}
    kids = {n: (df, [c for c in df.columns if c != "study_id"]) for n, df in own.items()}
    if mechanisms is not None and "drugs" in own and "drug_moa_id" in own["drugs"].columns:
        moa = R.resolve(mechanisms, {"drug_moa_id": []} | {f: [] for f in MECHANISM}).withColumn("drug_moa_id", F.col("drug_moa_id").cast("string"))
        joined = own["drugs"].select("study_id", F.col("drug_moa_id").cast("string").alias("drug_moa_id")).distinct().join(moa, "drug_moa_id", "left")
        kids["drug_moa"] = (joined, [c for c in moa.columns if c != "drug_moa_id"])
    records = R.nested_records(base, kids, "study_id", most)
    return records.withColumnRenamed("study_id", "trial_id").withColumn("source", F.lit("tables"))


def relation_edges(relations: DataFrame, studies: DataFrame) -> DataFrame:
    """(src, dst) both ways, of relations that touch a known study; ids of studies are named as such whatever the type says."""
    known = studies.select(F.col(R.pick(studies, KEYS)).cast("string").alias("id"))
    rows = R.marked(R.marked(relations.withColumns({"head_id": F.col("head_id").cast("string"), "tail_id": F.col("tail_id").cast("string")}), "head_id", known, "_h"), "tail_id", known, "_t")
    end = lambda side, flag: F.when(F.col(flag), R.node(F.lit("study"), F.col(f"{side}_id"))).otherwise(R.node(F.col(f"{side}_type"), F.col(f"{side}_id")))
    return R.symmetric_edges(rows.where("_h or _t").select(end("head", "_h").alias("src"), end("tail", "_t").alias("dst")))


def focus_values(records: DataFrame, focus: str) -> Column:
    """The texts of a focus, squeezed, distinct, in order."""
    name = ALIASES.get(focus, focus)
    if name not in FOCUS:
        raise ValueError(f"unknown focus {focus}")
    columns, parts = set(records.columns), []
    for path in FOCUS[name]:
        top, field = path.split(".")
        if top in columns:
            kind = records.schema[top].dataType
            inner = getattr(kind, "elementType", kind)
            if field in getattr(inner, "names", []):
                value = F.col(path).cast("array<string>") if hasattr(kind, "elementType") else F.array(F.col(path).cast("string"))
                parts.append(F.coalesce(value, F.array().cast("array<string>")))
    return A.distinct_any_case(A.clean_list(F.concat(*parts), 1000)) if parts else F.array().cast("array<string>")


def focus_text(records: DataFrame, focus: str = "full") -> Column:
    """One text for a focus; any other name than a focus gives all of them."""
    names = [focus] if ALIASES.get(focus, focus) in FOCUS else list(FOCUS)
    return A.focus_text(*(F.array_join(focus_values(records, n), " ") for n in names))


def focus_chunks(records: DataFrame, focus: str = "full", most_chars: int = 8000) -> DataFrame:
    """(trial_id, chunk_no, text): a chunk for each focus that has text, cut to so many characters."""
    names = [focus] if ALIASES.get(focus, focus) in FOCUS else list(FOCUS)
    parts = A.chunks(most_chars, *(F.array_join(focus_values(records, n), " ") for n in names))
    return records.select("trial_id", F.posexplode(parts).alias("chunk_no", "text"))


def match_basis(records: DataFrame, most: int = 10) -> DataFrame:
    """(trial_id, focus columns): the values that a match can rest on, at most `most` a focus."""
    return records.select("trial_id", *(F.slice(focus_values(records, n), 1, most).alias(n) for n in ("condition", "drug", "biomarker", "endpoint")))


def get_many(records: DataFrame, ids: list[str]) -> DataFrame:
    """Records by id in the order asked for; those that are missing are left out."""
    wanted = records.sparkSession.createDataFrame(list(enumerate(ids)), "place int, trial_id string")
    return records.join(F.broadcast(wanted), "trial_id").orderBy("place").drop("place")


def drug_names(drugs: DataFrame) -> DataFrame:
    """(name, drugbank_id): names and synonyms for comparison; of drugs with one name the first by id has it."""
    rows = drugs.select("drugbank_id", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    return rows.select(X.drug_key(F.col("name")).alias("name"), "drugbank_id").where("name <> ''").groupBy("name").agg(F.min("drugbank_id").alias("drugbank_id"))


def addition_table(studies: DataFrame, drugs: DataFrame, smiles: DataFrame, conditions: DataFrame, codes: DataFrame) -> DataFrame:
    """Criteria, structures and codes of each study: (study_id, study_source, criteria_inclusion_text, criteria_exclusion_text, smiles, icd_codes).

    studies has `criteria`; smiles is (drugbank_id, smiles) and codes is (term, code), the terms lower case."""
    inclusion, exclusion = X.split_sections(F.col("criteria"), "inclusion", "exclusion")
    base = studies.select(F.col("study_id").cast("string").alias("study_id"), "study_source", inclusion.alias("criteria_inclusion_text"), exclusion.alias("criteria_exclusion_text"))
    found = drugs.select(F.col("study_id").cast("string").alias("study_id"), "drugbank_id").join(smiles, "drugbank_id").groupBy("study_id").agg(F.sort_array(F.collect_set("smiles")).alias("smiles"))
    coded = conditions.select(F.col("study_id").cast("string").alias("study_id"), F.lower(X.squeeze(F.col("condition_name"))).alias("term")).join(codes, "term").groupBy("study_id").agg(F.sort_array(F.collect_set("code")).alias("icd_codes"))
    none = F.array().cast("array<string>")
    return base.join(found, "study_id", "left").join(coded, "study_id", "left").withColumns({"smiles": F.coalesce("smiles", none), "icd_codes": F.coalesce("icd_codes", none)})


def dataset(labels: DataFrame, tables: dict[str, DataFrame], allowlist: DataFrame, key: str = "StudyID", most_missing: float = 0.5) -> DataFrame:
    """Labelled studies with the allowed features of each table: (table, variable, kind) says which; columns get the table's name on a clash.

    Tables with several rows a study lose columns with several values in one, and are reduced; columns with too many blanks go; texts
    become presence flags."""
    from tessera.operators import features as M

    wanted: dict[str, dict[str, str]] = {}
    for r in allowlist.select("table", "variable", "kind").collect():
        wanted.setdefault(r["table"], {})[r["variable"]] = r["kind"].lower()
    parts = {}
    for name, df in tables.items():
        columns = {c: k for c, k in wanted.get(name, {}).items() if c in df.columns}
        if not columns:
            continue
        own = R.filter_ids(df.select(key, *columns), key, labels.select(key))
        several = set(R.several_valued(own, key)) if own.groupBy(key).count().where("count > 1").limit(1).count() else set()
        kept = M.dense_columns(own, [c for c in columns if c not in several], most_missing)
        own = own.select(key, *(M.presence(F.col(c)).alias(c) if columns[c] == "text" else F.col(c) for c in kept))
        parts[name] = R.reduce_to_key(own, [key], kept or [key])
    return R.merge_left(labels, parts, [key])
