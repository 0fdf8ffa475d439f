"""Registry documents (one XML a study) to relational tables: design, population, interventions, outcomes, arms, results.

A document's text is parsed by from_xml with a fixed schema, so a scan of many documents is one narrow projection; child tables are
explodes of it. Columns are texts, missing ones empty, as such tables have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as X

GROUP = "array<struct<_group_id:string,title:string,description:string>>"
MEASUREMENT = "array<struct<_group_id:string,_value:string,_spread:string,_lower_limit:string,_upper_limit:string>>"
SCHEMA = f"""
id_info struct<nct_id:string, org_study_id:string, secondary_id:array<string>>,
brief_title string, official_title string, overall_status string, why_stopped string, phase string, study_type string, start_date string,
sponsors struct<lead_sponsor:struct<agency:string,agency_class:string>, collaborator:array<struct<agency:string>>>,
oversight_info struct<has_dmc:string>,
study_design_info struct<allocation:string, intervention_model:string, primary_purpose:string, masking:string>,
condition array<string>, enrollment struct<_VALUE:string,_type:string>,
arm_group array<struct<arm_group_label:string, arm_group_type:string, description:string>>,
intervention array<struct<intervention_type:string, intervention_name:string, description:string, arm_group_label:array<string>, other_name:array<string>>>,
eligibility struct<criteria:struct<textblock:string>, gender:string, minimum_age:string, maximum_age:string, healthy_volunteers:string>,
primary_outcome array<struct<measure:string, time_frame:string, description:string>>,
secondary_outcome array<struct<measure:string, time_frame:string, description:string>>,
location array<struct<facility:struct<name:string, address:struct<city:string, country:string>>>>,
clinical_results struct<outcome_list:struct<outcome:array<struct<type:string, title:string, time_frame:string, population:string,
  group_list:struct<`group`:{GROUP}>,
  measure:struct<title:string, units:string, param:string, dispersion:string,
    class_list:struct<class:array<struct<title:string, category_list:struct<category:array<struct<title:string,
      measurement_list:struct<measurement:{MEASUREMENT}>>>>>>>>,
  analysis_list:struct<analysis:array<struct<group_id_list:struct<group_id:array<string>>, p_value:string, method:string, param_type:string, param_value:string, ci_lower_limit:string, ci_upper_limit:string>>>>>>>
"""


def studies(docs: DataFrame, content: str = "content") -> DataFrame:
    """docs with `x`, the parsed study; documents that do not parse, or have no id, are left out."""
    flat = " ".join(SCHEMA.split())
    return docs.withColumn("x", F.from_xml(content, flat, {"mode": "PERMISSIVE"})).where("x.id_info.nct_id is not null")


def text(path: str) -> Column:
    return X.squeeze(F.col(path))


def joined(values: Column) -> Column:
    return A.distinct_join(F.coalesce(values, F.array().cast("array<string>")))


def each(path: str, field: str) -> Column:
    return F.transform(F.coalesce(F.col(path), F.array()), lambda v: v[field])


def nested(docs: DataFrame) -> DataFrame:
    """Nested records: (trial_id, condition, phase, interventions, design, criteria, endpoints)."""
    inclusion, exclusion = X.split_sections(F.col("x.eligibility.criteria.textblock"), "inclusion", "exclusion")
    pair = lambda p, a, b, n, m: F.transform(F.coalesce(F.col(p), F.array()), lambda v: F.struct(X.squeeze(v[a]).alias(n), X.squeeze(v[b]).alias(m)))
    parsed = F.struct(X.age_years(F.col("x.eligibility.minimum_age")).alias("age_min"), X.age_years(F.col("x.eligibility.maximum_age")).alias("age_max"), X.gender(F.col("x.eligibility.gender")).alias("sex"))
    first = F.get(F.coalesce(F.col("x.primary_outcome"), F.array()), F.lit(0))["measure"]
    return studies(docs).select(
        F.col("x.id_info.nct_id").alias("trial_id"), A.clean_list(F.col("x.condition")).alias("condition"), text("x.phase").alias("phase"),
        pair("x.intervention", "intervention_type", "intervention_name", "type", "name").alias("interventions"),
        F.struct(text("x.study_design_info.allocation").alias("allocation"), text("x.study_design_info.masking").alias("masking"), text("x.study_design_info.primary_purpose").alias("primary_purpose"), pair("x.arm_group", "arm_group_label", "description", "name", "description").alias("arms")).alias("design"),
        F.struct(inclusion.alias("inclusion_text"), exclusion.alias("exclusion_text"), parsed.alias("parsed")).alias("criteria"),
        F.struct(pair("x.primary_outcome", "measure", "description", "name", "description").alias("primary"), pair("x.secondary_outcome", "measure", "description", "name", "description").alias("secondary"), X.endpoint_type(first).alias("primary_type")).alias("endpoints"),
    )


def design(docs: DataFrame) -> DataFrame:
    """A row a study: identity, sponsors, arms, randomization, blinding, control, enrolment, endpoints, centres by region."""
    blinded, level = X.blinding(F.col("x.study_design_info.masking"))
    types = F.transform(each("x.arm_group", "arm_group_type"), lambda t: F.lower(X.blank_if_null(t)))
    place = lambda v: v["facility"]["address"]["country"]
    centers = F.array_distinct(F.transform(F.coalesce(F.col("x.location"), F.array()), lambda v: F.struct(v["facility"]["name"].alias("n"), v["facility"]["address"]["city"].alias("c"), place(v).alias("k"))))
    names = lambda kind: F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(F.col("x.intervention"), F.array()), kind), lambda v: F.array(X.squeeze(v["intervention_name"])))))
    controls = F.transform(F.filter(F.coalesce(F.col("x.arm_group"), F.array()), lambda a: F.lower(X.blank_if_null(a["arm_group_type"])).rlike("comparator|control|placebo|sham")), lambda a: a["arm_group_label"])
    in_control = lambda v: F.arrays_overlap(F.coalesce(v["arm_group_label"], F.array().cast("array<string>")), controls)
    active = F.filter(F.array_except(names(lambda v: F.lit(True)), names(in_control)), lambda n: ~X.placebo_like(n))
    rows = studies(docs).select(
        F.col("x.id_info.nct_id").alias("StudyID"), joined(F.col("x.id_info.secondary_id")).alias("Secondary_IDs"), X.eudract_id(F.concat_ws(" ", "x.id_info.secondary_id")).alias("EudraCT"),
        text("x.brief_title").alias("Title"), text("x.phase").alias("Study_Phase"), text("x.start_date").alias("Start_Date"), text("x.overall_status").alias("Status"),
        text("x.sponsors.lead_sponsor.agency").alias("Sponsor"), text("x.sponsors.lead_sponsor.agency_class").alias("Sponsor_Class"), joined(each("x.sponsors.collaborator", "agency")).alias("Collaborators"),
        X.yes_no_unknown(F.col("x.oversight_info.has_dmc")).alias("Has_DMC"), F.size(types).cast("string").alias("N_Arms"),
        F.when(F.lower(text("x.study_design_info.allocation")).startswith("random"), "Yes").when(text("x.study_design_info.allocation") == "", "").otherwise("No").alias("Randomized"),
        F.regexp_replace(F.lower(text("x.study_design_info.intervention_model")), r"[\s\-_]+", "").alias("Model"), blinded.alias("Blinded"), level.alias("Blinding_Level"),
        F.when(F.exists(types, lambda t: t.rlike("comparator|control|placebo|sham")), "Yes").otherwise("No").alias("Has_Control"), A.distinct_join(active).alias("Investigational"),
        F.when(F.lower(X.blank_if_null(F.col("x.enrollment._type"))) == "actual", "").otherwise(X.blank_if_null(F.col("x.enrollment._VALUE"))).alias("Enrolment_Planned"),
        F.when(F.lower(X.blank_if_null(F.col("x.enrollment._type"))) == "actual", X.blank_if_null(F.col("x.enrollment._VALUE"))).otherwise("").alias("Enrolment_Actual"),
        F.size(each("x.primary_outcome", "measure")).cast("string").alias("N_Primary"), F.size(each("x.secondary_outcome", "measure")).cast("string").alias("N_Secondary"),
        F.transform(centers, lambda c: X.region(c["k"])).alias("_r"), F.size(centers).cast("string").alias("N_Centers"),
    )
    for name in X.REGIONS:
        rows = rows.withColumn(f"Centers_{name}", F.size(F.filter("_r", lambda r: r == name)).cast("string"))
    many = F.size(F.array_distinct(F.filter("_r", lambda r: r != ""))) >= 2
    return rows.withColumn("Multi_Region", F.when(many, "Yes").otherwise("No")).drop("_r")


def population(docs: DataFrame) -> DataFrame:
    inclusion, exclusion = X.split_sections(F.col("x.eligibility.criteria.textblock"), "inclusion", "exclusion")
    return studies(docs).select(
        F.col("x.id_info.nct_id").alias("StudyID"), joined(F.col("x.condition")).alias("Conditions"), X.age_years(F.col("x.eligibility.minimum_age")).alias("Age_Min"), X.age_years(F.col("x.eligibility.maximum_age")).alias("Age_Max"),
        X.gender(F.col("x.eligibility.gender")).alias("Sex"), text("x.eligibility.healthy_volunteers").alias("Healthy_Volunteers"), inclusion.alias("Inclusion"), exclusion.alias("Exclusion"),
    )


def drugs(docs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A row a drug of a study; with names (name_key, drugbank_id, approved) each gets the id of its best-known variant."""
    rows = studies(docs).select(F.col("x.id_info.nct_id").alias("StudyID"), F.explode("x.intervention").alias("v"))
    rows = rows.where(F.lower(X.blank_if_null(F.col("v.intervention_type"))).isin("drug", "biological", "combination product", "genetic"))
    rows = rows.select("StudyID", X.squeeze(F.col("v.intervention_name")).alias("Drug_Name"), joined(F.col("v.other_name")).alias("Other_Names"), joined(F.col("v.arm_group_label")).alias("Arms")).distinct()
    if names is None:
        return rows
    variants = rows.select("StudyID", "Drug_Name", F.explode(X.name_variants(F.col("Drug_Name"))).alias("name_key"))
    best = variants.join(names, "name_key").groupBy("StudyID", "Drug_Name").agg(F.min_by("drugbank_id", F.struct(~F.col("approved"), F.length("name_key") * -1, "drugbank_id")).alias("DrugBank_ID"))
    return rows.join(best, ["StudyID", "Drug_Name"], "left").withColumn("DrugBank_ID", F.coalesce("DrugBank_ID", F.lit("")))


def outcomes(docs: DataFrame) -> DataFrame:
    """A row a reported outcome, with its analyses as JSON."""
    rows = studies(docs).select(F.col("x.id_info.nct_id").alias("StudyID"), F.posexplode("x.clinical_results.outcome_list.outcome").alias("i", "o"))
    return rows.select("StudyID", (F.col("i") + 1).alias("outcome_id"), text("o.type").alias("type"), text("o.title").alias("title"), text("o.time_frame").alias("time_frame"), text("o.population").alias("population"), text("o.measure.units").alias("units"), F.coalesce(F.to_json("o.analysis_list.analysis"), F.lit("[]")).alias("analyses"))


def measurements(docs: DataFrame) -> DataFrame:
    """A row a measurement, with the titles of the class and category above it and the title of its group."""
    rows = studies(docs).select(F.col("x.id_info.nct_id").alias("StudyID"), F.posexplode("x.clinical_results.outcome_list.outcome").alias("i", "o"))
    rows = rows.select("StudyID", "i", "o.title", F.col("o.group_list.group").alias("groups"), F.posexplode("o.measure.class_list.class").alias("c", "class"))
    rows = rows.select("StudyID", "i", "title", "groups", "c", F.col("class.title").alias("class"), F.posexplode("class.category_list.category").alias("k", "cat"))
    rows = rows.select("StudyID", "i", "title", "groups", "c", "class", "k", F.col("cat.title").alias("category"), F.posexplode("cat.measurement_list.measurement").alias("m", "v"))
    group = F.get(F.filter("groups", lambda g: g["_group_id"] == F.col("v._group_id")), F.lit(0))
    ident = F.concat_ws(".", *((F.col(c) + 1).cast("string") for c in "ickm"))
    return rows.select("StudyID", (F.col("i") + 1).alias("outcome_id"), ident.alias("measure_id"), X.squeeze(F.col("title")).alias("outcome"), X.blank_if_null(F.col("class")).alias("class"), X.blank_if_null(F.col("category")).alias("category"), F.col("v._group_id").alias("group_id"), X.squeeze(group["title"]).alias("group"), F.col("v._value").alias("value"), F.col("v._spread").alias("spread"), F.col("v._lower_limit").alias("lower"), F.col("v._upper_limit").alias("upper"))


def analyses(docs: DataFrame) -> DataFrame:
    """A row an analysis of an outcome."""
    rows = studies(docs).select(F.col("x.id_info.nct_id").alias("StudyID"), F.posexplode("x.clinical_results.outcome_list.outcome").alias("i", "o"))
    rows = rows.select("StudyID", "i", F.posexplode("o.analysis_list.analysis").alias("a", "v"))
    return rows.select("StudyID", (F.col("i") + 1).alias("outcome_id"), (F.col("a") + 1).alias("analysis_id"), F.array_join("v.group_id_list.group_id", "; ").alias("groups"), "v.p_value", "v.method", "v.param_type", "v.param_value", "v.ci_lower_limit", "v.ci_upper_limit")


def arm_results(docs: DataFrame) -> DataFrame:
    """A row for each outcome and group: the group's arm and its points as JSON.

    A group is aligned to the first arm whose label equals its title, else whose label its title or description contains, else is an arm of
    its own."""
    parsed = studies(docs).select(F.col("x.id_info.nct_id").alias("StudyID"), "x.arm_group", F.posexplode("x.clinical_results.outcome_list.outcome").alias("i", "o"))
    groups = parsed.select("StudyID", "arm_group", (F.col("i") + 1).alias("outcome_id"), X.squeeze(F.col("o.title")).alias("outcome"), F.explode("o.group_list.group").alias("g"))
    labels = F.transform(F.coalesce("arm_group", F.array()), lambda a: X.squeeze(a["arm_group_label"]))
    key = X.label_key(F.col("g.title"))
    same = F.get(F.filter(labels, lambda v: (X.label_key(v) == key) & (key != "")), F.lit(0))
    said = X.label_key(F.concat_ws(" ", "g.title", "g.description"))
    near = F.get(F.filter(labels, lambda v: (F.length(X.label_key(v)) >= 3) & F.contains(said, X.label_key(v))), F.lit(0))
    groups = groups.select("StudyID", "outcome_id", "outcome", F.col("g._group_id").alias("group_id"), X.squeeze(F.col("g.title")).alias("group"), F.coalesce(same, near, X.squeeze(F.col("g.title"))).alias("Arm"), F.when(same.isNotNull(), "title").when(near.isNotNull(), "text").otherwise("new").alias("match"))
    points = measurements(docs).groupBy("StudyID", "outcome_id", "group_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("measure_id", "class", "category", "value"))), lambda v: F.struct(v["class"].alias("class"), v["category"].alias("category"), v["value"].alias("value")))).alias("points"))
    return groups.join(points, ["StudyID", "outcome_id", "group_id"], "left").withColumn("points", F.coalesce("points", F.lit("[]")))


def text_blocks(docs: DataFrame) -> DataFrame:
    """A row a study: its free texts in one, in a fixed order, each under its name."""
    parts = {"title": text("x.brief_title"), "conditions": joined(F.col("x.condition")), "criteria": text("x.eligibility.criteria.textblock"), "arms": joined(each("x.arm_group", "description")), "interventions": joined(each("x.intervention", "description")), "outcomes": joined(F.concat(each("x.primary_outcome", "measure"), each("x.secondary_outcome", "measure")))}
    named = F.filter(F.array(*(F.when(c != "", F.concat(F.lit(f"[{n}] "), c)) for n, c in parts.items())), lambda s: s.isNotNull())
    return studies(docs).select(F.col("x.id_info.nct_id").alias("StudyID"), F.array_join(named, "\n").alias("text"))
