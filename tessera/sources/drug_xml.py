"""Drug knowledge-base XML to records: identity, groups, synonyms with brands, pharmacology, targets, properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as X

POLYPEPTIDE = "struct<_id:string,`gene-name`:string>"
SCHEMA = f"""
_type string, `drugbank-id` array<struct<_VALUE:string,_primary:string>>, name string, indication string, `mechanism-of-action` string,
pharmacodynamics string, absorption string, metabolism string, toxicity string, `half-life` string,
groups struct<`group`:array<string>>, synonyms struct<synonym:array<struct<_VALUE:string,_language:string>>>,
`international-brands` struct<`international-brand`:array<struct<name:string>>>,
targets struct<target:array<struct<name:string,organism:string,actions:struct<action:array<string>>,polypeptide:array<{POLYPEPTIDE}>>>>,
`calculated-properties` struct<property:array<struct<kind:string,value:string>>>, `experimental-properties` struct<property:array<struct<kind:string,value:string>>>
"""
PHARMACOLOGY = ["pharmacodynamics", "absorption", "metabolism", "toxicity", "half-life"]


def records(spark: SparkSession, path: str) -> DataFrame:
    """A row a drug. Only elements with a type are drugs; the same tag inside others is a reference and has none. The scan is split by
    record, so a file of any size is read in parallel."""
    rows = spark.read.format("xml").option("rowTag", "drug").schema(" ".join(SCHEMA.split())).load(path).where("_type is not null")
    ids = F.col("drugbank-id")
    primary = F.coalesce(F.get(F.filter(ids, lambda i: i["_primary"] == "true"), F.lit(0))["_VALUE"], F.get(ids, F.lit(0))["_VALUE"])
    none = F.array().cast("array<string>")
    names = F.concat(F.coalesce(F.transform("synonyms.synonym", lambda s: s["_VALUE"]), none), F.coalesce(F.transform(F.col("international-brands.international-brand"), lambda b: b["name"]), none))
    genes = lambda t: F.array_distinct(F.filter(F.transform(F.coalesce(t["polypeptide"], F.array()), lambda p: p["gene-name"]), lambda g: g.isNotNull()))
    targets = F.transform(F.coalesce(F.col("targets.target"), F.array()), lambda t: F.struct(X.squeeze(t["name"]).alias("name"), t["organism"].alias("organism"), F.coalesce(t["actions"]["action"], none).alias("actions"), genes(t).alias("genes")))
    kinds = lambda c: A.first_by_kind(F.coalesce(F.col(c), F.array()), "kind", "value")
    return rows.select(
        primary.alias("drugbank_id"), X.squeeze(F.col("name")).alias("name"), F.coalesce(F.col("groups.group"), none).alias("groups"), A.distinct_any_case(A.clean_list(names, 1000)).alias("synonyms"),
        X.squeeze(F.col("indication")).alias("indication"), X.squeeze(F.col("mechanism-of-action")).alias("mechanism_of_action"), targets.alias("targets"),
        F.struct(kinds("`calculated-properties`.property").alias("calculated"), kinds("`experimental-properties`.property").alias("experimental")).alias("properties"),
        F.struct(*(X.squeeze(F.col(f"`{c}`")).alias(c.replace("-", "_")) for c in PHARMACOLOGY)).alias("pharmacology"),
    )
