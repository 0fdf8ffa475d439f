"""Corpus building, results groups and the drug knowledge base."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import corpus as C
from tessera.operators import groups as G
from tessera.sources import drug_xml


def test_build(spark):
    studies = spark.createDataFrame([(1, "s", "T", "P2"), (1, "s", "T", "P2"), (2, "s", None, "P1")], "NCT_ID int, study_source string, title string, phase string")
    conditions = spark.createDataFrame([("1", "flu"), ("1", "Flu"), ("1", None), ("9", "x")], "study_id string, condition_name string")
    drugs = spark.createDataFrame([("1", 7, "drug a"), ("2", 8, "drug b")], "study_id string, drug_moa_id int, drug_name string")
    moa = spark.createDataFrame([("7", "T1", "inhibitor")], "drug_moa_id string, target_name string, moa string")
    records = C.build(studies, {"conditions": conditions, "drugs": drugs}, moa).orderBy("trial_id")
    one, two = records.collect()
    assert [c.condition_name for c in one.conditions] == ["Flu", "flu"] and one.study.title == "T" and [m.moa for m in one.drug_moa] == ["inhibitor"]
    assert two.conditions == [] and two.drug_moa == []
    text = records.select(C.focus_text(records, "conditions"), C.focus_text(records, "anything")).first()
    assert tuple(text) == ("Flu", "Flu drug a inhibitor T")
    assert [(r.trial_id, r.text) for r in C.focus_chunks(records, "full", 4).where("trial_id = '1'").collect()] == [("1", "Flu"), ("1", "drug"), ("1", "T")]
    assert C.match_basis(records).first().drug == ["drug a", "inhibitor"]
    assert [r.trial_id for r in C.get_many(records, ["2", "zz", "1"]).collect()] == ["2", "1"]
    with pytest.raises(ValueError, match="unknown focus"):
        C.focus_values(records, "zzz")


def test_relations(spark):
    studies = spark.createDataFrame([("S1",)], "study_id string")
    rel = spark.createDataFrame([("S1", "Trial", "d1", None), ("x", "a", "y", "b")], "head_id string, head_type string, tail_id string, tail_type string")
    assert sorted(map(tuple, C.relation_edges(rel, studies).collect())) == [("study:S1", "unknown:d1"), ("unknown:d1", "study:S1")]


def test_names_and_additions(spark):
    drugs = spark.createDataFrame([("DB2", "Alpha", ["Beta (x)"]), ("DB1", "beta", None)], "drugbank_id string, name string, synonyms array<string>")
    assert sorted(map(tuple, C.drug_names(drugs).collect())) == [("alpha", "DB2"), ("beta", "DB1")]
    studies = spark.createDataFrame([(1, "s", "Inclusion a Exclusion b"), (2, "s", None)], "study_id int, study_source string, criteria string")
    own = spark.createDataFrame([(1, "DB1"), (1, "DB9")], "study_id int, drugbank_id string")
    smiles = spark.createDataFrame([("DB1", "CC")], "drugbank_id string, smiles string")
    conditions = spark.createDataFrame([(1, " Flu ")], "study_id int, condition_name string")
    codes = spark.createDataFrame([("flu", "J10")], "term string, code string")
    got = C.addition_table(studies, own, smiles, conditions, codes).orderBy("study_id").collect()
    assert [(r.criteria_inclusion_text, r.criteria_exclusion_text, r.smiles, r.icd_codes) for r in got] == [("Inclusion a", "Exclusion b", ["CC"], ["J10"]), ("", "", [], [])]


def test_dataset(spark):
    labels = spark.createDataFrame([("A", 1), ("B", 0)], "StudyID string, y int")
    design = spark.createDataFrame([("A", "2", None), ("B", "1", None), ("C", "9", "q")], "StudyID string, arms string, rare string")
    drug = spark.createDataFrame([("A", 1.0, "x", "same"), ("A", 3.0, "y", "same"), ("B", 2.0, "z", "other")], "StudyID string, dose double, route string, arms string")
    allow = spark.createDataFrame([("design", "arms", "categorical"), ("design", "rare", "categorical"), ("drug", "dose", "continuous"), ("drug", "arms", "text"), ("drug", "route", "categorical")], "table string, variable string, kind string")
    got = C.dataset(labels, {"design": design, "drug": drug}, allow).orderBy("StudyID")
    assert got.columns == ["StudyID", "y", "arms", "arms_drug"] and [tuple(r) for r in got.collect()] == [("A", 1, "2", 1.0), ("B", 0, "1", 1.0)]


def test_groups(spark):
    flow = spark.createDataFrame([(1, "COMPLETED", "8"), (1, "STARTED", "10 people"), (2, "TREATED", "5"), (3, "OTHER", "4")], "g int, m string, v string")
    assert sorted(map(tuple, G.started(flow, ["g"], "m", "v").collect())) == [(1, 10), (2, 5)]
    race = spark.createDataFrame([(1, "Caucasian", "6"), (1, "Asian", "3"), (1, "Unknown", "1")], "g int, t string, v string")
    r = G.demographics(race, ["g"], "t", "v", G.RACES).first()
    assert (r.white, r.asian, r.other, r.black, r.total, r.white_share, r.heterogeneity) == (6, 3, 1, None, 10, "0.6", 0.54)
    sex = spark.createDataFrame([(1, "Female", "2"), (1, "Male", "1")], "g int, t string, v string")
    assert tuple(G.demographics(sex, ["g"], "t", "v", G.SEXES).select("female", "male").first()) == (2, 1)
    titles = spark.createDataFrame([(1, "Total"), (1, "A"), (2, "Overall")], "s int, t string")
    assert sorted(map(tuple, G.without_totals(titles, ["s"], "t").collect())) == [(1, "A"), (2, "Overall")]
    assert sorted(r.t for r in G.scoped(titles, "t", ["tot", "x"]).collect()) == ["Total"]
    arms = spark.createDataFrame([(1, "1", "Arm A", "low dose"), (1, "2", "Arm 7", "high")], "s int, arm_id string, title string, description string")
    groups = spark.createDataFrame([(1, "G1", "arm a", ""), (1, "2", "zzz", ""), (1, "G3", "Cohort 7", ""), (1, "G4", "q", "Low dose"), (1, "G5", "new one", "")], "s int, group_id string, title string, description string")
    assert {r.group_id: (r.arm_id, r.match) for r in G.align(groups, arms, "s").collect()} == {"G1": ("1", "title"), "2": ("2", "id"), "G3": ("2", "number"), "G4": ("1", "description"), "G5": ("new_1", "new")}
    outs = spark.createDataFrame([(1, "Primary", 0), *((1, "Secondary", i) for i in range(1, 6))], "s int, k string, i int")
    assert G.first_outcomes(outs, "s", "k", "i").count() == 4


def test_drug_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text("""<drugbank><drug type="small"><drugbank-id primary="true">DB1</drugbank-id><drugbank-id>X</drugbank-id><name>Alpha</name><groups><group>approved</group></groups>
<synonyms><synonym language="en">Al</synonym><synonym language="en">AL</synonym></synonyms><international-brands><international-brand><name>Brand</name></international-brand></international-brands>
<targets><target><name>T</name><organism>Humans</organism><actions><action>inhibitor</action></actions><polypeptide id="P1"><gene-name>G1</gene-name></polypeptide></target></targets>
<calculated-properties><property><kind>logP</kind><value>1</value></property><property><kind>logP</kind><value>2</value></property></calculated-properties></drug>
<drug type="biotech"><drugbank-id primary="true">DB2</drugbank-id><name>Beta</name></drug></drugbank>""")
    a, b = drug_xml.records(spark, f"{tmp_path}/d.xml").orderBy("drugbank_id").collect()
    assert (a.drugbank_id, a.groups, a.synonyms, a.targets[0].genes, a.properties.calculated) == ("DB1", ["approved"], ["Al", "Brand"], ["G1"], {"logP": "1"})
    assert (b.drugbank_id, b.synonyms, b.targets) == ("DB2", [], [])
    assert drug_xml.records(spark, f"{tmp_path}/d.xml").select(F.col("name")).count() == 2
