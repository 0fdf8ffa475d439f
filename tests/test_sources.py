"""Scans, sinks, registry documents, streams, and the entry points."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tessera.sources import io, registry_xml
from tessera.streaming import incremental

XML = """<clinical_study><id_info><nct_id>NCT00000001</nct_id><secondary_id>2010-123456-12</secondary_id></id_info><brief_title>A  title</brief_title>
<sponsors><lead_sponsor><agency>Org</agency><agency_class>Industry</agency_class></lead_sponsor></sponsors><phase>Phase 2</phase>
<study_design_info><allocation>Randomized</allocation><intervention_model>Parallel Assignment</intervention_model><masking>Double (Participant)</masking></study_design_info>
<condition>Asthma</condition><condition>Cough</condition><enrollment type="Actual">120</enrollment>
<arm_group><arm_group_label>Drug A</arm_group_label><arm_group_type>Experimental</arm_group_type><description>gets A</description></arm_group>
<arm_group><arm_group_label>Placebo</arm_group_label><arm_group_type>Placebo Comparator</arm_group_type></arm_group>
<intervention><intervention_type>Drug</intervention_type><intervention_name>A (alpha)</intervention_name><arm_group_label>Drug A</arm_group_label></intervention>
<intervention><intervention_type>Drug</intervention_type><intervention_name>Placebo pill</intervention_name><arm_group_label>Placebo</arm_group_label></intervention>
<eligibility><criteria><textblock>Inclusion Criteria: adults. Exclusion Criteria: none.</textblock></criteria><gender>All</gender><minimum_age>18 Years</minimum_age><maximum_age>N/A</maximum_age></eligibility>
<primary_outcome><measure>Overall Survival</measure></primary_outcome>
<location><facility><name>X</name><address><city>Bonn</city><country>Germany</country></address></facility></location>
<location><facility><name>Y</name><address><city>Rome</city><country>United States</country></address></facility></location>
<clinical_results><outcome_list><outcome><type>Primary</type><title>OS</title><group_list><group group_id="O1"><title>Drug A</title></group><group group_id="O2"><title>Other</title><description>got placebo</description></group></group_list>
<measure><title>OS</title><units>months</units><class_list><class><title>all</title><category_list><category><measurement_list><measurement group_id="O1" value="12.5" spread="1"/><measurement group_id="O2" value="9"/></measurement_list></category></category_list></class></class_list></measure>
<analysis_list><analysis><group_id_list><group_id>O1</group_id><group_id>O2</group_id></group_id_list><p_value>0.01</p_value><method>Log Rank</method></analysis></analysis_list></outcome></outcome_list></clinical_results></clinical_study>"""


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(XML,), ("<clinical_study><id_info></id_info></clinical_study>",), ("junk",)], "content string")


def test_design(docs):
    (r,) = registry_xml.design(docs).collect()
    assert (r.StudyID, r.EudraCT, r.Title, r.Randomized, r.Model, r.Blinded, r.Blinding_Level, r.Has_Control) == ("NCT00000001", "2010-123456-12", "A title", "Yes", "parallelassignment", "Yes", "2", "Yes")
    assert (r.Investigational, r.Enrolment_Actual, r.Enrolment_Planned, r.N_Centers, r.Centers_WEU, r.Centers_NA, r.Multi_Region) == ("A (alpha)", "120", "", "2", "1", "1", "Yes")


def test_population_and_record(docs):
    (r,) = registry_xml.population(docs).collect()
    assert (r.Conditions, r.Age_Min, r.Age_Max, r.Sex, r.Inclusion) == ("Asthma; Cough", "18", "", "Both", "Inclusion Criteria: adults.")
    (n,) = registry_xml.nested(docs).collect()
    assert n.endpoints.primary_type == "OS" and n.design.arms[0].name == "Drug A" and n.criteria.parsed.age_min == "18"
    assert "[conditions] Asthma; Cough" in registry_xml.text_blocks(docs).first().text


def test_drugs(spark, docs):
    names = spark.createDataFrame([("alpha", "DB1", False), ("a", "DB2", True)], "name_key string, drugbank_id string, approved boolean")
    got = {r.Drug_Name: r.DrugBank_ID for r in registry_xml.drugs(docs, names).collect()}
    assert got == {"A (alpha)": "DB2", "Placebo pill": ""}


def test_results(docs):
    (o,) = registry_xml.outcomes(docs).collect()
    assert (o.type, o.units, json.loads(o.analyses)[0]["p_value"]) == ("Primary", "months", "0.01")
    got = {r.group_id: (r.measure_id, r.value, r.group) for r in registry_xml.measurements(docs).collect()}
    assert got == {"O1": ("1.1.1.1", "12.5", "Drug A"), "O2": ("1.1.1.2", "9", "Other")}
    assert registry_xml.analyses(docs).first().groups == "O1; O2"
    arms = {r.group_id: (r.Arm, r.match, json.loads(r.points)[0]["value"]) for r in registry_xml.arm_results(docs).collect()}
    assert arms == {"O1": ("Drug A", "title", "12.5"), "O2": ("Placebo", "text", "9")}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ""), (2, "é\n", "x")], "id int, v string, w string")
    io.write_csv(df, f"{tmp_path}/csv", ["id", "v", "new"])
    assert [tuple(r) for r in io.csv(spark, f"{tmp_path}/csv").orderBy("id").collect()] == [("1", "a", None), ("2", "é\n", None)]
    io.write_parquet(df, f"{tmp_path}/t/studies_1.parquet")
    assert io.family(spark, f"{tmp_path}/t", "studies").count() == 2
    assert io.append_missing(spark, df, f"{tmp_path}/index", ["id"]) == 2 and io.append_missing(spark, df, f"{tmp_path}/index", ["id"]) == 0
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbad\n{"a": 2}\n')
    assert io.jsonl(spark, f"{tmp_path}/l.jsonl", "a int", strict=False).count() == 2
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        io.jsonl(spark, f"{tmp_path}/l.jsonl", "a int").collect()
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert io.json_any(spark, f"{tmp_path}/a.json", "a int").count() == 2
    assert io.manifest(spark, f"{tmp_path}/a.json").first().bytes == 21
    assert [r.id for r in io.id_list(spark.createDataFrame([("x", "NCT2, nct1")], "a string, NCTID string")).orderBy("id").collect()] == ["NCT1", "NCT2"]
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "id int, v string"), spark.createDataFrame([(2, "n")], "id int, v string")
    assert sorted(map(tuple, io.upsert(old, new, ["id"]).collect())) == [(1, "o"), (2, "n")]
    name = spark.range(1).select(io.download_name(F.lit("http://x.org/a b/Prot%20SAP.pdf?v=1"))).first()[0]
    assert name.startswith("Prot_20SAP_") and name.endswith(".pdf")


def test_entity_tables(spark, tmp_path):
    for entity, name, text in (("NCT1", "Design.csv", "a\nbase1\n"), ("NCT2", "Design.csv", "a\nbase2\n"), ("NCT2", "filled/Design_filled.csv", "a,b\nfill2,z\n")):
        path = tmp_path / entity / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = io.entity_tables(spark, str(tmp_path), "Design").orderBy("entity").select("entity", "a").collect()
    assert [tuple(r) for r in got] == [("NCT1", "base1"), ("NCT2", "fill2")]
    assert io.entity_tables(spark, str(tmp_path), "Design", "base").count() == 2


def test_stream_goes_on(spark, tmp_path):
    source, sink, done = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/done"
    for i in range(2):
        spark.createDataFrame([(i, "a b")], "id int, t string").write.mode("append").parquet(source)
        q = incremental.build_available(spark, source, "id int, t string", lambda b: b.select("id", F.explode(F.split("t", " ")).alias("token")), sink, done)
        q.awaitTermination(60)
        assert spark.read.parquet(sink).count() == 2 * (i + 1)


def test_without_corpus_operators(tmp_path):
    """The entry points work where the corpus operators and the pipeline are left out."""
    root = Path(__file__).resolve().parent.parent
    import shutil

    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
