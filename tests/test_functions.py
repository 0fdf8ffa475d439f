"""Text, number and array functions against values worked out by hand."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tessera.functions import arrays as A
from tessera.functions import fuzzy as Z
from tessera.functions import numeric as N
from tessera.functions import text as X


def of(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (X.age_years, "18 Years", "18"),
        (X.age_years, "6 Months", "0.5"),
        (X.age_years, "90 Days", "0.25"),
        (X.age_years, "N/A", ""),
        (X.age_years, None, ""),
        (X.age_years, "26 weeks", "0.5"),
        (X.gender, "All", "Both"),
        (X.gender, "Female", "Female"),
        (X.gender, "male", "Male"),
        (X.gender, "Female and Male", "Both"),
        (X.gender, "not applicable", ""),
        (X.endpoint_type, "Objective Response Rate", "ORR"),
        (X.endpoint_type, "Oscillation index", "OS"),
        (X.endpoint_type, "Anaemia rate", "Safety"),
        (X.endpoint_type, None, ""),
        (X.yes_no_unknown, " Yes - planned", "Yes"),
        (X.yes_no_unknown, "None", "No"),
        (X.yes_no_unknown, "", "Unknown"),
        (X.tokens, "A-b +c, d.E", ["a-b", "+c", "d", "e"]),
        (X.squeeze, "  a  \n b ", "a b"),
        (X.sentences, "One. Two! Three? Four. Five.", ["One.", "Two!", "Three?", "Four."]),
        (X.trial_id, "see nct0123 and NCT9", "NCT0123"),
        (X.trial_id, "none", None),
        (X.eudract_id, "x 2010-123456-12 y", "2010-123456-12"),
        (X.id_list, "NCT1, nct2 x\nNCT1", ["NCT1", "NCT2"]),
        (X.primary_drug, "Drug-A (old) + Drug B", "drug a"),
        (X.combo_parts, "a and b/c plus d; e", ["a", "b", "c", "d", "e"]),
        (X.split_list, "a; b, |c", ["a", "b", "c"]),
        (X.region, "United  States", "NA"),
        (X.region, "Mexico", ""),
        (X.region, "congo, republic of the", "AF"),
        (X.region, "Cote d'Ivoire", "AF"),
        (X.region, "Israel", "AP"),
        (X.region, "Sweden", ""),
        (X.region, "Germany", "WEU"),
        (X.region, "Atlantis", ""),
        (X.placebo_like, "Matching Placebo", True),
        (X.label_key, "Arm A: 10 mg", "arma10mg"),
        (X.match_text, "Été  Nº1", "ete no1"),
        (X.match_text, "ﬁnal ½ β-x ™", "final 12 x tm"),
        (X.match_text, None, ""),
        (X.plain_text, "<p>a &lt; b</p><script>x</script>\n\n\n<b>c</b>", "a < b\n\nc"),
        (X.without_fence, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (X.pseudo_missing, " Not Reported ", True),
        (X.pseudo_missing, "none of these", False),
        (X.pseudo_missing, "\tNotApplicable\n", True),
        (X.pseudo_missing, "blank", False),
        (N.first_int, "a 12 b 3", 12),
        (N.first_float, "x -1.5", -1.5),
        (N.phase_value, "Phase 2/3", 2.5),
        (N.phase_value, None, 2.0),
        (N.endpoint_value, "OS", 0.9),
        (N.answer_hash, "ab", 97 * 31 + 98),
        (N.date_ordinal, "January 2, 0001", 2),
        (N.date_ordinal, "soon", 0),
        (A.outer_json, 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        (A.outer_json, "x {a y", None),
    ],
)
def test_text(spark, f, value, want):
    assert of(spark, f, value) == want


def test_blinding(spark):
    row = lambda v: tuple(spark.createDataFrame([(v,)], "c string").select(*X.blinding(F.col("c"))).first())
    assert [row(v) for v in ("None (Open Label)", "Double (Participant, Investigator)", "Quadruple", "Single", None, "unknown")] == [("No", "0"), ("Yes", "2"), ("Yes", "4"), ("Yes", "1"), ("", ""), ("", "")]


def test_sections(spark):
    cut = lambda v: tuple(spark.createDataFrame([(v,)], "c string").select(*X.split_sections(F.col("c"), "inclusion", "exclusion")).first())
    assert cut("Inclusion: a\nExclusion: b") == ("Inclusion: a", "Exclusion: b")
    assert cut("Exclusion: b Inclusion: a") == ("Inclusion: a", "Exclusion: b")
    assert cut("x inclusion y") == ("inclusion y", "")
    assert cut("x exclusion y") == ("", "exclusion y")
    assert cut("plain") == ("plain", "") and cut(None) == ("", "")


def test_snippets(spark):
    df = spark.createDataFrame([("a" * 50 + " needle " + "b" * 50,)], "c string")
    got = df.select(X.window_around(F.col("c"), F.lit("NEEDLE"), 5), X.snippet(F.col("c"), 10), X.occurrences(F.col("c"), "b"), X.keyword_hits(F.col("c"), ["needle", "x"])).first()
    assert tuple(got) == ("...aaaa needle bbbb...", "aaaaaaa...", 50, 1)


def test_numbers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert get(N.ratio_text(lit(1), lit(3))) == "0.3333" and get(N.ratio_text(lit(1), lit(2))) == "0.5" and get(N.ratio_text(lit(1), lit(0))) == ""
    assert get(N.strictness(lit(80), lit(2), lit(1.0), lit(None).cast("double"))) == pytest.approx(0.237)
    assert get(N.strictness(lit(100), lit(0), lit(None).cast("double"), lit(None).cast("double"))) == 0.062
    assert get(N.strictness_label(lit(0.237))) == "permissive"
    assert get(N.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b")))) == 0.5 and get(N.jaccard(F.array().cast("array<string>"), F.array(lit("b")))) == 0
    assert get(N.hamming(lit(5).cast("long"), lit(-1).cast("long"))) == 62
    assert get(F.get(N.band_ids([lit(0), lit(0), lit(5)]), lit(2))) == 131077
    assert get(N.unit(F.array(lit(3.0), lit(4.0)))) == [0.6, 0.8] and get(N.unit(F.array(lit(0.0)))) == [0.0]
    assert get(N.heterogeneity(F.array(lit(1), lit(1), lit(None).cast("int")))) == 0.5
    assert get(N.finite(F.array(lit(1.0), lit(float("nan"))))) is False


def test_arrays(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    arr = lambda *v: F.array(*(F.lit(x).cast("string") for x in v))
    assert get(A.distinct_join(arr("b", " a ", None, "a", ""))) == "b; a"
    assert get(A.distinct_any_case(arr("Ab", "aB", "c"))) == ["Ab", "c"]
    assert get(A.compact(arr("x" * 300, "", "y"), 10, 5)) == ["xxxxxxx...", "y"]
    assert get(A.batches(arr("a", "b", "c"), 2)) == [["a", "b"], ["c"]] and get(A.batches(arr(), 2)) == []
    assert get(A.packed(arr("aaa", "bb", "c", "dddddddd", "e"), 5)) == [0, 0, 1, 2, 3]
    assert get(A.focus_text(F.lit("a"), F.lit(None), F.lit(" "), F.lit("b"))) == "a b"
    assert get(A.chunks(2, F.lit("abc"), F.lit(""))) == ["ab"]
    src = F.lit("the quick brown fox")
    assert get(A.evidence_holds(F.lit("quick | fox"), src)) and not get(A.evidence_holds(F.lit("quick | dog"), src)) and not get(A.evidence_holds(F.lit(""), src))
    assert not get(A.evidence_holds(F.lit("x" * 241), F.lit("x" * 300)))
    kinds = F.array(F.struct(F.lit("a").alias("k"), F.lit("1").alias("v")), F.struct(F.lit("a").alias("k"), F.lit("2").alias("v")))
    assert get(A.first_by_kind(kinds, "k", "v")) == {"a": "1"}
    assert get(A.target_text(F.lit("T"), arr("g1", "g2"))) == "T (g1; g2)"


def test_similarity(spark):
    df = spark.createDataFrame([("night", "nacht"), ("a", "b"), ("same", "same")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(Z.bigram_dice(F.col("a"), F.col("b"))).collect()] == [0.25, 0.0, 1.0]
    assert [r[0] for r in df.select(Z.block_ratio("a", "b")).collect()] == [60.0, 0.0, 100.0]
    left = spark.createDataFrame([(1, 1, "Arm A", "drug"), (1, 2, "Placebo arm", "x"), (1, 3, "zzz", "q")], "s int, l_id int, l_title string, l_text string")
    right = spark.createDataFrame([(1, 7, "arm a", "drug"), (1, 8, "placebo arms", "x")], "s int, r_id int, r_title string, r_text string")
    got = {r.l_id: (r.r_id, r.match) for r in Z.best_match(left, right, ["s"]).collect()}
    assert got == {1: (7, "title"), 2: (8, "fuzzy")}


def test_best_two_is_what_all_pairs_give():
    """Also where most pairs are never scored."""
    r = random.Random(4)
    said = lambda: f"party {r.randrange(300):06d}" + r.choice(["", " a", " b a"])
    right = pd.DataFrame([(t := said(), t + r.choice(["", " x"]), i) for i in range(60)], columns=["title", "text", "at"])
    left = pd.DataFrame([(t := said(), t + r.choice(["", " x"]), i) for i in range(80)], columns=["title", "text", "n"])
    want = []
    for title, text, n in left.itertuples(index=False):
        scores = []
        for other, said_there, at in right.itertuples(index=False):
            a, b = set(text.split()), set(said_there.split())
            ratio = float(round(100 * SequenceMatcher(None, text, said_there).ratio()))
            scores.append((other != title, -max(ratio, 100.0 * len(a & b) / max(len(a), len(b))), at))
        want += [(n, at, not apart, -s) for apart, s, at in sorted(scores)[:2]]
    assert list(Z.best_two(left, right).itertuples(index=False, name=None)) == want
