"""Personal data, with DataFrame functions only: patterns propose spans, checksums confirm them, words near by adjust the score.

Patterns are written so that a scan stays linear in the text: possessive repeats, and starts only where a run of the class starts or
the last match ended; both find what the plain greedy pattern finds. A text is split by a pattern, and the lengths of gaps and matches,
summed up, give positions in code points.

The base kinds (email, ip, card, phone) are kept whenever their own rule holds. The further kinds are kept from a score of THRESHOLD:
  iban     two letters, two digits, 11 to 30 letters or digits, spaces allowed between groups of four; the mod-97 check must hold (0.8)
  ssn      ddd-dd-dddd in ranges that are issued (0.3)
  amex     15 digits starting with 34 or 37 that pass Luhn (0.5)
and words about such data within CONTEXT code points add 0.4, words about orders, parts or versions take 0.4 away. Base spans carry a
score as well, which `spans_of` reports but which does not drop them.

Defined cases: a null text is empty and has no spans; rows of equal id and text get equal results, one row each; a null doc_id stays a
row; spans of different kinds may overlap; an empty table gives no rows; a text of any length is scanned whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import columns, materialize, row_key, small

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "amex"]
CONTEXT = 40
THRESHOLD = 0.6

#: Of each kind: what a text must hold for the pattern to be tried, and the pattern.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
    "amex": (r"3[47][0-9]{2}", r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
}
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "amex": 0.5}
FOR = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|mastercard|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|whatsapp|t[eé]l[eé]fono?",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|taxpayer",
    "amex": "amex|american express|card|credit",
}
AGAINST = r"\border|invoice|isbn|serial|version|part no|tracking"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.split(F.reverse(number), "")
    value = F.transform(each, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check: moved by four, letters as 10 to 35, the remainder by 97 is 1."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    code = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(F.ascii(c) >= 65, a * 100 + code(c)).otherwise(a * 10 + code(c)) % 97) == 1


def confirmed(kind: Column, m: Column) -> Column:
    """The checks that a proposed span of a kind must pass."""
    n = F.length(digits(m))
    octet = F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$"))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", octet)
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits(m))).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "iban", mod97(F.regexp_replace(m, " ", "")))
        .when(kind == "amex", luhn(digits(m)))
        .otherwise(True)
    )


def spans_of(docs: DataFrame) -> DataFrame:
    """(key, rank, kind, start, end, base, score): confirmed spans; rank orders kinds as listed, end is exclusive."""
    docs = columns(docs, ["doc_id", "text"], ["long", "string"]).where("text is not null")
    text = F.col("text")
    tried = docs.where(F.concat(*(F.when(text.contains("@") if h == "@" else text.rlike(h), "1").otherwise("") for h, _ in PATTERNS.values())) != "")
    tried = materialize(tried.select(row_key().alias("key"), "text"), "tried")
    cut = []
    for rank, (kind, (hint, pattern)) in enumerate(PATTERNS.items()):
        one = tried.where(text.contains("@") if hint == "@" else text.rlike(hint))
        cut.append(one.select("key", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("ms")))
    return score(cut)


def score(cut: list[DataFrame]) -> DataFrame:
    """From gaps and matches of each kind to scored spans."""
    found = []
    for df in cut:
        each = F.transform("ms", lambda m, i: F.struct(i.alias("i"), F.length(F.get(F.col("gaps"), i)).alias("gap"), m.alias("m"), F.right(F.get(F.col("gaps"), i), F.lit(CONTEXT)).alias("left"), F.substring(F.get(F.col("gaps"), i + 1), 1, CONTEXT).alias("right")))
        found.append(df.where(F.size("ms") > 0).select("key", "rank", "kind", F.explode(each).alias("x")).select("key", "rank", "kind", "x.*"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.distinct()  # of rows that repeat in full
    before = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(before).cast("long"))
    rows = rows.withColumn("start", F.col("end") - F.length("m")).where(confirmed(F.col("kind"), F.col("m")))
    near = F.lower(F.concat_ws(" ", "left", "right"))
    value, helps = F.lit(0.0), F.lit(False)
    for kind in KINDS:
        value = F.when(F.col("kind") == kind, START_SCORE[kind]).otherwise(value)
        helps = F.when(F.col("kind") == kind, near.rlike(FOR[kind])).otherwise(helps)
    total = value + F.when(helps, 0.4).otherwise(0.0) - F.when(near.rlike(AGAINST), 0.4).otherwise(0.0)
    rows = rows.select("key", "rank", "kind", "start", "end", F.col("kind").isin(BASE).alias("base"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 2).alias("score"))
    return rows.where(F.col("base") | (F.col("score") >= THRESHOLD))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more."""
    docs = columns(docs, ["doc_id", "text"], ["long", "string"])
    spans = spans_of(docs).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("rank", "start", "end", "kind", "base"))).alias("s"))
    spans = materialize(spans, "spans")
    out = docs.select(row_key().alias("key"), "doc_id").join(small(spans), "key", "left")
    s = F.coalesce("s", F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string,base:boolean>>"))
    out = out.select("doc_id", s.alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("s", lambda x: x["base"])
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"), F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_more"))
