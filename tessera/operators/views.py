"""What a search shows of nested records and what answers say: blobs, snippets, defaults, actions, values, errors, reranked hits.

Defined cases: a null text counts as blank, a null list as empty; ties go by id; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import numeric as N
from tessera.functions import text as X
from tessera.operators import retrieval as S


def first_filled(*cs: Column) -> Column:
    """The first of the texts that is neither null nor empty, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def field_text(c: Column, field: str | None = None) -> Column:
    """The non-empty values of a list, or of a field of its structs, joined by a space."""
    values = F.transform(c, lambda s: X.blank_if_null(s[field] if field else s))
    return F.coalesce(F.array_join(F.filter(values, lambda s: s != ""), " "), F.lit(""))


def search_blob(*parts: Column) -> Column:
    """Lower-case text to search: a line for each part, also for those that are blank."""
    return F.lower(F.concat_ws("\n", *map(X.blank_if_null, parts)))


def criteria_text(inclusion: Column, exclusion: Column, most: int = 2000) -> Column:
    """Both criteria, a line each, the first `most` characters."""
    return F.substring(F.concat(X.blank_if_null(inclusion), F.lit("\n"), X.blank_if_null(exclusion)), 1, most)


def record_blob(records: DataFrame) -> Column:
    """The blob of a nested record: conditions, drugs, endpoints, outcomes, and the abstract or else the title."""
    lists = [field_text(F.col(c), f) for c, f in (("conditions", "condition_name"), ("drugs", "drug_name"), ("endpoints", "primary_endpoint"), ("outcomes", "outcome_type"))]
    return search_blob(*lists, first_filled(F.col("study.abstract"), F.col("study.title")))


def pick_snippet(endpoints: Column, inclusion: Column, exclusion: Column, abstract: Column, title: Column, outcomes: Column, purpose: Column) -> Column:
    """The text that stands for a record: its first endpoint, if it has endpoints, whatever that says; else criteria, abstract or title, the
    first outcome, the purpose."""
    end, out = F.get(endpoints, F.lit(0)), F.get(outcomes, F.lit(0))
    text = F.when(F.size(endpoints) > 0, first_filled(end["primary_endpoint"], end["primary_endpoint_domain"], end["primary_endpoint_subdomain"]))
    text = text.when(first_filled(inclusion, exclusion) != "", first_filled(inclusion, exclusion))
    text = text.when(first_filled(abstract, title) != "", first_filled(abstract, title))
    text = text.when(F.size(outcomes) > 0, first_filled(out["outcome_type"], out["why_terminated"], out["overall_status"]))
    return X.snippet(text.otherwise(X.blank_if_null(purpose)))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls filled: defaults maps a column, or column.field of a struct, to a value; a list stands for an empty array. A null struct is filled
    field by field."""
    value = lambda v, kind: F.array().cast(kind) if isinstance(v, list) else F.lit(v).cast(kind)
    out, structs = {}, {}
    for path, v in defaults.items():
        top, _, field = path.partition(".")
        kind = df.schema[top].dataType
        if field:
            structs.setdefault(top, {})[field] = v
        else:
            out[top] = F.coalesce(F.col(top), value(v, kind))
    for top, fields in structs.items():
        made = [F.coalesce(F.col(f"{top}.{f.name}"), value(fields[f.name], f.dataType)).alias(f.name) if f.name in fields else F.col(f"{top}.{f.name}").alias(f.name) for f in df.schema[top].dataType.fields]
        out[top] = F.struct(*made)
    return df.withColumns(out)


def with_start(labels: DataFrame, dates: DataFrame, key: str, day: str) -> DataFrame:
    """Labels with the start day of their study, null if it has none; of several days the first, so labels never multiply."""
    first = dates.where(F.col(day).isNotNull()).groupBy(key).agg(F.min(day).alias(day))
    return labels.join(first, key, "left")


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate, rank): the share of null or blank values of each column, the highest first."""
    blank = lambda c: F.avg((F.trim(X.blank_if_null(c.cast("string"))) == "").cast("double"))
    row = df.agg(*(blank(F.col(c)).alias(c) for c in columns))
    each = F.array(*(F.struct(F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias("rate"), F.lit(c).alias("column")) for c in columns))
    order = F.array_sort(F.transform(each, lambda s: F.struct((-s["rate"]).alias("r"), s["column"].alias("column"), s["rate"].alias("rate"))))
    return row.select(F.posexplode(order).alias("i", "s")).select("s.column", "s.rate", (F.col("i") + 1).cast("long").alias("rank"))


def response_status(lines: DataFrame, by: list[str], line: str) -> DataFrame:
    """Rows and errors of answer logs: lines that are not blank, and those of them that are JSON objects whose `error` says something; a line
    that does not parse counts as a row alone."""
    text = F.trim(X.blank_if_null(F.col(line)))
    error = F.get_json_object(F.when(F.try_parse_json(text).isNotNull(), text), "$.error")
    said = error.isNotNull() & ~error.isin("", "false", "0", "0.0", "null", "[]", "{}")
    return lines.where(text != "").groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.count_if(said).cast("long").alias("n_errors"))


def action(answer: Column, allowed: Iterable[str]) -> Column:
    """What an answer asks for: a struct of kind (tool, final, invalid) and tool, '' where none is named."""
    data = A.outer_json(answer)
    get = lambda f: F.get_json_object(data, f"$.{f}")
    kind, known = get("type"), list(allowed)
    name = first_filled(get("tool"), get("action"), get("name"))
    says = lambda k, tool: F.struct(F.lit(k).alias("kind"), tool.alias("tool"))
    none = F.lit("")
    out = F.when(data.isNull() | F.regexp_like(X.blank_if_null(data), F.lit(r"^\{\s*\}$")), says("invalid", none))
    out = out.when(kind == "final", says("final", none)).when(kind == "tool", says("tool", X.blank_if_null(get("tool"))))
    out = out.when(kind.isin(known), says("tool", kind)).when(name.isin(known), says("tool", name))
    return out.when(kind.isNotNull(), says("invalid", none)).otherwise(says("final", none))


def balanced(c: Column) -> Column:
    """The text from the first { or [ to where its brackets are closed again, brackets within JSON strings aside; null if they never are. One
    pass over the characters, inside the JVM."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, ch: Column) -> Column:
        live, plain = (s["start"] > 0) & (s["end"] == 0), ~s["quoted"]
        opens = (s["end"] == 0) & plain & ch.isin("{", "[")
        closes = live & plain & ch.isin("}", "]")
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        at = s["at"] + 1
        quote = live & (ch == '"') & ~s["escaped"]
        return F.struct(
            at.alias("at"),
            F.when((s["start"] == 0) & opens, at).otherwise(s["start"]).alias("start"),
            F.when(closes & (depth == 0), at).otherwise(s["end"]).alias("end"),
            depth.alias("depth"),
            F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (live & s["quoted"] & (ch == "\\") & ~s["escaped"]).alias("escaped"),
        )

    span = F.aggregate(F.split(X.blank_if_null(c), ""), zero, step)
    return F.when(span["end"] > 0, F.substring(c, span["start"], span["end"] - span["start"] + 1))


def one_or_list(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """(by, n, value): the value of a key that has one, else its values as a JSON list in their order; null values are left out."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))).alias("l"))
    values = F.col("l.v")
    return rows.select(*by, F.size("l").cast("long").alias("n"), F.when(F.size("l") == 1, values[0]).otherwise(F.to_json(values)).alias(value))


def analysed(measures: Column, outcomes: Column, group: Column) -> Column:
    """How many of a group were analysed: the count that the measure states, else that of its outcome; lists of structs (group, n)."""
    own = lambda c: F.get(F.filter(c, lambda s: (s["group"] == group) & s["n"].isNotNull()), F.lit(0))["n"]
    return F.coalesce(own(measures), own(outcomes))


def simhash_top(sigs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, id, distance, score, rank): records whose signature shares a band with the query's, nearest first; scored 1 / (1 + distance).

    sigs is (id, sig), queries is (query, sig); a query is not its own answer. What comes near a query is ranked in its own group only."""
    asked = S.simhash_bands(queries.select(F.col("query").alias("id"), "sig")).select(F.col("id").alias("query"), F.col("sig").alias("q_sig"), "bucket")
    met = S.simhash_bands(sigs).join(asked, "bucket").where("id <> query").select("query", "id", N.hamming(F.col("sig"), F.col("q_sig")).cast("long").alias("distance")).distinct()
    return S.top_k(met.withColumn("score", 1 / (1 + F.col("distance"))), k, ["query"], [F.col("distance"), F.col("id")])


def reranked(found: DataFrame, scores: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k best of over-fetched hits (query, id) by the scores (query, id, score), after those that the allowlist (id) lacks have gone; a query
    may get fewer than k."""
    hits = found.select("query", "id")
    if allowed is not None:
        hits = hits.join(allowed.select("id").distinct(), "id", "left_semi")
    return S.top_k(hits.join(scores, ["query", "id"]).select("query", "id", "score"), k, ["query"], [F.desc("score"), F.col("id")])
