"""Arrays, structs and JSON on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import blank_if_null, squeeze


def clean_list(c: Column, most: int = 20) -> Column:
    """Squeezed texts without nulls and blanks, the first `most`."""
    return F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), squeeze), lambda s: s != ""), 1, most)


def clean_structs(c: Column, fields: list[str], most: int = 20) -> Column:
    """Structs with some non-blank field, the first `most`."""
    some = lambda s: F.concat_ws("", *(F.coalesce(s[f].cast("string"), F.lit("")) for f in fields)) != ""
    return F.slice(F.filter(c, some), 1, most)


def distinct_join(c: Column, by: str = "; ") -> Column:
    """Squeezed texts, each once in order of first sight, joined."""
    return F.array_join(F.array_distinct(F.filter(F.transform(c, squeeze), lambda s: s != "")), by)


def distinct_any_case(c: Column) -> Column:
    """Each text once, without regard to case; the first spelling stays."""
    empty = F.array().cast("array<string>")
    return F.aggregate(c, empty, lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x))))


def compact(c: Column, text: int = 240, most: int = 5) -> Column:
    """A list of texts for a summary: no blanks, at most `most`, each cut to `text` characters with three dots."""
    cut = lambda s: F.when(F.length(s) > text, F.concat(F.substring(s, 1, text - 3), F.lit("..."))).otherwise(s)
    return F.transform(clean_list(c, most), cut)


def focus_text(*parts: Column) -> Column:
    """Parts that are not blank, joined by a space in the given order."""
    return F.concat_ws(" ", F.filter(F.array(*map(blank_if_null, parts)), lambda s: F.trim(s) != ""))


def chunks(most_chars: int, *parts: Column) -> Column:
    """Parts that are not blank, each cut to that many characters."""
    return F.transform(F.filter(F.array(*map(squeeze, parts)), lambda s: s != ""), lambda s: F.substring(s, 1, most_chars))


def outer_json(c: Column) -> Column:
    """The text from the first { to the last }; null if there is none or it does not parse."""
    found = F.nullif(F.regexp_extract(blank_if_null(c), r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def evidence_holds(evidence: Column, source: Column, most: int = 240) -> Column:
    """Whether every part of the evidence between ' | ' is at most `most` long and occurs in the source; blank evidence does not hold."""
    segments = F.transform(F.split(blank_if_null(evidence), r" \| "), lambda s: F.trim(s))
    return (F.trim(blank_if_null(evidence)) != "") & F.forall(segments, lambda s: (F.length(s) <= most) & F.contains(blank_if_null(source), s))


def first_by_kind(c: Column, kind: str, value: str) -> Column:
    """A map from kind to the first value of that kind."""
    kinds = F.array_distinct(F.transform(c, lambda s: s[kind]))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.get(F.filter(c, lambda s: s[kind] == k), F.lit(0))[value]))


def target_text(name: Column, genes: Column) -> Column:
    """name (gene; gene), or the name alone."""
    return F.when(F.size(genes) > 0, F.concat(name, F.lit(" ("), F.array_join(genes, "; "), F.lit(")"))).otherwise(name)


def batches(c: Column, size: int) -> Column:
    """An array cut into arrays of `size`, the last shorter."""
    n = F.ceil(F.size(c) / size).cast("int")
    return F.when(F.size(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def packed(c: Column, budget: int) -> Column:
    """For each text the number of its pack: texts fill a pack in order while their characters stay within the budget."""
    zero = F.struct(F.lit(0).alias("pack"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fits = (a["used"] + F.length(s) <= budget) | (a["used"] == 0)
        pack = F.when(fits, a["pack"]).otherwise(a["pack"] + 1)
        return F.struct(pack.alias("pack"), F.when(fits, a["used"] + F.length(s)).otherwise(F.length(s)).alias("used"), F.concat(a["out"], F.array(pack)).alias("out"))

    return F.aggregate(c, zero, step, lambda a: a["out"])
