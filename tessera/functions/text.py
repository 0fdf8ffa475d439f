"""Text functions on columns. A null argument counts as the empty text unless a docstring says otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9\-\+]+"
SPACE = r"(?U)\s+"

# Labels and word lists that results depend on.
AGE_MISSING = ["n/a", "na", "not applicable", "none"]
AGE_UNITS = [("month", 12.0), ("week", 52.0), ("day", 365.25)]
NOT_GIVEN = ["n/a", "na", "not applicable", "unknown"]
ENDPOINTS = [
    ("OS", ["overall survival"], ["os"]),
    ("PFS", ["progression-free", "pfs"], []),
    ("ORR", ["objective response", "overall response", "orr"], []),
    ("DCR", ["disease control", "dcr"], []),
    ("DoR", ["duration of response", "dor"], []),
    ("Safety", ["adverse", "safety", "ae"], []),
    ("QoL", ["quality of life", "qol"], []),
    ("Biomarker", ["biomarker"], []),
]
PSEUDO_MISSING = r"(?i)^(?:n/?a|nan|null|none|missing|not\s*(?:available|applicable|reported|specified)|unknown|-|\.|--)$"
PLACEBO_LIKE = ["placebo", "sham", "vehicle", "saline", "dummy"]
REGIONS = {
    "NA": ["United States", "Canada"],
    "WEU": ["Austria", "Belgium", "France", "Germany", "Greece", "Italy", "Liechtenstein", "Luxembourg", "Monaco", "Netherlands", "Portugal", "Spain", "Switzerland"],
    "EEU": [
        "Albania", "Belarus", "Bulgaria", "Czech Republic", "Czechia", "Estonia", "Hungary", "Latvia", "Lithuania", "Moldova", "Poland", "Romania", "Russia", "Russian Federation", "Serbia", "Slovakia",
        "Ukraine",
    ],
    "AF": [
        "Algeria", "Angola", "Benin", "Botswana", "Burkina Faso", "Burundi", "Cabo Verde", "Cape Verde", "Cameroon", "Central African Republic", "Chad", "Comoros", "Congo", "Congo, Republic of the",
        "Congo, The Democratic Republic of the", "Democratic Republic of the Congo", "Djibouti", "Egypt", "Equatorial Guinea", "Eritrea", "Eswatini", "Swaziland", "Ethiopia", "Gabon", "Gambia", "Ghana",
        "Guinea", "Guinea-Bissau", "Ivory Coast", "Cote d'Ivoire", "Kenya", "Lesotho", "Liberia", "Libya", "Madagascar", "Malawi", "Mali", "Mauritania", "Mauritius", "Morocco", "Mozambique", "Namibia",
        "Niger", "Nigeria", "Rwanda", "Sao Tome and Principe", "Senegal", "Seychelles", "Sierra Leone", "Somalia", "South Africa", "South Sudan", "Sudan", "Tanzania", "Togo", "Tunisia", "Uganda", "Zambia",
        "Zimbabwe",
    ],
    "AP": [
        "Afghanistan", "Armenia", "Azerbaijan", "Bahrain", "Bangladesh", "Bhutan", "Brunei", "Cambodia", "China", "Cyprus", "Georgia", "Hong Kong", "India", "Indonesia", "Iran", "Iraq", "Israel", "Japan",
        "Jordan", "Kazakhstan", "Kuwait", "Kyrgyzstan", "Laos", "Lebanon", "Macau", "Macao", "Malaysia", "Maldives", "Mongolia", "Myanmar", "Nepal", "North Korea", "Oman", "Pakistan", "Palestine",
        "Philippines", "Qatar", "Saudi Arabia", "Singapore", "South Korea", "Sri Lanka", "Syria", "Taiwan", "Tajikistan", "Thailand", "Timor-Leste", "Turkey", "Turkmenistan", "United Arab Emirates",
        "Uzbekistan", "Vietnam", "Viet Nam", "Yemen", "Australia", "New Zealand", "Papua New Guinea", "Fiji", "Solomon Islands", "Vanuatu", "Samoa", "Tonga", "Tuvalu", "Kiribati", "Nauru", "Palau",
        "Micronesia", "Micronesia, Federated States of", "Marshall Islands", "American Samoa", "Guam", "Northern Mariana Islands",
    ],
}

# From a rule: what is ASCII in the compatibility decomposition of each character beyond ASCII, of one character and of several.
PLAIN = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000}
ONE = {c: d for c, d in PLAIN.items() if len(d) == 1}
MORE = {c: d for c, d in PLAIN.items() if len(d) > 1}


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def has_any(c: Column, words: list[str]) -> Column:
    """Whether c contains one of the words."""
    return reduce(lambda a, w: a | c.contains(w), words[1:], c.contains(words[0]))


def tokens(c: Column) -> Column:
    """All tokens of letters, digits, plus and minus, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(TOKEN), 0)


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def word_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def squeeze(c: Column) -> Column:
    """White space of any kind to one space, and none at the ends."""
    return F.trim(F.regexp_replace(blank_if_null(c), SPACE, " "))


def snippet(c: Column, limit: int = 400) -> Column:
    """The squeezed text, or its start and three dots within limit."""
    t = squeeze(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def sentences(c: Column, most: int = 4) -> Column:
    """At most `most` sentences: parts that end in . ! or ? before white space."""
    return F.slice(F.filter(F.split(squeeze(c), r"(?<=[.!?])\s+"), lambda s: s != ""), 1, most)


def window_around(c: Column, keyword: Column, window: int = 180, limit: int = 360) -> Column:
    """The text within `window` characters of the keyword's first occurrence (any case), dots at the cut sides; else the snippet."""
    t = squeeze(c)
    at = F.instr(F.lower(t), F.lower(keyword))
    start = F.greatest(F.lit(1), at - window)
    stop = F.least(F.length(t), at + F.length(keyword) - 1 + window)
    cut = F.trim(F.substr(t, start, stop - start + 1))
    dotted = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(stop < F.length(t), "...").otherwise(""))
    return F.when((at > 0) & (keyword != ""), dotted).otherwise(snippet(c, limit))


def split_sections(c: Column, first: str, second: str) -> tuple[Column, Column]:
    """The parts of a text that belong to two marker words, each from its marker to the other or the end; without markers all is the first's."""
    t = blank_if_null(c)
    low = F.lower(t)
    a, b, end = F.instr(low, first), F.instr(low, second), F.length(t) + 1
    part = lambda lo, hi: squeeze(F.substr(t, lo, hi - lo))
    one = F.when((a > 0) & (b > 0) & (a < b), part(a, b)).when(a > 0, part(a, end)).when(b > 0, F.lit("")).otherwise(squeeze(t))
    two = F.when((a > 0) & (b > 0) & (b < a), part(b, a)).when(b > 0, part(b, end)).otherwise(F.lit(""))
    return one, two


def endpoint_type(c: Column) -> Column:
    """The first type whose words occur, or whose prefix starts the measure; '' if none. Short words match inside longer ones too."""
    m = F.lower(blank_if_null(c))
    out = F.lit("")
    for name, words, prefixes in reversed(ENDPOINTS):
        out = F.when(reduce(lambda a, p: a | m.startswith(p), prefixes, has_any(m, words)), name).otherwise(out)
    return out


def number_text(x: Column, places: int) -> Column:
    """A number with at most that many places and no trailing zeros."""
    fixed = F.format_string(f"%.{places}f", x)
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def age_years(c: Column) -> Column:
    """An age such as `6 Months` in years as text, whole or with two places; '' if there is none."""
    low = F.lower(F.trim(blank_if_null(c)))
    value = F.regexp_extract(low, r"\d+(?:\.\d+)?", 0)
    years = value.try_cast("double")
    for unit, per in reversed(AGE_UNITS):
        years = F.when(low.contains(unit), value.try_cast("double") / per).otherwise(years)
    whole = F.abs(years - F.round(years)) < 1e-6
    text = F.when(whole, F.round(years).cast("long").cast("string")).otherwise(number_text(years, 2))
    return F.when(low.isin(AGE_MISSING) | low.contains("no limit") | (value == ""), "").otherwise(text)


def gender(c: Column) -> Column:
    """Male, Female, Both or ''. Any text with `female` holds `male` as well, so a longer one than `female` is Both."""
    low = F.lower(squeeze(c))
    return F.when(has_any(low, NOT_GIVEN), "").when(low.isin("male", "female"), F.initcap(low)).when(low.contains("female") | low.isin("all", "both"), "Both").otherwise("")


def blinding(c: Column) -> tuple[Column, Column]:
    """(Yes, No or '', level 0 to 4 or '') of a masking text."""
    low = F.lower(blank_if_null(c))
    missing = (low == "") | has_any(low, NOT_GIVEN)
    opened = low.contains("none") | low.contains("open")
    level = F.when(low.contains("single"), "1").when(low.contains("triple"), "3").when(low.contains("quadruple"), "4").when(low.contains("double"), "2").otherwise("")
    return F.when(missing, "").when(opened, "No").otherwise("Yes"), F.when(missing, "").when(opened, "0").otherwise(level)


def yes_no_unknown(c: Column, unknown: str = "Unknown") -> Column:
    """Yes or No by prefix, else the token for unknown; `none` starts with no."""
    low = F.trim(F.lower(blank_if_null(c)))
    return F.when(low.startswith("yes"), "Yes").when(low.startswith("no"), "No").otherwise(unknown)


def filled(c: Column, token: str = "Unknown") -> Column:
    """A null or blank text as the token."""
    return F.when(c.isNull() | (F.trim(c) == ""), token).otherwise(c)


def pseudo_missing(c: Column) -> Column:
    """Whether a text is null, blank or a word for missing."""
    said = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return c.isNull() | (said == "") | said.rlike(PSEUDO_MISSING)


def label_key(c: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(blank_if_null(c)), "[^a-z0-9]", "")


def ascii_text(c: Column) -> Column:
    """The text in compatibility decomposition, with what is not ASCII left out."""
    many = F.create_map(*(F.lit(x) for pair in MORE.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(many, ch), ch)), "")
    c = F.when(c.rlike("[" + "".join(f"\\x{{{ord(x):x}}}" for x in MORE) + "]"), spelled).otherwise(c)
    plain = F.regexp_replace(F.translate(c, "".join(ONE), "".join(ONE.values())), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def match_text(c: Column) -> Column:
    """Lower case, accents off, other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(ascii_text(squeeze(c))), "[^a-z0-9]+", " "))


def trial_id(c: Column) -> Column:
    """The first NCT number, upper case; null if none."""
    return F.nullif(F.regexp_extract(F.upper(blank_if_null(c)), r"NCT\d+", 0), F.lit(""))


def eudract_id(c: Column) -> Column:
    return F.regexp_extract(blank_if_null(c), r"\b\d{4}-\d{6}-\d{2}\b", 0)


def id_list(c: Column) -> Column:
    """The NCT numbers of a text parted by commas or white space, upper case, distinct, in order."""
    return F.array_distinct(F.filter(F.split(F.upper(blank_if_null(c)), r"[,\s]+"), lambda s: s.startswith("NCT")))


def drug_key(c: Column) -> Column:
    """A drug name for comparison: brackets off, lower case, other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(blank_if_null(c), r"\([^)]*\)|\[[^\]]*\]", " ")), "[^a-z0-9]+", " "))


def combo_parts(c: Column) -> Column:
    """The single drugs of a combination parted by + / & , ; and, plus."""
    return F.filter(F.transform(F.split(blank_if_null(c), r"(?i)\s*(?:[+/&,;]|\band\b|\bplus\b)\s*"), lambda s: F.trim(s)), lambda s: s != "")


def primary_drug(c: Column) -> Column:
    return drug_key(F.get(combo_parts(c), F.lit(0)))


def name_variants(c: Column) -> Column:
    """Keys of a name as it is, without its bracketed alias, of the alias, and of each part of a combination."""
    alias = F.regexp_extract(blank_if_null(c), r"\(([^)]*)\)", 1)
    plain = F.regexp_replace(F.lower(blank_if_null(c)), "[^a-z0-9]+", " ")
    keys = F.concat(F.array(F.trim(plain), drug_key(c), drug_key(alias)), F.transform(combo_parts(c), drug_key))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def split_list(c: Column) -> Column:
    """Parts between ; , and |, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(blank_if_null(c), r"[;,|]"), lambda s: F.trim(s)), lambda s: s != "")


def occurrences(c: Column, word: str) -> Column:
    """How often a word occurs in the lower-cased text, without overlap."""
    low, w = F.lower(blank_if_null(c)), word.lower()
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("long")


def keyword_hits(c: Column, words: list[str]) -> Column:
    """How many of the words occur."""
    low = F.lower(blank_if_null(c))
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]).cast("long")


def placebo_like(c: Column) -> Column:
    return has_any(F.lower(blank_if_null(c)), PLACEBO_LIKE)


def country(c: Column) -> Column:
    """A country's name for comparison: lower case, & as and, other characters as one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(squeeze(c)), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))


def region(c: Column) -> Column:
    """One of five regions by country, or ''."""
    name, out = country(c), F.lit("")
    for r, names in reversed(REGIONS.items()):
        keys = [re.sub("[^a-z0-9]+", " ", n.lower()).strip() for n in names]
        out = F.when(name.isin(keys), r).otherwise(out)
    return out


def plain_text(c: Column) -> Column:
    """Markup to text: comments, scripts and styles off, tags to line ends, five entities decoded, white space tidied."""
    t = F.regexp_replace(blank_if_null(c), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    t = F.regexp_replace(t, r"<[^>]+>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def without_fence(c: Column) -> Column:
    """Byte order mark and code fences off."""
    return F.trim(F.regexp_replace(blank_if_null(c), r"^﻿|^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))


def file_name(c: Column) -> Column:
    """Safe characters only, at most 120, never empty."""
    safe = F.regexp_replace(blank_if_null(c), r"[^A-Za-z0-9._-]+", "_")
    return F.when(safe == "", "file").otherwise(F.substring(safe, 1, 120))
