"""Text expressions: cleaning, tokens, entity rules, triple normalisation, rendering. All are plain Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens whose presence marks an entity as document boilerplate.
NOISE = (
    "NASDAQ", "STOCK", "ACT OF", "REGISTRANT", "SECTION", "FISCAL YEAR", "DELAWARE", "SANTA CLARA", "CALIFORNIA", "95051",
    "TELEPHONE", "FORM 10-K", "SECURITIES", "COMMISSION", "EXCHANGE", "PURSUANT",
)
# Words that are no keywords of a question.
STOP_WORDS = (
    "NVIDIA", "NVIDIAS", "CORPORATION", "CORP", "COMPANY", "HOW", "DOES", "WHAT", "IS", "ARE", "THE", "A", "AN", "IN", "ON", "OF", "TO",
    "FOR", "AND", "OR", "WITH", "BY", "THIS", "THAT", "HELP", "IT", "ITS", "BEYOND", "SPECIFICALLY", "ABOUT", "CAN", "COULD", "WOULD", "SHOULD",
)
# A case-sensitive alias, and the phrases of a refusal.
ALIASES = {"NVIDIA CORPORATION": "NVIDIA"}
REFUSAL, REFUSAL_ZH = "cannot conclude", "无法得出结论"

BLANK = r"(?U)[\s\x1c-\x1f]+"


def fold(text: Column) -> Column:
    """Sharp s as ss, so that every engine's upper-casing agrees."""
    return F.replace(text, F.lit("ß"), F.lit("ss"))


def upper(text: Column) -> Column:
    return F.upper(fold(text))


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n+", "\n")


def clean(text: Column, dehyphenate_first: bool = False) -> Column:
    """White-space runs to one space, ends trimmed. ``dehyphenate_first`` joins words cut at line ends before that."""
    if dehyphenate_first:
        text = dehyphenate(text)
    return F.trim(F.regexp_replace(collapse_newlines(text), BLANK, " "))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)-\n\s*", "")


def tokens(text: Column) -> Column:
    """Distinct upper-case words, punctuation dropped."""
    spaced = F.regexp_replace(upper(text), r"(?U)[^\w\s]", " ")
    return F.array_distinct(F.filter(F.split(spaced, r"(?U)\s+"), lambda t: t != ""))


def parse_keywords(reply: Column, min_length: int = 0, strip_quotes: bool = False, drop_empty: bool = False) -> Column:
    """Keywords of a comma list: trimmed and upper-cased. Empty ones stay unless ``drop_empty``."""
    if strip_quotes:
        reply = F.replace(F.replace(reply, F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))
    words = F.transform(F.split(reply, ","), lambda k: upper(F.trim(F.regexp_replace(k, BLANK, " "))))
    if drop_empty:
        min_length = max(min_length, 1)
    return F.filter(words, lambda k: F.length(k) >= min_length) if min_length else words


def engine_keywords(reply: Column) -> Column:
    """All entities of the reply, empty ones included; none without a reply."""
    return F.coalesce(parse_keywords(reply), F.array().cast("array<string>"))


def fallback_keywords(question: Column) -> Column:
    """Words of the question, longer than two letters and no stop words, upper-cased, in order."""
    spaced = F.regexp_replace(fold(question), r"(?U)[^\w\s]", " ")
    stop = F.lit(list(STOP_WORDS))
    words = F.filter(F.split(spaced, r"(?U)\s+"), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, F.upper(t)))
    return F.transform(words, F.upper)


def keywords_or_fallback(reply: Column, question: Column) -> Column:
    """The reply's keywords of more than two letters; those of the question where the reply gives none."""
    found = parse_keywords(reply, 3, strip_quotes=True)
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, found).otherwise(fallback_keywords(question))


def valid_entity(entity: Column) -> Column:
    """2 to 55 characters, no run of five digits or hyphens, no noise token, not only figures and symbols."""
    name = upper(F.trim(F.regexp_replace(entity, r"(?U)^[\s]+|[\s]+$", "")))
    noisy = name.rlike("|".join(t.replace(".", r"\.") for t in NOISE))
    ok = F.length(name).between(2, 55) & ~name.rlike("[0-9-]{5,}") & ~noisy & ~name.rlike(r"^[0-9.,$%-]+$")
    return F.coalesce(ok, F.lit(False))


def entity(name: Column) -> Column:
    """Aliases are resolved before upper-casing and match case; nothing is trimmed."""
    for alias, to in ALIASES.items():
        name = F.replace(name, F.lit(alias), F.lit(to))
    return upper(name)


def relation(name: Column) -> Column:
    return F.replace(upper(F.coalesce(name, F.lit("None"))), F.lit(" "), F.lit("_"))


def page_label(index: Column) -> Column:
    return (index + 1).cast("string")


def render(source: Column, rel: Column, target: Column) -> Column:
    return F.format_string("[%s] -%s-> [%s]", source, rel, target)


def render_with_context(source: Column, rel: Column, target: Column, description: Column) -> Column:
    return F.format_string("[%s] - %s -> [%s] (Context: %s)", source, rel, target, F.coalesce(description, F.lit("None")))


def is_refusal(text: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(REFUSAL)) | F.contains(text, F.lit(REFUSAL_ZH)), F.lit(False))


def overlap(part: Column, whole: Column) -> Column:
    """Share of the distinct words of ``part`` that ``whole`` has."""
    own = tokens(F.coalesce(part, F.lit("")))
    shared = F.size(F.array_intersect(own, tokens(F.coalesce(whole, F.lit("")))))
    return shared / F.greatest(F.size(own), F.lit(1))


def two_decimals(x: Column) -> Column:
    """Rounded as a hundredfold double, as DuckDB does; ``F.round(x, 2)`` goes by the decimal digits (1.005: 1.01, not 1.00)."""
    return F.format_string("%.2f", F.round(x * 100) / 100)
