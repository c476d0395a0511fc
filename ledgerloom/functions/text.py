"""Text functions: leak sanitising, secrets, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import collapse

# What names or measures a target, by kind.
KEY_PREFIXES = ["fuelCost", "co2", "barrels", "feScore", "ghgScore", "smartwayScore", "youSaveSpend"]
LABELS = ["annual fuel costs", "annual fuel cost", "fuel economy", "fuel consumption", "fuel costs", "fuel cost", "emissions score", "emission score", "emissions", "emission", "efficiency score", "ghg score", "smartway score", "smartway", "co2"]
CONTEXTS = ["combined", "city", "highway"]
DISTANCE_UNITS = ["mpge", "mpg", "miles per gallon"]
VOLUME_UNITS = ["l/100 km", "l per 100 km", "liter/100 km", "litre/100 km", "liters/100 km", "litres/100 km"]
MASS_UNITS = ["g/km", "g/mi", "kg/year", "kg co2/year"]
MONEY_UNITS = ["usd", "dollars", "dollar", "/year", "per year"]


def _one_of(phrases: list[str]) -> str:
    """Any of the phrases; a blank stands for any white space or none, a slash may have some."""
    return "(?:" + "|".join(p.replace(" ", r"\s*").replace("/", r"\s*/\s*") for p in phrases) + ")"


def leak_grammar() -> list[str]:
    """The patterns of target leaks, from the kinds above: a leak is a label or unit with the
    amount that follows it, an amount with the unit that follows it, money, or a label alone.
    No pattern looks around itself, so that every regex engine reads them alike."""
    amount = r"[-+]?\b\d+(?:[.,]\d+)*"
    units = _one_of(DISTANCE_UNITS + VOLUME_UNITS + MASS_UNITS)
    priced = rf"[$€£]\s*{amount}(?:\s*{_one_of(MONEY_UNITS)}\b)?"
    value = rf"(?:{priced}|{amount}(?:\s*(?:{units}|{_one_of(MONEY_UNITS)}))?\b)"
    key = rf"{_one_of(KEY_PREFIXES)}[a-z0-9]*"
    label = rf"(?:{key}|{_one_of(LABELS)}|{_one_of(DISTANCE_UNITS)}|{_one_of(VOLUME_UNITS)})"
    context = rf"(?:epa\s*)?{_one_of(CONTEXTS)}(?:\s*{_one_of(['mpge', 'mpg', 'fuel economy', 'consumption'])})?"
    named = rf"\b(?:{label}|{context})\s*[:=]?\s*{value}"
    alone = rf"\b(?:{key}|{_one_of(LABELS)}|mpge|mpg)\b"
    return [r"\b(?:gas\s+)?guzzler\b", rf"{named}|{amount}\s*{units}\b|{priced}", alone]


LEAKS = leak_grammar()


def sanitize(text: Column) -> Column:
    """text without target leaks, white space collapsed; null gives an empty string. A second
    application changes nothing."""
    out = F.coalesce(text, F.lit(""))
    for _ in range(2):  # what a removal brings together goes in the second pass
        for p in LEAKS:
            out = F.regexp_replace(out, "(?iuU)" + p, " ")
    return collapse(out)


SECRET = r"(AKIA|ASIA)[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(password|token|secret|api_key) ?= ?\"?[A-Za-z0-9]{8,}"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def unigrams_bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)
