"""Values that clauses state, brought to one form: durations, sums of money, percentages, dates and jurisdictions.

A small grammar of patterns, as column expressions: each kind has one pattern that finds its matches, and
expressions that read a match. So variants of one value, as in 30 days, thirty (30) days and
30 calendar days, come out equal and can be compared, joined and counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number words, currencies, months and jurisdictions, with what they stand for.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fourteen": 14, "fifteen": 15, "eighteen": 18, "twenty": 20, "thirty": 30, "forty": 40, "sixty": 60, "ninety": 90}
CURRENCIES = {"usd": "USD", "us$": "USD", "$": "USD", "dollars": "USD", "aed": "AED", "dirhams": "AED", "eur": "EUR", "€": "EUR", "euros": "EUR", "gbp": "GBP", "£": "GBP", "pounds": "GBP"}
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
JURISDICTIONS = {"united arab emirates": "UAE", "uae": "UAE", "dubai": "UAE", "abu dhabi": "UAE", "england and wales": "UK", "england": "UK", "united kingdom": "UK", "uk": "UK", "united states": "USA", "usa": "USA", "new york": "NY"}

_WORDS = "|".join(sorted(NUMBERS, key=len, reverse=True))
_NAMES = "|".join(sorted(JURISDICTIONS, key=len, reverse=True))
_MONTHS = "|".join(MONTHS)
_SUM = r"[0-9][0-9,]*(?:\.[0-9]+)?"
PATTERNS = {
    "DURATION": rf"(?i)\b([0-9]{{1,6}}|{_WORDS})\s*(?:\([0-9]{{1,6}}\)\s*)?(?:calendar\s+|consecutive\s+)?(day|week|month|year)s?\b",
    "AMOUNT": rf"(?i)(?:\b(usd|aed|eur|gbp)|(us\$|\$|€|£))\s*({_SUM})(?:\s*(thousand|million|billion)\b)?|\b({_SUM})\s*(?:(thousand|million|billion)\s+)?(usd|aed|eur|gbp|dollars|dirhams|euros|pounds)\b",
    "PERCENT": r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(?:%|per\s?cent\b)",
    "DATE": rf"(?i)\b([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})\b|\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_MONTHS}),?\s+([0-9]{{4}})\b|\b({_MONTHS})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b",
    "JURISDICTION": rf"(?i)\b({_NAMES})\b",
}
KINDS = tuple(PATTERNS)
VALUE = "array<struct<kind:string,value:string,number:decimal(38,4),unit:string,source:string>>"


def _looked_up(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(key))


def _plain(number: Column) -> Column:
    """A decimal without zeros that say nothing."""
    text = number.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _value(kind: str, value: Column, number: Column, unit: Column, source: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), number.cast("decimal(38,4)").alias("number"), unit.alias("unit"), source.alias("source"))


def _duration(m: Column) -> Column:
    part = lambda k: F.regexp_extract(m, PATTERNS["DURATION"], k)
    n = F.coalesce(part(1).try_cast("long"), _looked_up(part(1), NUMBERS).cast("long"))
    unit = F.lower(part(2))
    days, months = F.when(unit == "week", n * 7).when(unit == "day", n), F.when(unit == "year", n * 12).when(unit == "month", n)
    named = lambda count, name: F.concat(count.cast("string"), F.lit(f" {name}"), F.when(count == 1, "").otherwise("s"))
    years = F.call_function("div", months, F.lit(12).cast("long"))
    shown = F.when(days.isNotNull(), named(days, "day")).when((months % 12 == 0) & (months > 0), named(years, "year")).otherwise(named(months, "month"))
    return _value("DURATION", shown, F.coalesce(days, months), F.when(days.isNotNull(), "days").otherwise("months"), m)


def _amount(m: Column) -> Column:
    part = lambda *ks: F.concat(*[F.regexp_extract(m, PATTERNS["AMOUNT"], k) for k in ks])
    n = F.regexp_replace(part(3, 5), ",", "").try_cast("decimal(24,4)") * F.coalesce(_looked_up(part(4, 6), SCALES), F.lit(1)).cast("decimal(12,0)")
    unit = _looked_up(part(1, 2, 7), CURRENCIES)
    return _value("AMOUNT", F.concat_ws(" ", unit, _plain(n)), n, unit, m)


def _percent(m: Column) -> Column:
    n = F.regexp_extract(m, PATTERNS["PERCENT"], 1).try_cast("decimal(24,4)")
    return _value("PERCENT", F.concat(_plain(n), F.lit("%")), n, F.lit("%"), m)


def _date(m: Column) -> Column:
    part = lambda *ks: F.concat(*[F.regexp_extract(m, PATTERNS["DATE"], k) for k in ks])
    month = F.coalesce(F.nullif(part(2), F.lit("")), F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(5, 7))).cast("string"), 2, "0"))
    day = F.concat_ws("-", part(1, 6, 9), month, F.lpad(part(3, 4, 8), 2, "0"))
    good = day.try_cast("date")
    return _value("DATE", F.date_format(good, "yyyy-MM-dd"), F.unix_date(good), F.lit("day"), m)


def _jurisdiction(m: Column) -> Column:
    return _value("JURISDICTION", _looked_up(m, JURISDICTIONS), F.lit(None), F.lit(None).cast("string"), m)


_READ = {"DURATION": _duration, "AMOUNT": _amount, "PERCENT": _percent, "DATE": _date, "JURISDICTION": _jurisdiction}


def values_of(text: Column) -> Column:
    """All values in a text: array of (kind, value, number, unit, source), kind by kind, each in the order of the text.

    `value` is the form that is compared: durations in days, or in months that full years are written as years of; sums as
    currency and number; dates as ISO; jurisdictions as codes. `number` and `unit` are the same for computing.
    What looks like a value and is none, as the 31st of June, is left out. A null or empty text has no values.
    """
    found = [F.filter(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)), _READ[k]), lambda v: v["value"].isNotNull()) for k in KINDS]
    return F.coalesce(F.concat(*found), F.expr(f"CAST(array() AS {VALUE})"))


def value_rows(clauses: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """A row per value: the keys, its place among the clause's values, kind, value, number, unit, source."""
    return clauses.select(*keys, F.posexplode(values_of(F.col(text))).alias("at", "v")).select(*keys, "at", "v.*")


def kind_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How often each kind is stated, and how many different values of it there are; most frequent first, ties by name."""
    keys = [*(by or []), "kind"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values")).orderBy(F.desc("n"), *keys)


def in_one_unit(rows: DataFrame, kind: str) -> DataFrame:
    """The smallest and largest number of a kind by unit: what a reviewer looks at first."""
    return rows.filter(F.col("kind") == kind).groupBy("unit").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("n"))
