"""Who the parties are: patterns, lists in model answers, exclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausegrid.functions.text import strip

# The patterns and the placeholder names.
PATTERNS = (
    r"(?i)(?:between|BETWEEN)\s+(.+?)\s+AND\s+(.+?)(?:hereinafter|,|\()",
    r"(?i)(?:agreement|contract)\s+(?:is\s+)?(?:made\s+)?between\s+(.+?)\s+and\s+(.+?)(?:\.|,|\()",
    r"(?i)parties:\s*(.+?)\s+and\s+(.+?)(?:\.|,|\n)",
)
DEFAULT = ("UNKNOWN PARTY 1", "UNKNOWN PARTY 2")
EXCLUDE = (r"P\.?O\.?\s+Box", r"\d{5,}", r"(?i)tower|building|floor|street|avenue|road", r"(?i)hereinafter|referred\s+to\s+as")


def by_pattern(text: Column) -> Column:
    """The two names of the first pattern that is found, else placeholders."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    out = F.array(*map(F.lit, DEFAULT))
    for pattern in reversed(PATTERNS):
        names = F.array(strip(F.regexp_extract(line, pattern, 1)), strip(F.regexp_extract(line, pattern, 2)))
        out = F.when(line.rlike(pattern), names).otherwise(out)
    return out


def parse_list(answer: Column) -> Column:
    """Names in a JSON list, with or without a code fence around it; null if it is no list or has no name."""
    bare = strip(F.regexp_replace(strip(answer), r"(?s)\A```(?:json)?\s*|\s*```\z", ""))
    names = F.filter(F.transform(F.from_json(bare, "array<string>"), strip), lambda n: n.isNotNull() & (n != ""))
    return F.when(F.size(names) > 0, names)


def identify(answer: Column, text: Column) -> Column:
    return F.coalesce(parse_list(answer), by_pattern(text))


def without_addresses(names: Column) -> Column:
    """Names that are no address, number or boilerplate; all of them if none is left."""
    def good(n: Column) -> Column:
        bad = F.lit(False)
        for pattern in EXCLUDE:
            bad = bad | n.rlike(pattern)
        return (strip(n) != "") & ~bad

    left = F.transform(F.filter(names, good), strip)
    return F.when(F.size(left) > 0, left).otherwise(names)
