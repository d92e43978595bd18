"""Text functions as column expressions. White space and digits are Unicode classes, letters a-z are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\x01", "\x02"
#: White space of any kind: the characters that (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends. Only the ends are looked at, which a pattern cannot do."""
    return F.btrim(c, F.lit(SPACES))


def normalize(c: Column) -> Column:
    """Runs of newlines become one, then runs of white space one blank, then the ends are stripped.

    A newline next to other white space is lost in the second step. The two control
    characters that later steps use as marks are removed.
    """
    plain = F.replace(F.replace(c, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(plain, "\n{2,}", "\n"), r"(?U)\s{2,}", " "))


def _upper_marked(c: Column) -> Column:
    parts = F.split(c, OPEN)
    done = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.split_part(p, F.lit(CLOSE), F.lit(1))), F.split_part(p, F.lit(CLOSE), F.lit(2)))))
    return F.array_join(done, "")


def capitalize_titles(c: Column) -> Column:
    """Upper-cases the titles of clauses and sub-clauses that begin with a small letter."""
    main = _upper_marked(F.regexp_replace(c, r"(^|\n)((?U:\d){1,2}[.)])(?U:\s)*([a-z][^\n]*)", f"$1$2 {OPEN}$3{CLOSE}"))
    return _upper_marked(F.regexp_replace(main, r"(?<=\n)([a-z]\))(?U:\s)*([a-z][^\n]*)", f"$1 {OPEN}$2{CLOSE}"))


def remove_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)\[?Page\s*\d+\]?", "")


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def snippet(c: Column, most: int = 4000) -> Column:
    """The first words, joined by blanks: what a prompt for parties holds."""
    return F.array_join(F.slice(words(c), 1, most), " ")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def page_count(n_words: Column, per_page: int = 500) -> Column:
    return F.greatest(F.lit(1), F.floor(n_words / per_page)).cast("int")


def leading_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[.\s]+", "")


def capitalized(c: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_tags(c: Column) -> Column:
    """Plain text of simple HTML: scripts, styles and comments go, tags become blanks."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return collapse_whitespace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
