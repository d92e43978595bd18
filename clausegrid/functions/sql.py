"""The library's text functions for users of SQL.

They are SQL functions, not Python ones: Spark puts their bodies into the plan of whatever calls them, so a lateral join with
contract_clauses runs as a generator in generated code, as the DataFrame operators do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_STRIP = r"regexp_replace({x}, r'(?U)\A\s+|\s+\z', '')"
_UPPER = r"array_join(transform(split({x}, '\u0001'), (p, i) -> CASE WHEN i = 0 THEN p ELSE concat(upper(split_part(p, '\u0002', 1)), split_part(p, '\u0002', 2)) END), '')"
_MAIN = _UPPER.format(x=r"regexp_replace(text, r'(^|\n)((?U:\d){1,2}[.)])(?U:\s)*([a-z][^\n]*)', '$1$2 \u0001$3\u0002')")
_PIECES = r"split(regexp_replace(text, r'(^|\n)((?U:\d){1,2}[.)])((?U:\s))', '$1\u0001$2$3'), '\u0001', -1)"
_PARTS = r"split(regexp_replace(body, r'(?<=\n)([a-z]\))((?U:\s))', '\u0001$1$2'), '\u0001', -1)"

#: name, arguments, what it returns, body.
FUNCTIONS = (
    ("normalize_text", "text STRING", "STRING", _STRIP.format(x=r"regexp_replace(regexp_replace(translate(text, '\u0001\u0002', ''), r'\n{2,}', '\n'), r'(?U)\s{2,}', ' ')")),
    ("capitalize_titles", "text STRING", "STRING", _UPPER.format(x=rf"regexp_replace({_MAIN}, r'(?<=\n)([a-z]\))(?U:\s)*([a-z][^\n]*)', '$1 \u0001$2\u0002')")),
    ("contract_clauses", "text STRING", "TABLE (pos INT, clause_number STRING, content STRING, subs ARRAY<STRUCT<clause_number: STRING, content: STRING>>)", rf"""
        SELECT pos, number, CASE WHEN size(parts) > 1 THEN {_STRIP.format(x='element_at(parts, 1)')} ELSE body END,
            transform(slice(parts, 2, size(parts)), p -> named_struct('clause_number', regexp_extract(p, r'^([a-z]\))', 1), 'content', {_STRIP.format(x='p')}))
        FROM (SELECT pos, number, body, {_PARTS} AS parts
            FROM (SELECT pos - 1 AS pos, regexp_extract(piece, r'^((?U:\d){{1,2}}[.)])', 1) AS number, regexp_replace({_STRIP.format(x='piece')}, r'=+(?U:\s)*', '') AS body
                FROM posexplode({_PIECES}) AS x(pos, piece) WHERE pos > 0))"""),
    ("has_leader", "content STRING", "BOOLEAN", r"content RLIKE r'\.{5,}'"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Creates the functions in the session, in place of any of the same name; gives their names.

    normalize_text and capitalize_titles make a text ready; contract_clauses(text) is a table of its clauses, for
    `FROM (SELECT id, capitalize_titles(normalize_text(text)) AS text FROM docs) d, LATERAL contract_clauses(d.text)`
    (Spark takes no such function right inside a table function); has_leader tells a line of a table of contents. Null texts give null, or no clauses.
    """
    for name, arguments, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
