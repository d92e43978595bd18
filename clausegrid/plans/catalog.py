"""The registered queries and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions import text as X
from clausegrid.functions.sql import register_functions
from clausegrid.operators import answers as A, candidates as T, chat, claims as Q, clauses as C, compare as B, contracts as K, coverage as D, detection as E, ingest as G, outline as O, pairs as P, parties as N, review as R, values as W, verdicts as V
from clausegrid.plans import inputs as I
from clausegrid.sources import event_lines as L
from clausegrid.sources.contract_store import ContractStore
from clausegrid.sources.files import parser_of
from clausegrid.sources.folder import read_records, register
from clausegrid.sources.tables import linked, table_cells, tables
from clausegrid.streaming import comparisons as M, folds as S, uploads as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Text


@query(f"WITH {I.TEXTS}, {I.NORMAL} SELECT doc_id, md5(text) AS digest, length(text) AS n FROM normal")
def normalize_text(spark, sf):
    return I.contract_texts(spark, sf).select("doc_id", X.normalize(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query(f"WITH {I.TEXTS}, {I.NORMAL}, {I.CAPITAL} SELECT doc_id, md5(text) AS digest FROM capital")
def capitalize_titles(spark, sf):
    return I.contract_texts(spark, sf).select("doc_id", F.md5(X.capitalize_titles(X.normalize(F.col("text")))).alias("digest"))


@query(r"""SELECT doc_id, n_words, greatest(1, n_words // 500)::INT AS n_pages, md5(array_to_string(w[1:4000], ' ')) AS snippet, md5(array_to_string(w, ' ')) AS collapsed
FROM (SELECT doc_id, [x FOR x IN string_split_regex(text, '\s+') IF x <> ''] AS w, len([x FOR x IN string_split_regex(text, '\s+') IF x <> ''])::INT AS n_words FROM documents)""")
def word_and_page_counts(spark, sf):
    t = F.col("text")
    d = I.table(spark, sf, "documents").select("doc_id", X.word_count(t).alias("n_words"), F.md5(X.snippet(t)).alias("snippet"), F.md5(X.collapse_whitespace(t)).alias("collapsed"))
    return d.withColumn("n_pages", X.page_count(F.col("n_words")))


@query(r"""SELECT doc_id, md5(regexp_replace(t, '\[?Page\s*\d+\]?', '', 'gi')) AS digest FROM (SELECT doc_id, text || ' [Page ' || doc_id || '] page' || doc_id AS t FROM documents)""")
def page_numbers_removed(spark, sf):
    marked = F.concat("text", F.lit(" [Page "), F.col("doc_id").cast("string"), F.lit("] page"), F.col("doc_id").cast("string"))
    return I.table(spark, sf, "documents").select("doc_id", F.md5(X.remove_page_numbers(marked)).alias("digest"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '')) AS digest FROM pages""")
def html_plain_text(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


@query(r"""SELECT doc_id, regexp_replace(repeat('.', (doc_id % 4)::INT) || repeat(' ', (doc_id % 3)::INT) || source, '^[.\s]+', '') AS heading, upper(left(lang, 1)) || lower(lang[2:]) AS lang_name FROM documents""")
def leading_dots_removed(spark, sf):
    lead = F.concat(F.expr("repeat('.', cast(doc_id % 4 as int))"), F.expr("repeat(' ', cast(doc_id % 3 as int))"), F.col("source"))
    return I.table(spark, sf, "documents").select("doc_id", X.leading_dots(lead).alias("heading"), X.capitalized(F.col("lang")).alias("lang_name"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def file_hash(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


# Clauses


@query(f"{I.WITH} SELECT doc_id, pos, clause_number, md5(content) AS digest, len(subs)::INT AS n_subs FROM split")
def split_into_clauses(spark, sf):
    text = I.contract_texts(spark, sf).select("doc_id", X.capitalize_titles(X.normalize(F.col("text"))).alias("text"))
    return C.split_clauses(text).select("doc_id", "pos", "clause_number", F.md5("content").alias("digest"), F.size("subs").alias("n_subs"))


@query(f"{I.WITH} SELECT doc_id, pos, clause_number, md5(content) AS digest FROM clauses")
def toc_filtered_clauses(spark, sf):
    return I.extracted(spark, sf).select("doc_id", "pos", "clause_number", F.md5("content").alias("digest"))


@query(f"{I.WITH}, {I.SUBS} SELECT doc_id, pos, sub_pos, clause_number, md5(content) AS digest FROM subs")
def sub_clauses(spark, sf):
    return C.sub_clauses(I.extracted(spark, sf)).select("doc_id", "pos", "sub_pos", "clause_number", F.md5("content").alias("digest"))


@query(f"""{I.WITH} SELECT d.doc_id, count(c.pos) AS main_count, coalesce(sum(len(c.subs)), 0)::BIGINT AS sub_count, (count(c.pos) + coalesce(sum(len(c.subs)), 0))::BIGINT AS total_count
FROM documents d LEFT JOIN clauses c USING (doc_id) GROUP BY 1""")
def extraction_stats(spark, sf):
    texts = I.contract_texts(spark, sf)
    return C.extraction_stats(texts, C.extract_clauses(texts))


@query(f"""{I.WITH}, {I.SUBS} SELECT sha256(doc_id || '~' || pos) AS id, doc_id AS contract_id, clause_number, md5(content) AS digest, NULL::VARCHAR AS parent_clause_id, pos AS order_index FROM clauses
UNION ALL SELECT sha256(doc_id || '~' || pos || '~' || sub_pos), doc_id, clause_number, md5(content), sha256(doc_id || '~' || pos), sub_pos FROM subs""")
def flat_clause_table(spark, sf):
    return C.flat_clauses(I.extracted(spark, sf)).withColumn("digest", F.md5("content")).drop("content")


@query(f"""{I.WITH} SELECT sha256(doc_id || '~' || pos) AS id, doc_id AS contract_id, clause_number, len(subs)::INT AS n_subs, array_to_string([x.clause_number FOR x IN subs], ',') AS numbers, md5(array_to_string([x.content FOR x IN subs], '|')) AS digest FROM clauses""")
def clause_tree(spark, sf):
    tree = C.clause_tree(I.written(C.flat_clauses(I.extracted(spark, sf)), "flat"))
    return tree.select("id", "contract_id", "clause_number", F.size("sub_clauses").alias("n_subs"), F.array_join("sub_clauses.clause_number", ",").alias("numbers"), F.md5(F.array_join("sub_clauses.content", "|")).alias("digest"))


@query(f"{I.WITH} SELECT doc_id, pos, clause_number FROM clauses WHERE contains(lower(clause_number), 'tion a') OR contains(lower(content), 'tion a')")
def clause_search(spark, sf):
    return C.search(I.extracted(spark, sf), "Tion A").select("doc_id", "pos", "clause_number")


@query(f"{I.WITH} SELECT doc_id, pos FROM clauses WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = clauses.doc_id AND l.quality = 1)")
def selected_clauses(spark, sf):
    chosen = I.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return I.extracted(spark, sf).join(chosen, "doc_id", "left_semi").select("doc_id", "pos")


@query(f"""{I.WITH} SELECT doc_id, count(*) AS n, count(*) FILTER (length(content) > 50000) AS too_long, coalesce(array_to_string(list_sort(list(pos) FILTER (regexp_replace(content, '\\s', '', 'g') = '')), ','), '') AS blank,
count(*) BETWEEN 2 AND 50 AND count(*) FILTER (regexp_replace(content, '\\s', '', 'g') = '') = 0 AND count(*) FILTER (length(content) > 50000) = 0 AS ok FROM clauses GROUP BY 1""")
def comparison_validation(spark, sf):
    return C.blank_or_large(I.extracted(spark, sf)).select("doc_id", "n", "too_long", F.array_join("blank_at", ",").alias("blank"), "ok")


@query(f"{I.WITH} SELECT doc_id, clause_number, pos, length(content) AS n FROM clauses QUALIFY row_number() OVER (PARTITION BY doc_id, clause_number ORDER BY length(content) DESC, pos) = 1")
def longest_clause_of_each_number(spark, sf):
    return R.longest_of_each_number(I.extracted(spark, sf)).select("doc_id", "clause_number", "pos", F.length("content").cast("long").alias("n"))


@query(f"""{I.WITH} SELECT doc_id, round(100.0 * sum(length(content)) / max(n), 4) AS coverage, max(n) AS n, CASE WHEN count(*) <= 50 THEN 'fast' WHEN count(*) <= 150 THEN 'medium' ELSE 'smart' END AS route
FROM clauses JOIN (SELECT doc_id, length(text) AS n FROM texts) USING (doc_id) GROUP BY 1""")
def coverage_and_route(spark, sf):
    texts = I.contract_texts(spark, sf)
    sizes = texts.select("doc_id", F.length("text").cast("long").alias("n"))
    out = C.extract_clauses(texts).groupBy("doc_id").agg(F.sum(F.length("content")).alias("held"), F.count(F.lit(1)).alias("c")).join(sizes, "doc_id")
    return out.select("doc_id", F.round(F.lit(100.0) * F.col("held") / F.col("n"), 4).alias("coverage"), "n", R.route(F.col("c")).alias("route"))


# Contracts


@query(f"WITH {I.CONTRACTS} SELECT id, filename, file_type, file_size, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM contracts ORDER BY created_at DESC, id LIMIT 100 OFFSET 20")
def list_contracts(spark, sf):
    return K.list_contracts(I.contracts(spark, sf), 20, 100)


@query(f"""{I.WITH}, {I.CONTRACTS} SELECT k.id, k.status, count(c.pos) AS clause_count, ['Party ' || k.id || ' LLC', 'Firm ' || k.id || ' FZE'][2] || ';' || 'Party ' || k.id || ' LLC' AS parties
FROM contracts k LEFT JOIN clauses c ON c.doc_id::VARCHAR = k.id GROUP BY k.id, k.status""")
def contract_details(spark, sf):
    contracts = I.contracts(spark, sf)
    names = contracts.select(F.col("id").alias("contract_id"), F.explode(F.array(F.concat(F.lit("Party "), "id", F.lit(" LLC")), F.concat(F.lit("Firm "), "id", F.lit(" FZE")))).alias("name"))
    flat = C.flat_clauses(I.extracted(spark, sf)).withColumn("contract_id", F.col("contract_id").cast("string"))
    return K.details(contracts, names, flat).select("id", "status", "clause_count", F.array_join("parties", ";").alias("parties"))


@query(f"""{I.WITH}, {I.SUBS}, {I.CONTRACTS}, keep AS (SELECT id FROM contracts WHERE status <> 'failed')
SELECT 'contracts' AS name, count(*) AS n FROM keep UNION ALL SELECT 'clauses', (SELECT count(*) FROM clauses WHERE doc_id::VARCHAR IN (SELECT id FROM keep)) + (SELECT count(*) FROM subs WHERE doc_id::VARCHAR IN (SELECT id FROM keep))""")
def delete_cascade_counts(spark, sf):
    contracts = I.contracts(spark, sf)
    tables = {"contracts": contracts, "clauses": C.flat_clauses(I.extracted(spark, sf)).withColumn("contract_id", F.col("contract_id").cast("string"))}
    left = K.delete(tables, contracts.filter("status = 'failed'"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@query(f"""WITH {I.CONTRACTS} SELECT id, CASE WHEN status = 'parsing' THEN 'completed' ELSE status END AS status, file_type, CASE WHEN status = 'parsing' THEN TIMESTAMP '2025-01-01' ELSE updated_at END AS updated_at FROM contracts""")
def update_contracts(spark, sf):
    contracts = I.contracts(spark, sf)
    patch = contracts.filter("status = 'parsing'").select("id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("file_type"))
    return K.update(contracts, patch, F.lit("2025-01-01").cast("timestamp_ntz")).select("id", "status", "file_type", "updated_at")


@query(f"""WITH {I.CONTRACTS} SELECT id, CASE WHEN file_type = 'md' THEN 'unsupported file type' END AS upload_error, CASE file_type WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'txt' ELSE file_type END AS parser, (SELECT CASE WHEN length(trim(text)) < 100 THEN 'too little text' END FROM documents WHERE doc_id::VARCHAR = id) AS text_error FROM contracts""")
def upload_validation(spark, sf):
    texts = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    joined = I.contracts(spark, sf).join(texts, "id")
    return joined.select("id", K.upload_error(F.col("filename"), F.col("file_size")).alias("upload_error"), parser_of(F.col("filename")).alias("parser"), K.text_error(F.col("text")).alias("text_error"))


@query("""SELECT user_id::VARCHAR AS contract_id, CASE arg_max(event_type, (ts, event_type)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'parsing' END AS status,
CASE WHEN arg_max(event_type, (ts, event_type)) = 'error' THEN 'stopped' END AS error_message FROM events GROUP BY user_id""")
def status_machine(spark, sf):
    stage = F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "ERROR").otherwise(F.col("event_type"))
    e = I.table(spark, sf, "events")
    order = F.struct("ts", "event_type")
    last = e.groupBy("user_id").agg(F.max_by("event_type", order).alias("event_type"), F.max("ts").alias("at"))
    return K.last_status(last.select(F.col("user_id").cast("string").alias("contract_id"), "at", stage.alias("stage"), F.lit("stopped").alias("message")))


@query(f"""WITH {I.CONTRACTS} SELECT 'contracts' AS name, count(*) AS n FROM contracts UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels""")
def table_counts(spark, sf):
    each = [(n, df) for n, df in (("contracts", I.contracts(spark, sf)), ("pages", I.table(spark, sf, "pages")), ("labels", I.table(spark, sf, "labels")))]
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in each]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {I.CONTRACTS} SELECT status, count(*) AS n, count(DISTINCT file_type) AS kinds, count(*) FILTER (file_size > 1000) AS large FROM contracts GROUP BY 1")
def status_counts(spark, sf):
    return I.contracts(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_type").alias("kinds"), F.count_if(F.col("file_size") > 1000).alias("large"))


# Parties

_PARTY_TEXT = """party_texts AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'made BETWEEN Party ' || doc_id || ' LLC' || chr(10) || 'and Firm ' || doc_id || ', hereinafter' WHEN 1 THEN 'Agreement between Acme ' || doc_id || ' and Beta.' WHEN 2 THEN 'Parties: Acme and Beta ' || doc_id || '.'
  WHEN 3 THEN 'between P.O. Box ' || doc_id || ' and Main Street, x' ELSE 'Nobody' END || chr(10) || source AS text FROM documents)"""


def _party_texts(spark, sf):
    text = F.expr(
        """concat(case doc_id % 5 when 0 then concat('made BETWEEN Party ', doc_id, ' LLC', '\\n', 'and Firm ', doc_id, ', hereinafter') when 1 then concat('Agreement between Acme ', doc_id, ' and Beta.') when 2 then concat('Parties: Acme and Beta ', doc_id, '.')
           when 3 then concat('between P.O. Box ', doc_id, ' and Main Street, x') else 'Nobody' end, '\\n', source)"""
    )
    return I.table(spark, sf, "documents").select("doc_id", text.alias("text"))


_NAMES = r"""named AS (SELECT doc_id, CASE
  WHEN regexp_matches(t, '(?i)between\s+(.+?)\s+AND\s+(.+?)(?:hereinafter|,|\()') THEN [trim(regexp_extract(t, '(?i)between\s+(.+?)\s+AND\s+(.+?)(?:hereinafter|,|\()', 1)), trim(regexp_extract(t, '(?i)between\s+(.+?)\s+AND\s+(.+?)(?:hereinafter|,|\()', 2))]
  WHEN regexp_matches(t, '(?i)(?:agreement|contract)\s+(?:is\s+)?(?:made\s+)?between\s+(.+?)\s+and\s+(.+?)(?:\.|,|\()') THEN [trim(regexp_extract(t, '(?i)(?:agreement|contract)\s+(?:is\s+)?(?:made\s+)?between\s+(.+?)\s+and\s+(.+?)(?:\.|,|\()', 1)), trim(regexp_extract(t, '(?i)(?:agreement|contract)\s+(?:is\s+)?(?:made\s+)?between\s+(.+?)\s+and\s+(.+?)(?:\.|,|\()', 2))]
  WHEN regexp_matches(t, '(?i)parties:\s*(.+?)\s+and\s+(.+?)(?:\.|,|\n)') THEN [trim(regexp_extract(t, '(?i)parties:\s*(.+?)\s+and\s+(.+?)(?:\.|,|\n)', 1)), trim(regexp_extract(t, '(?i)parties:\s*(.+?)\s+and\s+(.+?)(?:\.|,|\n)', 2))]
  ELSE ['UNKNOWN PARTY 1', 'UNKNOWN PARTY 2'] END AS names FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM party_texts))"""


@query(f"WITH {_PARTY_TEXT}, {_NAMES} SELECT doc_id, names[1] AS first, names[2] AS second FROM named")
def parties_by_pattern(spark, sf):
    d = _party_texts(spark, sf).select("doc_id", N.by_pattern(F.col("text")).alias("names"))
    return d.select("doc_id", F.element_at("names", 1).alias("first"), F.element_at("names", 2).alias("second"))


@query(f"""WITH {_PARTY_TEXT}, {_NAMES}, good AS (SELECT doc_id, names, [n FOR n IN names IF NOT regexp_matches(n, 'P\\.?O\\.?\\s+Box|\\d{{5,}}|(?i:tower|building|floor|street|avenue|road|hereinafter|referred\\s+to\\s+as)')] AS g FROM named)
SELECT doc_id, array_to_string(CASE WHEN len(g) > 0 THEN g ELSE names END, '|') AS names FROM good""")
def parties_without_addresses(spark, sf):
    d = _party_texts(spark, sf).select("doc_id", N.without_addresses(N.by_pattern(F.col("text"))).alias("names"))
    return d.select("doc_id", F.array_join("names", "|").alias("names"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A' || doc_id || '|B' WHEN 1 THEN source ELSE NULL END AS names FROM documents""")
def parties_from_answers(spark, sf):
    answer = F.expr("""case doc_id % 4 when 0 then concat('```json\\n["A', doc_id, '", " B ", " "]\\n```') when 1 then concat('["', source, '"]') when 2 then 'no list' else '[]' end""")
    return I.table(spark, sf, "documents").select("doc_id", F.array_join(N.parse_list(answer), "|").alias("names"))


# Pairs

@query(f"""{I.WITH} SELECT doc_id, a.pos AS i, b.pos AS j, a.pos = b.pos AS is_self_check, row_number() OVER (PARTITION BY doc_id ORDER BY a.pos <> b.pos, a.pos, b.pos) - 1 AS pair_order,
(row_number() OVER (PARTITION BY doc_id ORDER BY a.pos <> b.pos, a.pos, b.pos) - 1) // 10 AS block FROM clauses a JOIN clauses b USING (doc_id) WHERE a.pos <= b.pos""")
def pairs_all_against_all(spark, sf):
    return P.blocks(P.upper_triangular(I.extracted(spark, sf))).select("doc_id", "i", "j", "is_self_check", "pair_order", "block")


@query(f"{I.WITH} SELECT doc_id, a.pos AS i, b.pos AS j FROM clauses a JOIN clauses b USING (doc_id) WHERE a.pos < b.pos")
def pairs_strict(spark, sf):
    return P.upper_triangular(I.extracted(spark, sf), self_checks=False).select("doc_id", "i", "j")


@query(f"{I.WITH} SELECT doc_id, a.pos - 1 AS target_index, md5('Compare.' || chr(10)||chr(10) || '[Source clause]' || chr(10) || s.content || chr(10)||chr(10) || '[Target clause ' || a.pos || ']' || chr(10) || a.content || chr(10)||chr(10) || 'Answer with these lines:' || chr(10) || 'Conflict: Yes/No' || chr(10) || 'Explanation' || chr(10) || 'Severity: High/Medium/Low') AS digest FROM clauses a JOIN clauses s USING (doc_id) WHERE s.pos = 0 AND a.pos > 0")
def prompts_one_to_many(spark, sf):
    p = P.one_to_many(I.written(I.extracted(spark, sf).select("doc_id", "pos", "content"), "clauses"))
    return p.select("doc_id", "target_index", F.md5(V.target_prompt(F.lit("Compare."), F.col("source"), F.col("target_index"), F.col("target"))).alias("digest"))


@query(f"""{I.WITH} SELECT doc_id, a.pos AS i, b.pos AS j, md5('Compare.' || chr(10)||chr(10) || '[Clause ' || (a.pos + 1) || ']' || chr(10) || a.content || CASE WHEN a.pos = b.pos THEN '' ELSE chr(10)||chr(10) || '[Clause ' || (b.pos + 1) || ']' || chr(10) || b.content END || chr(10)||chr(10) || 'Answer with these lines:' || chr(10) || 'Conflict: Yes/No' || chr(10) || 'Explanation' || chr(10) || 'Severity: High/Medium/Low') AS digest
FROM clauses a JOIN clauses b USING (doc_id) WHERE a.pos <= b.pos""")
def prompts_all_against_all(spark, sf):
    p = P.upper_triangular(I.extracted(spark, sf))
    return p.select("doc_id", "i", "j", F.md5(V.pair_prompt(F.lit("Compare."), F.col("i"), F.col("j"), F.col("text_i"), F.col("text_j"))).alias("digest"))


@query("""SELECT a.item_id, md5('Compare.' || chr(10)||chr(10) || '[Clause A]' || chr(10) || a.text || chr(10)||chr(10) || '[Clause B]' || chr(10) || b.text || chr(10)||chr(10) || 'Compare the two clauses as asked above.') AS digest FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def prompts_one_to_one(spark, sf):
    b = I.table(spark, sf, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.md5(V.single_prompt(F.lit("Compare."), F.col("text"), F.col("other"))).alias("digest"))


@query(f"""{I.WITH}, sized AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS n FROM clauses), numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, n FROM sized)
SELECT doc_id, k, b AS block FROM (SELECT doc_id, k, n, unnest(range(0, greatest(0, ceil((n - 75) / 50.0))::BIGINT + 1)) AS b FROM numbered) WHERE k >= b * 50 AND k < b * 50 + 75""")
def sliding_blocks(spark, sf):
    from pyspark.sql.window import Window

    k = I.extracted(spark, sf).select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("long").alias("k"))
    return P.sliding_blocks(k, pos="k").select("doc_id", "k", F.col("block").cast("long").alias("block"))


@query(f"""{I.WITH}, kept AS (SELECT doc_id, clause_number, pos FROM clauses QUALIFY row_number() OVER (PARTITION BY doc_id, clause_number ORDER BY pos) <= 50)
SELECT doc_id, clause_number, a.pos AS i, b.pos AS j FROM kept a JOIN kept b USING (doc_id, clause_number) WHERE a.pos < b.pos""")
def section_pairs(spark, sf):
    return P.capped_pairs(I.extracted(spark, sf), ["doc_id", "clause_number"], 50)


@query("""WITH p AS (SELECT doc_id, toxic AS i, quality AS j, doc_id AS by_id FROM labels) SELECT source, least(i, j) AS i, greatest(i, j) AS j, min(by_id) AS by_id FROM p JOIN documents USING (doc_id) GROUP BY 1, 2, 3""")
def canonical_pairs(spark, sf):
    p = I.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("i"), F.col("quality").alias("j"))
    p = p.join(I.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumnRenamed("doc_id", "by_id")
    return P.canonical(p, "source", "by_id").select("source", "i", "j", "by_id")


@query(f"""{I.WITH}, n AS (SELECT doc_id, count(*) AS n FROM clauses GROUP BY 1), c AS (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, a.pos, b.pos FROM clauses a JOIN clauses b USING (doc_id) WHERE a.pos < b.pos AND a.clause_number = b.clause_number) GROUP BY 1)
SELECT doc_id, n, coalesce(c, 0) AS candidates, CASE WHEN n > 1 THEN round(100.0 * (1 - coalesce(c, 0) / (n * (n - 1) / 2.0)), 4) ELSE 0 END AS reduction FROM n LEFT JOIN c USING (doc_id)""")
def reduction_ratio(spark, sf):
    clauses = I.extracted(spark, sf).select("doc_id", "pos", "clause_number")
    n = clauses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # Pairs with the same number, counted per number, so that no pair is made.
    same = clauses.groupBy("doc_id", "clause_number").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id").agg(F.sum(F.expr("k * (k - 1) div 2")).alias("c"))
    out = n.join(same, "doc_id", "left").withColumn("candidates", F.coalesce("c", F.lit(0)))
    return out.select("doc_id", "n", "candidates", F.when(F.col("n") > 1, F.round(F.lit(100.0) * (1 - F.col("candidates") / (F.col("n") * (F.col("n") - 1) / 2)), 4)).otherwise(0.0).alias("reduction"))


# Verdicts


def _sql_any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


_CONFLICT = f"CASE WHEN {_sql_any('a', V.STRUCTURED_YES)} OR {_sql_any('a', V.STRUCTURED_NO)} THEN {_sql_any('a', V.STRUCTURED_YES)} AND NOT {_sql_any('a', V.STRUCTURED_NO)} WHEN {_sql_any('a', V.EXPLICIT_YES)} OR {_sql_any('a', V.EXPLICIT_NO)} THEN {_sql_any('a', V.EXPLICIT_YES)} AND NOT {_sql_any('a', V.EXPLICIT_NO)} ELSE {_sql_any('a', V.GENERAL)} END"
_SEVERITY = "CASE " + " ".join(f"WHEN contains(a, 'severity: {s.lower()}') OR contains(a, '{s.lower()} severity') THEN '{s}'" for s in V.SEVERITIES) + " ELSE 'Unknown' END"
_JUDGED = f"judged AS (SELECT doc_id, toxic, quality, {_CONFLICT} AS conflict, {_SEVERITY} AS severity, {_sql_any('a', V.ONE_TO_MANY_YES)} AS conflict_one FROM (SELECT *, lower(answer) AS a FROM answers))"


@query(f"WITH {I.ANSWERS}, {_JUDGED} SELECT doc_id, conflict, conflict_one, severity FROM judged")
def verdicts(spark, sf):
    a = I.answers(spark, sf)
    return V.judged(a).select("doc_id", "conflict", V.conflict_one_to_many(F.col("answer")).alias("conflict_one"), "severity")


@query(f"WITH {I.ANSWERS}, {_JUDGED} SELECT quality, count(*) AS results_sent, count(*) FILTER (conflict) AS conflicts_found, 0::BIGINT AS errors, count(*) FILTER (toxic = 1) AS self_checks, count(*) FILTER (toxic <> 1) AS pair_checks FROM judged GROUP BY 1")
def run_counters(spark, sf):
    judged = V.judged(I.answers(spark, sf)).withColumn("is_self_check", F.col("toxic") == 1)
    return V.run_counters(judged, "quality")


@query("""SELECT conv_id, turn, row_number() OVER o AS current, count(*) OVER c AS total, round(row_number() OVER o / count(*) OVER c * 100.0, 4) AS percent,
round((count(*) OVER c - row_number() OVER o) * (sum(length(text)) OVER o) / row_number() OVER o, 4)::DOUBLE AS eta FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn), c AS (PARTITION BY conv_id)""")
def progress_and_eta(spark, sf):
    rows = I.table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("seconds"))
    return V.progress(rows, "conv_id", "turn", "seconds").select("conv_id", "turn", "current", "total", "percent", F.col("eta").cast("double").alias("eta"))


@query("SELECT source, lang, sum(toxic)::BIGINT AS votes, count(*) AS checks FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING sum(toxic) >= (count(*) + 1) // 2")
def majority_vote(spark, sf):
    rows = I.table(spark, sf, "labels").join(I.table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return V.majority(rows, ["source", "lang"], "toxic")


@query()
def compare_all_against_all(spark, sf):
    """All pairs of each document's clauses through the offline provider; each distinct prompt is asked once."""
    told = V.answered_pairs(I.written(I.extracted(spark, sf).select("doc_id", "pos", "content"), "clauses"), F.lit("Compare."))
    return V.judged(told).select("doc_id", "i", "j", "is_self_check", "conflict", "severity")


# Chat

_CHAT = """SELECT conv_id, turn, md5(coalesce(array_to_string(list(upper(left(role, 1)) || lower(role[2:]) || ': ' || text || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), ''), '') || 'User: ' || text || chr(10) || 'Assistant:') AS digest FROM conversations"""


@query(_CHAT.format(k=10))
def chat_prompts(spark, sf):
    return chat.prompts(I.table(spark, sf, "conversations")).select("conv_id", "turn", F.md5("prompt").alias("digest"))


@query(_CHAT.format(k=3))
def chat_prompts_last_3(spark, sf):
    return chat.prompts(I.table(spark, sf, "conversations"), 3).select("conv_id", "turn", F.md5("prompt").alias("digest"))


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS token, epoch_us(ts) / 1000000.0 AS tick FROM events), m AS (
SELECT user_id, coalesce(array_to_string(list(token ORDER BY event_id) FILTER (token IS NOT NULL), ''), '') AS response, count(token) AS total_tokens, min(tick) FILTER (token IS NOT NULL) AS f, max(tick) AS l, min(tick) AS s FROM c GROUP BY 1)
SELECT user_id, response, total_tokens, round(coalesce(nullif(f - s, 0), l - s), 6) AS time_to_first_token, round(l - s, 6) AS total_time, round(CASE WHEN l - s > 0 THEN total_tokens / (l - s) ELSE 0 END, 6) AS tokens_per_second FROM m""")
def token_metrics(spark, sf):
    e = I.table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    chunks = e.select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("token"), at.alias("at"))
    return chat.token_metrics(chunks.withColumn("start", F.col("at")), "user_id", "event_id", "token", "at", "start")


# Event lines and streams


@query("SELECT event_id, event_type AS stage, (event_id % 101)::INT AS progress FROM events")
def server_sent_events(spark, sf):
    """Events written as server-sent lines and read again; lines of other kinds are skipped."""
    e = I.table(spark, sf, "events")
    record = F.struct(F.lit("status").alias("type"), F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("message"), (F.col("event_id") % 101).cast("int").alias("progress"))
    lines = e.select(F.explode(F.array(F.split_part(L.to_sse(record), F.lit("\n"), F.lit(1)), F.lit(": ping"), F.lit("data: {broken"))).alias("value"))
    return L.from_sse(lines).select(F.col("event.message").cast("long").alias("event_id"), F.col("event.stage").alias("stage"), F.col("event.progress").alias("progress"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS token, event_id % 7 = 0 AND event_id % 5 <> 0 AS done FROM events")
def token_lines(spark, sf):
    line = F.when(F.col("event_id") % 5 == 0, "{oops").otherwise(F.to_json(F.struct(F.col("event_type").alias("response"), (F.col("event_id") % 7 == 0).alias("done"))))
    return L.from_ndjson(I.table(spark, sf, "events").select("event_id", line.alias("value"))).select("event_id", "token", "done")


@query("""SELECT user_id AS run_id, arg_max(event_type, (ts, event_id)) AS stage, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 0 ELSE arg_max(event_id % 101, (ts, event_id)) END::INT AS progress, count(*) AS events FROM events GROUP BY 1""")
def upload_progress(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("stage"), (F.col("event_id") % 101).cast("int").alias("progress"))
    out = S.latest_progress(e.withColumn("stage", F.when(F.col("stage") == "error", "ERROR").otherwise(F.col("stage"))))
    return out.withColumn("stage", F.when(F.col("stage") == "ERROR", "error").otherwise(F.col("stage")))


_STEPS = "[" + ", ".join(f"{{'s': '{stage}', 'p': {percent}}}" for stage, percent in U.STEPS) + "]"


@query(f"""WITH e AS (SELECT user_id || '/' || event_id % 7 AS run_id, ts, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN -1 WHEN event_id % 13 = 0 THEN NULL ELSE event_id * 7 % 16 END AS step FROM events),
now AS (SELECT max(ts) - INTERVAL 1 HOUR AS now FROM e), steps AS (SELECT run_id, step, min(ts) AS t FROM e WHERE step >= 0 GROUP BY 1, 2),
ordered AS (SELECT run_id, max(step) AS far, count(*) AS n, bool_and(ok) AS in_order FROM (SELECT *, coalesce(t >= lag(t) OVER (PARTITION BY run_id ORDER BY step), true) AS ok FROM steps) GROUP BY 1),
runs AS (SELECT run_id, count(*) AS events, max(ts) AS last, coalesce(bool_or(step = -1), false) AS failed FROM e GROUP BY 1)
SELECT run_id, CASE WHEN failed THEN 'ERROR' ELSE {_STEPS}[far + 1].s END AS stage, CASE WHEN failed OR far IS NULL THEN 0 ELSE {_STEPS}[far + 1].p END AS progress,
CASE WHEN failed THEN 'failed' WHEN far = 15 THEN 'completed' WHEN last + INTERVAL 2 DAY <= now THEN 'aborted' ELSE 'running' END AS status, events, coalesce(far + 1 - n, 0)::INT AS missing, coalesce(in_order, true) AS in_order
FROM runs LEFT JOIN ordered USING (run_id), now""")
def upload_steps(spark, sf):
    """Where uploads stand by their sixteen steps, some of them failed, some silent for two days, steps in any order."""
    e = I.table(spark, sf, "events")
    k = (F.col("event_id") * 7 % 16).cast("int")
    failed, other = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), F.col("event_id") % 13 == 0
    names, percents = (F.get(F.array(*[F.lit(step[side]) for step in U.STEPS]), k) for side in (0, 1))
    told = e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("run_id"), F.when(failed, U.ERROR).when(other, "OTHER").otherwise(names).alias("stage"),
        F.when(failed | other, 0).otherwise(percents).alias("progress"), F.col("ts").alias("at"),
    )
    return U.upload_status(told, 172_800, "1 hour")


@query("""SELECT user_id::VARCHAR AS run_id, count(*) FILTER (event_type IN ('view', 'click')) AS results, count(*) FILTER (event_type = 'click') AS conflicts, count(*) FILTER (event_type = 'view' AND value > 90) AS errors,
CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY 1""")
def run_totals(spark, sf):
    return S.run_totals(run_events(I.table(spark, sf, "events")))


def run_events(events: DataFrame) -> DataFrame:
    """Run events made from events: views and clicks are results, a click is a conflict."""
    kind = F.when(F.col("event_type").isin("view", "click"), "result").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "complete").otherwise("status")
    return events.select(F.col("user_id").cast("string").alias("run_id"), kind.alias("type"), (F.col("event_type") == "click").alias("conflict"), F.when((F.col("event_type") == "view") & (F.col("value") > 90), "Error").otherwise("Low").alias("severity"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_day(spark, sf):
    return S.windowed_counts(I.table(spark, sf, "events"))


# Documented review rules


@query(r"""SELECT doc_id, line, (regexp_matches(l, '^\d+(?:\.\d+)*\.?\s+\S.*\s\d{1,3}$') AND length(l) < 100) OR regexp_matches(l, '\.{5,}') OR regexp_matches(lower(l), '^\s*(table of )?contents\s*$') AS toc
FROM (SELECT doc_id, unnest([{'i': (i - 1)::INT, 'l': x} FOR x, i IN string_split(t, chr(10))], recursive := true) FROM (SELECT doc_id, text || chr(10) || doc_id || '. Terms ' || doc_id || chr(10) || 'Contents' || chr(10) || 'Fees ..... 3' AS t FROM documents)) AS q(doc_id, line, l)""")
def toc_lines(spark, sf):
    t = F.concat("text", F.lit("\n"), F.col("doc_id").cast("string"), F.lit(". Terms "), F.col("doc_id").cast("string"), F.lit("\nContents\nFees ..... 3"))
    lines = I.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(t, "\n")).alias("line", "l"))
    return lines.select("doc_id", "line", R.toc_line(F.col("l")).alias("toc"))


_REVIEWED = r"""reviewed AS (SELECT doc_id, pos, CASE pos % 6 WHEN 0 THEN 'The Supplier shall pay all invoices within ' || doc_id || ' days of notice.' WHEN 1 THEN 'It is hereby agreed that:' WHEN 2 THEN 'Fees' WHEN 3 THEN 'Notwithstanding clause ' || (doc_id % 5 + 1) || ' and section 2.1, courts of ' || left(md5(doc_id::VARCHAR), 4) || ' have jurisdiction.'
  WHEN 4 THEN 'Any notice follows the mediation procedure in paragraph 3, see clause 3 and Article 7.' ELSE content END AS content, clause_number FROM clauses)"""


def _reviewed(spark, sf):
    text = F.expr(
        """case pos % 6 when 0 then concat('The Supplier shall pay all invoices within ', doc_id, ' days of notice.') when 1 then 'It is hereby agreed that:' when 2 then 'Fees' when 3 then concat('Notwithstanding clause ', doc_id % 5 + 1, ' and section 2.1, courts of ', left(md5(cast(doc_id as string)), 4), ' have jurisdiction.')
           when 4 then 'Any notice follows the mediation procedure in paragraph 3, see clause 3 and Article 7.' else content end"""
    )
    return I.extracted(spark, sf).select("doc_id", "pos", "clause_number", text.alias("content"))


_LEGAL = r"(?i)\b(shall|must|will|may|agrees?|undertakes?|warrants?|liable)\b"
_STUB = rf"(right(s, 1) = ':' OR regexp_matches(s, '(?is)it is (?:hereby )?agreed that:?.{{0,19}}$') OR (length(s) < 30 AND NOT regexp_matches(s, '{_LEGAL}')))"
_WORDS = r"len([x FOR x IN string_split_regex(s, '\s+') IF x <> ''])"
_SUBST = rf"""(({_WORDS} >= 10 AND length(s) >= 50) OR regexp_matches(s, '{_LEGAL}') OR regexp_matches(s, '(?i)"[^"]+"\s+(means|refers to)'))"""
_STRIPPED = r"stripped AS (SELECT *, regexp_replace(content, '^\s+|\s+$', '', 'g') AS s FROM reviewed)"


@query(rf"""{I.WITH}, {_REVIEWED}, {_STRIPPED} SELECT doc_id, pos, {_STUB} AS stub, length(s) < 180 AND (right(s, 1) = ':' OR (regexp_matches(s, '(?i)agreed that|as follows') AND {_WORDS} < 15)) AS short_stub, {_SUBST} AS substantive FROM stripped""")
def stubs_and_substance(spark, sf):
    c = F.col("content")
    return _reviewed(spark, sf).select("doc_id", "pos", R.is_stub(c).alias("stub"), R.is_short_stub(c).alias("short_stub"), R.is_substantive(c).alias("substantive"))


@query(rf"""{I.WITH}, {_REVIEWED}, {_STRIPPED} SELECT coalesce(CASE WHEN (regexp_matches(content, '^\d+(?:\.\d+)*\.?\s+\S.*\s\d{{1,3}}$') AND length(content) < 100) OR regexp_matches(content, '\.{{5,}}') OR regexp_matches(lower(content), '^\s*(table of )?contents\s*$') THEN 'toc' WHEN {_STUB} THEN 'stub' WHEN NOT {_SUBST} THEN 'no_content' END, 'valid') AS reason, count(*) AS n FROM stripped GROUP BY 1""")
def filter_metrics(spark, sf):
    return _reviewed(spark, sf).groupBy(F.coalesce(R.removal_reason(F.col("content")), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_FUNCTION = "CASE " + " ".join(f"WHEN regexp_matches(content, '{p}') THEN '{n}'" for n, p in R.FUNCTIONS.items()) + " ELSE 'GENERAL' END"


@query(f"{I.WITH}, {_REVIEWED} SELECT doc_id, pos, {_FUNCTION} AS function, regexp_matches(content, '{R.OVERRIDE}') AS override FROM reviewed")
def clause_functions(spark, sf):
    c = F.col("content")
    return _reviewed(spark, sf).select("doc_id", "pos", R.function_of(c).alias("function"), c.rlike(R.OVERRIDE).alias("override"))


@query(f"""{I.WITH}, {_REVIEWED}, f AS (SELECT doc_id, {_FUNCTION} AS function, count(*) AS n FROM reviewed GROUP BY 1, 2)
SELECT doc_id, sum(n * (n - 1) // 2)::BIGINT AS same, coalesce(sum(n) FILTER (function = 'CONFIDENTIALITY') * sum(n) FILTER (function = 'INDEMNITY_LIABILITY'), 0)::BIGINT AS across FROM f GROUP BY 1""")
def gated_pairs(spark, sf):
    """Pairs that the gate lets pass, counted by function so that none is made."""
    f = _reviewed(spark, sf).groupBy("doc_id", R.function_of(F.col("content")).alias("function")).agg(F.count(F.lit(1)).alias("n"))
    n = lambda name: F.sum(F.when(F.col("function") == name, F.col("n")))
    return f.groupBy("doc_id").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("same"), F.coalesce(n("CONFIDENTIALITY") * n("INDEMNITY_LIABILITY"), F.lit(0)).alias("across"))


@query(f"{I.WITH}, {_REVIEWED} SELECT doc_id, pos, array_to_string(list_distinct_ordered, ',') AS refs FROM (SELECT doc_id, pos, [x FOR x, i IN r IF list_position(r, x) = i] AS list_distinct_ordered FROM (SELECT doc_id, pos, regexp_extract_all(content, '{R.REFERENCE}', 1) AS r FROM reviewed))")
def cross_references(spark, sf):
    return _reviewed(spark, sf).select("doc_id", "pos", F.array_join(R.references(F.col("content")), ",").alias("refs"))


@query(f"""{I.WITH}, {_REVIEWED}, o AS (SELECT DISTINCT doc_id, pos, unnest(regexp_extract_all(content, '{R.REFERENCE}', 1)) AS number FROM reviewed WHERE regexp_matches(content, '{R.OVERRIDE}'))
SELECT o.doc_id, number, o.pos AS i, r.pos AS j FROM o JOIN reviewed r ON r.doc_id = o.doc_id AND regexp_replace(r.clause_number, '[.)]$', '') = number WHERE o.pos <> r.pos""")
def override_references(spark, sf):
    return R.override_pairs(_reviewed(spark, sf)).select("doc_id", "number", "i", "j")


@query(f"""{I.WITH}, {_REVIEWED}, p AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(lower(content), 'notice|procedure|mediation|escalation') AND NOT regexp_matches(lower(content), 'jurisdiction|governing law|courts of')) AS k FROM reviewed GROUP BY 1)
SELECT doc_id, n * (n - 1) // 2 - (n - k) * (n - k - 1) // 2 AS dropped FROM p""")
def procedure_pairs_dropped(spark, sf):
    """How many pairs of each document the procedure-against-jurisdiction rule drops, from counts."""
    only = R.procedure_against_jurisdiction(F.col("content"), F.col("content"))
    p = _reviewed(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(only).alias("k"))
    return p.select("doc_id", F.expr("n * (n - 1) div 2 - (n - k) * (n - k - 1) div 2").alias("dropped"))


_CONF = "conf AS (SELECT doc_id, ['TRUE_CONFLICT', 'AMBIGUITY', 'NONE'][(doc_id % 3 + 1)::INT] AS classification, (70 + doc_id % 31) / 100.0::DOUBLE AS confidence, 70 + doc_id % 31 AS pct, source FROM documents)"


def _conflicts(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.element_at(F.array(F.lit("TRUE_CONFLICT"), F.lit("AMBIGUITY"), F.lit("NONE")), (F.col("doc_id") % 3 + 1).cast("int")).alias("classification"), ((F.lit(70) + F.col("doc_id") % 31) / F.lit(100.0)).alias("confidence"), (F.lit(70) + F.col("doc_id") % 31).alias("pct"), "source")


@query(f"WITH {_CONF} SELECT classification, count(*) AS n, ((2 * sum(pct) + count(*)) // (2 * count(*)))::BIGINT / 100.0::DOUBLE AS mean, min(confidence) AS low, max(confidence) AS high, count(DISTINCT source) AS sources FROM conf WHERE classification IN ('TRUE_CONFLICT', 'AMBIGUITY') AND confidence >= 0.85 GROUP BY 1")
def confidence_stats(spark, sf):
    return R.stored(_conflicts(spark, sf)).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), (F.expr("(2 * sum(pct) + count(*)) div (2 * count(*))") / F.lit(100.0)).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count_distinct("source").alias("sources"))


@query(f"""WITH {_CONF} SELECT doc_id, CASE WHEN confidence >= 0.95 THEN 'CRITICAL' WHEN confidence >= 0.90 THEN 'HIGH' WHEN confidence >= 0.85 THEN 'MEDIUM' ELSE 'LOW' END AS by_confidence,
CASE WHEN classification = 'AMBIGUITY' THEN 'MEDIUM' WHEN doc_id % 4 = 0 THEN 'CRITICAL' WHEN doc_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS by_materiality FROM conf""")
def conflict_severities(spark, sf):
    d = _conflicts(spark, sf)
    kind = F.when(F.col("doc_id") % 4 == 0, "JurisdictionMismatch").otherwise("Other")
    function = F.when(F.col("doc_id") % 2 == 0, "PAYMENT").otherwise("TERM")
    return d.select("doc_id", R.severity_by_confidence(F.col("confidence")).alias("by_confidence"), R.severity_by_materiality(F.lit("LOW"), kind, function, F.col("classification")).alias("by_materiality"))


@query(f"WITH {_CONF} SELECT c.doc_id, c.confidence, d.source AS left_source, e.source AS right_source FROM conf c JOIN documents d ON d.doc_id = c.doc_id JOIN documents e ON e.doc_id = c.doc_id + 1 ORDER BY c.confidence DESC, c.doc_id LIMIT 10")
def top_conflicts(spark, sf):
    docs = I.table(spark, sf, "documents")
    left = docs.select("doc_id", F.col("source").alias("left_source"))
    right = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("right_source"))
    out = _conflicts(spark, sf).select("doc_id", "confidence").join(left, "doc_id").join(right, "doc_id")
    return out.orderBy(F.desc("confidence"), "doc_id").limit(10)


_CLAIMS = "claims AS (SELECT event_id AS claim_id, user_id || '/' || date_trunc('day', ts)::DATE AS topic, event_type AS action, CASE WHEN event_id % 2 = 0 THEN 'shall' ELSE 'shall not' END AS modality, user_id AS subject, 'days' AS value_type, (event_id % 3) AS value FROM events)"


@query(f"""WITH {_CLAIMS} SELECT a.claim_id AS i, b.claim_id AS j, a.topic, CASE WHEN a.modality <> b.modality AND a.action = b.action THEN 'modality' ELSE 'value' END AS rule FROM claims a JOIN claims b ON a.topic = b.topic AND a.claim_id < b.claim_id
WHERE (a.modality <> b.modality AND a.action = b.action) OR (a.value_type = b.value_type AND a.subject = b.subject AND a.value <> b.value)""")
def claim_conflicts(spark, sf):
    e = I.table(spark, sf, "events")
    claims = e.select(F.col("event_id").alias("claim_id"), F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("topic"), F.col("event_type").alias("action"), F.when(F.col("event_id") % 2 == 0, "shall").otherwise("shall not").alias("modality"), F.col("user_id").alias("subject"), F.lit("days").alias("value_type"), (F.col("event_id") % 3).alias("value"))
    return R.claim_conflicts(claims)


@query("""SELECT event_id, n AS number, CASE WHEN regexp_matches(n, '^\\d+(\\.\\d+)*$') THEN CASE WHEN contains(n, '.') THEN regexp_replace(n, '\\.\\d+$', '') END ELSE a END AS parent_number,
CASE WHEN regexp_matches(n, '^\\d+(\\.\\d+)*$') THEN len(string_split(n, '.')) ELSE coalesce(len(string_split(a, '.')), 0) + 1 END::INT AS depth FROM (
SELECT event_id, n, last_value(CASE WHEN regexp_matches(n, '^\\d+(\\.\\d+)*$') THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM (
SELECT event_id, user_id, [(event_id % 9 + 1)::VARCHAR, (event_id % 9 + 1) || '.2', '(a)', (event_id % 9 + 1) || '.2.' || (event_id % 5)][(event_id % 4 + 1)::INT] AS n FROM events))""")
def clause_hierarchy(spark, sf):
    number = F.expr("element_at(array(cast(event_id % 9 + 1 as string), concat(event_id % 9 + 1, '.2'), '(a)', concat(event_id % 9 + 1, '.2.', event_id % 5)), cast(event_id % 4 + 1 as int))")
    rows = I.table(spark, sf, "events").select("event_id", "user_id", number.alias("number"))
    return R.hierarchy(rows, "user_id", "event_id", "number").select("event_id", "number", "parent_number", F.col("depth").cast("int").alias("depth"))


@query()
def long_clauses_split(spark, sf):
    out = R.split_long(I.extracted(spark, sf), 400)
    return out.select("doc_id", "pos", "clause_number", "split_from", F.length("content").alias("n"))


# Small reads and filters


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS token, event_id % 7 = 0 AND event_id % 5 <> 0 AS done FROM events),
e AS (SELECT *, min(CASE WHEN done THEN event_id END) OVER (PARTITION BY user_id) AS last FROM l) SELECT user_id, event_id, token, done FROM e WHERE last IS NULL OR event_id <= last""")
def token_lines_until_done(spark, sf):
    line = F.when(F.col("event_id") % 5 == 0, "{oops").otherwise(F.to_json(F.struct(F.col("event_type").alias("response"), (F.col("event_id") % 7 == 0).alias("done"))))
    lines = I.table(spark, sf, "events").select("user_id", "event_id", line.alias("value"))
    return L.until_done(L.from_ndjson(lines), "user_id", "event_id").select("user_id", "event_id", "token", "done")


@query(f"WITH {I.CONTRACTS} SELECT id, filename, status, file_type FROM contracts WHERE id = '7'")
def contract_by_id(spark, sf):
    return K.by_id(I.contracts(spark, sf), "7").select("id", "filename", "status", "file_type")


@query("SELECT doc_id, (i - 1)::INT AS pos, md5(x) AS digest FROM (SELECT doc_id, unnest([{'i': i, 'x': x} FOR x, i IN string_split(text, chr(10))], recursive := true) FROM documents) AS q(doc_id, i, x)")
def request_positions(spark, sf):
    """Lines stand for the clauses that a request carries as an array."""
    requests = I.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("clauses"))
    return P.positions(requests, "doc_id", "clauses").select("doc_id", "pos", F.md5("content").alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, i, CASE WHEN (doc_id + i) % 3 = 0 THEN '  ' ELSE x END AS x FROM (SELECT doc_id, unnest([{'i': i, 'x': x} FOR x, i IN string_split(text, chr(10))], recursive := true) FROM documents) AS q(doc_id, i, x))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, md5(x) AS digest FROM l WHERE regexp_replace(x, '\s', '', 'g') <> ''""")
def clauses_without_blank(spark, sf):
    lines = P.positions(I.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("clauses")), "doc_id", "clauses")
    lines = lines.withColumn("content", F.when((F.col("doc_id") + F.col("pos") + 1) % 3 == 0, "  ").otherwise(F.col("content")))
    return P.without_blank(lines).select("doc_id", "pos", F.md5("content").alias("digest"))


@query("SELECT DISTINCT source, i, j FROM (SELECT source, toxic AS i, quality AS j FROM labels JOIN documents USING (doc_id) UNION ALL SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id) UNION ALL SELECT source, quality, quality FROM labels JOIN documents USING (doc_id))")
def candidate_tiers_united(spark, sf):
    d = I.table(spark, sf, "labels").join(I.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    tiers = [d.select("source", F.col(a).alias("i"), F.col(b).alias("j")) for a, b in (("toxic", "quality"), ("quality", "toxic"), ("quality", "quality"))]
    return P.united(tiers, ["source", "i", "j"])


@query("""SELECT doc_id, n AS number, regexp_matches(upper(n), 'APPENDIX|SCHEDULE|EXHIBIT') AS appendix, left(text, 200) AS short, length(left(text, 1000)) AS n_chars FROM (SELECT doc_id, text, ['1.2', 'Appendix A', 'schedule 3', doc_id || '.'][(doc_id % 4 + 1)::INT] AS n FROM documents)""")
def appendices_and_cut_texts(spark, sf):
    number = F.expr("element_at(array('1.2', 'Appendix A', 'schedule 3', concat(doc_id, '.')), cast(doc_id % 4 + 1 as int))")
    d = I.table(spark, sf, "documents").select("doc_id", "text", number.alias("number"))
    return d.select("doc_id", "number", R.is_appendix(F.col("number")).alias("appendix"), R.cut_text(F.col("text"), 200).alias("short"), F.length(R.cut_text(F.col("text"))).cast("long").alias("n_chars"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE '[' || doc_id || ']' END AS found FROM documents")
def lists_in_answers(spark, sf):
    answer = F.expr("""case doc_id % 4 when 0 then concat('{"results":[', doc_id, ']}') when 1 then concat('{"data":[0],"conflicts":[', doc_id, ']}') when 2 then concat('[', doc_id, ']') else '{"other":1}' end""")
    return I.table(spark, sf, "documents").select("doc_id", R.first_list(answer).alias("found"))


@query("SELECT event_type AS topic, count(*) AS n FROM events GROUP BY 1")
def topic_counts(spark, sf):
    return R.topic_counts(I.table(spark, sf, "events").select(F.col("event_type").alias("topic")))


# Candidate tiers and what is done with reported conflicts

_PHRASES = ("Payment of a fee shall fall due.", "They shall not terminate.", "Notwithstanding this, damage is required.", "A patent is optional and mandatory.", "Notice as agreed.", "The courts' jurisdiction is prohibited or permitted.", "Confidential or secret, it must stay so.")


def _told(spark, sf):
    """Clauses with phrases of the tiers in front, so that every tier has clauses in it and clauses out of it."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), ((F.col("doc_id") + F.col("pos")) % len(_PHRASES) + 1).cast("int"))
    return I.extracted(spark, sf).select("doc_id", "pos", F.concat(phrase, F.lit(" "), "content").alias("content"))


_TOLD = f"{I.WITH}, told AS (SELECT doc_id, pos, {[p.replace(chr(39), chr(39) * 2) for p in _PHRASES]!r}[((doc_id + pos) % {len(_PHRASES)} + 1)::INT] || ' ' || content AS content FROM clauses)".replace('"', "'")


def _tagged(topics: dict) -> str:
    """One SELECT for each topic: the clauses that mention it."""
    return " UNION ALL ".join(f"SELECT doc_id, pos, '{name}' AS topic FROM told WHERE {_sql_any('lower(content)', words)}" for name, words in topics.items())


@query(f"{_TOLD}, tagged AS ({_tagged(T.TOPICS)}), first AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY doc_id, topic ORDER BY pos) <= 3) SELECT DISTINCT doc_id, a.pos AS i, b.pos AS j FROM first a JOIN first b USING (doc_id, topic) WHERE a.pos < b.pos")
def topic_pairs(spark, sf):
    """With a limit of 3 in place of 30, as the documents here have few clauses."""
    return T.topic_pairs(_told(spark, sf), 3)


@query(f"{_TOLD}, tagged AS ({_tagged(T.CLUSTERS)}) SELECT DISTINCT doc_id, a.pos AS i, b.pos AS j FROM tagged a JOIN tagged b USING (doc_id, topic) WHERE a.pos < b.pos")
def cluster_pairs(spark, sf):
    return T.cluster_pairs(_told(spark, sf))


@query(f"{_TOLD} SELECT doc_id, a.pos AS i, b.pos AS j FROM told a JOIN told b USING (doc_id) WHERE a.pos < b.pos AND ("
+ " OR ".join(f"(contains(lower(a.content), '{x}') AND contains(lower(b.content), '{y}')) OR (contains(lower(a.content), '{y}') AND contains(lower(b.content), '{x}'))" for x, y in T.CONTRARY) + ")")
def contrary_pairs(spark, sf):
    return T.contrary_pairs(_told(spark, sf))


@query(f"{_TOLD} SELECT doc_id, a.pos AS i, b.pos AS j FROM told a JOIN told b USING (doc_id) WHERE a.pos <> b.pos AND ({_sql_any('lower(a.content)', T.OVERRIDES)})")
def override_against_all(spark, sf):
    return T.override_against_all(_told(spark, sf))


_REPORTED = f"""{_TOLD}, reported AS (SELECT doc_id, a.pos AS i, b.pos AS j, a.content AS text_i, b.content AS text_j, (70 + (doc_id + a.pos) % 31) / 100.0::DOUBLE AS confidence, repeat('because ', (doc_id % 9)::INT) AS description,
  left(a.content, 20) AS quote_i, CASE WHEN doc_id % 3 = 0 THEN 'not there' ELSE b.content END AS quote_j FROM told a JOIN told b USING (doc_id) WHERE b.pos = a.pos + 1)"""


def _reported(spark, sf):
    """Conflicts between neighbouring clauses, with quotes of which some stand nowhere."""
    told = I.written(_told(spark, sf), "told")
    pairs = T.with_texts(told.select("doc_id", F.col("pos").alias("i"), (F.col("pos") + 1).alias("j")), told)
    return pairs.withColumns({
        "confidence": (70 + (F.col("doc_id") + F.col("i")) % 31) / 100.0, "description": F.expr("repeat('because ', cast(doc_id % 9 as int))"),
        "quote_i": F.substring("text_i", 1, 20), "quote_j": F.when(F.col("doc_id") % 3 == 0, "not there").otherwise(F.col("text_j")),
    })


@query(f"{_REPORTED} SELECT doc_id, i, j FROM reported WHERE confidence >= 0.8 AND length(text_i) >= 20 AND length(text_j) >= 20 AND length(description) >= 50")
def believable_conflicts(spark, sf):
    return T.believable(_reported(spark, sf)).select("doc_id", "i", "j")


@query(f"{_REPORTED} SELECT doc_id, i, j FROM reported WHERE confidence >= 0.9 AND contains(text_i, quote_i) AND contains(text_j, quote_j)")
def verified_conflicts(spark, sf):
    return T.verified(_reported(spark, sf)).select("doc_id", "i", "j")


@query(f"{_REPORTED} SELECT doc_id, i, j, 'i' AS side, 0 AS start, 20 AS \"end\", left(text_i, 20) AS snippet FROM reported UNION ALL SELECT doc_id, i, j, 'j', 0, length(left(text_j, 60))::INT, left(text_j, 60) FROM reported WHERE doc_id % 3 <> 0")
def conflict_evidence(spark, sf):
    """With snippets of 60 characters in place of 500, as clauses here are short."""
    return T.evidence(_reported(spark, sf), ["doc_id", "i", "j"], 60)


@query("SELECT doc_id, toxic FROM labels WHERE doc_id % 10 = 3 AND quality <> 2")
def unresolved_conflicts(spark, sf):
    """Labels stand for conflicts: ten contracts, a version per document, quality 2 for resolved."""
    labels = I.table(spark, sf, "labels")
    versions = labels.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("contract_id")).distinct()
    conflicts = labels.select(F.col("doc_id").alias("version_id"), F.when(F.col("quality") == 2, "RESOLVED").otherwise("OPEN").alias("status"), "doc_id", "toxic")
    return T.unresolved(conflicts, versions, 3).select("doc_id", "toxic")


# Ingest and comparison in one call


@query(rf"""{I.WITH}, {I.SUBS}, ok AS (SELECT doc_id FROM texts WHERE doc_id % 5 < 3 AND doc_id % 11 <> 0 AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100)
SELECT 'contracts' AS name, count(*) AS n FROM texts UNION ALL SELECT 'failed', (SELECT count(*) FROM texts) - (SELECT count(*) FROM ok) UNION ALL SELECT 'versions', count(*) FROM ok
UNION ALL SELECT 'parties', 2 * count(*) FROM ok UNION ALL SELECT 'clauses', (SELECT count(*) FROM clauses JOIN ok USING (doc_id)) + (SELECT count(*) FROM subs JOIN ok USING (doc_id))""")
def ingest_counts(spark, sf):
    """Rows of the four tables made from all documents as files, some of them of a wrong kind or too large."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".PDF", ".docx", ".md", ".exe")]), (F.col("doc_id") % 5 + 1).cast("int"))
    size = F.when(F.col("doc_id") % 11 == 0, K.MOST_BYTES + 1).otherwise(F.length("text"))
    files = I.contract_texts(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("/in/"), "doc_id", suffix).alias("path"), size.alias("size"), "text", F.lit('["Acme", "Beta"]').alias("answer"))
    made = G.ingest(files, F.lit("2024-01-01").cast("timestamp_ntz"))
    made["failed"] = made["contracts"].filter("status = 'failed'")
    counts = [made[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in ("contracts", "failed", "versions", "parties", "clauses")]
    return reduce(DataFrame.unionByName, counts)


# The stored tables: files of all documents, inserted in two runs of which the second brings the first one's again, then changed

_KINDS = (".txt", ".PDF", ".docx", ".md", ".TXT")
_GOOD = r"[n FOR n IN names IF n <> '' AND NOT regexp_matches(n, 'P\.?O\.?\s+Box|\d{5,}|(?i:tower|building|floor|street|avenue|road|hereinafter|referred\s+to\s+as)')]"
_STORED = rf"""WITH {_PARTY_TEXT}, raw_{I.TEXTS}, texts AS (SELECT doc_id, p.text || chr(10) || r.text AS text FROM raw_texts r JOIN party_texts p USING (doc_id)), {I.NORMAL}, {I.CAPITAL}, {I.SPLIT}, {I.CLAUSES}, {I.SUBS},
{_NAMES.replace('FROM party_texts', 'FROM texts')},
files AS (SELECT doc_id, doc_id::VARCHAR AS id, ['.txt', '.PDF', '.docx', '.md', '.TXT'][(doc_id % 5 + 1)::INT] AS suffix, CASE WHEN doc_id % 11 = 0 THEN {K.MOST_BYTES + 1} ELSE length(text) END AS size, text FROM texts),
k AS (SELECT *, CASE WHEN suffix = '.md' THEN 'unsupported file type' WHEN size > {K.MOST_BYTES} THEN 'file too large' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 100 THEN 'too little text' END AS error FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
names AS (SELECT doc_id, CASE WHEN len(good) > 0 THEN good ELSE names END AS names FROM (SELECT doc_id, names, {_GOOD} AS good FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['Acme ' || doc_id, 'Main Street 5', 'Beta'] ELSE names END AS names FROM named))),
every AS (SELECT 'contracts' AS name, id AS contract_id, id AS key, concat_ws('|', id, id || lower(suffix), id || suffix, substring(lower(suffix), 2), size, CASE WHEN error = 'file too large' THEN 'parsing' WHEN error IS NULL THEN 'completed' ELSE 'failed' END, coalesce(error, '-'), '2024-01-01 00:00:00', CASE WHEN error = 'file too large' THEN '2025-01-01 00:00:00' ELSE '2024-01-01 00:00:00' END) AS line FROM k
UNION ALL SELECT 'versions', id, sha256('version~' || id), concat_ws('|', sha256('version~' || id), id, 1, md5(k.text), md5(n.text), '2024-01-01 00:00:00') FROM k JOIN normal n USING (doc_id) WHERE error IS NULL
UNION ALL SELECT 'parties', id, sha256('party~' || id || '~' || nth), concat_ws('|', sha256('party~' || id || '~' || nth), id, name, '2024-01-01 00:00:00') FROM (SELECT id, unnest(names) AS name, unnest(range(len(names))) AS nth FROM k JOIN names USING (doc_id) WHERE error IS NULL)
UNION ALL SELECT 'clauses', id, sha256(id || '~' || pos), concat_ws('|', sha256(id || '~' || pos), id, sha256('version~' || id), clause_number, content, '-', pos, sha256(id || '~' || pos), '2024-01-01 00:00:00') FROM clauses JOIN k USING (doc_id) WHERE error IS NULL
UNION ALL SELECT 'clauses', id, sha256(id || '~' || pos || '~' || sub_pos), concat_ws('|', sha256(id || '~' || pos || '~' || sub_pos), id, sha256('version~' || id), clause_number, content, sha256(id || '~' || pos), sub_pos, sha256(id || '~' || pos || '~' || sub_pos), '2024-01-01 00:00:00') FROM subs JOIN k USING (doc_id) WHERE error IS NULL)
SELECT name, contract_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY key)) AS digest FROM every GROUP BY 1, 2"""


def _party_files(spark, sf) -> DataFrame:
    """Files (id, path, size, text, answer) of all documents, some of a wrong kind, too large or too short, a third with a model's answer."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % 5 + 1).cast("int"))
    texts = I.contract_texts(spark, sf).join(_party_texts(spark, sf).withColumnRenamed("text", "front"), "doc_id").withColumn("text", F.concat_ws("\n", "front", "text"))
    size = F.when(F.col("doc_id") % 11 == 0, K.MOST_BYTES + 1).otherwise(F.length("text"))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('["Acme '), "doc_id", F.lit('", "Main Street 5", "Beta"]')))
    return texts.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("/in/"), "doc_id", kind).alias("path"), size.cast("long").alias("size"), "text", answer.alias("answer"))


@query(_STORED)
def stored_tables(spark, sf):
    """All columns of the four tables, read back from the store: files of labelled documents, then files of all of them, the first run over again, a patch, and contracts deleted."""
    store, labels = ContractStore(spark, I.scratch(spark, "store")), I.table(spark, sf, "labels").select("doc_id", "quality")
    # taken up by eight stages, four a run
    files, now = I.written(_party_files(spark, sf), "store-files"), F.lit("2024-01-01").cast("timestamp_ntz")
    store.create()
    first = G.ingest(files.join(labels, "doc_id", "left_semi").drop("doc_id"), now)
    store.insert(first, "labelled")
    store.insert(G.ingest(files.drop("doc_id"), now), "all")
    store.insert(first, "labelled")
    large = store.read("contracts").filter("error_message = 'file too large'").select("id", F.lit("parsing").alias("status"))
    store.update(large, F.lit("2025-01-01").cast("timestamp_ntz"), "patch")
    store.delete(labels.filter("quality = 0").select(F.col("doc_id").cast("string").alias("id")), "deleted")
    out = []
    for name, df in store.tables().items():
        shown = [F.md5(c) if c in ("raw_text", "parsed_text") else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c.endswith("_at") else F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns]
        line = F.struct("id", F.concat_ws("|", *shown).alias("line"))
        key = F.col("id" if name == "contracts" else "contract_id").alias("contract_id")
        out.append(df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(line))["line"], "\n")).alias("digest")).select(F.lit(name).alias("name"), "contract_id", "n", "digest"))
    return reduce(DataFrame.unionByName, out)


@query("""SELECT 'txt' AS kind, md5(line) AS key, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY 2
UNION ALL SELECT 'csv', concat_ws('/', doc_id, quality, toxic), count(*) FROM labels GROUP BY 2
UNION ALL SELECT 'json', item_id || '/' || md5(text), count(*) FROM benchmark GROUP BY 2 UNION ALL SELECT 'error', 'docx', 1""")
def mixed_folder(spark, sf):
    """Documents as text files, labels as CSV, benchmark as JSON and a broken file in one folder, read back: lines, records and errors."""
    at = I.scratch(spark, "folder")
    # a file is parsed as a whole, so files do not grow with the table
    I.table(spark, sf, "documents").select("text").write.option("maxRecordsPerFile", 2000).text(f"{at}/texts")
    I.table(spark, sf, "labels").write.option("header", "true").csv(f"{at}/labels")
    I.table(spark, sf, "benchmark").write.json(f"{at}/benchmark")
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/broken.docx")
    broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken).close()
    register(spark)
    files, records = spark.read.format("clausegrid").load(at), read_records(spark, at)
    lines = files.filter("text IS NOT NULL").select(F.lit("txt").alias("kind"), F.explode(F.split("text", "\n")).alias("key")).filter("key <> ''").withColumn("key", F.md5("key"))
    errors = files.filter("error IS NOT NULL").select(F.lit("error").alias("kind"), F.element_at(F.split("path", r"\."), -1).alias("key"))
    field = lambda *names: [F.get_json_object("record", f"$.{n}") for n in names]
    csv = records.filter("kind = 'csv'").select("kind", F.concat_ws("/", *field("doc_id", "quality", "toxic")).alias("key"))
    told = records.filter("kind = 'json'").select("kind", F.concat_ws("/", *field("item_id"), F.md5(*field("text"))).alias("key"))
    return reduce(DataFrame.unionByName, (lines, errors, csv, told)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


_REQUESTS = """requests AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'Compare.' END AS prompt, l[1] AS source, l[2:] AS targets FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
checked AS (SELECT *, CASE WHEN prompt = ' ' THEN 'blank prompt' WHEN regexp_replace(source, '\\s', '', 'g') = '' THEN 'blank source' WHEN len(targets) < 1 THEN 'no target' WHEN len(targets) > 100 THEN 'too many targets' END AS fault FROM requests)"""
_COMPARED = f"""WITH {_REQUESTS}, results AS (SELECT doc_id, (i - 1)::BIGINT AS index, len(targets) AS total, coalesce(length(t) % 3 = 0 AND length(t) % 5 <> 0, false) AS conflict, CASE WHEN length(t) % 5 = 0 THEN 'Error' WHEN length(t) % 2 = 0 THEN 'High' ELSE 'Low' END AS severity
  FROM (SELECT doc_id, targets, unnest([{{'t': t, 'i': i}} FOR t, i IN targets], recursive := true) FROM checked WHERE fault IS NULL) AS q(doc_id, targets, t, i)),
runs AS (SELECT doc_id, max(total) AS total, count(*) FILTER (conflict) AS conflicts_found, count(*) FILTER (severity = 'Error') AS errors FROM results GROUP BY 1)
SELECT doc_id::VARCHAR AS run_id, 0 AS seq, 'status' AS type, 'Starting ' || total || ' comparisons' AS message, NULL::BIGINT AS index, NULL::BOOLEAN AS conflict, NULL::VARCHAR AS severity, total, NULL::BIGINT AS conflicts_found, NULL::BIGINT AS errors FROM runs
UNION ALL SELECT doc_id::VARCHAR, index + 1, 'result', NULL, index, conflict, severity, total, NULL, NULL FROM results
UNION ALL SELECT doc_id::VARCHAR, total + 1, 'complete', 'All comparisons completed', NULL, NULL, NULL, total, conflicts_found, errors FROM runs
UNION ALL SELECT doc_id::VARCHAR, 0, 'error', fault, NULL, NULL, NULL, NULL, NULL, NULL FROM checked WHERE fault IS NOT NULL"""


def _requests(docs: DataFrame) -> DataFrame:
    """A document is a request: its first line against the others, some without a prompt."""
    lines = F.split("text", "\n")
    return docs.select(F.col("doc_id").cast("string").alias("run_id"), F.when(F.col("doc_id") % 17 == 0, " ").otherwise("Compare.").alias("prompt"), F.get(lines, F.lit(0)).alias("source"), F.slice(lines, F.lit(2), F.size(lines)).alias("targets"))


def _by_length(rows: DataFrame) -> DataFrame:
    """Answers that follow from a target's length, some of them failed calls, read like any other answer."""
    n = F.length("target")
    said = F.concat(F.when(n % 3 == 0, "Conflict: Yes").otherwise("Conflict: No"), F.when(n % 2 == 0, ". Severity: High").otherwise(". Severity: Low"))
    return V.judged(rows.withColumn("answer", F.when(n % 5 == 0, "Error: no reply").otherwise(said)))


@query(_COMPARED)
def comparison_events(spark, sf):
    """Events of one-to-many comparisons of every document; requests with no prompt, no source, no target or over 100 are refused."""
    return M.compared(_requests(I.table(spark, sf, "documents")), _by_length)


@query(_COMPARED)
def streamed_comparison_events(spark, sf):
    """The same through a stream that ends in the middle: the second batch is written and then fails, and is run again."""
    at = I.scratch(spark, "comparisons")
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    for half in (0, 1):  # files of both halves, as many as there are tasks; a batch takes half of all files
        I.spread(docs.filter(F.col("doc_id") % 2 == half)).write.mode("append").parquet(f"{at}/in")
    files = len(spark.read.schema(docs.schema).parquet(f"{at}/in").inputFiles())
    stream = _requests(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(1, files - files // 2)).parquet(f"{at}/in"))

    def lost(requests: DataFrame, batch_id: int) -> None:
        M.compared(requests, _by_length).write.mode("overwrite").parquet(f"{at}/out/batch={batch_id}")
        if batch_id == 1:
            raise RuntimeError("lost after the write, before the batch counted as done")

    with contextlib.suppress(StreamingQueryException):
        stream.writeStream.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).foreachBatch(lost).start().awaitTermination()
    M.write_events(stream, f"{at}/out", f"{at}/check", _by_length).awaitTermination()
    return M.read_events(spark, f"{at}/out").drop("batch")


# Values and claims

_STATED = (
    "The supplier shall make payment of USD 1,000.00 within 30 days.", "The supplier shall not make payment within one month, or two weeks.", "The buyer must accept; the governing law is that of Dubai.",
    "Notwithstanding clause 2, the supplier shall make payment of 1 thousand dollars in thirty (30) calendar days.", "The buyer must not accept; the governing law is that of England and Wales from 1 March 2024.", "The courts of the UAE have jurisdiction.",
    "A lock-up of 12 months.", "A lock-up of one year or 400 days applies.", "The supplier is permitted to terminate at 5% on 31 June 2024 or 2024-07-01.", "The supplier is prohibited to terminate, at 5.00 per cent.", "The fee is AED 5.5 million and 20 euros.",
)


def _stating(spark, sf) -> DataFrame:
    """Clauses with a sentence that states values in front of what they say."""
    said = F.element_at(F.array(*[F.lit(x) for x in _STATED]), ((F.col("doc_id") + F.col("pos")) % len(_STATED) + 1).cast("int"))
    return I.extracted(spark, sf).select("doc_id", "pos", "clause_number", F.concat(said, F.lit(" "), "content").alias("content"))


def _sql_map(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in table.items()) + "}"


def _sql_part(kind: str, *groups: int) -> str:
    return " || ".join(f"regexp_extract(m, '{W.PATTERNS[kind]}', {g})" for g in groups)


_DAYS = f"coalesce(TRY_CAST({_sql_part('DURATION', 1)} AS BIGINT), {_sql_map(W.NUMBERS)}[lower({_sql_part('DURATION', 1)})])"
_UNIT = f"lower({_sql_part('DURATION', 2)})"
_COUNT = "n || ' ' || u || CASE WHEN n = 1 THEN '' ELSE 's' END"
_MONEY = f"(TRY_CAST(replace({_sql_part('AMOUNT', 3, 5)}, ',', '') AS DECIMAL(24,4)) * coalesce({_sql_map(W.SCALES)}[lower({_sql_part('AMOUNT', 4, 6)})], 1))"
_PLAIN = r"regexp_replace(({n})::VARCHAR, '\.?0+$', '')"
_DAY = f"TRY_CAST(concat_ws('-', {_sql_part('DATE', 1, 6, 9)}, coalesce(nullif({_sql_part('DATE', 2)}, ''), lpad(list_position({list(W.MONTHS)!r}, lower({_sql_part('DATE', 5, 7)}))::VARCHAR, 2, '0')), lpad({_sql_part('DATE', 3, 4, 8)}, 2, '0')) AS DATE)"
_READ = {
    "DURATION": f"(SELECT CASE WHEN u = 'month' AND n % 12 = 0 AND n > 0 THEN (n // 12) || ' year' || CASE WHEN n = 12 THEN '' ELSE 's' END ELSE {_COUNT} END FROM (SELECT CASE {_UNIT} WHEN 'week' THEN 7 WHEN 'year' THEN 12 ELSE 1 END * {_DAYS} AS n, CASE WHEN {_UNIT} IN ('day', 'week') THEN 'day' ELSE 'month' END AS u))",
    "AMOUNT": f"{_sql_map(W.CURRENCIES)}[lower({_sql_part('AMOUNT', 1, 2, 7)})] || ' ' || {_PLAIN.format(n=_MONEY)}",
    "PERCENT": _PLAIN.format(n=f"TRY_CAST({_sql_part('PERCENT', 1)} AS DECIMAL(24,4))") + " || '%'", "DATE": f"strftime({_DAY}, '%Y-%m-%d')", "JURISDICTION": f"{_sql_map(W.JURISDICTIONS)}[lower(m)]",
}
_SAID = f"{I.WITH}, said AS (SELECT doc_id, pos, clause_number, {list(_STATED)!r}[((doc_id + pos) % {len(_STATED)} + 1)::INT] || ' ' || content AS content FROM clauses)"
_VALUES = _SAID + ", matched AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, {k} AS kind_at, '{kind}' AS kind, x.m AS m, x.i AS i FROM (SELECT doc_id, pos, unnest([{{'m': m, 'i': i}} FOR m, i IN regexp_extract_all(content, '{W.PATTERNS[kind]}', 0)]) AS x FROM said)" for k, kind in enumerate(W.KINDS)) + f"""),
  read AS (SELECT doc_id, pos, kind_at, kind, i, m, CASE kind {' '.join(f"WHEN '{kind}' THEN {_READ[kind]}" for kind in W.KINDS)} END AS value FROM matched),
  vals AS (SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id, pos ORDER BY kind_at, i) - 1)::INT AS nth, kind, value, m FROM read WHERE value IS NOT NULL)"""


@query(f"{_VALUES} SELECT doc_id, pos, nth AS \"at\", kind, value, m AS source FROM vals")
def clause_values(spark, sf):
    return W.value_rows(_stating(spark, sf), ["doc_id", "pos"]).select("doc_id", "pos", "at", "kind", "value", "source")


@query(f"{_VALUES} SELECT kind, count(*) AS n, count(DISTINCT value) AS \"values\" FROM vals GROUP BY 1 ORDER BY n DESC, kind")
def value_kind_counts(spark, sf):
    return W.kind_counts(W.value_rows(_stating(spark, sf), ["doc_id", "pos"]))


_TOPIC = f"CASE WHEN regexp_matches(content, '{Q.LOCK_UP}') THEN 'LOCK_UP' ELSE {_FUNCTION} END"
_MODALITY = "CASE " + " ".join(f"WHEN regexp_matches(content, '{p}') THEN '{n}'" for n, p in Q.MODALITIES.items()) + " END"
_MADE = f"""{_VALUES}, claims AS (SELECT doc_id, doc_id || '/' || pos || '/' || coalesce(nth, 0) AS id, {_TOPIC} AS topic, coalesce(lower(nullif(regexp_extract(content, '{Q.SUBJECT}', 1), '')), '') AS subject, {_MODALITY} AS modality,
  kind, value, regexp_replace(clause_number, '[.)]+$', '') AS clause, CASE WHEN regexp_matches(content, '{Q.OVERRIDES}') THEN nullif(regexp_extract(content, '{Q.OVERRIDDEN}', 1), '') END AS over FROM said LEFT JOIN vals USING (doc_id, pos))"""


@query(f"{_MADE} SELECT doc_id, id AS claim_id, topic, subject, coalesce(modality, '') AS modality, coalesce(kind, '') AS value_type, coalesce(value, '') AS value, clause, coalesce(over, '') AS overrides FROM claims")
def clause_claims(spark, sf):
    claims = Q.claims_of(_stating(spark, sf), ["doc_id"])
    return claims.select("doc_id", "claim_id", "topic", *[F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "modality", "value_type", "value")], "clause", F.coalesce("overrides", F.lit("")).alias("overrides"))


_OPPOSED = " OR ".join(f"(a.modality = '{x}' AND b.modality = '{y}') OR (a.modality = '{y}' AND b.modality = '{x}')" for x, y in Q.OPPOSITES)


@query(f"""{_MADE}, pairs AS (SELECT a.doc_id, a.id AS i, b.id AS j, a.topic, CASE WHEN a.subject = b.subject AND ({_OPPOSED}) THEN 'modality' WHEN a.kind = b.kind AND a.subject = b.subject AND a.value <> b.value THEN 'value'
  WHEN a.kind = 'JURISDICTION' AND b.kind = 'JURISDICTION' AND a.value <> b.value THEN 'jurisdiction' WHEN a.topic = 'PAYMENT' AND a.kind = 'DURATION' AND b.kind = 'DURATION' AND a.subject = b.subject THEN 'payment_timing'
  WHEN a.topic = 'LOCK_UP' AND a.kind = 'DURATION' AND b.kind = 'DURATION' THEN 'lock_up' END AS rule FROM claims a JOIN claims b ON a.doc_id = b.doc_id AND a.topic = b.topic AND a.id < b.id WHERE NOT coalesce(a.over = b.clause, false) AND NOT coalesce(b.over = a.clause, false))
SELECT * FROM pairs WHERE rule IS NOT NULL""")
def contradicting_claims(spark, sf):
    """Claims of each document's clauses that contradict, with overrides among them."""
    return Q.find_conflicts(I.written(Q.claims_of(_stating(spark, sf), ["doc_id"]), "claims"), ["doc_id"])


_NUMBERS = ("1", "1.1", "1.1.1.", "1.1.1.1", "1.1.1.1.1", "1.1.1.1.1.1", "(a)", "Appendix A", "A.1", "A.1.2", "2", "2.1", "3.1.4")
_HEADINGS = ("Payment of invoices", "Termination", "Confidential matters", "Liability", "Notices")


@query(f"""WITH RECURSIVE n AS (SELECT user_id, event_id AS pos, {list(_NUMBERS)!r}[(event_id * 5 % 13 + 1)::INT] AS number, {list(_HEADINGS)!r}[(event_id % 5 + 1)::INT] AS content FROM events),
l AS (SELECT *, CASE WHEN regexp_matches(number, '{O.APPENDIX}') THEN 'A' WHEN number <> '(a)' THEN regexp_replace(number, '[.)]+$', '') END AS label, regexp_matches(number, '{O.APPENDIX}') AS top FROM n),
asks AS (SELECT user_id, pos, k, array_to_string(string_split(label, '.')[:len(string_split(label, '.')) - k], '.') AS label FROM (SELECT *, unnest(range(1, len(string_split(label, '.')))) AS k FROM l WHERE label IS NOT NULL AND NOT top)),
met AS (SELECT a.user_id, a.pos, k, max(h.pos) AS spot FROM asks a JOIN l h ON h.user_id = a.user_id AND h.label = a.label AND h.pos < a.pos GROUP BY 1, 2, 3),
near AS (SELECT user_id, pos, arg_min(spot, k) AS spot FROM met GROUP BY 1, 2),
p AS (SELECT l.*, CASE WHEN label IS NULL THEN max(CASE WHEN label IS NOT NULL THEN l.pos END) OVER (PARTITION BY l.user_id ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE near.spot END AS parent_pos FROM l LEFT JOIN near ON near.user_id = l.user_id AND near.pos = l.pos),
tree AS (SELECT user_id, pos, pos AS root_pos, 0 AS depth FROM p WHERE parent_pos IS NULL UNION ALL SELECT p.user_id, p.pos, root_pos, depth + 1 FROM p JOIN tree t ON t.user_id = p.user_id AND t.pos = p.parent_pos)
SELECT p.user_id, p.pos, p.number, p.parent_pos, t.root_pos, t.depth, {_FUNCTION.replace('content', 'r.content')} AS category FROM p JOIN tree t ON t.user_id = p.user_id AND t.pos = p.pos JOIN n r ON r.user_id = p.user_id AND r.pos = t.root_pos""")
def clause_outline(spark, sf):
    """Outlines of clauses of up to depth 6 with appendices, and the category that each clause gets from the top."""
    e = I.table(spark, sf, "events")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    rows = e.select("user_id", F.col("event_id").alias("pos"), pick(_NUMBERS, F.col("event_id") * 5 % 13).alias("number"), pick(_HEADINGS, F.col("event_id") % 5).alias("content"))
    out = O.with_category(O.with_roots(O.outline(rows, "user_id"), "user_id", most_depth=8), "content", "user_id")
    return out.select("user_id", "pos", "number", "parent_pos", "root_pos", "depth", "category")


# Comparisons with results: the answer follows from the prompt's length, and a clock that goes on by a quarter of a second each time stands in for time


def _tick():
    """A clock that has gone on by a quarter of a second each time it is looked at."""
    ticks = itertools.count()
    return lambda: next(ticks) / 4


def _told_by_length(prompt: str):
    n = len(prompt)
    if n % 7 == 0:
        raise ValueError("no reply")
    yield "Conflict: " + ("Yes" if n % 3 == 0 else "No")
    yield from (" so",) * (n % 4)
    if n % 5:
        yield " Severity: " + ("High" if n % 2 else "Low")


_ANSWERED = """answered AS (SELECT *, n % 7 = 0 AS failed, 1 + n % 4 + CASE WHEN n % 5 <> 0 THEN 1 ELSE 0 END AS tokens, 'Conflict: ' || CASE WHEN n % 3 = 0 THEN 'Yes' ELSE 'No' END || repeat(' so', (n % 4)::INT) || CASE WHEN n % 5 = 0 THEN '' WHEN n % 2 = 1 THEN ' Severity: High' ELSE ' Severity: Low' END AS answer FROM prompts),
results AS (SELECT *, NOT failed AND n % 3 = 0 AS conflict, CASE WHEN failed THEN 'Error: no reply' ELSE answer END AS explanation, CASE WHEN failed THEN 'Error' WHEN n % 5 = 0 THEN 'Unknown' WHEN n % 2 = 1 THEN 'High' ELSE 'Low' END AS severity,
  CASE WHEN failed THEN 0 ELSE tokens END AS total_tokens, CASE WHEN failed THEN 0 ELSE 0.25 END::DOUBLE AS time_to_first_token, CASE WHEN failed THEN 0 ELSE 0.5 END::DOUBLE AS total_time FROM answered)"""
_AROUND = len("\n\n[Source clause]\n" + "\n\n[Target clause " + "]\n" + "\n\n" + V.ASK)  # what a prompt holds beside the texts
_TARGETED = f"""WITH {_REQUESTS}, prompts AS (SELECT doc_id, (i - 1)::BIGINT AS index, len(targets) AS total, length(prompt) + length(source) + length(t) + length(i::VARCHAR) + {_AROUND} AS n
  FROM (SELECT doc_id, prompt, source, targets, unnest([{{'t': t, 'i': i}} FOR t, i IN targets], recursive := true) FROM checked WHERE fault IS NULL) AS q(doc_id, prompt, source, targets, t, i)), {_ANSWERED}"""


@query(f"{_TARGETED} SELECT doc_id::VARCHAR AS run_id, index, total, conflict, explanation, severity, total_tokens, time_to_first_token, total_time, CASE WHEN failed THEN 0 ELSE total_tokens / 0.5 END::DOUBLE AS tokens_per_second FROM results")
def compared_one_to_many(spark, sf):
    """Each document's first line against its others, through a provider that yields tokens, with what every call took."""
    out = B.compare_one_to_many(_requests(I.table(spark, sf, "documents")), _told_by_length, clock=_tick)
    return out.select("run_id", "index", "total", "conflict", "explanation", "severity", "performance.*")


@query(f"{_TARGETED} SELECT doc_id::VARCHAR AS run_id, count(*) AS n, sum(total_tokens)::BIGINT AS tokens, sum(total_time) AS seconds, sum(total_tokens) / sum(total_time) AS tokens_per_second, max(time_to_first_token) AS longest_wait FROM results WHERE NOT failed GROUP BY 1")
def performance_of_runs(spark, sf):
    return B.performance(B.compare_one_to_many(_requests(I.table(spark, sf, "documents")), _told_by_length, clock=_tick), ["run_id"])


# Where clauses stand in their texts

_SPANS = r"""located AS (SELECT doc_id, pos::INT AS pos, p, before, regexp_replace(p, '^\s+|\s+$', '', 'g') AS bare, length(p) - length(regexp_replace(p, '^\s+', '')) AS lead FROM (
    SELECT doc_id, unnest([{'pos': i - 2, 'p': x, 'before': coalesce(list_sum([length(y) FOR y IN ps[:i - 1]]), 0)} FOR x, i IN ps], recursive := true) FROM pieces) AS q(doc_id, pos, p, before) WHERE pos >= 0),
  cut AS (SELECT doc_id, pos, before + lead AS spot, string_split_regex(bare, '=+\s*') AS kept, regexp_extract_all(bare, '=+\s*', 0) AS gone FROM located),
  spans AS (SELECT doc_id, pos, s AS start, s + n AS "end" FROM (SELECT doc_id, pos, unnest([{'s': spot + coalesce(list_sum([length(y) FOR y IN kept[:i - 1]]), 0) + coalesce(list_sum([length(y) FOR y IN gone[:i - 1]]), 0), 'n': length(x)} FOR x, i IN kept], recursive := true) FROM cut) AS q(doc_id, pos, s, n) WHERE n > 0),
  kept AS (SELECT s.* FROM spans s SEMI JOIN clauses c ON c.doc_id = s.doc_id AND c.pos = s.pos)"""


def _processed(spark, sf) -> DataFrame:
    return I.contract_texts(spark, sf).select("doc_id", X.capitalize_titles(X.normalize(F.col("text"))).alias("text"))


@query(f'{I.WITH}, {_SPANS} SELECT doc_id, pos, start::BIGINT AS start, "end"::BIGINT AS "end", md5(substring(text, (start + 1)::BIGINT, ("end" - start)::BIGINT)) AS digest FROM spans JOIN capital USING (doc_id)')
def clause_spans(spark, sf):
    """Where each clause stands, and that this is what stands there."""
    texts = _processed(spark, sf)
    spans = D.clause_spans(texts).join(texts, "doc_id")
    return spans.select("doc_id", "pos", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.expr("substring(text, cast(start + 1 AS INT), cast(end - start AS INT))")).alias("digest"))


@query(f"""{I.WITH}, {_SPANS}, reach AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM kept),
islands AS (SELECT *, sum(CASE WHEN start <= r THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM reach), merged AS (SELECT doc_id, k, min(start) AS s, max("end") AS e FROM islands GROUP BY 1, 2),
sums AS (SELECT doc_id, sum(e - s) AS covered, count(*) AS n, min(s) AS f, max(e) AS t FROM merged GROUP BY 1)
SELECT c.doc_id, length(text) AS n_chars, coalesce(covered, 0)::BIGINT AS covered, coalesce(n - 1 + CASE WHEN f > 0 THEN 1 ELSE 0 END + CASE WHEN t < length(text) THEN 1 ELSE 0 END, CASE WHEN length(text) > 0 THEN 1 ELSE 0 END)::BIGINT AS gaps,
CASE WHEN length(text) > 0 THEN round(100.0 * coalesce(covered, 0)::DOUBLE / length(text), 4) ELSE 0 END::DOUBLE AS coverage FROM capital c LEFT JOIN sums USING (doc_id)""")
def clause_coverage(spark, sf):
    """How much of each text the clauses that stay cover, by the union of where they stand."""
    texts = I.written(_processed(spark, sf), "processed")
    return D.coverage(texts, D.clause_spans(texts).filter("NOT is_toc"))


# For users of SQL


@query(f"{I.WITH} SELECT doc_id, pos, clause_number, md5(content) AS digest, array_to_string([x.clause_number || x.content FOR x IN subs], '|') AS subs FROM split WHERE NOT regexp_matches(content, '\\.{{5,}}')")
def clauses_by_sql(spark, sf):
    """Clauses through the registered table function and a lateral join, in SQL alone."""
    register_functions(spark)
    I.contract_texts(spark, sf).createOrReplaceTempView("clausegrid_texts")
    return spark.sql("""
        SELECT d.doc_id, c.pos, c.clause_number, md5(c.content) AS digest, array_join(transform(c.subs, x -> concat(x.clause_number, x.content)), '|') AS subs
        FROM (SELECT doc_id, capitalize_titles(normalize_text(text)) AS text FROM clausegrid_texts) d, LATERAL contract_clauses(d.text) c WHERE NOT has_leader(c.content)""")


# Tables: a conversation is a page with a table of its turns, with cells that span columns and rows

_TURN_ROWS = """turn_rows AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS row, (CASE WHEN turn % 4 = 2 THEN turn - 1 ELSE turn END)::VARCHAR AS turn,
  CASE WHEN turn % 3 = 0 THEN role || ' ' || length(text) ELSE role END AS said, CASE WHEN turn % 3 = 0 THEN role || ' ' || length(text) ELSE length(text)::VARCHAR END AS said_2 FROM conversations)"""


def _turn_tables(spark, sf) -> DataFrame:
    """Pages (conv_id, html) with a table of the turns."""
    turn, size = F.col("turn").cast("string"), F.length("text").cast("string")
    first = F.when(F.col("turn") % 4 == 2, "").when(F.col("turn") % 4 == 1, F.concat(F.lit("<td rowspan=2>"), turn, F.lit("</td>"))).otherwise(F.concat(F.lit("<td>"), turn, F.lit("</td>")))
    rest = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<td colspan='2'>"), "role", F.lit(" <b>"), size, F.lit("</b></td>"))).otherwise(F.concat(F.lit("<td>"), "role", F.lit("<td>"), size))
    rows = I.table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("<tr>"), first, rest, F.lit("</tr>")).alias("line")).alias("r"))
    lines = F.array_join(F.array_sort(F.collect_list("r"))["line"], "\n")
    return rows.groupBy("conv_id").agg(F.concat(F.lit("<h1>Turns</h1><table><tr><th>Turn</th><th colspan=2>Said</th></tr>"), lines, F.lit("</table>")).alias("html"))


@query(f"WITH {_TURN_ROWS} SELECT conv_id, row, turn, said, said_2, 'Turn: ' || turn || '; Said: ' || said || '; Said_2: ' || said_2 AS line FROM turn_rows")
def table_rows(spark, sf):
    found = tables(table_cells(_turn_tables(spark, sf), ["conv_id"], "html"), ["conv_id"])
    rows = found.select("conv_id", F.split("formatted_text", "\n").alias("lines"), F.posexplode("rows").alias("row", "r"))
    return rows.select("conv_id", "row", F.col("r")["Turn"].alias("turn"), F.col("r")["Said"].alias("said"), F.col("r")["Said_2"].alias("said_2"), F.get("lines", "row").alias("line"))


@query("SELECT conv_id, 0 AS table_no, turn, n AS n_matched, n / 3.0::DOUBLE AS share FROM (SELECT conv_id, turn, (CASE WHEN contains(t, 'turn') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'said') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'said_2') THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT conv_id, turn, lower(CASE turn % 3 WHEN 0 THEN 'As SAID in ' WHEN 1 THEN 'Turn and said_2: ' ELSE '' END || text) AS t FROM conversations)) WHERE n >= 1")
def table_links(spark, sf):
    """Turns stand for the clauses of the page, some of which speak of its table's columns."""
    found = tables(table_cells(_turn_tables(spark, sf), ["conv_id"], "html"), ["conv_id"])
    front = F.when(F.col("turn") % 3 == 0, "As SAID in ").when(F.col("turn") % 3 == 1, "Turn and said_2: ").otherwise("")
    clauses = I.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(front, "text").alias("content"))
    return linked(found, clauses, ["conv_id"], "turn", least=0.3)


# What takes part in detection, and the pairs that pass

_MORE = (
    "The supplier shall make payment of all invoices under Section 2.1 and Appendix 3; see also Clause 4.", "The fee is confidential, as defined in Article 7.2, pursuant to clause 2.1.", "Notwithstanding clause 3, the lower fee shall prevail in any case.",
    "The courts of Dubai have jurisdiction over any dispute of the parties.", "TABLE OF CONTENTS", "Any notice follows the mediation procedure that the issuer and the underwriter have agreed.", "12.", "Liability is limited; confidential terms bind the underwriter.",
)
_HEADING = ("Terms", "APPENDIX", "Fees")


def _detected(spark, sf) -> DataFrame:
    """Clauses (doc_id, pos, clause_number, heading, content) of all the kinds that the rules tell apart; a third repeats the text of a kind as it is."""
    k = (F.col("doc_id") + F.col("pos")) % len(_MORE)
    said = F.element_at(F.array(*[F.lit(x) for x in _MORE]), (k + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(x) for x in _HEADING]), (F.col("pos") % 3 + 1).cast("int"))
    number = F.when(F.col("pos") % 5 == 4, F.concat(F.lit("0."), "clause_number")).otherwise(F.col("clause_number"))
    text = F.when((F.col("pos") % 3 == 0) | (k == 6), said).otherwise(F.concat_ws(" ", said, "content"))
    return I.extracted(spark, sf).select("doc_id", "pos", number.alias("clause_number"), head.alias("heading"), text.alias("content"))


_DETECTED = f"""{I.WITH}, base AS (SELECT doc_id, pos, (doc_id + pos) % {len(_MORE)} AS k, CASE WHEN pos % 5 = 4 THEN '0.' || clause_number ELSE clause_number END AS clause_number, {list(_HEADING)!r}[(pos % 3 + 1)::INT] AS heading, content FROM clauses),
detected AS (SELECT doc_id, pos, clause_number, heading, CASE WHEN pos % 3 = 0 OR k = 6 THEN {list(_MORE)!r}[(k + 1)::INT] ELSE {list(_MORE)!r}[(k + 1)::INT] || ' ' || content END AS content FROM base)"""
_TOC_LINE = r"((regexp_matches(content, '^\d+(?:\.\d+)*\.?\s+\S.*\s\d{1,3}$') AND length(content) < 100) OR regexp_matches(content, '\.{5,}') OR regexp_matches(lower(content), '^\s*(table of )?contents\s*$'))"
_BARE = r"length(regexp_replace(content, '^\s+|\s+$', '', 'g'))"
_PART = f"NOT (starts_with(clause_number, '0.') OR (upper(heading) IN ('APPENDIX', 'SCHEDULE', 'ANNEX', 'EXHIBIT') AND length(content) < 50) OR contains(upper(content), 'TABLE OF CONTENTS')) AND {_BARE} >= 20 AND NOT regexp_matches(content, '{E.OVERRIDE_TAG}')"
_ELIGIBLE = f"{_DETECTED}, clean AS (SELECT * FROM detected WHERE NOT {_TOC_LINE} AND {_BARE} >= 20 QUALIFY row_number() OVER (PARTITION BY doc_id, content ORDER BY pos) = 1), eligible AS (SELECT * FROM clean WHERE {_PART})"


@query(f"{_DETECTED} SELECT doc_id, pos, array_to_string([x FOR x, i IN r IF list_position(r, x) = i], ',') AS refs, regexp_matches(content, '{E.OVERRIDE_TAG}') AS override FROM (SELECT *, list_concat(list_concat({', '.join(f"regexp_extract_all(content, '{p}', 1)" for p in E.REFERENCES[:2])}), list_concat({', '.join(f"regexp_extract_all(content, '{p}', 1)" for p in E.REFERENCES[2:])})) AS r FROM detected)")
def all_references(spark, sf):
    return _detected(spark, sf).select("doc_id", "pos", F.array_join(E.references(F.col("content")), ",").alias("refs"), E.is_override(F.col("content")).alias("override"))


@query(f"{_ELIGIBLE} SELECT doc_id, pos, clause_number FROM eligible")
def clauses_in_detection(spark, sf):
    """Clauses without contents lines, lone numbers, repeats, metadata, bare headings and overrides."""
    return E.taking_part(E.cleaned(_detected(spark, sf))).select("doc_id", "pos", "clause_number")


_IN_CATEGORY = "tagged AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, '{name}' AS category FROM eligible WHERE {_sql_any('lower(content)', words)}" for name, words in E.CATEGORIES.items()) + "), labelled AS (SELECT * FROM tagged UNION ALL SELECT doc_id, pos, 'GENERAL' FROM eligible e WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.doc_id = e.doc_id AND t.pos = e.pos))"
_LABELLED = f"{_ELIGIBLE}, {_IN_CATEGORY}"


def _pairs_within(clauses: str) -> str:
    return f"paired AS (SELECT doc_id, a.pos AS i, b.pos AS j, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM {clauses} a JOIN {clauses} b USING (doc_id, category) WHERE a.pos < b.pos GROUP BY 1, 2, 3)"


@query(f"{_LABELLED}, {_pairs_within('labelled')} SELECT * FROM paired")
def pairs_of_categories(spark, sf):
    """All pairs of a document's clauses within a category."""
    pairs = E.category_pairs(E.taking_part(E.cleaned(_detected(spark, sf))))
    return pairs.select("doc_id", "i", "j", F.array_join("categories", ",").alias("categories"))


_PAIRED = f"{_LABELLED}, first AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY doc_id, category ORDER BY pos) <= 40), {_pairs_within('first')}"  # of pairs_past_the_gate alone: all pairs are in pairs_of_categories
_ONLY = "(regexp_matches(lower(content), 'notice|procedure|mediation|escalation') AND NOT regexp_matches(lower(content), 'jurisdiction|governing law|courts of'))"


@query(f"""{_PAIRED}, told AS (SELECT doc_id, pos, {_FUNCTION} AS f, {_ONLY} AS procedure, regexp_matches(content, '{R.OVERRIDE}') AS bypass FROM eligible)
SELECT p.doc_id, i, j, a.f AS function_i, b.f AS function_j FROM paired p JOIN told a ON a.doc_id = p.doc_id AND a.pos = i JOIN told b ON b.doc_id = p.doc_id AND b.pos = j
WHERE (a.f = b.f OR (a.f = 'INDEMNITY_LIABILITY' AND b.f = 'CONFIDENTIALITY') OR (a.f = 'CONFIDENTIALITY' AND b.f = 'INDEMNITY_LIABILITY') OR a.bypass OR b.bypass) AND NOT a.procedure AND NOT b.procedure""")
def pairs_past_the_gate(spark, sf):
    """Pairs of a category's first 40 clauses whose functions may be compared, without procedure beside jurisdiction: the rules on real pairs."""
    eligible = I.written(E.taking_part(E.cleaned(_detected(spark, sf))).select("doc_id", "pos", "content"), "eligible")
    return E.gated(E.category_pairs(eligible, most=40), eligible).select("doc_id", "i", "j", "function_i", "function_j")


@query(f"""{I.WITH}, {I.SUBS} SELECT doc_id::VARCHAR AS contract_id, 'main' AS kind, count(*) AS n FROM clauses GROUP BY 1 UNION ALL SELECT doc_id::VARCHAR, 'sub', count(*) FROM subs GROUP BY 1
UNION ALL SELECT doc_id::VARCHAR, 'all', count(*) FROM (SELECT doc_id FROM clauses UNION ALL SELECT doc_id FROM subs) GROUP BY 1""")
def clauses_of_kinds(spark, sf):
    flat = C.flat_clauses(I.extracted(spark, sf)).select(F.col("contract_id").cast("string").alias("contract_id"), "parent_clause_id")
    flat = I.written(flat, "flat")
    return reduce(DataFrame.unionByName, [E.of_kind(flat, k).groupBy("contract_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k in ("all", "main", "sub")]).select("contract_id", "kind", "n")


# Answers and summaries


@query(f"SELECT doc_id, md5('{A.PARTIES_ASKED.replace(chr(39), chr(39) * 2)}' || array_to_string([x FOR x IN string_split_regex(text, '\\s+') IF x <> ''][:4000], ' ') || chr(10)) AS digest FROM documents")
def party_prompts(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.md5(A.party_prompt(F.col("text"))).alias("digest"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '[\"A' || doc_id || '\"]' WHEN 1 THEN 'said ' || doc_id END AS content FROM documents")
def reply_contents(spark, sf):
    reply = F.expr("""case doc_id % 6 when 0 then concat('{"message":{"role":"assistant","content":"[\\\\"A', doc_id, '\\\\"]"}}') when 1 then concat('{"choices":[{"message":{"content":"said ', doc_id, '"}}]}') when 2 then '{"message":{"content":""}}'
        when 3 then '{"choices":[]}' when 4 then 'no json' else '{"message":{"x":1},"choices":[{"message":{"content":"other"}}]}' end""")
    return I.table(spark, sf, "documents").select("doc_id", A.content_of(reply).alias("content"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 IN (3, 4) OR (doc_id % 5 = 0 AND doc_id % 11 >= 5 AND doc_id % 7 <> 0)")
def clauses_that_hold(spark, sf):
    """Documents stand for clauses with a model's check: of varying quality, some of contents lines, invalid, or without a check."""
    answer = F.expr("""case doc_id % 5 when 0 then concat('```json\n{"is_valid": true, "quality_score": ', (doc_id % 11) / 10.0, ', "is_toc_entry": ', doc_id % 7 = 0, ', "issues": []}\n```') when 1 then '{"is_valid": false, "quality_score": 0.9}' when 2 then '{"quality_score": 0.4}'
        when 3 then 'no check' else '{"is_valid": true}' end""")
    rows = I.table(spark, sf, "documents").select("doc_id", A.check_of(answer).alias("check"))
    return A.good_clauses(rows).select("doc_id")


@query(r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'عقد ' || doc_id || chr(10) || ' 12 ' ELSE '' END AS t FROM documents), l AS (SELECT doc_id, t, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '\p{L}')] AS ls FROM t),
p AS (SELECT doc_id, t, array_to_string([x FOR x IN ls IF NOT regexp_matches(x, '\p{Arabic}')], chr(10)) AS e, array_to_string([x FOR x IN ls IF regexp_matches(x, '\p{Arabic}')], chr(10)) AS a FROM l)
SELECT doc_id, e <> '' AND a <> '' AS is_bilingual, length(e) AS english_length, length(a) AS arabic_length, length(t) AS original_length FROM p""")
def bilingual_lengths(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nعقد "), F.col("doc_id").cast("string"), F.lit("\n 12 "))).otherwise(F.col("text"))
    return A.bilingual_lengths(I.table(spark, sf, "documents").select("doc_id", t.alias("content")), ["doc_id"])


@query(f"{I.WITH}, parties AS (SELECT doc_id, doc_id % 3 AS n FROM documents) SELECT d.doc_id::VARCHAR AS id, coalesce(c.n, 0) AS clause_count, coalesce(s.n, 0) - coalesce(c.n, 0) AS removed_count, d.doc_id % 3 AS party_count FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM clauses GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM split GROUP BY 1) s USING (doc_id)")
def upload_summaries(spark, sf):
    """Clauses that stay, those that were taken out, and parties of each contract, of which some have none."""
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    of = lambda rows: rows.select(F.col("doc_id").cast("string").alias("contract_id"))
    found = C.split_clauses(_processed(spark, sf)).select("doc_id", "content")
    parties = docs.filter("doc_id % 3 > 0").select(F.col("id").alias("contract_id"), F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int"))).alias("k"))
    return A.upload_summary(docs, parties, of(C.remove_toc(found)), of(found))


@query(f"WITH {I.CONTRACTS} SELECT status, count(*) AS n FROM contracts WHERE created_at > TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 1 DAY GROUP BY 1")
def recent_status_counts(spark, sf):
    return A.recent_status_counts(I.contracts(spark, sf), F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))


# Earlier operators on rows that meet their rules: sources with hundreds of clauses, resolved conflicts, quotes inside texts, failed calls, and all tiers together


def _of_sources(spark, sf) -> DataFrame:
    """The clauses of all documents of a source as one sequence: (source, k)."""
    docs = I.table(spark, sf, "documents").select("doc_id", "source")
    rows = I.extracted(spark, sf).select("doc_id", "pos").join(docs, "doc_id")
    return P.without_blank(rows.withColumns({"content": F.lit("x"), "pos": F.struct("doc_id", "pos")}), "source").select("source", F.col("pos").cast("long").alias("k"))


_OF_SOURCES = f"{I.WITH}, numbered AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM clauses JOIN documents USING (doc_id))"


@query(f"{_OF_SOURCES} SELECT source, k, b AS block FROM (SELECT source, k, n, unnest(range(0, greatest(0, ceil((n - 75) / 50.0))::BIGINT + 1)) AS b FROM numbered) WHERE k >= b * 50 AND k < b * 50 + 75")
def sliding_blocks_of_sources(spark, sf):
    return P.sliding_blocks(_of_sources(spark, sf), "source", "k").select("source", "k", F.col("block").cast("long").alias("block"))


@query(f"{_OF_SOURCES} SELECT source, count(*) AS n, CASE WHEN count(*) <= 50 THEN 'fast' WHEN count(*) <= 150 THEN 'medium' ELSE 'smart' END AS route FROM numbered WHERE k < 40 * (1 + length(source) + k % 7) GROUP BY 1")
def routes_of_sources(spark, sf):
    kept = _of_sources(spark, sf).filter("k < 40 * (1 + length(source) + k % 7)")  # so that sizes differ
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("route", R.route(F.col("n")))


@query("SELECT doc_id, toxic FROM labels WHERE doc_id % 10 = 3 AND (doc_id // 10) % 3 <> 0")
def open_conflicts(spark, sf):
    """Labels stand for conflicts, a third of which are resolved."""
    labels = I.table(spark, sf, "labels")
    versions = labels.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("contract_id")).distinct()
    conflicts = labels.select(F.col("doc_id").alias("version_id"), F.when(F.expr("(doc_id div 10) % 3") == 0, "RESOLVED").otherwise("OPEN").alias("status"), "doc_id", "toxic")
    return T.unresolved(conflicts, versions, 3).select("doc_id", "toxic")


@query(f"""{_REPORTED}, quoted AS (SELECT doc_id, i, j, text_i, text_j, substring(text_i, 4 + (doc_id % 5)::BIGINT, 30) AS q_i, CASE WHEN doc_id % 3 = 0 THEN 'not there' WHEN doc_id % 3 = 1 THEN '' ELSE right(text_j, 25) END AS q_j FROM reported)
SELECT * FROM (SELECT doc_id, i, j, 'i' AS side, (strpos(text_i, q_i) - 1)::INT AS start, (strpos(text_i, q_i) - 1 + length(left(q_i, 20)))::INT AS "end", left(q_i, 20) AS snippet FROM quoted WHERE q_i <> '' AND contains(text_i, q_i)
UNION ALL SELECT doc_id, i, j, 'j', (strpos(text_j, q_j) - 1)::INT, (strpos(text_j, q_j) - 1 + length(left(q_j, 20)))::INT, left(q_j, 20) FROM quoted WHERE q_j <> '' AND contains(text_j, q_j))""")
def evidence_inside_texts(spark, sf):
    """Quotes from the middle and the end of clauses, cut to 20 characters; some stand nowhere and some are empty."""
    told = _reported(spark, sf).withColumns({"quote_i": F.expr("substring(text_i, cast(4 + doc_id % 5 as int), 30)"), "quote_j": F.when(F.col("doc_id") % 3 == 0, "not there").when(F.col("doc_id") % 3 == 1, "").otherwise(F.expr("right(text_j, 25)"))})
    return T.evidence(told, ["doc_id", "i", "j"], 20)


@query(f"WITH {I.ANSWERS}, {_JUDGED} SELECT quality, count(*) AS results_sent, count(*) FILTER (conflict AND doc_id % 6 <> 0) AS conflicts_found, count(*) FILTER (doc_id % 6 = 0) AS errors, count(*) FILTER (toxic = 1) AS self_checks, count(*) FILTER (toxic <> 1) AS pair_checks FROM judged GROUP BY 1")
def run_counters_with_errors(spark, sf):
    failed = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Error: "), "answer")).otherwise(F.col("answer"))
    judged = V.judged(I.answers(spark, sf).withColumn("answer", failed)).withColumn("is_self_check", F.col("toxic") == 1)
    return V.run_counters(judged, "quality")


def _body(sql: str) -> str:
    """A tier's own SELECT, without the inputs that all tiers share."""
    return sql.removeprefix(_TOLD).lstrip(", ")


_TOPIC_TIER = f"SELECT DISTINCT doc_id, a.pos AS i, b.pos AS j FROM first_of a JOIN first_of b USING (doc_id, topic) WHERE a.pos < b.pos"
_CLUSTER_TIER = "SELECT DISTINCT doc_id, a.pos AS i, b.pos AS j FROM clustered a JOIN clustered b USING (doc_id, topic) WHERE a.pos < b.pos"


@query(f"{_TOLD}, tagged AS ({_tagged(T.TOPICS)}), first_of AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY doc_id, topic ORDER BY pos) <= 3), clustered AS ({_tagged(T.CLUSTERS)})"
       f" {_TOPIC_TIER} UNION {_CLUSTER_TIER} UNION {_body(ORACLES['contrary_pairs'])} UNION {_body(ORACLES['override_against_all'])}")
def all_tiers_united(spark, sf):
    """The pairs of four tiers, each once: topics, clusters, contrary terms, and clauses of override against all others."""
    told = I.written(_told(spark, sf), "told")
    return P.united([T.topic_pairs(told, 3), T.cluster_pairs(told), T.contrary_pairs(told), T.override_against_all(told)], ["doc_id", "i", "j"])


_PAIRS_AROUND = len("\n\n[Clause ]\n")


@query(f"""{I.WITH}, fit AS (SELECT doc_id FROM clauses GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50 AND count(*) FILTER (regexp_replace(content, '\\s', '', 'g') = '') = 0 AND max(length(content)) <= 50000),
prompts AS (SELECT doc_id, a.pos AS i, b.pos AS j, a.pos = b.pos AS is_self_check, CASE WHEN a.pos = b.pos THEN 6 ELSE 8 END + {_PAIRS_AROUND} + length((a.pos + 1)::VARCHAR) + length(a.content)
  + CASE WHEN a.pos = b.pos THEN 0 ELSE {_PAIRS_AROUND} + length((b.pos + 1)::VARCHAR) + length(b.content) END + {len(V.ASK) + 2} AS n FROM clauses a JOIN clauses b USING (doc_id) JOIN fit USING (doc_id) WHERE a.pos <= b.pos), {_ANSWERED}
SELECT doc_id, i, j, is_self_check, conflict, severity, md5(explanation) AS explanation, total_tokens FROM results""")
def compared_all_against_all(spark, sf):
    """Every clause against itself and all others of its document, where there are 2 to 50 and none is blank, with what is read out of each answer."""
    out = B.compare_all(I.written(I.extracted(spark, sf).select("doc_id", "pos", "content"), "clauses"), F.lit("Compare."), F.lit("Check."), _told_by_length, clock=_tick)
    return out.select("doc_id", "i", "j", "is_self_check", "conflict", "severity", F.md5("explanation").alias("explanation"), "performance.total_tokens")


@query("""WITH prompts AS (SELECT a.item_id, CASE WHEN a.item_id % 9 = 0 THEN ' ' ELSE 'Compare.' END AS prompt, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
sized AS (SELECT *, length(prompt) + length(a) + length(b) + """ + str(len("\n\n[Clause A]\n" + "\n\n[Clause B]\n" + "\n\nCompare the two clauses as asked above.")) + """ AS n FROM prompts)
SELECT item_id, CASE WHEN prompt = ' ' OR n % 7 = 0 THEN NULL ELSE 'Conflict: ' || CASE WHEN n % 3 = 0 THEN 'Yes' ELSE 'No' END || repeat(' so', (n % 4)::INT) || CASE WHEN n % 5 = 0 THEN '' WHEN n % 2 = 1 THEN ' Severity: High' ELSE ' Severity: Low' END END AS response,
CASE WHEN prompt = ' ' THEN 'blank prompt' WHEN n % 7 = 0 THEN 'no reply' END AS error FROM sized""")
def compared_one_to_one(spark, sf):
    """Each passage against the next, some without a prompt: the answer as it came, or why there is none."""
    b = I.table(spark, sf, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("clause_b"))
    pairs = b.join(other, "item_id").select("item_id", F.when(F.col("item_id") % 9 == 0, " ").otherwise("Compare.").alias("prompt"), F.col("text").alias("clause_a"), "clause_b")
    return B.compare_one(pairs, _told_by_length, clock=_tick)


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), t AS (SELECT doc_id, array_to_string([CASE doc_id % 3 WHEN 0 THEN '(' || i || ') ' || x WHEN 1 THEN 'PART ' || ['ONE', 'TWO', 'THREE'][(i % 3 + 1)::INT] || ': ' || x ELSE x END FOR x, i IN ls], ' ') AS content FROM l),
p AS (SELECT doc_id, content, string_split(regexp_replace(content, '\s(\(\d+\)\s)', chr(1) || '\1', 'g'), chr(1)) AS m, string_split(regexp_replace(content, '\s([A-Z][A-Z ]{2,}:)', chr(1) || '\1', 'g'), chr(1)) AS h, string_split(regexp_replace(content, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM t),
c AS (SELECT doc_id, CASE WHEN length(content) <= 2500 THEN [content] WHEN len(m) > 1 THEN m WHEN len(h) > 1 THEN h ELSE s END AS parts FROM p)
SELECT doc_id, CASE WHEN n > 1 THEN '7.' || i ELSE '7.' END AS clause_number, CASE WHEN n > 1 THEN '7.' END AS split_from, md5(x) AS digest FROM (SELECT doc_id, len(parts) AS n, unnest([{'x': x, 'i': i} FOR x, i IN parts], recursive := true) FROM c) AS q(doc_id, n, x, i)""")
def long_texts_split(spark, sf):
    """Whole documents as clauses, over 2500 characters for many: with numbered marks, headings in capitals, or sentences alone."""
    docs = I.spread(I.table(spark, sf, "documents").select("doc_id", "text"))
    part = F.expr("""array_join(transform(split(text, '\\n'), (x, i) -> case doc_id % 3 when 0 then concat('(', i + 1, ') ', x) when 1 then concat('PART ', element_at(array('ONE', 'TWO', 'THREE'), (i + 1) % 3 + 1), ': ', x) else x end), ' ')""")
    return R.split_long(docs.select("doc_id", F.lit("7.").alias("clause_number"), part.alias("content"))).select("doc_id", "clause_number", "split_from", F.md5("content").alias("digest"))


# Streams of answers as events, results in two, and chunks


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' AND event_id % 11 <> 0 THEN event_type END AS token, epoch_us(ts) / 1000000.0 AS tick, CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN 'lost at ' || event_id END AS error FROM events WHERE event_id % 3 < 2),
e AS (SELECT *, min(CASE WHEN error IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM c), k AS (SELECT * FROM e WHERE stop IS NULL OR event_id <= stop),
m AS (SELECT user_id, coalesce(array_to_string(list(token ORDER BY event_id) FILTER (token IS NOT NULL), ''), '') AS response, count(token) AS n, min(tick) FILTER (token IS NOT NULL) AS f, max(tick) AS l, min(tick) AS s, max(error) AS error FROM k GROUP BY 1),
r AS (SELECT *, round(coalesce(nullif(f - s, 0), l - s), 6) AS ttft, round(l - s, 6) AS total, round(CASE WHEN l - s > 0 THEN n / (l - s) ELSE 0 END, 6) AS rate FROM m)
SELECT user_id, 0::BIGINT AS seq, 'metric' AS type, NULL::VARCHAR AS content, ttft AS time_to_first_token, NULL::BIGINT AS total_tokens, NULL::DOUBLE AS total_time, NULL::DOUBLE AS tokens_per_second FROM r WHERE n > 0
UNION ALL SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id), 'token', token, NULL, NULL, NULL, NULL FROM k WHERE token IS NOT NULL
UNION ALL SELECT user_id, CASE WHEN n > 0 THEN n + 1 ELSE 0 END, 'complete', response, ttft, n, total, rate FROM r WHERE error IS NULL
UNION ALL SELECT user_id, CASE WHEN n > 0 THEN n + 1 ELSE 0 END, 'error', error, NULL, NULL, NULL, NULL FROM r WHERE error IS NOT NULL""")
def chat_events(spark, sf):
    """Events of answers of which some chunks are malformed and some streams break off."""
    e = I.table(spark, sf, "events").filter("event_id % 3 < 2")
    chunks = e.select(
        "user_id", "event_id", F.when((F.col("event_type") != "error") & (F.col("event_id") % 11 != 0), F.col("event_type")).alias("token"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 6 == 0), F.concat(F.lit("lost at "), "event_id")).alias("error"),
    )
    return chat.events(chunks.withColumn("start", F.col("at")), "user_id", "event_id", "token", "at", "start", "error")


@query(f"WITH {I.ANSWERS}, {_JUDGED}, r AS (SELECT quality, doc_id % 6 = 0 AS failed, conflict, severity FROM judged) SELECT quality, count(*) FILTER (NOT failed AND conflict) AS conflicts, count(*) FILTER (NOT failed AND NOT conflict) AS non_conflicts, count(*) FILTER (failed) AS failed, "
       + ", ".join(f"count(*) FILTER (NOT failed AND conflict AND severity = '{s}') AS {s.lower()}_conflicts" for s in (*V.SEVERITIES, "Unknown")) + " FROM r GROUP BY 1")
def conflict_split(spark, sf):
    failed = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Error: "), "answer")).otherwise(F.col("answer"))
    return V.conflict_split(V.judged(I.answers(spark, sf).withColumn("answer", failed)), ["quality"])


@query(f"{_OF_SOURCES} SELECT source, k // 50 AS block, count(*) AS n, min(k) AS first, max(k) AS last FROM numbered GROUP BY 1, 2")
def chunks_of_50(spark, sf):
    rows = P.blocks(_of_sources(spark, sf), 50, "k")
    return rows.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))


_TREE = ORACLES["clause_outline"].rpartition("SELECT p.user_id")[0]


@query(_TREE.rstrip() + """, sections AS (SELECT user_id, root_pos, pos FROM tree QUALIFY row_number() OVER (PARTITION BY user_id, root_pos ORDER BY pos) <= 50)
SELECT user_id, root_pos, a.pos AS i, b.pos AS j FROM sections a JOIN sections b USING (user_id, root_pos) WHERE a.pos < b.pos""")
def pairs_of_sections(spark, sf):
    """All pairs of clauses under one heading, of its first 50."""
    rows = clause_outline(spark, sf).select("user_id", "root_pos", "pos")
    return P.capped_pairs(rows, ["user_id", "root_pos"], 50)
