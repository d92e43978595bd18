"""Contract-shaped inputs made from the given tables, by the same expressions in Spark and DuckDB."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.operators import clauses as C


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for stored tables, below the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only where all runs on one machine may a temporary folder stand in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/clausegrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a stored table, read back: for what a query takes up more than once and would else work out from the texts each time."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out to all cores where its scan gives fewer tasks than there are cores, as one large row group does; else as it is.

    What comes after a scan here is mostly work on texts. A table of many files is left alone: it needs no shuffle of its texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def contract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with all its lines numbered from 1 to 4 over and over: each fourth as a sub-clause, every other in small letters, some with a leader."""
    text = F.expr(
        """array_join(transform(split(text, '\\n'), (l, k) -> concat(
             case when k % 4 = 3 then concat(char(cast(97 + (k div 4) % 26 as int)), ') ') else concat(cast((k - (k div 4)) % 4 + 1 as string), '. ') end,
             case when k % 2 = 0 then lower(l) else l end,
             case when (doc_id + k) % 7 = 0 then ' ........ 3' when (doc_id + k) % 11 = 0 then '\\n\\n===  ' else '' end)), '\\n')"""
    )
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.alias("text"))


TEXTS = """texts AS (SELECT doc_id, array_to_string([
  (CASE WHEN (i-1) % 4 = 3 THEN chr((97 + ((i-1)//4) % 26)::INT) || ') ' ELSE (((i-1) - (i-1)//4) % 4 + 1)::VARCHAR || '. ' END)
  || (CASE WHEN (i-1) % 2 = 0 THEN lower(l) ELSE l END)
  || (CASE WHEN (doc_id + i - 1) % 7 = 0 THEN ' ........ 3' WHEN (doc_id + i - 1) % 11 = 0 THEN chr(10)||chr(10)||'===  ' ELSE '' END)
  FOR l, i IN string_split(text, chr(10))], chr(10)) AS text FROM documents)"""
NORMAL = r"""normal AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n{2,}', chr(10), 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM texts)"""
_UP = "upper(replace(split_part(p, chr(2), 1), 'ß', 'SS')) || split_part(p, chr(2), 2)"
CAPITAL = rf"""cap1 AS (SELECT doc_id, array_to_string([CASE WHEN i = 1 THEN p ELSE {_UP} END FOR p, i IN
    string_split(regexp_replace(text, '(^|\n)(\d{{1,2}}[.)])\s*([a-z][^\n]*)', '\1\2 ' || chr(1) || '\3' || chr(2), 'g'), chr(1))], '') AS text FROM normal),
  capital AS (SELECT doc_id, array_to_string([CASE WHEN i = 1 THEN p ELSE {_UP} END FOR p, i IN
    string_split(regexp_replace(text, '(\n)([a-z]\))\s*([a-z][^\n]*)', '\1\2 ' || chr(1) || '\3' || chr(2), 'g'), chr(1))], '') AS text FROM cap1)"""
SPLIT = r"""pieces AS (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)(\d{1,2}[.)])(\s)', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS ps FROM capital),
  bodies AS (SELECT doc_id, x.pos AS pos, regexp_extract(x.p, '^(\d{1,2}[.)])', 1) AS clause_number, regexp_replace(regexp_replace(x.p, '^\s+|\s+$', '', 'g'), '=+\s*', '', 'g') AS body
    FROM (SELECT doc_id, unnest([{'pos': i - 1, 'p': p} FOR p, i IN ps[2:]]) AS x FROM pieces)),
  parts AS (SELECT doc_id, pos::INT AS pos, clause_number, body, string_split(regexp_replace(body, '(\n)([a-z]\))(\s)', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS q FROM bodies),
  split AS (SELECT doc_id, pos, clause_number, CASE WHEN len(q) > 1 THEN regexp_replace(q[1], '^\s+|\s+$', '', 'g') ELSE body END AS content,
    [{'clause_number': regexp_extract(s, '^([a-z]\))', 1), 'content': regexp_replace(s, '^\s+|\s+$', '', 'g')} FOR s IN q[2:]] AS subs FROM parts)"""
CLAUSES = r"""clauses AS (SELECT * FROM split WHERE NOT regexp_matches(content, '\.{5,}'))"""
WITH = "WITH " + ",\n".join([TEXTS, NORMAL, CAPITAL, SPLIT, CLAUSES])
SUBS = "subs AS (SELECT doc_id, pos, s.i AS sub_pos, s.c AS clause_number, s.t AS content FROM (SELECT doc_id, pos, unnest([{'i': (i - 1)::INT, 'c': x.clause_number, 't': x.content} FOR x, i IN subs]) AS s FROM clauses))"


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract_clauses(contract_texts(spark, sf_dir))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts made from documents."""
    d = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(k) for k in (".txt", ".pdf", ".docx", ".md")])
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "parsing", "failed", "completed", "completed")]), (F.col("doc_id") % 5 + 1).cast("int"))
    at = F.timestamp_add("MINUTE", (F.col("doc_id") * 7 % 5000).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    name = F.concat_ws("-", "source", "doc_id")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat(name, F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))).alias("filename"), name.alias("original_filename"), F.expr("substring(element_at(array('.txt','.pdf','.docx','.md'), cast(doc_id % 4 + 1 as int)), 2)").alias("file_type"), F.col("n_chars").alias("file_size"), status.alias("status"), F.when(status == "failed", "no text").alias("error_message"), at.alias("created_at"), at.alias("updated_at"))


CONTRACTS = """contracts AS (SELECT doc_id::VARCHAR AS id, source || '-' || doc_id || ['.txt', '.pdf', '.docx', '.md'][(doc_id % 4 + 1)::INT] AS filename, source || '-' || doc_id AS original_filename,
  ['txt', 'pdf', 'docx', 'md'][(doc_id % 4 + 1)::INT] AS file_type, n_chars AS file_size, ['completed', 'parsing', 'failed', 'completed', 'completed'][(doc_id % 5 + 1)::INT] AS status,
  CASE WHEN doc_id % 5 = 2 THEN 'no text' END AS error_message, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7 % 5000)::INT) AS created_at, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7 % 5000)::INT) AS updated_at FROM documents)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all shapes, made from labels: id and answer."""
    parts = F.expr(
        """concat(element_at(array('Conflict: Yes', '**Conflict:** Yes', 'conflict:no', 'There is a conflict here', 'A conflict exists. There is no conflict elsewhere', 'This contradicts clause 2', 'Conflict: none', 'Nothing', 'Conflict: Yes and conflict: no'), cast(doc_id % 9 + 1 as int)),
             element_at(array('. Severity: High', '. medium severity', '. **Severity:** Low', '; low severity', '', '. severity: low and high severity'), cast((doc_id div 9 + toxic + quality) % 6 + 1 as int)))"""
    )
    return table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality", parts.alias("answer"))


ANSWERS = """answers AS (SELECT doc_id, toxic, quality, ['Conflict: Yes', '**Conflict:** Yes', 'conflict:no', 'There is a conflict here', 'A conflict exists. There is no conflict elsewhere', 'This contradicts clause 2', 'Conflict: none', 'Nothing', 'Conflict: Yes and conflict: no'][(doc_id % 9 + 1)::INT]
  || ['. Severity: High', '. medium severity', '. **Severity:** Low', '; low severity', '', '. severity: low and high severity'][((doc_id // 9 + toxic + quality) % 6 + 1)::INT] AS answer FROM labels)"""
