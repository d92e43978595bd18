"""From uploaded files to the four stored tables, in one call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.text import normalize
from clausegrid.operators import clauses as C, contracts as K, parties as N


def ingest(files: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The tables contracts, versions, parties and clauses of files (id, path, size, text, answer).

    `answer` is what a model said about the parties, or null. A file that is refused, that could
    not be read (a column `error` says why, where there is one), or
    whose text is too short, becomes a failed contract with its reason and nothing else; a
    null text counts as empty. Ids of what hangs below a contract come from its id, so that
    a repeated run gives the same rows.
    """
    text = F.coalesce("text", F.lit(""))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.withColumns({"_text": text, "_error": F.coalesce(K.upload_error(F.col("path"), F.col("size")), *([F.col("error")] if "error" in files.columns else []), K.text_error(text)), "_suffix": suffix, "_now": now})
    failed = F.col("_error").isNotNull()
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    contracts = rows.select(
        "id", F.concat("id", "_suffix").alias("filename"), name.alias("original_filename"), F.substring("_suffix", 2, 20).alias("file_type"), F.col("size").cast("long").alias("file_size"),
        F.when(failed, "failed").otherwise("completed").alias("status"), F.col("_error").alias("error_message"), F.col("_now").alias("created_at"), F.col("_now").alias("updated_at"),
    )
    good = rows.filter(~failed)
    version = F.sha2(F.concat_ws("~", F.lit("version"), "id"), 256)
    versions = good.select(version.alias("id"), F.col("id").alias("contract_id"), F.lit(1).alias("version_number"), F.col("_text").alias("raw_text"), normalize(F.col("_text")).alias("parsed_text"), F.col("_now").alias("created_at"))
    names = N.without_addresses(N.identify(F.col("answer"), F.col("_text")))
    parties = good.select("id", "_now", F.posexplode(names).alias("at", "name")).select(F.sha2(F.concat_ws("~", F.lit("party"), "id", "at"), 256).alias("id"), F.col("id").alias("contract_id"), "name", F.col("_now").alias("created_at"))
    flat = C.flat_clauses(C.extract_clauses(good.select("id", "_text"), "id", "_text"), "id")
    flat = flat.select(
        "id", "contract_id", F.sha2(F.concat_ws("~", F.lit("version"), "contract_id"), 256).alias("version_id"), "clause_number", "content", "parent_clause_id",
        F.col("order_index").cast("int").alias("order_index"), F.col("id").alias("uuid_from_extractor"), now.alias("created_at"),
    )
    return {"contracts": contracts, "versions": versions, "parties": parties, "clauses": flat}


def load(store, files: DataFrame, now: Column, run_id: str, answers: DataFrame | None = None) -> bool:
    """Files in, tables out: parses `files` (path, length, content, sha256, as read_files gives them) and inserts what they hold; False if this run is committed already.

    A contract's id comes from a file's name and content, so a file that is loaded again is the contract that is
    there. `answers` (id, answer) has what a model said about the parties; without it the patterns decide. Each file is
    read and parsed once: the parsed rows are kept until they are stored.
    """
    from clausegrid.sources.files import parse_files

    name = F.regexp_extract("path", r"([^/]*)$", 1)
    known = files.select("path", F.col("length").alias("size"), F.sha2(F.concat_ws("~", name, "sha256"), 256).alias("id"))
    parsed = parse_files(files).select("path", "text", "error").join(known, "path").dropDuplicates(["id"])
    rows = parsed.join(answers, "id", "left") if answers is not None else parsed.withColumn("answer", F.lit(None).cast("string"))
    rows = rows.persist()
    try:
        return store.insert(ingest(rows, now), run_id)
    finally:
        rows.unpersist()
