"""The four stored tables: building, listing, changing and deleting contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a status can be, and what can be uploaded.
STATUSES = ("uploading", "parsing", "extracting", "identifying_parties", "saving", "completed", "failed")
UPLOADS = (".pdf", ".docx", ".doc", ".txt")
MOST_BYTES = 50 * 1024 * 1024
LEAST_CHARS = 100

CONTRACTS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("filename", T.StringType(), False), T.StructField("original_filename", T.StringType(), False), T.StructField("file_type", T.StringType(), False), T.StructField("file_size", T.LongType(), False), T.StructField("status", T.StringType(), False), T.StructField("error_message", T.StringType()), T.StructField("created_at", T.TimestampNTZType(), False), T.StructField("updated_at", T.TimestampNTZType(), False)])
VERSIONS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("contract_id", T.StringType(), False), T.StructField("version_number", T.IntegerType(), False), T.StructField("raw_text", T.StringType()), T.StructField("parsed_text", T.StringType()), T.StructField("created_at", T.TimestampNTZType(), False)])
PARTIES = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("contract_id", T.StringType(), False), T.StructField("name", T.StringType(), False), T.StructField("created_at", T.TimestampNTZType(), False)])
CLAUSES = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("contract_id", T.StringType(), False), T.StructField("version_id", T.StringType(), False), T.StructField("clause_number", T.StringType(), False), T.StructField("content", T.StringType(), False), T.StructField("parent_clause_id", T.StringType()), T.StructField("order_index", T.IntegerType(), False), T.StructField("uuid_from_extractor", T.StringType()), T.StructField("created_at", T.TimestampNTZType(), False)])


def upload_error(path: Column, size: Column) -> Column:
    """Why a file is refused, else null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(~suffix.isin(*UPLOADS), "unsupported file type").when(size > MOST_BYTES, "file too large")


def text_error(text: Column) -> Column:
    from clausegrid.functions.text import strip

    return F.when(F.length(strip(text)) < LEAST_CHARS, "too little text")


def list_contracts(contracts: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of contracts, newest first, ties by id."""
    shown = contracts.select("id", "filename", "file_type", "file_size", "status", iso(F.col("created_at")).alias("created_at"))
    return shown.orderBy(F.desc("created_at"), "id").offset(skip).limit(limit)


def iso(at: Column) -> Column:
    """ISO 8601; a fraction is shown when there is one."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(at, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction))


def details(contracts: DataFrame, parties: DataFrame, flat: DataFrame) -> DataFrame:
    """Each contract with its parties and its number of main clauses."""
    names = parties.groupBy("contract_id").agg(F.array_sort(F.collect_list("name")).alias("parties"))
    counts = flat.filter("parent_clause_id IS NULL").groupBy("contract_id").agg(F.count(F.lit(1)).alias("clause_count"))
    out = contracts.join(names, contracts["id"] == names["contract_id"], "left").drop("contract_id")
    out = out.join(counts, out["id"] == counts["contract_id"], "left").drop("contract_id")
    return out.withColumn("parties", F.coalesce("parties", F.array().cast("array<string>"))).withColumn("clause_count", F.coalesce("clause_count", F.lit(0)))


def update(contracts: DataFrame, patch: DataFrame, now: Column) -> DataFrame:
    """Contracts with the non-null columns of `patch` (by id) put in; changed rows get a new updated_at."""
    columns = [c for c in patch.columns if c != "id"]
    new = patch.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = contracts.join(new, contracts["id"] == new["_id"], "left")
    put = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}
    return joined.withColumns(put | {"updated_at": F.when(F.col("_id").isNotNull(), now).otherwise(F.col("updated_at"))}).select(contracts.columns)


def delete(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the contracts in `ids` and whatever belongs to them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return {name: df.join(gone, df["id" if name == "contracts" else "contract_id"] == F.col("_gone"), "left_anti") for name, df in tables.items()}


def last_status(events: DataFrame) -> DataFrame:
    """The status each contract is in after its events (contract_id, at, stage, message)."""
    last = events.groupBy("contract_id").agg(F.max_by(F.struct("stage", "message"), F.struct("at", "stage")).alias("e"))
    status = F.when(F.col("e.stage") == "COMPLETED", "completed").when(F.col("e.stage") == "ERROR", "failed").otherwise("parsing")
    return last.select("contract_id", status.alias("status"), F.when(F.col("e.stage") == "ERROR", F.col("e.message")).alias("error_message"))


def by_id(contracts: DataFrame, wanted: str) -> DataFrame:
    return contracts.filter(F.col("id") == wanted)
