"""Strict CSV scans, JSON reference tables, versioned writes and their manifests."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import RAW_COLUMNS
from ..functions import digests
from ..functions.digests import table_fingerprint
from ..operators.audit import complete_rows
from ..operators.quotas import Quota, check_plan
from ..session import path_exists
from .quoted import quoted_records

_CORRUPT = "_corrupt"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names as the file states them, without a byte order mark."""
    first = spark.read.text(path).first()
    return next(csv.reader([first[0].lstrip("﻿")]), []) if first else []


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """file, header (its first line without a byte order mark) and lines of every CSV file below ``path``."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("place"),
    )
    first = F.min_by(F.when(F.col("start") == 0, F.col("value")), F.when(F.col("start") == 0, F.col("place")))
    return lines.groupBy("file").agg(F.regexp_replace(first, "^\ufeff", "").alias("header"), F.count(F.lit(1)).alias("lines"))


def csv_header_violations(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """Files whose first line does not state exactly these columns in this order."""
    return csv_files(spark, path).where(~_states(header))


def _states(header: Sequence[str]) -> Column:
    """Whether the line in ``header`` parses to exactly these names, so a quoted comma stays within one."""
    places = [f"c{i}" for i in range(len(header))]
    parsed = F.from_csv("header", ", ".join(f"{name} STRING" for name in [*places, _CORRUPT]), {"columnNameOfCorruptRecord": _CORRUPT, "escape": '"'})
    same = parsed[_CORRUPT].isNull()
    for place, name in zip(places, header, strict=True):
        same = same & parsed[place].eqNullSafe(F.lit(name))
    return F.coalesce(same, F.lit(False))


def read_strict_csv(
    spark: SparkSession, path: str, required: Sequence[str] = RAW_COLUMNS, *, multiline: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """All-text trimmed rows of a CSV export, and the rows whose shape is broken.

    The header must name every required column once; a file with another header refuses the
    whole folder. ``multiline`` accepts line breaks in quoted values; large files stay split,
    and a file that ends inside a quoted value refuses the folder as well.
    """
    header = csv_header(spark, path)
    missing = sorted(set(required) - set(header))
    if missing:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    if len(set(header)) != len(header):
        raise ValueError(f"{path}: duplicate column names")
    records, blocks = quoted_records(spark, path) if multiline else (None, None)
    heads = csv_files(spark, path) if blocks is None else blocks.where("start = 0")
    refused = heads.where(~_states(header)).select("file").first()
    if refused:
        raise ValueError(f"{refused['file']}: its header differs from the other files'")
    unclosed = blocks.where(~F.col("closed")).select("file").first() if blocks is not None else None
    if unclosed:
        raise ValueError(f"{unclosed['file']}: it ends inside a quoted value")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*header, _CORRUPT]])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "escape": '"'}
    if multiline:
        fields = ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in schema.fields)
        scanned = records.select(F.from_csv("record", fields, options).alias("r")).select("r.*")
    else:
        scanned = spark.read.schema(schema).options(header=True, **options).csv(path)
    # A short row shows only when every column is parsed, so both filters read them all.
    parsed = F.length(F.concat_ws("\x1f", *header)) >= 0
    whole = scanned.where(F.col(_CORRUPT).isNull() & parsed)
    rows = whole.select(*[F.trim(F.coalesce(F.col(name), F.lit(""))).alias(name) for name in header])
    broken = scanned.where(F.col(_CORRUPT).isNotNull() & parsed).select(F.col(_CORRUPT).alias("record"))
    return rows, broken


def write_exports(rows: DataFrame, folder: str) -> None:
    """The raw export and its parser-complete subset, as CSV with headers."""
    for name, part in (("raw", rows), ("complete", complete_rows(rows))):
        part.write.mode("errorifexists").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


CATALOGUE_SCHEMA = "catalogue_version int, families array<struct<make:string,model:string,variants:array<string>>>"
SCOPE_SCHEMA = "candidate_families array<struct<make:string,model:string>>, year_range array<int>"
REVIEW_SCHEMA = (
    "version int, decisions array<struct<listing_id:string,decision:string,reason:string,"
    "corrections:struct<mileage_km:struct<from:bigint,to:bigint>>,"
    "accept_price_precision:struct<displayed_pkr:bigint,structured_pkr:bigint>>>"
)
PLAN_SCHEMA = (
    "plan_version int, searches array<struct<name:string,expected_make:string,expected_model:string,"
    "target_complete_rows:int,max_detail_requests:int>>"
)


def _documents(spark: SparkSession, path: str, schema: str, version: str | None, multiline: bool) -> DataFrame:
    documents = spark.read.schema(schema).option("multiLine", multiline).json(path)
    if version and not documents.where(~F.col(version).eqNullSafe(1)).isEmpty():
        raise ValueError(f"{path}: unsupported version")
    return documents


def load_catalogue(spark: SparkSession, path: str, *, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Families and variants of catalogue documents, in their order of listing."""
    entries = _documents(spark, path, CATALOGUE_SCHEMA, "catalogue_version", multiline).select(F.posexplode("families").alias("place", "f"))
    families = entries.select("place", "f.make", "f.model")
    variants = entries.select("f.make", "f.model", F.posexplode("f.variants").alias("place", "variant"))
    return families, variants


def catalogue_violations(families: DataFrame, variants: DataFrame) -> DataFrame:
    """Labels that name two entries when case is ignored, and blank labels."""
    def repeated(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
        keys = F.lower(F.concat_ws(" / ", *columns)).alias("label")
        return df.groupBy(keys).count().where("count > 1").select(F.lit(kind).alias("violation"), "label")

    blank = variants.where(F.coalesce(F.trim("variant"), F.lit("")) == "").select(
        F.lit("blank variant").alias("violation"), F.concat_ws(" / ", "make", "model").alias("label"))
    return reduce(DataFrame.unionByName, [
        repeated(families, ["make", "model"], "repeated family"), repeated(variants, ["make", "model", "variant"], "repeated variant"), blank,
    ])


def load_scope(spark: SparkSession, path: str, *, multiline: bool = True) -> tuple[DataFrame, tuple[int, int]]:
    """Allowed families, and the inclusive range of model years, which all documents must share."""
    scope = _documents(spark, path, SCOPE_SCHEMA, None, multiline)
    least, most, stated = scope.agg(F.min("year_range"), F.max("year_range"), F.count("year_range") == F.count("*")).first()
    if not stated or least is None or least != most or len(least) != 2 or None in least:
        raise ValueError(f"{path}: documents must state one range of years")
    return scope.select(F.explode("candidate_families").alias("f")).select("f.make", "f.model"), tuple(least)


def load_decisions(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """Review decisions with their corrections as flat columns."""
    listed = _documents(spark, path, REVIEW_SCHEMA, "version", multiline).select(F.explode("decisions").alias("d"))
    return listed.select(
        "d.listing_id", "d.decision", "d.reason", F.col("d.corrections.mileage_km.from").alias("mileage_from"),
        F.col("d.corrections.mileage_km.to").alias("mileage_to"), "d.accept_price_precision.displayed_pkr", "d.accept_price_precision.structured_pkr",
    )


def load_plan(spark: SparkSession, path: str) -> list[Quota]:
    """The quotas of a sampling plan, which is a short configuration."""
    searches = _documents(spark, path, PLAN_SCHEMA, "plan_version", True).first()["searches"]
    return list(check_plan([
        Quota(s["name"], s["target_complete_rows"], s["max_detail_requests"], s["expected_make"], s["expected_model"]) for s in searches
    ]))


def _inside(path: str, other: str) -> bool:
    first, second = path.rstrip("/") + "/", other.rstrip("/") + "/"
    return first.startswith(second) or second.startswith(first)


def check_target(spark: SparkSession, target: str, inputs: Sequence[str] = ()) -> str:
    """Refuse a version folder that exists or overlaps one of its inputs."""
    if path_exists(spark, target):
        raise ValueError(f"{target} already exists; choose a new version")
    for source in inputs:
        if _inside(target, source):
            raise ValueError(f"{target} overlaps the input {source}")
    return target


def write_version(tables: dict[str, DataFrame], target: str, inputs: Sequence[str] = (), partition_by: dict[str, str] | None = None) -> DataFrame:
    """Write named tables once below a new folder, with a manifest of their contents."""
    spark = next(iter(tables.values())).sparkSession
    check_target(spark, target, inputs)
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{target}/{name}")
    manifest = manifest_of({name: spark.read.parquet(f"{target}/{name}") for name in tables})
    manifest.write.mode("errorifexists").parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


# The populations of a prepared dataset and the flag that each stands for.
POPULATIONS = {"normalized_all": None, "modeling_candidates": "modeling_candidate", "source_checked_candidates": "source_checked_candidate"}


def _population_metrics(digest: str) -> list[Column]:
    """Row count and fingerprint of every population, as aggregates over one table."""
    found = []
    for name, flag in POPULATIONS.items():
        among = F.lit(True) if flag is None else F.coalesce(F.col(flag), F.lit(False))
        found += [F.count_if(among).alias(f"{name}:rows"), digests.fingerprint_of(F.col(digest), among).alias(f"{name}:fingerprint")]
    return found


def _population_manifest(spark: SparkSession, columns: Sequence[str], found: dict) -> DataFrame:
    records = [(name, ",".join(columns), found[f"{name}:rows"], found[f"{name}:fingerprint"]) for name in POPULATIONS]
    return spark.createDataFrame(records, "name string, columns string, rows bigint, fingerprint string")


def write_dataset(rows: DataFrame, target: str, inputs: Sequence[str] = ()) -> DataFrame:
    """Write a prepared dataset once, with its populations as partitions, and its manifest.

    Counts and fingerprints of all populations are observed while the rows pass into their files, so
    the rows are computed once however many populations there are.
    """
    spark = rows.sparkSession
    check_target(spark, target, inputs)
    columns, seen = sorted(rows.columns), Observation()
    digested = rows.withColumn("__digest", digests.row_digest(columns)).observe(seen, *_population_metrics("__digest")).drop("__digest")
    flags = [flag for flag in POPULATIONS.values() if flag]
    digested.write.mode("errorifexists").partitionBy(*flags).parquet(f"{target}/rows")
    manifest = _population_manifest(spark, columns, seen.get)
    manifest.write.mode("errorifexists").parquet(f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


def read_dataset(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The populations of a written dataset; each reads only its partitions."""
    flags = [flag for flag in POPULATIONS.values() if flag]
    rows = spark.read.parquet(f"{target}/rows").withColumns({flag: F.col(flag).cast("boolean") for flag in flags})
    return {name: rows if flag is None else rows.where(flag) for name, flag in POPULATIONS.items()}


def verify_dataset(spark: SparkSession, target: str) -> None:
    """Stop before use when the files no longer agree with the manifest; one scan for all populations."""
    rows = read_dataset(spark, target)["normalized_all"]
    columns = sorted(rows.columns)
    found = rows.select(*[flag for flag in POPULATIONS.values() if flag], digests.row_digest(columns).alias("__digest"))
    current = _population_manifest(spark, columns, found.agg(*_population_metrics("__digest")).first().asDict())
    _refuse_changes(target, spark.read.parquet(f"{target}/manifest"), current)


def manifest_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, columns, rows, fingerprint) of each table; row order does not matter."""
    return reduce(DataFrame.unionByName, [
        table_fingerprint(table, sorted(table.columns)).select(F.lit(name).alias("name"), "columns", "rows", "fingerprint")
        for name, table in tables.items()
    ])


def manifest_differences(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Tables that are missing, new or changed since the manifest was written."""
    now = current.select("name", *[F.col(c).alias(f"now_{c}") for c in ("columns", "rows", "fingerprint")])
    joined = recorded.join(now, "name", "full")
    same = F.lit(True)
    for column in ("columns", "rows", "fingerprint"):
        same = same & F.col(column).eqNullSafe(F.col(f"now_{column}"))
    problem = F.when(F.col("now_rows").isNull(), F.lit("missing")).when(F.col("rows").isNull(), F.lit("unrecorded")).when(
        ~same, F.lit("changed"))
    return joined.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def verify_version(spark: SparkSession, target: str) -> None:
    """Stop before use when a written version no longer agrees with its manifest."""
    recorded = spark.read.parquet(f"{target}/manifest")
    names = [row["name"] for row in recorded.select("name").collect()]
    _refuse_changes(target, recorded, manifest_of({name: spark.read.parquet(f"{target}/{name}") for name in names}))


def _refuse_changes(target: str, recorded: DataFrame, current: DataFrame) -> None:
    changed = [row["name"] for row in manifest_differences(recorded, current).collect()]
    if changed:
        raise ValueError(f"{target}: changed since it was written: {', '.join(sorted(changed))}")


def split_id(assignments: DataFrame) -> DataFrame:
    """Identifier of a split that depends on its content alone."""
    return table_fingerprint(assignments, ["listing_id", "group_id", "partition", "validation_fold"]).select(
        F.concat(F.lit("split_"), F.sha2(F.concat_ws(":", "rows", "fingerprint"), 256)).alias("split_id")
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path, computed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
