"""Readers and writers of JSON lines, whole JSON files and raw pages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which the driver and all executors see; a local session may lack that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the driver and the executors share no folder")
        root = tempfile.mkdtemp(prefix="protomill-")
    return f"{root.rstrip('/')}/protomill-{name}-{uuid.uuid4().hex}"


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped and a malformed one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The malformed lines, as text."""
    whole = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    # the JSON reader refuses plans that ask for nothing but the corrupt column, so lines are read as text
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r"))
    return lines.where("r._corrupt_record is not null").select("r._corrupt_record")


def whole_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array (or object)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def pages(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """(name, text) of files, a row for each; the name has no folder and no suffix."""
    read = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return read.select(name.alias("name"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length) of files below a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def entry_views(manifest: DataFrame) -> DataFrame:
    """A row for each view of each entry of a manifest with entries[] and their maps of views."""
    each = manifest.select(F.explode("entries").alias("e"))
    return each.select(F.col("e.entry_id").alias("entry_id"), F.explode("e.views").alias("view", "path"))


def cache_key(doi):
    """A DOI as a file name."""
    return F.regexp_replace(doi, "[^A-Za-z0-9]+", "_")


def save_routed(df: DataFrame, folder: str, manifest_columns: list[str]) -> None:
    """Rows as JSON by (qc_pass, source), and their manifest projection with the time of the save."""
    df.write.mode("append").partitionBy("qc_pass", "source").json(f"{folder}/records")
    df.select(*manifest_columns, F.unix_timestamp().alias("ts")).write.mode("append").json(f"{folder}/manifest")


def save_with_report(kept: DataFrame, report: DataFrame, folder: str) -> None:
    kept.write.mode("overwrite").json(f"{folder}/kept")
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/report")  # a report is a few rows


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that ``df`` has rows for; ``df`` must not read ``path``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
