"""Tables, texts and result documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import lenient_date


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*((F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(f.name) for f in df.schema.fields))


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with nested columns as JSON text, or JSON lines."""
    if fmt == "csv":
        _flat(df).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, dates: list[str] = ()) -> DataFrame:
    """CSV with a header; what is no date in the date columns becomes null."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({c: lenient_date(F.col(c)) for c in dates})


def write_document(df: DataFrame, path: str) -> None:
    """Nested result rows as JSON."""
    df.write.mode("overwrite").json(path)


def read_objects(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All JSON objects of a folder, with ``key``, the file's stem; broken ones have nulls and _corrupt_record."""
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder).select("*", stem.alias("key"))


def blob_keys(spark: SparkSession, folder: str, extension: str = "txt") -> DataFrame:
    """Stems of the files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder)
    return files.select(F.regexp_extract("path", rf"([^/]+)\.{extension}$", 1).alias("key"))


def read_texts(spark: SparkSession, folder: str, extension: str = "txt") -> DataFrame:
    """(key, text) of whole files; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder)
    return files.select(F.regexp_extract("path", rf"([^/]+)\.{extension}$", 1).alias("key"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row per wanted key, with nulls where there is none: a set of point look-ups as one join."""
    return keys.select(key).distinct().join(df, key, "left")


def upsert(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the given rows in place of those of their keys, or added; of several rows of a key all stay."""
    return df.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def exists(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, found) for each wanted key."""
    there = df.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).distinct().join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share; where it is unset, a
    temporary one for a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docket-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
