"""Records that break their contract are set apart where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import scratch


def _by_path(path: str) -> Column:
    return F.try_variant_get("__v", f"$.{path}", "string")


def split(spark: SparkSession, folder: str, fields: dict[str, tuple[str, list[str], bool]], glob: str = "*.json", multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of JSON files by a contract; the files are read once.

    ``fields`` gives by name a type, the dotted paths under which sources deliver it (the first filled one counts) and
    whether it is required.  Good rows have the fields and ``source_file``; rejected ones ``source_file``, ``reason`` and
    the ``record`` as it was read.  Reasons: ``unreadable`` (no JSON object), ``missing: field``, ``bad value: field``
    (there, but not of its type); of several those of all fields, comma-separated.  Each record is in one of the two,
    and once: both are read from what the one scan has written under ``spark.checkpoint.dir``.
    Empty lines are no records.  With ``multi_line`` a file is one record, else each line is.
    """
    if multi_line:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        raw = files.select(F.make_valid_utf8(F.col("content").cast("string")).alias("record"), F.col("path").alias("source_file"))
    else:
        raw = spark.read.option("pathGlobFilter", glob).text(folder).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("source_file")).where(F.trim("record") != "")
    # as the only element of a list, so that more than one value, or what follows a value, is no record
    listed = raw.select("record", "source_file", F.try_parse_json(F.concat(F.lit("["), F.col("record"), F.lit("]"))).alias("__list"))
    parsed = listed.select("record", "source_file", F.when(F.try_variant_get("__list", "$[1]", "variant").isNull(), F.try_variant_get("__list", "$[0]", "variant")).alias("__v"))
    told = {name: F.coalesce(*(_by_path(p) for p in (paths or [name]))) for name, (_, paths, _) in fields.items()}
    told = parsed.select("record", "source_file", F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")).alias("__object"), *(c.alias(f"__t_{n}") for n, c in told.items()))
    typed = told.select("*", *(F.col(f"__t_{n}").try_cast(kind).alias(n) for n, (kind, _, _) in fields.items()))
    faults = []
    for name, (_, _, required) in fields.items():
        bad = F.when(F.col(f"__t_{name}").isNotNull() & F.col(name).isNull(), F.lit(f"bad value: {name}"))
        faults.append(bad.when(F.col(f"__t_{name}").isNull(), F.lit(f"missing: {name}")) if required else bad)
    reason = F.when(~F.coalesce("__object", F.lit(False)), F.lit("unreadable")).otherwise(F.concat_ws(", ", *faults))
    path = scratch(spark, "quarantine")
    judged = typed.select(*fields, "source_file", "record", reason.alias("reason"))
    judged.select(*fields, "source_file", F.when(F.col("reason") != "", F.col("record")).alias("record"), "reason", (F.col("reason") == "").alias("good")).write.partitionBy("good").parquet(path)
    whole = spark.read.schema(judged.withColumn("good", F.lit(True)).schema).parquet(path)
    return whole.where("good").select(*fields, "source_file"), whole.where("not good").select("source_file", "reason", "record")
