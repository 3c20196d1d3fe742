"""File-incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.flatten import by_path
from ..operators.joins import missing_keys


def _run(stream: DataFrame, checkpoint: str, batch) -> None:
    """All files that are new, then stop; a second run without new files adds nothing."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pages_to_table(spark: SparkSession, folder: str, schema: T.StructType | str, bag: str, mapping: dict[str, str], target: str, checkpoint: str) -> None:
    """New JSON pages -> records -> flat rows, appended to ``target``; exactly once by the file sink's own log."""
    pages = spark.readStream.schema(schema).option("multiLine", True).json(folder)
    flat = by_path(pages.select(F.explode(bag).alias("r")).select("r.*"), mapping)
    append_new(flat, target, checkpoint)


def append_new(stream: DataFrame, target: str, checkpoint: str) -> None:
    """What is new in the stream goes to the table, exactly once by the file sink's own log."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; of equal ones any.  A task passes one row a key on to the shuffle."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row")
    return df.groupBy(F.col(key).alias("__key")).agg(row).select("__row.*")


def upsert_latest(spark: SparkSession, source: DataFrame, key: str, order: list[str], versions: str, checkpoint: str, parts: int | None = None) -> DataFrame | None:
    """Keeps the newest row per key in a table dealt out by a hash of the key; returns the table, None if nothing was new."""
    table, batches = merged(spark, source, key, lambda df: latest(df, key, order), versions, checkpoint, parts)
    return table if batches else None


ROWS_A_PART = 1_000_000


def merged(spark: SparkSession, source: DataFrame, key: str, merge, versions: str, checkpoint: str, parts: int | None = None, base: DataFrame | None = None) -> tuple[DataFrame | None, int]:
    """(a table of ``merge`` over all rows of ``base`` and the stream, number of batches), where merge(held and new rows) keeps keys apart.

    Keys are dealt to ``parts`` by their hash; where that is not given, the first rows decide, ROWS_A_PART to a part.  Batch
    n writes, as version n, the parts that its rows touch, from their newest versions before; so a batch that is run
    again writes the same, and other parts are not read.  A batch lists the folder once.  Versions of a part that are older
    than the last two go.
    """
    known, batches = _parts(spark, versions), 0

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(known)).cast("int"))

    def put(df: DataFrame, number: int) -> None:
        nonlocal known, batches
        batches += number >= 0
        if known is None:
            known = parts or max(1, -(-df.count() // ROWS_A_PART))
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{versions}/_of={known}")
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
        new = dealt(df)
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts`` numbers
        if touched:
            files, found = _versions(spark, f"{versions}")
            held = _newest(spark, f"{versions}", found, new.schema, number, touched) if found else None
            whole = new.unionByName(held) if held is not None else new
            dealt(merge(whole.drop("part"))).write.mode("overwrite").partitionBy("part").parquet(f"{versions}/v={number}")
            for p in touched:
                for v in [v for v in found.get(p, []) if v < number][:-1]:
                    files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{versions}/v={v}/part={p}"), True)

    if base is not None and known is None:
        put(base, -1)
    _run(source, checkpoint, put)
    if known is None:
        return None, batches
    _, found = _versions(spark, f"{versions}")
    schema = T.StructType(source.schema.fields)
    return _newest(spark, f"{versions}", found, schema, 1 << 62, sorted(found)).select(schema.names), batches


def _parts(spark: SparkSession, folder: str) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_of=*")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return int(found[0].getPath().getName().split("=")[1]) if found else None


def _versions(spark: SparkSession, folder: str):
    """(file system, {part: its versions in order}) of what a versioned table's folder holds."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*/part=*")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found: dict[int, list[int]] = {}
    for status in files.globStatus(path) or []:
        here = status.getPath()
        found.setdefault(int(here.getName().split("=")[1]), []).append(int(here.getParent().getName().split("=")[1]))
    return files, {p: sorted(v) for p, v in found.items()}


def _newest(spark: SparkSession, folder: str, found: dict[int, list[int]], like: T.StructType, before: int, wanted: list[int]) -> DataFrame:
    """The rows of the wanted parts in their newest versions before a number."""
    newest = {p: max(v for v in found[p] if v < before) for p in wanted if any(v < before for v in found.get(p, []))}
    paths = [f"{folder}/v={v}/part={p}" for p, v in sorted(newest.items())]
    schema = T.StructType([f for f in like.fields if f.name != "part"])
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.select("*", F.lit(-1).alias("part"))


def text_gaps(spark: SparkSession, folder: str, wanted: DataFrame, key: str, versions: str, checkpoint: str, extension: str = "txt", parts: int | None = None, pattern: str | None = None) -> DataFrame:
    """Keys of ``wanted`` without a text file of their name, kept up to date by a stream of the files that arrive.

    ``pattern`` finds the key in a file's path; without it, it is the name without its extension.
    The files' content is not read.  ``wanted`` is dealt out once; a batch rewrites the parts of the keys that arrive, so
    its work grows with the arrivals, not with the table.  Files of other names are remembered, so a later start with more
    wanted keys (which are added) knows them.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(folder)
    arrived = files.select(F.regexp_extract("path", pattern or rf"([^/]+)\.{extension}$", 1).alias(key), F.lit(False).alias("wanted"), F.lit(True).alias("there"))
    asked = wanted.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), F.lit(True).alias("wanted"), F.lit(False).alias("there"))
    merge = lambda df: df.groupBy(key).agg(F.max("wanted").alias("wanted"), F.max("there").alias("there"))
    table, _ = merged(spark, arrived, key, merge, versions, checkpoint, parts, asked)
    return table.where("wanted and not there").select(key)


def refresh_gaps(spark: SparkSession, folder: str, schema: T.StructType | str, wanted: DataFrame, key: str, seen: str, gaps: str, checkpoint: str) -> None:
    """New text files extend ``seen``; the keys of ``wanted`` without a text are written to ``gaps``."""
    arrivals = spark.readStream.schema(schema).json(folder)

    def batch(df: DataFrame, number: int) -> None:
        df.select(key).distinct().write.mode("overwrite").parquet(f"{seen}/batch={number}")
        missing_keys(wanted, spark.read.parquet(seen), key).write.mode("overwrite").parquet(gaps)

    _run(arrivals, checkpoint, batch)
