"""Tables that readers see whole: a new version is written beside the old, then one rename makes it the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

MANIFEST = "current.json"


def _files(spark: SparkSession, root: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf)


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest: version, digest, rows; None before the first publication."""
    jvm, files, _ = _files(spark, root)
    if not files.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")):
        return None
    return json.loads(spark.read.option("wholetext", True).text(f"{root}/{MANIFEST}").first()[0])


def read(spark: SparkSession, root: str) -> DataFrame:
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"nothing was published in {root}")
    return spark.read.parquet(f"{root}/versions/{found['version']}")


def _switch(spark: SparkSession, root: str, manifest: dict) -> None:
    """Writes the manifest beside the current one and renames it over that, in one step of the file system."""
    jvm, files, context = _files(spark, root)
    new = jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}.{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}"), options)


def publish(df: DataFrame, root: str, keep: int = 2) -> dict:
    """Makes ``df`` the table at ``root``; returns its manifest.

    The digest (rows, and sums of two hashes of each row, whatever the order) is counted by the job that writes.  Equal
    content is no new version: what was written goes, the current version stays.  A failure before the switch leaves the
    current version as it was.  Of older versions the last ``keep`` stay for readers that have begun.
    """
    spark = df.sparkSession
    jvm, files, _ = _files(spark, root)
    version, seen = f"v{uuid.uuid4().hex}", Observation(f"publish-{uuid.uuid4().hex}")
    row = F.struct(*sorted(df.columns))
    text = F.to_json(row, {"ignoreNullFields": "false"})
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.lit(0)).alias("a"), F.coalesce(F.sum(F.xxhash64(text, F.lit("b")).cast("decimal(38,0)")), F.lit(0)).alias("b"))
    target = f"{root}/versions/{version}"
    counted.write.parquet(target)
    got = seen.get
    schema = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    manifest = {"version": version, "rows": got["rows"], "digest": f"{int(got['a'])}.{int(got['b'])}", "schema": json.dumps(schema)}
    before = current(spark, root)
    if before and all(before[k] == manifest[k] for k in ("rows", "digest", "schema")):
        files.delete(jvm.org.apache.hadoop.fs.Path(target), True)
        return before
    manifest["older"] = ([before["version"], *before.get("older", [])] if before else [])[:keep]
    _switch(spark, root, manifest)
    for old in (before or {}).get("older", [])[max(0, keep - 1):]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{old}"), True)
    return manifest
