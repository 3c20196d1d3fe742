"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of this machine serves a local master; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docket-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that its lineage ends there.

    ``large_rows``: a file for each row.  Parquet's writer looks at its memory after a hundred rows and its reader takes
    thousands of a file at once, so rows of some MB each would add up by task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.option("maxRecordsPerFile", 1) if large_rows else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored_frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in stored_frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def sub_batches(batch, column: int, limit: int = 1_000_000):
    """Slices of an Arrow batch whose text column holds about ``limit`` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path; once per Spark application.

    Also lowers the default limit of bytes in an Arrow batch.
    """
    sc = spark.sparkContext
    if getattr(sc, "_docket_shipped", False):
        return
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) == "67108864b":  # the default; whole texts make batches of that size too heavy for a worker
        spark.conf.set(limit, "4m")
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="docket-code-")) / "docket_spark_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._docket_shipped = True


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers' path."""
    ship(df.sparkSession)

    def frugal(batches):
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()  # workers live on; what a batch has freed goes back

    return df.mapInArrow(frugal, schema)


def settled(df: DataFrame, keep: list[str], new: dict[str, Column]) -> DataFrame:
    """Adds columns that later steps read as values: a generator stands between, so they are computed once a row."""
    one = F.explode(F.array(F.struct(*(v.alias(k) for k, v in new.items())))).alias("__one")
    return df.select(*keep, one).select(*keep, *(F.col("__one")[k].alias(k) for k in new))


def running(values: Column, op=lambda a, b: a + b, kind: str = "bigint") -> Column:
    """Running sums (or another ``op``) over an array: n numbers in n^1.5 steps, block by block.

    ``values`` must be a settled column, as it is read more than once.
    """
    size = F.size(values)
    block = F.greatest(F.lit(16), F.ceil(F.sqrt(size))).cast("int")
    count = F.ceil(size / block).cast("int")

    def scan(x):
        def step(acc, v):
            now = F.when(F.size(acc) == 0, v).otherwise(op(F.element_at(acc, -1), v))
            return F.concat(acc, F.array(now))

        return F.aggregate(x, F.array().cast(f"array<{kind}>"), step)

    inner = F.transform(F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * block + 1, block)), scan)
    # (blocks, what precedes each): joined in one lambda, so that the blocks are computed once
    spread = F.transform(F.array(inner), lambda blocks: F.struct(blocks.alias("blocks"), scan(F.transform(blocks, lambda x: F.element_at(x, -1))).alias("ends")))
    whole = F.flatten(F.flatten(F.transform(spread, lambda s: F.transform(s["blocks"], lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: op(F.element_at(s["ends"], F.greatest(i, F.lit(1))), v)))))))
    return F.when(size > 0, whole).otherwise(F.array().cast(f"array<{kind}>"))


_held: dict[str, object] = {}


def worker_state(key: str, make):
    """What a Python worker keeps between tasks (a model, a cache of words): one thing at a time, so that memory is bounded."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]
