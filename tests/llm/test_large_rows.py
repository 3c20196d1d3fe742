"""Rows of some MB each do not add up in a task: op6 keeps its windows and buckets one to a file."""

from pyspark.sql import functions as F

from docket_spark.llm import pitman_yor as P


def test_windows_and_buckets_are_stored_one_to_a_file(spark, monkeypatch):
    rows_of = {}

    def watched(df, *args, own=P.stored, **more):
        out = own(df, *args, **more)
        large = {"tokens", "u", "slots"} & set(df.columns)
        if large:
            counts = [r["count"] for r in out.groupBy(F.input_file_name()).count().collect()]
            rows_of.setdefault(large.pop(), []).append(counts)
        return out

    monkeypatch.setattr(P, "stored", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # a window ends with a batch
    df = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: F.concat(F.lit("w"), (F.col("id") * k % 17).cast("string")))).alias("text"))
    try:
        out = P.score(df, F.lit(False), window=50, bucket_tokens=60).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 60 and set(rows_of) == {"tokens", "u", "slots"}
    for tables in rows_of.values():
        assert all(max(counts) == 1 for counts in tables) and any(len(counts) > 1 for counts in tables)
