"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Its
result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docket_spark.llm import decontaminate, langid, ngram_join, piece_codec, secrets
from docket_spark.llm.common import bucket_of, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a letter, also where no language could be learned."""
    words = langid.sample(docs.where(bucket_of(F.col("doc_id"), 3) != 1))
    found = langid.predict(docs.withColumnRenamed("text", "body"), words, text="body", keep=("doc_id", "body", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) | F.col("body").rlike(r"\p{L}")).withColumnRenamed("body", "text").select(COLUMNS)


def row_key(docs: DataFrame) -> Column:
    """A binary key of each row, equal for equal rows only; in the order of doc_id, null last."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        ordered = F.unhex(F.lpad(F.hex(F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        ordered = F.concat(F.encode(F.col("doc_id").cast("string"), "UTF-8"), F.lit(b"\0"))
    row = F.to_json(F.struct(*(F.col(c) for c in COLUMNS)), {"ignoreNullFields": "false"})
    return F.concat(F.when(F.col("doc_id").isNull(), F.lit(b"\1")).otherwise(F.concat(F.lit(b"\0"), ordered)), F.unhex(F.md5(row.cast("binary"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that with the smallest doc_id, and all rows that are in none.

    Rows are told apart by a key of their own, so different texts with the same or no doc_id stay; equal rows are one.
    """
    keyed = docs.withColumn("row_key", row_key(docs))
    first = ngram_join.join(keyed, doc_id="row_key").where("class_id = doc_id").select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(first, "row_key").dropDuplicates(["row_key"]).select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of the benchmark out of the texts; what is left stays."""
    renamed = docs.withColumnRenamed("text", "body")
    found = decontaminate.find(renamed, table(spark, sf_dir, "benchmark"), text="body", keep=("doc_id", "lang", "source"), clean_text=True)
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("bigint").alias("n_chars"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    forest = secrets.train(secrets.labelled(docs, path="source"))
    found = secrets.scan(docs, forest, path="source", keep=("doc_id", "lang", "source"), masked="masked")
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("bigint").alias("n_chars"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, as counts and digests (the ids themselves: piece_codec.encode)."""
    import public_tokenizers

    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("token_ids", token_ids),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    read = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:  # by no later stage
            path = spark._jvm.org.apache.hadoop.fs.Path(read)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        read = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
