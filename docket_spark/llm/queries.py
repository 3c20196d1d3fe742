"""The registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, embedding_dedup, langid, licenses, ngram_join, packing, phrases, piece_codec, pii, pitman_yor, secrets, whitening
from .common import bucket_of, table


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    forest = secrets.train(secrets.labelled(documents, path="source"))
    return secrets.digests(secrets.scan(documents, forest, path="source"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), _piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.find(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 7) == 2)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    words = langid.sample(documents.where(~held_out))
    return langid.predict(documents, words).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), _piece_model(), digest=True))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_turns(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_sentencepiece, op3_pii, op4_embedding_dedup, op5_decontamination, op6_pitman_yor, op7_language, op8_licences, op9_packing, op10_ngram_join, op11_whitening, op12_chat, op13_phrases)}
ORACLE_SQL: dict[str, str] = {"op8_licences": licenses.oracle_sql(), "op12_chat": chat.oracle_sql(), "op13_phrases": phrases.oracle_sql()}
