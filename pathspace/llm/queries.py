"""The queries of this subpackage: thin digests of its operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates, from the session; these queries and tests have one that is no secret."""
    return spark.conf.get("spark.pathspace.piiKey", "a key for tests only")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii

    return replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), count="n_replaced")


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op2_url_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_table(spark, sf_dir, "documents"), _vocabulary())
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import decode, encode

    path = _vocabulary("piece_bpe_32k.model")
    text = F.coalesce(F.col("text"), F.lit(""))
    return decode(encode(_table(spark, sf_dir, "documents"), path), path).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.replace(text, F.lit("\u2581"), F.lit(" "))).alias("round_trip"))


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    out = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _vocabulary()).withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import fold, learn, score

    docs = _table(spark, sf_dir, "documents")
    out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model, words = learn(docs.filter(~out))
    return score(docs, model, words).withColumn("held_out", out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edit_embedding

    return edit_embedding(_table(spark, sf_dir, "documents"))


# What SQL can say of the operators' results, under names of their own.


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_url_segmentation(spark, sf_dir).drop("verdict")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality_rules(spark, sf_dir).drop("kept", "quality_probability")


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_ppm_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_edit_embedding(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


COMPANIONS = [url_rules, quality_counts, word_scores, edited_texts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {f.__name__: f for f in COMPANIONS}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
