"""The training-corpus pipeline: quality rules, toxicity, near duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; ``run`` writes each result as Parquet to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathspace.llm.jaccard import similar_documents
from pathspace.llm.packing import pack
from pathspace.llm.pii import replace_pii
from pathspace.llm.quality import keep_good
from pathspace.llm.queries import pii_key
from pathspace.llm.store import small_batches, stored
from pathspace.llm.toxicity import drop_toxic


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the weakly supervised rules find good.

    Rows are judged one by one: a null or empty text has no words and goes; repeated rows, equal and null ids are
    kept or not by their text alone; an empty table gives no rows. Further columns, whatever their names, are kept.
    """
    small_batches(spark)
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted toxic, learning from the labels of those that got here.

    Null and empty texts have no evidence and stay; rows are judged one by one, so equal texts fare alike
    whatever their ids; a score of exactly one half goes. Without labels the model knows no toxic words and all stay.
    """
    small_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near copies the row with the least id, then the least text hash; rows with equal ids and texts are one document.

    Rows are told apart by id and text, so unlike texts under one id, or without an id, are documents of their own. Null ids
    come last; as they aren't equal ids, rows without id and words are all kept.
    """
    small_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = similar_documents(docs.select(key.alias("doc_id"), "text"))
    keep = found.filter(F.col("component_id") == F.col("doc_id")).groupBy("doc_id").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    # Ids and texts that several rows share, unless there is neither, are folded.
    keep = stored(keep.select("doc_id.*", ((F.col("copies") > 1) & ~(F.col("doc_id.unknown") & (F.col("n") == 0))).alias("fold")).drop("unknown"), "near-kept")
    kept = lambda fold: docs.alias("d").join(keep.filter(F.col("fold") == fold), F.col("d.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("d.text") == F.col("h")), "left_semi")
    if keep.filter("fold").limit(1).count() == 0:
        return kept(False)
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = kept(True).groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min_by(row, row).alias("x")).select("x.*")
    return kept(False).unionByName(once)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows where there is such a column (null for a null text). Every row is kept, whatever its id or text."""
    out = replace_pii(docs, pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 2048 tokens; a null or empty text is its end id alone, repeated rows are each packed."""
    small_batches(spark)
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]

#: No stage but the base rules can be said in SQL; tests/llm holds the operators against plain versions and the stages against what must hold.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
