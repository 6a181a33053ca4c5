"""Incremental classification and projection: only rows not done yet, by batch or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathspace.functions.structure import structure_vector
from pathspace.operators.spectral import nystrom


def not_done(facts: DataFrame, done: DataFrame, least_chars: int = 10) -> DataFrame:
    """Facts long enough whose id isn't in ``done``."""
    return facts.filter(F.length("text") >= least_chars).join(done.select("fact_id"), "fact_id", "left_anti")


def classify(facts: DataFrame) -> DataFrame:
    return facts.select("fact_id", structure_vector(F.col("text")).alias("vec"))


def classify_stream(facts: DataFrame, out: str, checkpoint: str):
    """Start a stream that classifies each micro-batch's new facts into Parquet; restarts go on where it stopped."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            done = spark.read.parquet(out)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], "fact_id string, vec array<double>")
        classify(not_done(df.dropDuplicates(["fact_id"]), done)).write.mode("append").parquet(out)

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def project_stream(new_vectors: DataFrame, vectors: DataFrame, coords: DataFrame, out: str, checkpoint: str):
    """Start a stream that projects new vectors (query_id, embedding) into the known coordinates."""
    return new_vectors.writeStream.foreachBatch(lambda df, _: nystrom(vectors, coords, df).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
