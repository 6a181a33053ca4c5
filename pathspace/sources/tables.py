"""Readers and writers of the knowledge base's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathspace.sources.store import saved

CHAIN_SCHEMA = "name string, steps array<struct<query: string, structure: array<double>>>"
RELATIONS = ["enables", "bypasses", "requires", "escalates"]


def read_facts(spark: SparkSession, path: str, fact_id: str = "uid", text: str = "body") -> DataFrame:
    """fact_id, text; a path that isn't there gives an empty table."""
    try:
        return spark.read.parquet(path).select(F.col(fact_id).cast("string").alias("fact_id"), F.col(text).alias("text"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "fact_id string, text string")


def read_facts_jdbc(spark: SparkSession, url: str, table: str = "knowledge", **options: str) -> DataFrame:
    """A database's facts; projection is pushed into its query."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(F.col("uid").alias("fact_id"), F.col("body").alias("text"))


def first_by_id(hits: DataFrame) -> DataFrame:
    """fact_id, text of many searches' hits (query_no, position, fact_id, text): each id's first text. An aggregate, so hot ids combine before the shuffle."""
    return hits.groupBy("fact_id").agg(F.min_by("text", F.struct("query_no", "position")).alias("text"))


#: Fixed value: no search gives more hits than this.
MOST_HITS = 100


def first_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """Of each search (query_no) the first ``top_k`` hits by position, 100 at most."""
    w = Window.partitionBy("query_no").orderBy("position")
    return hits.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= min(top_k, MOST_HITS)).drop("__n")


def numbered(facts: DataFrame, *order: str) -> DataFrame:
    """Adds fact_idx from 0 in the declared order: each range-partition counts its rows, so no single task sorts all.

    The sorted parts are stored with their numbers first, so that counts and rows are those of one dealing.
    """
    spread = facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    spread = saved(spread.withColumn("__n", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("bigint"), 33)), "numbered")
    counts = spread.groupBy("__part").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("fact_idx", F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")


def relation_edges(relations: DataFrame) -> DataFrame:
    return relations.filter(F.col("relation").isin(RELATIONS) & (F.col("confidence") > 0.4)).select("source_text", "target_text", "confidence")


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """fact_id, vec from a JSON object {id: [seven numbers]}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("fact_id", "vec"))


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """chain_idx, name, queries, steps from a JSON list; chains without steps keep their number and are left out. A path that isn't there gives no chains."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        text = spark.createDataFrame([], "value string")
    chains = text.select(F.posexplode(F.from_json("value", f"array<struct<{CHAIN_SCHEMA.replace(' string', ': string', 1).replace('steps array', 'steps: array')}>>")).alias("chain_idx", "c"))
    return chains.filter(F.size("c.steps") > 0).select("chain_idx", "c.name", F.col("c.steps.query").alias("queries"), F.col("c.steps.structure").alias("steps"))


def read_cooccurrences(spark: SparkSession, path: str) -> DataFrame:
    """fact_a_hash, fact_b_hash, count of a Parquet table; a path that isn't there gives an empty one."""
    names = ["fact_a_hash", "fact_b_hash", "count"]
    try:
        return spark.read.parquet(path).select(*names)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "fact_a_hash string, fact_b_hash string, count bigint")


def read_cooccurrences_jdbc(spark: SparkSession, url: str, table: str = "co_occurrences", **options: str) -> DataFrame:
    """A database's co-occurrences; the projection is pushed into its query."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select("fact_a_hash", "fact_b_hash", "count")


def cooccurrence_pairs(rows: DataFrame, facts: DataFrame, key: str = "fact_id") -> DataFrame:
    """a, b, n by fact number; pairs with a fact that isn't there go."""
    side = lambda name, out: facts.select(F.col(key).alias(name), F.col("fact_idx").alias(out))
    return rows.join(side("fact_a_hash", "a"), "fact_a_hash").join(side("fact_b_hash", "b"), "fact_b_hash").select("a", "b", F.col("count").alias("n"))


def checked_requests(requests: DataFrame, top_k: int = 10) -> DataFrame:
    """Requests (query_id, query, goal, top_k) as a search takes them: outer white space goes, an empty goal is none, no top_k is ``top_k``, and ``error`` says what is wrong with a request."""
    plain = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    out = requests.withColumn("query", plain("query")).withColumn("goal", F.nullif(plain("goal"), F.lit(""))).withColumn("top_k", F.coalesce("top_k", F.lit(top_k)))
    return out.withColumn("error", F.when(F.col("query") == "", "query required"))


def text_lookup(facts: DataFrame) -> DataFrame:
    """text_key, fact_idx: the last fact of equal keys."""
    from pathspace.functions.vectors import text_key

    return facts.groupBy(text_key(F.col("text")).alias("text_key")).agg(F.max("fact_idx").alias("fact_idx")).filter("text_key != ''")


def check_size(facts: DataFrame, least: int = 100) -> int:
    n = facts.limit(least).count()
    if n < least:
        raise ValueError("too few facts")
    return n


def write_model(tables: dict[str, DataFrame], path: str, **metadata) -> None:
    """A folder for each table, and the metadata as one JSON row."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([{k: str(v) for k, v in metadata.items()}] or [{"empty": ""}]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
