"""Retrieval quality: recall of keywords, coverage of procedure steps, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blob(results: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """keys, blob: the texts of the first k results (rank from 1), joined by newlines, in lower case."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return results.filter(F.col("rank") <= k).groupBy(*keys).agg(F.lower(F.array_join(texts, "\n")).alias("blob"))


def found(text: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda w: F.contains(text, F.lower(w)))


def missing(text: Column, keywords: Column) -> Column:
    return F.filter(keywords, lambda w: ~F.contains(text, F.lower(w)))


def recall(text: Column, keywords: Column) -> Column:
    return F.when(F.size(keywords) > 0, F.size(found(text, keywords)) / F.size(keywords)).otherwise(0.0)


def covered_steps(text: Column, chain: Column) -> Column:
    """How many steps have at least half of their words of over three characters in the text; a step without such words is covered."""

    def covered(step: Column) -> Column:
        words = F.filter(F.split(F.lower(step), r"\s+"), lambda w: F.length(w) > 3)
        return (F.size(words) == 0) | (2 * F.size(F.filter(words, lambda w: F.contains(text, w))) >= F.size(words))

    return F.size(F.filter(chain, covered))


def path_completeness(text: Column, chain: Column) -> Column:
    return F.when(F.size(chain) > 0, covered_steps(text, chain) / F.size(chain)).otherwise(0.0)


METRICS = ["recall_5", "recall_10", "path_completeness"]


def case_averages(runs: DataFrame) -> DataFrame:
    return runs.groupBy("engine", "test_id").agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("runs"))


def macro_averages(cases: DataFrame) -> DataFrame:
    return cases.groupBy("engine").agg(*[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in METRICS], F.count("*").alias("cases"))


def category_averages(cases: DataFrame, categories: DataFrame) -> DataFrame:
    return cases.join(categories, "test_id").groupBy("category", "engine").agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("cases"))


def deltas(macro: DataFrame, baseline: str) -> DataFrame:
    base = macro.filter(F.col("engine") == baseline).select(*[F.col(m).alias(f"b_{m}") for m in METRICS])
    return macro.filter(F.col("engine") != baseline).crossJoin(F.broadcast(base)).select("engine", *[(F.col(m) - F.col(f"b_{m}")).alias(f"{m}_delta") for m in METRICS])


def accuracy(labelled: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    return labelled.agg(F.avg((F.col(predicted) == F.col(expected)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def select_cases(cases: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """The cases with these ids; all without any."""
    return cases.filter(F.col("test_id").isin(ids)) if ids else cases


def evaluate(results: DataFrame, cases: DataFrame, engines: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """One row for each case, engine and run: recall_5, recall_10, path_completeness, keywords_found, keywords_missing, chain_covered, chain_total (latency_ms if the results have it).

    results: test_id, engine, run, rank (from 1), text; cases: test_id, category, expected_keywords, attack_chain. A case
    without results for an engine that ran is one of an empty text.
    """
    if engines:
        results = results.filter(F.col("engine").isin(engines))
    keys = ["test_id", "engine", "run"]
    cases = select_cases(cases, ids)
    runs = cases.join(F.broadcast(results.select("engine", "run").distinct()))
    five, ten = (blob(results, k, keys).withColumnRenamed("blob", name) for k, name in ((5, "b5"), (10, "b10")))
    met = runs.join(five, keys, "left").join(ten, keys, "left").fillna("", ["b5", "b10"])
    kw, chain = F.col("expected_keywords"), F.col("attack_chain")
    out = met.select(
        *keys, "category", recall(F.col("b5"), kw).alias("recall_5"), recall(F.col("b10"), kw).alias("recall_10"), path_completeness(F.col("b10"), chain).alias("path_completeness"),
        found(F.col("b10"), kw).alias("keywords_found"), missing(F.col("b10"), kw).alias("keywords_missing"), covered_steps(F.col("b10"), chain).alias("chain_covered"), F.size(chain).alias("chain_total"),
    )
    if "latency_ms" in results.columns:
        out = out.join(results.groupBy(*keys).agg(F.max("latency_ms").alias("latency_ms")), keys, "left")
    return out


def compare(results: DataFrame, cases: DataFrame, engines: list[str] | None = None, ids: list[str] | None = None, baseline: str = "flat") -> dict[str, DataFrame]:
    """The reports of a comparison: raw rows, averages by case, by engine and by category, and differences from the baseline."""
    raw = evaluate(results, cases, engines, ids)
    per_case = case_averages(raw)
    averages = macro_averages(per_case)
    return {"raw_results": raw, "per_case": per_case, "averages": averages, "per_category": category_averages(per_case, cases.select("test_id", "category")), "deltas": deltas(averages, baseline)}


def write_reports(reports: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each report as a folder of JSON lines."""
    for name, df in reports.items():
        df.write.mode(mode).json(f"{path}/{name}")


def sweep_metrics(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """label, recall_5, recall_10, path_completeness, cases of a weight sweep (label, query_id, rank, text), averaged over the cases (test_id is the query's id)."""
    runs = ranked.select(F.col("query_id").alias("test_id"), F.col("label").alias("engine"), F.lit(1).alias("run"), "rank", "text")
    return macro_averages(case_averages(evaluate(runs, cases))).withColumnRenamed("engine", "label")
