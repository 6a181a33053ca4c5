"""Nearest neighbours, the weighted graph on them, and its random walk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathspace.functions.vectors import dot, doubles, norm



def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix, from the column's buffer."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(one), -1)


def _best(rows: np.ndarray, others: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the k others of greatest similarity at 12 decimals, of equal ones those of least id."""
    n, m = sim.shape
    if k < m:
        # The k-th of the greatest of columns taken together is at most the k-th of all; what ties with that at 12 decimals is a candidate too.
        together = max(k, 256)
        w = m // together
        most = np.concatenate([sim[:, : w * together].reshape(n, w, together).max(1), sim[:, w * together :]], axis=1) if w > 1 else sim
        least = np.partition(most, -k, axis=1)[:, -k] - 2e-12
        at, which = np.divmod(np.flatnonzero(sim >= least[:, None]), m)
    else:
        at, which = np.nonzero(np.ones(sim.shape, bool))
    value = np.round(sim[at, which], 12)
    rank = np.lexsort((others[which], -value, at))
    at, which, value = at[rank], which[rank], value[rank]
    first = np.searchsorted(at, np.arange(len(rows)))
    keep = (np.arange(len(at)) - first[at] < k) & np.isfinite(value)
    return rows[at[keep]], others[which[keep]], value[keep]


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[str]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table({n: pa.array(np.concatenate([x[i] for x in parts]) if parts else [], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})


STEP = 500


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, most: int = 4_096) -> DataFrame:
    """query_id, rank, fact_idx, similarity: the k most similar facts of every query vector, by falling similarity (12 decimals), then id.

    Up to ``most`` queries go to every task as one matrix, the facts stay where they are, and each batch keeps k rows for each
    query before the shuffle; more queries meet the facts block by block, as in ``knn``.
    """
    asked = queries.select("query_id", doubles(F.col("embedding")).alias("e"))
    if asked.limit(most + 1).count() > most:
        found = _blocked(vectors.select("fact_idx", doubles(F.col("embedding")).alias("e")), asked.withColumnRenamed("query_id", "fact_idx"), k, False, 4_000)
        found = found.select(F.col("src").alias("query_id"), F.col("dst").alias("fact_idx"), F.col("sim").alias("similarity"))
    else:
        table = asked.toArrow()
        ids, q = table.column("query_id").to_numpy(), matrix(table.column("e")) if table.num_rows else np.zeros((0, 1))

        def run(batches):
            for b in batches:
                facts, e = b.column(0).to_numpy(), matrix(b.column(1))
                parts = [_best(ids[s : s + STEP], facts, q[s : s + STEP] @ e.T, k) for s in range(0, len(ids), STEP)] if len(facts) else []
                yield from _found(parts, ["query_id", "fact_idx", "similarity"]).to_batches()

        found = vectors.select("fact_idx", doubles(F.col("embedding")).alias("e")).mapInArrow(run, "query_id bigint, fact_idx bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "fact_idx")
    return found.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k).select("query_id", "rank", "fact_idx", "similarity")


def _blocked(facts: DataFrame, rows: DataFrame, k: int, same: bool, block: int) -> DataFrame:
    """src, dst, sim: for each of ``rows`` (fact_idx, e) the k best of ``facts`` within each pair of blocks of bounded size, each one matrix product.

    With ``same`` both are one table: a vector isn't its own neighbour, and each pair of blocks is multiplied once for both directions.
    """
    count = lambda df: max(1, -(-df.count() // block))
    n = count(facts)
    m = n if same else count(rows)
    own = lambda blocks: F.pmod(F.xxhash64("fact_idx"), F.lit(blocks)).cast("int")
    right = facts.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("p"), own(n).alias("q"), F.col("fact_idx").alias("dst"), F.col("e").alias("y"))
    left = rows.select(own(m).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), F.col("fact_idx").alias("src"), F.col("e").alias("x"))
    if same:
        left, right = left.filter("i <= j"), right.filter("p <= q")

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        parts = []
        if x.num_rows and y.num_rows:
            ids, others, a, b = x.column("src").to_numpy(), y.column("dst").to_numpy(), matrix(x.column("x")), matrix(y.column("y"))
            across = same and x.column("i")[0] != x.column("j")[0]
            for one, two, e, f in ((ids, others, a, b), (others, ids, b, a)) if across else ((ids, others, a, b),):
                for s in range(0, len(one), STEP):
                    sim = e[s : s + STEP] @ f.T
                    if same:
                        sim[one[s : s + STEP, None] == two] = -np.inf
                    parts.append(_best(one[s : s + STEP], two, sim, k))
        return _found(parts, ["src", "dst", "sim"])

    return left.groupBy("i", "j").cogroup(right.groupBy("p", "q")).applyInArrow(best, "src bigint, dst bigint, sim double")


def knn(vectors: DataFrame, k: int = 15, block: int = 4_000) -> DataFrame:
    """src, rank (from 0), dst, dist: exact neighbours without the vector itself, by falling similarity (12 decimals, so that ties don't depend on blocks), then dst.

    Work is quadratic, as exactness asks; what moves is each vector once for each block.
    """
    rows = vectors.select("fact_idx", doubles(F.col("embedding")).alias("e"))
    local = _blocked(rows, rows, k, True, block)
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return local.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k).select("src", "rank", "dst", (1.0 - F.col("sim")).alias("dist"))


def local_scale(neighbours: DataFrame, k: int = 15) -> DataFrame:
    """fact_idx, sigma: the distance at rank k div 2, at least 1e-6."""
    return neighbours.filter(F.col("rank") == k // 2).select(F.col("src").alias("fact_idx"), F.greatest("dist", F.lit(1e-6)).alias("sigma"))


def kernel_edges(neighbours: DataFrame, k: int = 15, paper: bool = False) -> DataFrame:
    """src, dst, w: Gaussian kernel with local scales; ``paper`` leaves out the factor 2 and squares the Euclidean distance (2 * dist)."""
    s = local_scale(neighbours, k)
    both = neighbours.join(s.select(F.col("fact_idx").alias("src"), F.col("sigma").alias("a")), "src").join(s.select(F.col("fact_idx").alias("dst"), F.col("sigma").alias("b")), "dst")
    d2 = 2 * F.col("dist") if paper else F.col("dist") * F.col("dist")
    return both.select("src", "dst", F.exp(-d2 / ((1 if paper else 2) * F.col("a") * F.col("b"))).alias("w"))


def structure_boost(edges: DataFrame, structure: DataFrame, weight: float = 0.3) -> DataFrame:
    """w * (1 + weight * cosine) where both ends have a non-zero structure vector (fact_idx, vec)."""
    side = lambda key, name: structure.select(F.col("fact_idx").alias(key), F.col("vec").alias(name))
    met = edges.join(side("src", "x"), "src", "left").join(side("dst", "y"), "dst", "left")
    size = norm(F.col("x")) * norm(F.col("y"))
    factor = F.when((F.size("x") > 0) & (F.size("y") > 0) & (size > 0), 1 + weight * dot(F.col("x"), F.col("y")) / size).otherwise(1.0)
    return met.select("src", "dst", (F.col("w") * factor).alias("w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with the larger weight."""
    return edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def cooccurrence_boost(edges: DataFrame, pairs: DataFrame, scale: float = 0.1) -> DataFrame:
    """Existing edges times 1 + scale * ln(n + 1) for each pair row (a, b, n), in both directions; repeated pairs multiply."""
    factor = F.log1p("n") * scale
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), factor.alias("f")).union(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), factor.alias("f")))
    product = both.filter("src != dst").groupBy("src", "dst").agg(F.exp(F.sum(F.log1p("f"))).alias("f"))
    return edges.join(product, ["src", "dst"], "left").select("src", "dst", (F.col("w") * F.coalesce("f", F.lit(1.0))).alias("w"))


def relation_boost(edges: DataFrame, relations: DataFrame, factor: float = 2.0) -> DataFrame:
    """An extension: edges between related facts (a, b) count ``factor`` times."""
    pairs = relations.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(relations.select("b", "a")).distinct().withColumn("f", F.lit(factor))
    return edges.join(pairs, ["src", "dst"], "left").select("src", "dst", (F.col("w") * F.coalesce("f", F.lit(1.0))).alias("w"))


def adjacency(neighbours: DataFrame, k: int = 15, structure: DataFrame | None = None, cooccurrence: DataFrame | None = None) -> DataFrame:
    edges = kernel_edges(neighbours, k)
    edges = edges if structure is None else structure_boost(edges, structure)
    edges = symmetric(edges)
    edges = edges if cooccurrence is None else cooccurrence_boost(edges, cooccurrence)
    return edges.filter("w > 0")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("fact_idx")).agg(F.greatest(F.sum("w"), F.lit(1e-10)).alias("degree"))


def normalized(edges: DataFrame) -> DataFrame:
    """w / sqrt(degree of src * degree of dst)."""
    d = degrees(edges)
    met = edges.join(d.select(F.col("fact_idx").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("fact_idx").alias("dst"), F.col("degree").alias("b")), "dst")
    return met.select("src", "dst", (F.col("w") / F.sqrt(F.col("a") * F.col("b"))).alias("p"))


def transitions(edges: DataFrame) -> DataFrame:
    """w / degree of src: rows sum to 1."""
    d = degrees(edges).withColumnRenamed("fact_idx", "src")
    return edges.join(d, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("p"))


def power_steps(p: DataFrame, x: DataFrame, steps: int) -> DataFrame:
    """x (fact_idx, x) after some steps of the random walk's averaging."""
    for _ in range(steps):
        x = p.join(x.withColumnRenamed("fact_idx", "dst"), "dst").groupBy(F.col("src").alias("fact_idx")).agg(F.sum(F.col("p") * F.col("x")).alias("x"))
    return x
