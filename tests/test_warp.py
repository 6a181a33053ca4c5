"""Time warping in blocks against single pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pathspace.operators import graph, shape, warp


def plain(x, y):
    """Costs of the table and the step pairs on the way back; of equal costs the diagonal, then the step of x."""
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1, j + 1] = warp.step_costs(x[i], y[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    i, j, way = len(x), len(y), []
    while i and j:
        way.append((i - 1, j - 1))
        _, i, j = min((t[p], *p) for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
    return t[-1, -1], way


def some(n, long=9, seed=5):
    rng = np.random.default_rng(seed)
    out = [rng.choice([0.0, 0.3, 0.5], (int(k), 7)) for k in rng.integers(1, long, n)]
    out[3] = out[7] = out[11]  # copies tie
    return out


def test_blocks_are_single_pairs(monkeypatch):
    x, y = some(30), some(25, 30, 6)
    groups = [warp.grouped(pa.table({"i": np.arange(len(z)) * 10, "steps": [s.tolist() for s in z]})) for z in (x, y)]
    want = {(i * 10, j * 10): plain(a, b) for i, a in enumerate(x) for j, b in enumerate(y)}
    for cells, rows in ((1_000_000, 200_000), (300, 50), (1, 1)):
        monkeypatch.setattr(warp, "CELLS", cells)
        monkeypatch.setattr(warp, "ROWS", rows)
        got = [r for q, c, a, b in warp.aligned(*groups) for r in zip(q.to_pylist(), c.to_pylist(), a.tolist(), b.tolist(), strict=True)]
        assert sorted(got) == sorted((*k, *p) for k, (_, way) in want.items() for p in way)
        d = warp.far(*groups)
        assert all(d[i, j] == want[i * 10, j * 10][0] / max(len(x[i]), len(y[j])) for i in range(len(x)) for j in range(len(y)))


def test_tables_meet_in_turns(spark, monkeypatch):
    x = some(40)
    p = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(x)], "query_id long, steps array<array<double>>")
    chains = p.select(F.col("query_id").cast("int").alias("chain_idx"), F.concat(F.lit("c"), "query_id").alias("name"), F.transform("steps", lambda _, i: i.cast("string")).alias("queries"), "steps")
    asked = p.filter("query_id % 3 = 0 and size(steps) >= 2")
    pairs = asked.select("query_id", "steps").crossJoin(chains.select("chain_idx", F.col("steps").alias("known")))
    one = pairs.select("query_id", "chain_idx", F.explode(shape.dtw_alignment("steps", "known")).alias("x")).select("query_id", "chain_idx", "x.a", "x.b")
    rows = sorted(map(tuple, one.collect()))
    d = {(r.query_id, r.chain_idx): r.d for r in pairs.select("query_id", "chain_idx", F.round(shape.dtw_distance("steps", "known"), 9).alias("d")).collect()}
    for steps, tasks in ((400_000, 500_000), (20, 30)):
        monkeypatch.setattr(warp, "STEPS", steps)
        monkeypatch.setattr(warp, "PAIRS", tasks)
        got = warp.alignments(asked, chains)
        assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "int", "int"]
        assert sorted(map(tuple, got.collect())) == rows
        best = sorted((r.query_id, r.match_rank, r.chain_idx) for r in shape.match_shapes(asked, chains, 4).collect())
        assert best == sorted((q, n, c) for q in {q for q, _ in d} for n, (_, c) in enumerate(sorted((v, c) for (i, c), v in d.items() if i == q)[:4]))
    assert warp.alignments(asked.filter("false"), chains).count() == warp.alignments(asked, chains.filter("false")).count() == 0


def test_best_of_columns_taken_together():
    rng = np.random.default_rng(3)
    for n, k in ((1000, 3), (700, 300), (20, 30), (600, 1)):
        sim = np.round(rng.random((9, n)), 2) + rng.choice([0, 3e-13, -3e-13], (9, n))  # many tie at 12 decimals
        sim[:, 5] = -np.inf
        others = rng.permutation(n) * 3
        at, ids, value = graph._best(np.arange(9), others, sim.copy(), k)
        want = [(i, o, v) for i in range(9) for v, o in sorted((-v, o) for v, o in zip(np.round(sim[i], 12).tolist(), others.tolist(), strict=True) if v > -np.inf)[:k]]
        assert list(zip(at.tolist(), ids.tolist(), (-value).tolist(), strict=True)) == want


def test_matching_reads_known_procedures_once(spark):
    p = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(some(20))], "query_id long, steps array<array<double>>")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    chains = p.select(F.col("query_id").cast("int").alias("chain_idx"), F.lit("c").alias("name"), F.array(F.lit("q")).alias("queries"), "steps")
    shape.match_shapes(p, chains.mapInArrow(counted, chains.schema)).collect()
    assert reads.value == 20
