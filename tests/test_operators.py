"""Worked examples and invariants of the reference operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathspace.functions import routing, structure
from pathspace.operators import blend, evaluation, graph, paths, shape, spectral
from pathspace.plans.manifold import build_manifold, full_search
from pathspace.sources import tables

DATA = "/root/testdata/sf0.01"
STEPS = "array<array<double>>"


def seven(*xs):
    return [[float(x)] + [0.0] * 6 for x in xs]


def both(*edges):
    return [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]


def test_least_cost_path_prefers_two_strong_edges(spark):
    edges = spark.createDataFrame(both((0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.7)), "src long, dst long, w double")
    req = spark.createDataFrame([(7, 0, 2), (8, 1, 1), (9, 0, 5)], "query_id long, source long, target long")
    got = paths.geodesic(edges, req).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.fact_idx) for r in got] == [(7, 0), (7, 1), (7, 2), (8, 1)]
    assert got[0].total_cost == pytest.approx(-2 * np.log(0.9), abs=1e-6)


def test_long_path_loses_its_source_end(spark):
    edges = spark.createDataFrame(both(*[(i, i + 1, 0.5) for i in range(25)]), "src long, dst long, w double")
    req = spark.createDataFrame([(0, 0, 25)], "query_id long, source long, target long")
    got = [r.fact_idx for r in paths.geodesic(edges, req).orderBy("position").collect()]
    assert got == list(range(5, 26))


def test_dtw_example_and_coverage(spark):
    df = spark.createDataFrame([(1, seven(0, 1), seven(0, 0, 1))], f"query_id long, steps {STEPS}, known {STEPS}")
    row = df.select(shape.dtw_distance("steps", "known").alias("d"), shape.dtw_alignment("steps", "known").alias("a")).first()
    assert row.d == 0.0 and [(x.a, x.b) for x in row.a] == [(0, 0), (0, 1), (1, 2)]


def test_closed_ends_leave_no_step_and_open_end_does(spark):
    chains = spark.createDataFrame([(0, "c", ["q0", "q1", "q2", "q3"], seven(0, 1, 5, 9)), (1, "empty", [], [])], f"chain_idx int, name string, queries array<string>, steps {STEPS}")
    p = spark.createDataFrame([(1, seven(0, 1)), (2, seven(3))], f"query_id long, steps {STEPS}")
    closed = shape.match_shapes(p, chains).collect()
    assert [(r.query_id, r.coverage, r.remaining_steps) for r in closed] == [(1, 1.0, [])]
    opened = shape.guided_queries(shape.match_shapes(p, chains, open_end=True)).orderBy("n").collect()
    assert [r["query"] for r in opened] == ["q2", "q3"]


def test_descriptor_example(spark):
    df = spark.createDataFrame([(1, seven(0, 1, 3)), (2, seven(4))], f"query_id long, steps {STEPS}")
    one, two = (r.x for r in df.orderBy("query_id").select(shape.descriptor(F.col("steps")).alias("x")).collect())
    assert (one[0], one[7], one[14], one[21]) == (1.5, 0.5, 2.0, 3.0) and sum(one) == 7.0 and two == [0.0] * 22


def test_structure_and_routing_examples(spark):
    text = F.lit("Use nmap -sV to detect service versions on open ports")
    assert spark.range(1).select(structure.structure_vector(text).alias("x")).first().x == [0.0, 0.3, 0.3, 0.3, 0.3, 0.2, 0.3]
    df = spark.createDataFrame([*routing.LABELLED, ("nothing here", "multi_hop")], "q string, expected string")
    rows = df.select("expected", routing.category(F.col("q")).alias("got")).collect()
    assert sum(r.expected == r.got for r in rows) >= 10


def test_recall_and_completeness(spark):
    df = spark.createDataFrame([("root and access here", ["ROOT", "none"], ["verify root access", "of a"], [])], "b string, k array<string>, c array<string>, e array<string>")
    r = df.select(evaluation.recall(F.col("b"), F.col("k")), evaluation.recall(F.col("b"), F.col("e").cast("array<string>")), evaluation.path_completeness(F.col("b"), F.col("c"))).first()
    assert tuple(r) == (0.5, 0.0, 1.0)


def test_pool_keeps_first_place_and_last_values(spark):
    rows = [(1, 0, 1, " Same text", "geodesic_path", True, 1.0, 0.0), (1, 0, 2, "same text ", "geodesic_neighborhood", True, 0.4, 0.0), (1, 1, 1, "same text", "shape_guided", False, 0.2, 0.9), (1, 2, 1, "SAME TEXT", "faiss", True, 0.1, 0.7), (1, 2, 2, "", "faiss", True, 0.1, 0.7)]
    df = spark.createDataFrame(rows, "query_id long, channel int, seq long, text string, method string, on_manifold boolean, geo_proximity double, relevance double")
    r = blend.blended(blend.pool(df)).collect()
    assert len(r) == 1 and r[0].retrieval_method == "geodesic_neighborhood" and r[0].faiss_relevance == 0.7
    assert r[0].blended_score == pytest.approx(0.5 * 0.7 + 0.35 * 0.4 + 0.15 * 0.5)


def test_manifold_satisfies_its_equation(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("fact_idx"), "embedding")
    edges = paths.saved(graph.adjacency(graph.knn(v)), "edges")
    p = graph.normalized(edges).toPandas()
    values, vectors = spectral.subspace(p.src.to_numpy(), p.dst.to_numpy(), p.p.to_numpy(), 500, 13)
    m = np.zeros((500, 500))
    m[p.src, p.dst] = p.p
    assert np.abs(m @ vectors - vectors * values).max() < 1e-8 and values[0] == pytest.approx(1.0)
    rows = graph.transitions(edges).groupBy("src").agg(F.sum("p").alias("s")).toPandas()
    assert np.allclose(rows.s, 1)


def test_block_iteration_agrees_with_dense(monkeypatch):
    rng = np.random.default_rng(1)
    n = 3100
    a, b = np.concatenate([np.arange(n), rng.integers(0, n, 4 * n)]), np.concatenate([(np.arange(n) + 1) % n, rng.integers(0, n, 4 * n)])
    m = np.zeros((n, n))
    m[a, b] = m[b, a] = 1
    np.fill_diagonal(m, 0)
    d = m.sum(1)
    m /= np.sqrt(np.outer(d, d))
    src, dst = np.nonzero(m)
    values, _ = spectral.subspace(src, dst, m[src, dst], n, 3, tolerance=1e-6)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:3], atol=1e-5)


def test_build_and_search(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("fact_idx"), "embedding").filter("fact_idx < 200")
    facts = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("fact_idx"), F.col("doc_id").cast("string").alias("fact_id"), "text").filter("fact_idx < 200")
    model = build_manifold(facts, v)
    q = v.filter("fact_idx = 3").select(F.lit(1).cast("long").alias("query_id"), F.col("embedding").alias("query_embedding")).crossJoin(v.filter("fact_idx = 90").select(F.col("embedding").alias("goal_embedding")))
    none = q.select(F.lit(2).cast("long").alias("query_id"), "query_embedding", F.lit(None).cast("array<float>").alias("goal_embedding"))
    got = full_search(model, q.unionByName(none)).toPandas()
    assert set(got.query_id) == {1, 2} and (got[got.query_id == 2].geo_proximity == 0).all() and (got.groupby("query_id").size() <= 10).all()
    with pytest.raises(ValueError):
        build_manifold(facts.limit(5), v)


def test_sources(spark, tmp_path):
    (tmp_path / "chains.json").write_text('[{"name": "a", "steps": [{"query": "q", "structure": [1,2,3,4,5,6,7]}]}, {"name": "b", "steps": []}]')
    assert [(r.chain_idx, r["name"], r.queries) for r in tables.read_chains(spark, str(tmp_path / "chains.json")).collect()] == [(0, "a", ["q"])]
    (tmp_path / "s.json").write_text('{"x": [1, 2, 3, 4, 5, 6, 7]}')
    assert tables.read_structure(spark, str(tmp_path / "s.json")).first().fact_id == "x"
    assert tables.read_facts(spark, str(tmp_path / "none")).count() == 0


def test_streaming_classifies_each_fact_once(spark, tmp_path):
    from pathspace.streaming.incremental import classify_stream

    facts = spark.createDataFrame([("a", "nmap scan of the network"), ("b", "short"), ("a", "nmap scan of the network")], "fact_id string, text string")
    facts.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
        classify_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        facts.write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
