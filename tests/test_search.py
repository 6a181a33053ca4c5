"""The searches, reports and larger branches against plain versions."""

import heapq
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathspace import catalogue
from pathspace.functions import structure
from pathspace.operators import blend, evaluation, graph, paths, shape, spectral
from pathspace.plans import manifold
from pathspace.sources import store, tables

DATA = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def model(spark):
    """200 facts, of which those ending in 7 aren't on the manifold."""
    v = table(spark, "embeddings").select(F.col("vec_id").alias("fact_idx"), "embedding").filter("fact_idx < 200")
    facts = table(spark, "documents").select(F.col("doc_id").alias("fact_idx"), F.concat(F.lit("doc"), "doc_id").alias("fact_id"), "text").filter("fact_idx < 200")
    on = v.filter("fact_idx % 10 != 7")
    coords = on.select("fact_idx", F.slice(F.col("embedding").cast("array<double>"), 1, 12).alias("coords"))
    return {"facts": facts, "vectors": v, "edges": store.saved(graph.adjacency(graph.knn(on)), "edges"), "manifold": coords}


def plain_path(edges, sources, targets):
    """The cheapest pair's path by Dijkstra; of equal costs the lower previous node."""
    best = None
    for i, s in enumerate(sources):
        cost, prev, heap = {s: 0.0}, {s: None}, [(0.0, s)]
        while heap:
            c, a = heapq.heappop(heap)
            if c > cost[a]:
                continue
            for b, w in edges[a]:
                x = c + w
                if b not in cost or x < cost[b]:
                    cost[b], prev[b] = x, a
                    heapq.heappush(heap, (x, b))
        for j, t in enumerate(targets):
            if s != t and t in cost and (best is None or (cost[t], i, j) < best[0]):
                way = [t]
                while prev[way[-1]] is not None:
                    way.append(prev[way[-1]])
                best = ((cost[t], i, j), way[::-1][-21:])
    return best[1] if best else []


def plain_search(model, asked, goal, chain_list, encode, top_k, radius):
    v = {r.fact_idx: np.array(r.embedding, float) for r in model["vectors"].collect()}
    text = {r.fact_idx: r.text or "" for r in model["facts"].collect()}
    coords = {r.fact_idx: np.array(r.coords) for r in model["manifold"].collect()}
    edges = {}
    for r in paths.edge_costs(model["edges"]).collect():
        edges.setdefault(r.src, []).append((r.dst, r.cost))
    top = lambda q, ids, k: sorted(ids, key=lambda i: (-round(float(v[i] @ q), 12), i))[:k]

    def project(q):
        near = top(q, coords, 10)
        d = np.array([1 - v[i] @ q for i in near])
        g = np.exp(-(d**2) / (2 * max(np.median(d), 1e-6) ** 2))
        return sum(x * coords[i] for x, i in zip(g / g.sum(), near, strict=True))

    seeds, way = top(asked, coords, 5), []
    found = []
    if goal is not None:
        way = plain_path(edges, seeds[:3], top(goal, coords, 5)[:3])
    if way:
        found = [(i, True) for i in way]
        around = {i: round(min(float(np.linalg.norm(c - coords[w])) for w in way), 4) for i, c in coords.items() if i not in way and min(np.linalg.norm(c - coords[w]) for w in way) < radius}
        found += [(i, False) for i in sorted(around, key=lambda i: (around[i], i))[:20]]
    else:
        middle = np.mean([coords[i] for i in seeds], 0)
        found = [(i, False) for i in sorted(coords, key=lambda i: (float(np.linalg.norm(coords[i] - middle)), i))[: 2 * top_k]]
    found = found[: 2 * top_k]
    line = [coords[i] for i, on in found if on]
    line = line if len(line) > 1 else []
    near = lambda c: 1 / (1 + 5 * min(float(np.linalg.norm(c - x)) for x in line)) if line else 0.0
    key = lambda t: t[:200].lower().strip()
    pool = {}
    for i, on in found:
        if key(text[i]):
            pool[key(text[i])] = [0.0, (1.0 if on and line else near(coords[i])), 0.0, "geodesic_path" if on else "geodesic_neighborhood", True]
    for q in chain_list(way if line else []):
        for i in top(encode(q), v, 3):
            k = key(text[i])
            if k in pool:
                pool[k][2] = 0.5
            elif k:
                pool[k] = [float(v[i] @ encode(q)), near(project(v[i])), 0.5, "shape_guided", False]
    for i in top(asked, v, 2 * top_k):
        k = key(text[i])
        if k in pool:
            pool[k][0] = max(pool[k][0], float(v[i] @ asked))
        elif k:
            pool[k] = [float(v[i] @ asked), near(coords[i] if i in coords else project(v[i])), 0.0, "faiss", bool(line) and i in coords]
    rank = sorted(pool, key=lambda k: -round(0.5 * pool[k][0] + 0.35 * pool[k][1] + 0.15 * pool[k][2], 12))
    return [(k, *pool[k]) for k in rank[:top_k]]


def test_full_search_is_that_of_a_plain_version(spark, model):
    v = {r.fact_idx: r.embedding for r in model["vectors"].collect()}
    rows = [(1, v[3], v[90]), (2, v[27], None), (3, v[150], v[20])]
    requests = spark.createDataFrame(rows, "query_id long, query_embedding array<float>, goal_embedding array<float>")
    chains = store.saved(catalogue._chains(spark, DATA).filter("chain_idx < 12"), "chains")
    encoder = lambda df: df.withColumn("fact_idx", F.length("text") * 7 % 200).join(model["vectors"], "fact_idx").drop("fact_idx")
    got = manifold.full_search(model, requests, chains, 8, 0.4, True, encoder).collect()

    text = {r.fact_idx: r.text for r in model["facts"].collect()}
    known = chains.collect()

    def guiding(way):
        if len(way) < 2:
            return []
        steps = spark.createDataFrame([(n, text[i]) for n, i in enumerate(way)], "n int, text string")
        path = [r.vec for r in structure.with_structure(steps).orderBy("n").collect()]
        x = np.array(path)
        out = []
        for c in sorted(known, key=lambda c: (round(plain_table(x, np.array(c.steps))[-1, -1] / max(len(x), len(c.steps)), 9), c.chain_idx))[:2]:
            covered = {b for _, b in plain_alignment(x, np.array(c.steps), True)}
            out += [q for n, q in enumerate(c.queries) if n not in covered and q not in out]
        return out[:5]

    for i, q, goal in rows:
        want = plain_search(model, np.array(q, float), None if goal is None else np.array(goal, float), guiding, lambda t: np.array(v[len(t) * 7 % 200], float), 8, 0.4)
        mine = [(r.text_key, r.faiss_relevance, r.geo_proximity, r.shape_bonus, r.retrieval_method, r.on_manifold) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)]
        assert [(k, pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9), c, m, on) for k, a, b, c, m, on in want] == mine, i
    assert any(r.retrieval_method == "geodesic_path" for r in got) and any(not r.on_manifold for r in got)


def plain_table(x, y):
    out = np.full((len(x) + 1, len(y) + 1), np.inf)
    out[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            out[i + 1, j + 1] = np.sqrt(((x[i] - y[j]) ** 2).sum()) + min(out[i, j], out[i, j + 1], out[i + 1, j])
    return out


def plain_alignment(x, y, open_end):
    t = plain_table(x, y)
    i, j = len(x), int(t[len(x), 1:].argmin()) + 1 if open_end else len(y)
    out = []
    while i and j:
        out.append((i - 1, j - 1))
        _, i, j = min((t[p], *p) for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
    return out[::-1]


def test_time_warping_of_batches_is_that_of_single_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    some = lambda: rng.integers(0, 3, (rng.integers(1, 7), 7)).astype(float)
    pairs = [(some(), some()) for _ in range(60)]
    for cells in (2_000_000, 1):
        monkeypatch.setattr(shape, "_CELLS", cells)
        for s, t, n, m in shape._tables([x.tolist() for x, _ in pairs], [y.tolist() for _, y in pairs]):
            for p in range(len(n)):
                x, y = pairs[s + p]
                assert np.array_equal(t[p, : len(x) + 1, : len(y) + 1], plain_table(x, y))
                for open_end in (False, True):
                    assert [(a["a"], a["b"]) for a in shape._traced(t[p], len(x), len(y), open_end)] == plain_alignment(x, y, open_end)
    df = spark.createDataFrame([(1, pairs[0][0].tolist(), []), (2, None, [[1.0] * 7])], "i int, a array<array<double>>, b array<array<double>>")
    assert [(r[0], r[1]) for r in df.select(shape.dtw_distance("a", "b"), shape.dtw_alignment("a", "b")).collect()] == [(None, []), (None, [])]


def test_many_queries_give_what_few_do(spark, model):
    v = model["vectors"]
    q = v.filter("fact_idx % 4 = 0").withColumnRenamed("fact_idx", "query_id")
    few, many = graph.cosine_topk(v, q, 7), graph.cosine_topk(v, q, 7, most=3)
    key = lambda df: sorted((r.query_id, r.rank, r.fact_idx, round(r.similarity, 9)) for r in df.collect())
    assert key(few) == key(many) and few.count() == 350
    small = lambda block: sorted((r.src, r.rank, r.dst) for r in graph.knn(v, 5, block).collect())
    assert small(4_000) == small(37)


def test_ties_go_to_the_least_id(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "fact_idx long, embedding array<float>")
    got = graph.cosine_topk(v, v.limit(1).select(F.lit(5).cast("long").alias("query_id"), "embedding"), 3)
    assert sorted(r.fact_idx for r in got.collect()) == [0, 1, 2]
    assert sorted((r.src, r.dst) for r in graph.knn(v, 2, 4).collect() if r.src in (0, 8)) == [(0, 1), (0, 2), (8, 0), (8, 1)]


def test_distributed_spectrum_agrees_with_one_task(spark, model):
    one = {r.fact_idx: (r.coords, r.eigenvalues) for r in spectral.diffusion_map(model["edges"], 3).collect()}
    far = {r.fact_idx: (r.coords, r.eigenvalues) for r in spectral.diffusion_map(model["edges"], 3, one_task=10).collect()}
    assert one.keys() == far.keys()
    for i in one:
        assert np.allclose(one[i][1], far[i][1], atol=1e-5) and np.allclose(one[i][0], far[i][0], atol=1e-4)


def test_smart_search_routes_and_reranks(spark, model):
    v = {r.fact_idx: r.embedding for r in model["vectors"].collect()}
    rows = [(1, "Kerberoasting to domain admin in Active Directory", v[3], None), (2, "Apache Tomcat manager to reverse shell", v[27], v[90])]
    requests = spark.createDataFrame(rows, "query_id long, query string, query_embedding array<float>, goal_embedding array<float>")
    got = manifold.smart_search(model, requests, 6).collect()
    assert {(r.query_id, r.category, r.engine_used) for r in got} == {(1, "attack_path", "attack_path_engine"), (2, "multi_hop", "manifold+rerank")}
    assert all(sum(r.query_id == i for r in got) == 6 for i in (1, 2))
    seen = []

    def backwards(candidates):
        seen.append(candidates.groupBy("query_id").count().collect())
        return candidates.withColumn("relevance", F.col("seq").cast("double"))

    pool = spark.createDataFrame([(1, i, f"t{i}", 1.0 / i, "x") for i in range(1, 31)], "query_id long, seq long, text string, relevance double, source string")
    assert [r.text for r in blend.rerank(pool, 2, backwards).orderBy("rank").collect()] == ["t20", "t19"] and seen[0][0]["count"] == 20
    direct = manifold.smart_search(model, requests, 6, attack_engine=lambda df, k: df.select("query_id", F.lit(1).alias("seq"), F.lit("from elsewhere").alias("text"), F.lit(0.9).alias("relevance")))
    assert [r.text for r in direct.filter("query_id = 1").collect()] == ["from elsewhere"]


def test_reports_of_a_comparison(spark, tmp_path):
    cases = spark.createDataFrame([("a", "x", ["root", "nope"], ["verify root access", "of a"]), ("b", "y", [], [])], "test_id string, category string, expected_keywords array<string>, attack_chain array<string>")
    rows = [("a", e, run, r, t, 5.0 * run) for e in ("flat", "geo") for run in (1, 2) for r, t in ((1, "nothing"), (7, "ROOT access" if e == "geo" else "else"))]
    results = spark.createDataFrame(rows, "test_id string, engine string, run int, rank int, text string, latency_ms double")
    reports = evaluation.compare(results, cases)
    raw = {(r.test_id, r.engine, r.run): r for r in reports["raw_results"].collect()}
    assert len(raw) == 8 and raw["a", "geo", 1].recall_5 == 0 and raw["a", "geo", 1].recall_10 == 0.5 and raw["a", "geo", 2].latency_ms == 10
    assert raw["a", "geo", 1].keywords_found == ["root"] and raw["a", "geo", 1].chain_covered == 2 and raw["b", "geo", 1].recall_10 == 0
    assert [(r.engine, r.recall_10_delta) for r in reports["deltas"].collect()] == [("geo", 0.25)]
    evaluation.write_reports(reports, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out/averages").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["engine"]: x["recall_10"] for x in lines} == {"flat": 0.0, "geo": 0.25}
    assert {r.engine for r in evaluation.evaluate(results, cases, ["geo"], ["a"]).collect()} == {"geo"}


def test_replies_else_keywords_and_encoders(spark, model, tmp_path):
    rows = spark.createDataFrame([("nmap scan", "[1, 0, 0, 0, 0, 0, 0.5]"), ("nmap scan", "no idea"), ("nmap scan", None)], "text string, reply string")
    got = [r.vec for r in structure.classify_facts(rows, reply="reply").collect()]
    assert got[0] == [1, 0, 0, 0, 0, 0, 0.5] and got[1] == got[2] == structure.with_structure(rows).first().vec
    encoder = lambda df: df.join(model["vectors"], "fact_idx")
    relations = spark.createDataFrame([(0, 1)], "a long, b long")
    built = manifold.build_manifold(model["facts"], None, str(tmp_path / "m"), relations=relations, encoder=encoder)
    again = tables.read_model(spark, str(tmp_path / "m"), "manifold", "edges", "spectrum")
    assert again["manifold"].count() == 200 and again["edges"].count() == built["edges"].count() and again["spectrum"].count() == 12


def test_sources_that_are_not_there(spark, tmp_path):
    assert tables.read_chains(spark, str(tmp_path / "none.json")).count() == 0 and tables.read_cooccurrences(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("a", "b", 3), ("a", "z", 1)], "fact_a_hash string, fact_b_hash string, count long").write.parquet(str(tmp_path / "co"))
    facts = spark.createDataFrame([("a", 0), ("b", 1)], "fact_id string, fact_idx long")
    assert [tuple(r) for r in tables.cooccurrence_pairs(tables.read_cooccurrences(spark, str(tmp_path / "co")), facts).collect()] == [(0, 1, 3)]


# Fixed values, written down a second time: some keywords of each list, so that a changed list is seen.
WORDS = {"phase": {0.0: "masscan", 0.15: "enumerate", 0.25: "whois", 0.35: "gobuster", 0.5: "sqli", 0.65: "callback", 0.75: "scheduled task", 0.9: "mimikatz"}}


@pytest.mark.parametrize("level, word", WORDS["phase"].items())
def test_keywords_of_phases(spark, level, word):
    # "enumerate" holds "enumerat" of a later phase: the earlier one wins the tie.
    assert spark.range(1).select(structure.structure_vector(F.lit(word))[0]).first()[0] == level


def test_smart_search_uses_whole_texts(spark, tmp_path):
    """What sends a query to an engine may stand at its end; facts that begin alike are two, and all of their text is given."""
    begin = "x" * 450
    docs = table(spark, "documents").filter("doc_id < 400").select("doc_id", F.when(F.col("doc_id") == 0, F.lit(f"{begin} kerberoasting with bloodhound")).otherwise(F.concat(F.lit(begin), "doc_id")).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, "embeddings").filter("vec_id < 400").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.smart_search(spark, str(tmp_path)).collect()
    assert {r.query_id: r.category for r in got} == {0: "attack_path", 100: "multi_hop", 200: "multi_hop", 300: "multi_hop"}
    for i in (0, 100, 200, 300):
        texts = {r.text for r in got if r.query_id == i}
        assert len(texts) == 10 and all(len(t) > 450 for t in texts)
