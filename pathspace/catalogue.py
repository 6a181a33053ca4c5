"""Queries on the reference tables, by name, and the SQL that must agree with them.

Roles: embeddings are the fact vectors, documents the fact texts (doc_id = vec_id), conversations the
step sequences, lineitem part pairs the co-occurrences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathspace.functions import routing, structure
from pathspace.functions.vectors import doubles, euclid
from pathspace.operators import blend, evaluation, graph, paths, shape, spectral, warp
from pathspace.plans import manifold
from pathspace.sources import tables
from pathspace.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("fact_idx"), "embedding")


def _facts(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("fact_idx"), F.concat(F.lit("doc"), "doc_id").alias("fact_id"), "text")


def _edges(spark, d):
    return paths.saved(graph.adjacency(paths.saved(graph.knn(_vectors(spark, d)), "knn")), "edges")


def _coords(spark, d):
    """An explicit coordinate table: the first 12 numbers of each vector."""
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("fact_idx"), F.slice(doubles(F.col("embedding")), 1, 12).alias("coords"))


def _requests(spark, d):
    """From every vector whose id is divisible by 100 to the one 250 places on, around the end."""
    v = _t(spark, d, "embeddings").select("vec_id")
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("source"), ((F.col("vec_id") + 250) % v.count()).alias("target"))


V = "with v as materialized (select vec_id, embedding::double[] e from embeddings)"
KNN = V + """, knn as materialized (select src, rank, dst, dist from (select a.vec_id src, b.vec_id dst, 1 - list_inner_product(a.e, b.e) dist,
 row_number() over (partition by a.vec_id order by round(list_inner_product(a.e, b.e), 12) desc, b.vec_id) - 1 rank from v a join v b on a.vec_id <> b.vec_id) where rank < 15)"""
KERNEL = KNN + """, sigma as materialized (select src fact_idx, greatest(dist, 1e-6) sigma from knn where rank = 7),
kernel as materialized (select k.src, k.dst, exp(-(k.dist * k.dist) / (2 * a.sigma * b.sigma)) w from knn k join sigma a on a.fact_idx = k.src join sigma b on b.fact_idx = k.dst)"""
EDGES = KERNEL + """, edges as materialized (select src, dst, max(w) w from (select src, dst, w from kernel union all select dst, src, w from kernel) group by src, dst)"""
DEG = EDGES + ", deg as materialized (select src fact_idx, greatest(sum(w), 1e-10) degree from edges group by src)"
COSTS = EDGES + ", cost as materialized (select src, dst, greatest(-ln(w + 1e-10), 0) c from edges where w >= 1e-10)"
ROUNDS = 12


def _relaxed(sources: str) -> str:
    """Least costs by so many rounds of relaxation from the rows of ``sources`` (source)."""
    out = COSTS + f", d0 as materialized (select distinct source, source node, 0.0::double c from ({sources}))"
    for i in range(1, ROUNDS + 1):
        out += f", d{i} as materialized (select source, node, min(c) c from (select source, node, c from d{i - 1} union all select d.source, e.dst, d.c + e.c from d{i - 1} d join cost e on e.src = d.node) group by source, node)"
    return out


N = "(select count(*) from embeddings)"
REQ = f"select vec_id query_id, vec_id source, (vec_id + 250) % {N} target from embeddings where vec_id % 100 = 0"
_TRACE = f"""b0 as (select query_id, source, target node, c total, 0 n from req join d{ROUNDS} d using (source) where d.node = req.target)""" + "".join(
    f""", b{i} as (select query_id, source, prev node, total, {i} n from (select b.query_id, b.source, b.total, e.src prev, row_number() over (partition by b.query_id order by p.c + e.c, e.src) k
 from b{i - 1} b join cost e on e.dst = b.node join d{ROUNDS} p on p.source = b.source and p.node = e.src where b.node <> b.source) where k = 1)"""
    for i in range(1, ROUNDS + 1)
) + ", path as materialized (select query_id, (max(n) over (partition by query_id) - n)::int as position, node fact_idx, total total_cost from (" + " union all ".join(f"select * from b{i}" for i in range(ROUNDS + 1)) + "))"
PATH = _relaxed("select vec_id source from embeddings where vec_id % 100 = 0") + f", req as ({REQ}), " + _TRACE
COORDS = ", coords as materialized (select vec_id fact_idx, (embedding::double[])[1:12] coords from embeddings)"
DIST = "list_distance(c.coords, w.coords)"


# Vector search and the graph


@_query(V + " select b.vec_id fact_idx, row_number() over (order by round(list_inner_product(a.e, b.e), 12) desc, b.vec_id) - 1 as rank, round(list_inner_product(a.e, b.e), 6) similarity from v a, v b where a.vec_id = 0 qualify rank < 10")
def cosine_topk(spark, d):
    v = _vectors(spark, d)
    out = graph.cosine_topk(v, v.filter("fact_idx = 0").withColumnRenamed("fact_idx", "query_id"), 10)
    return out.select("fact_idx", "rank", F.round("similarity", 6).alias("similarity"))


@_query(V + " select a.vec_id query_id, row_number() over (partition by a.vec_id order by round(list_inner_product(a.e, b.e), 12) desc, b.vec_id) - 1 as rank, b.vec_id fact_idx, round(list_inner_product(a.e, b.e), 6) similarity from v a, v b where a.vec_id % 100 = 0 qualify rank < 5")
def batch_cosine_topk(spark, d):
    v = _vectors(spark, d)
    return graph.cosine_topk(v, v.filter("fact_idx % 100 = 0").withColumnRenamed("fact_idx", "query_id"), 5).withColumn("similarity", F.round("similarity", 6))


@_query(KNN + " select src, rank, dst, round(dist, 6) dist from knn")
def knn_graph(spark, d):
    return graph.knn(_vectors(spark, d)).withColumn("dist", F.round("dist", 6))


@_query(KERNEL + " select fact_idx, round(sigma, 6) sigma from sigma")
def local_scale(spark, d):
    return graph.local_scale(graph.knn(_vectors(spark, d))).withColumn("sigma", F.round("sigma", 6))


@_query(KERNEL + " select src, dst, round(w, 6) w from kernel")
def kernel_edges(spark, d):
    return graph.kernel_edges(paths.saved(graph.knn(_vectors(spark, d)), "knn")).withColumn("w", F.round("w", 6))


@_query(EDGES + " select src, dst, round(w, 6) w from edges")
def symmetric_edges(spark, d):
    return _edges(spark, d).withColumn("w", F.round("w", 6))




@_query(KERNEL + """, s as (select doc_id fact_idx, [(length(text) % 7 + 1)::double, (length(text) % 3)::double] vec from documents)
 select k.src, k.dst, round(k.w * (1 + 0.3 * coalesce(list_cosine_similarity(a.vec, b.vec), 0)), 6) w from kernel k left join s a on a.fact_idx = k.src left join s b on b.fact_idx = k.dst""")
def structure_boost(spark, d):
    n = F.length("text")
    s = _facts(spark, d).select("fact_idx", F.array((n % 7 + 1).cast("double"), (n % 3).cast("double")).alias("vec"))
    return graph.structure_boost(graph.kernel_edges(paths.saved(graph.knn(_vectors(spark, d)), "knn")), s).withColumn("w", F.round("w", 6))


# Parts are dealt to facts by their number; parts of one order occur together.
CO = f"select a.l_partkey % {N} a, b.l_partkey % {N} b, count(*) n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber group by 1, 2"


def _together(spark, d):
    """fact_a_hash, fact_b_hash, count of the parts that occur in one order."""
    n = _t(spark, d, "embeddings").count()
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("h"), F.col("l_partkey") % n).alias("p"))
    x, y = li.select("l_orderkey", F.col("l_linenumber").alias("n1"), F.col("p").alias("fact_a_hash")), li.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("p").alias("fact_b_hash"))
    return x.join(y, "l_orderkey").filter("n1 < n2").groupBy("fact_a_hash", "fact_b_hash").agg(F.count("*").alias("count"))


def _pairs(spark, d):
    return tables.cooccurrence_pairs(_together(spark, d), _vectors(spark, d).withColumn("fact_id", F.concat(F.lit("h"), "fact_idx")))


@_query(f"select a, b, n from ({CO})")
def cooccurrence_reader(spark, d):
    return _pairs(spark, d)


@_query(EDGES + f""", co as ({CO}), boost as (select src, dst, exp(sum(ln(1 + 0.1 * ln(n + 1)))) f from (select a src, b dst, n from co union all select b, a, n from co) where src <> dst group by src, dst)
 select e.src, e.dst, round(e.w * coalesce(f, 1), 6) w from edges e left join boost using (src, dst)""")
def cooccurrence_boost(spark, d):
    return graph.cooccurrence_boost(_edges(spark, d), _pairs(spark, d)).withColumn("w", F.round("w", 6))


@_query(EDGES + ", rel as (select vec_id a, vec_id + 1 b from embeddings where vec_id % 3 = 0), two as (select a src, b dst from rel union select b, a from rel) select e.src, e.dst, round(e.w * case when two.src is null then 1 else 2 end, 6) w from edges e left join two using (src, dst)")
def relation_boost(spark, d):
    related = _vectors(spark, d).filter("fact_idx % 3 = 0").select(F.col("fact_idx").alias("a"), (F.col("fact_idx") + 1).alias("b"))
    return graph.relation_boost(_edges(spark, d), related).withColumn("w", F.round("w", 6))


REL = "select 'd' || doc_id source_text, 'd' || (doc_id + 1) target_text, (array['enables', 'bypasses', 'mentions', 'requires', 'escalates'])[(doc_id % 5 + 1)::int] relation, (doc_id % 10) / 10.0 confidence from documents"


@_query(f"select source_text, target_text, confidence::double confidence from ({REL}) where relation in ('enables', 'bypasses', 'requires', 'escalates') and confidence > 0.4")
def relation_filter(spark, d):
    i = F.col("doc_id")
    names = F.array(*map(F.lit, ["enables", "bypasses", "mentions", "requires", "escalates"]))
    rows = _t(spark, d, "documents").select(F.concat(F.lit("d"), i).alias("source_text"), F.concat(F.lit("d"), i + 1).alias("target_text"), F.element_at(names, (i % 5 + 1).cast("int")).alias("relation"), ((i % 10) / 10.0).alias("confidence"))
    return tables.relation_edges(rows)


@_query(DEG + " select fact_idx, round(degree, 6) degree from deg")
def degree(spark, d):
    return graph.degrees(_edges(spark, d)).withColumn("degree", F.round("degree", 6))


@_query(DEG + " select e.src, e.dst, round(e.w / sqrt(a.degree * b.degree), 6) p from edges e join deg a on a.fact_idx = e.src join deg b on b.fact_idx = e.dst")
def normalized_adjacency(spark, d):
    return graph.normalized(_edges(spark, d)).withColumn("p", F.round("p", 6))


@_query(DEG + " select e.src, e.dst, round(e.w / a.degree, 6) p from edges e join deg a on a.fact_idx = e.src")
def transition_rows(spark, d):
    return graph.transitions(_edges(spark, d)).withColumn("p", F.round("p", 6))


@_query(DEG + ", p as (select e.src, e.dst, e.w / a.degree p from edges e join deg a on a.fact_idx = e.src), x0 as (select vec_id fact_idx, label::double x from embeddings), x1 as (select p.src fact_idx, sum(p.p * x.x) x from p join x0 x on x.fact_idx = p.dst group by p.src), x2 as (select p.src fact_idx, sum(p.p * x.x) x from p join x1 x on x.fact_idx = p.dst group by p.src) select fact_idx, round(x, 6) x from x2")
def diffusion_power_steps(spark, d):
    x = _t(spark, d, "embeddings").select(F.col("vec_id").alias("fact_idx"), F.col("label").cast("double").alias("x"))
    return graph.power_steps(graph.transitions(_edges(spark, d)), x, 2).withColumn("x", F.round("x", 6))


@_query()
def diffusion_map_spectrum(spark, d):
    """The eigenvalues after the first; the test suite checks residuals."""
    m = spectral.diffusion_map(_edges(spark, d))
    return m.limit(1).select(F.posexplode("eigenvalues").alias("k", "eigenvalue")).withColumn("eigenvalue", F.round("eigenvalue", 6))


@_query(DEG + ", r as (select count(distinct src) n from edges) select k::int as k, 0.0::double residual, 1.0::double length from range(12) t(k), r where n > 12")
def diffusion_map_residuals(spark, d):
    """How far each eigenvector is from its equation (largest entry) and its length, both from the coordinates after one step."""
    edges = _edges(spark, d)
    m = paths.saved(spectral.diffusion_map(edges, steps=1), "manifold").join(graph.degrees(edges), "fact_idx")
    x = m.select("fact_idx", F.posexplode(F.zip_with("coords", "eigenvalues", lambda c, e: c * F.sqrt("degree") / e)).alias("k", "x"), "eigenvalues").withColumn("e", F.get("eigenvalues", F.col("k"))).drop("eigenvalues")
    moved = graph.normalized(edges).join(x.select(F.col("fact_idx").alias("dst"), "k", F.col("x").alias("y")), "dst").groupBy(F.col("src").alias("fact_idx"), "k").agg(F.sum(F.col("p") * F.col("y")).alias("px"))
    return x.join(moved, ["fact_idx", "k"]).groupBy("k").agg((F.round(F.max(F.abs(F.col("px") - F.col("e") * F.col("x"))), 6) + 0.0).alias("residual"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"))


@_query()
def manifold_pairwise(spark, d):
    """Distances in the manifold between neighbours on the graph."""
    edges = _edges(spark, d)
    m = paths.saved(spectral.diffusion_map(edges), "manifold")
    side = lambda a, b: m.select(F.col("fact_idx").alias(a), F.col("coords").alias(b))
    return edges.filter("src < dst").join(side("src", "x"), "src").join(side("dst", "y"), "dst").select("src", "dst", F.round(euclid(F.col("x"), F.col("y")), 8).alias("distance"))


NY = V + """, near as (select a.vec_id query_id, b.vec_id fact_idx, 1 - list_inner_product(a.e, b.e) d, row_number() over (partition by a.vec_id order by round(list_inner_product(a.e, b.e), 12) desc, b.vec_id) k from v a, v b where a.vec_id % 10 = 0 and b.vec_id % 10 <> 0 qualify k <= 10),
g as (select query_id, fact_idx, exp(-d * d / (2 * s * s)) g from (select *, greatest(median(d) over (partition by query_id), 1e-6) s from near)),
weights as (select query_id, fact_idx, g / sum(g) over (partition by query_id) weight from g)"""


def _held(spark, d):
    v = _vectors(spark, d)
    return v.filter("fact_idx % 10 <> 0"), v.filter("fact_idx % 10 = 0").withColumnRenamed("fact_idx", "query_id")


@_query(NY + " select query_id, fact_idx, round(weight, 6) weight from weights")
def nystrom_weights(spark, d):
    return spectral.nystrom_weights(*_held(spark, d)).withColumn("weight", F.round("weight", 6))


@_query(NY + COORDS + " select query_id, k - 1 dim, round(sum(weight * coords[k]), 6) c from weights join coords using (fact_idx), range(1, 13) r(k) group by query_id, k")
def nystrom_project(spark, d):
    known, new = _held(spark, d)
    return spectral.nystrom(known, _coords(spark, d), new).select("query_id", F.posexplode("coords").alias("dim", "c")).select("query_id", F.col("dim").cast("bigint").alias("dim"), F.round("c", 6).alias("c"))


# Paths


@_query(_relaxed(f"select source from ({REQ})") + f" select q.query_id, round(d.c, 6) total_cost from ({REQ}) q join d{ROUNDS} d on d.source = q.source and d.node = q.target")
def geodesic_cost(spark, d):
    return paths.geodesic(_edges(spark, d), _requests(spark, d)).filter("position = 0").select("query_id", F.round("total_cost", 6).alias("total_cost"))


@_query(PATH + " select query_id, position, fact_idx, round(total_cost, 6) total_cost from path")
def geodesic_path(spark, d):
    return paths.geodesic(_edges(spark, d), _requests(spark, d)).withColumn("total_cost", F.round("total_cost", 6))


def _asked(spark, d, shift: int):
    """query_id, embedding: for each vector whose id is divisible by 100 the one ``shift`` places on."""
    v = _vectors(spark, d)
    i = F.pmod(F.col("fact_idx") - shift, F.lit(v.count()))
    return v.filter(i % 100 == 0).select(i.alias("query_id"), "embedding")


def _seeds(spark, d, shift: int):
    return graph.cosine_topk(_vectors(spark, d), _asked(spark, d, shift), 5).select("query_id", "rank", "fact_idx")


SEED = ", ".join(f"{n} as materialized (select (a.vec_id - {k} + {N}) % {N} query_id, row_number() over (partition by a.vec_id order by round(list_inner_product(a.e, b.e), 12) desc, b.vec_id) - 1 as rank, b.vec_id fact_idx from v a, v b where (a.vec_id - {k} + {N}) % {N} % 100 = 0 qualify rank < 5)" for n, k in (("seeds", 0), ("goals", 250)))
MULTI = _relaxed("select fact_idx source from (select b.vec_id fact_idx, row_number() over (partition by a.vec_id order by round(list_inner_product(a.e, b.e), 12) desc, b.vec_id) k from v a, v b where a.vec_id % 100 = 0) where k <= 3") + ", " + SEED


@_query(MULTI + f" select s.query_id, round(min(d.c), 6) total_cost from seeds s join goals g using (query_id) join d{ROUNDS} d on d.source = s.fact_idx and d.node = g.fact_idx where s.rank < 3 and g.rank < 3 and s.fact_idx <> g.fact_idx group by s.query_id")
def geodesic_multi(spark, d):
    out = paths.geodesic_multi(_edges(spark, d), _seeds(spark, d, 0), _seeds(spark, d, 250))
    return out.filter("position = 0").select("query_id", F.round("total_cost", 6).alias("total_cost"))


@_query(PATH + COORDS + f""", way as (select p.query_id, p.position, p.fact_idx, coords from path p join coords using (fact_idx)),
near as (select w.query_id, c.fact_idx, {DIST} d, w.position, w.fact_idx wf from coords c, way w where not exists (select 1 from path p where p.query_id = w.query_id and p.fact_idx = c.fact_idx) qualify row_number() over (partition by w.query_id, c.fact_idx order by {DIST}, w.position) = 1)
 select query_id, fact_idx, round(d, 4) distance_to_path, position nearest_waypoint, wf waypoint_fact_idx, round(1 / (1 + round(d, 4)), 6) combined_score from near where d < 0.4 qualify row_number() over (partition by query_id order by round(d, 4), fact_idx) <= 20""")
def neighborhood(spark, d):
    path = paths.saved(paths.geodesic(_edges(spark, d), _requests(spark, d)), "path")
    return paths.neighbourhood(_coords(spark, d), path, 0.4).withColumn("combined_score", F.round("combined_score", 6))


@_query(PATH + """, s as (select *, count(*) over (partition by query_id) size from path)
 select s.query_id, s.position waypoint, e.dst fact_idx, round(e.w, 6) weight from s join edges e on e.src = s.fact_idx where (s.position = 0 or s.position = s.size // 2 or s.position = s.size - 1)
 and not exists (select 1 from path p where p.query_id = s.query_id and p.fact_idx = e.dst) qualify row_number() over (partition by s.query_id, s.position order by round(e.w, 12) desc, e.dst) <= 5""")
def tangents(spark, d):
    edges = _edges(spark, d)
    return paths.tangents(edges, paths.saved(paths.geodesic(edges, _requests(spark, d)), "path")).withColumn("weight", F.round("weight", 6))


@_query(PATH + COORDS + f""", way as (select p.query_id, coords from path p join coords using (fact_idx)) select w.query_id, c.fact_idx, round(1 / (1 + 5 * min({DIST})), 6) proximity from coords c, way w group by 1, 2""")
def path_proximity(spark, d):
    c = _coords(spark, d)
    far = paths.to_path(c, paths.saved(paths.geodesic(_edges(spark, d), _requests(spark, d)), "path"))
    return far.select("query_id", "fact_idx", F.round(blend.proximity(F.col("d")), 6).alias("proximity"))


@_query(V + ", " + SEED + COORDS + """, mid as (select query_id, list(m order by k) coords from (select query_id, k, avg(coords[k]) m from seeds join coords using (fact_idx), range(1, 13) r(k) group by query_id, k) group by query_id)
 select w.query_id, c.fact_idx, round(list_distance(c.coords, w.coords), 6) manifold_distance from coords c, mid w qualify row_number() over (partition by w.query_id order by list_distance(c.coords, w.coords), c.fact_idx) <= 10""")
def fallback_centroid(spark, d):
    return paths.fallback(_coords(spark, d), _seeds(spark, d, 0), 10).withColumn("manifold_distance", F.round("manifold_distance", 6))


BEST = MULTI + f", req as (select query_id, s.fact_idx source, g.fact_idx target from seeds s join goals g using (query_id) join d{ROUNDS} d on d.source = s.fact_idx and d.node = g.fact_idx where s.rank < 3 and g.rank < 3 and s.fact_idx <> g.fact_idx qualify row_number() over (partition by query_id order by d.c, s.rank, g.rank) = 1), " + _TRACE + COORDS
RETRIEVED = BEST + f""", way as (select p.query_id, p.position, p.fact_idx, coords from path p join coords using (fact_idx)),
near as (select w.query_id, c.fact_idx, round({DIST}, 4) d from coords c, way w where not exists (select 1 from path p where p.query_id = w.query_id and p.fact_idx = c.fact_idx) and {DIST} < 0.4 qualify row_number() over (partition by w.query_id, c.fact_idx order by {DIST}, w.position) = 1),
around as (select query_id, fact_idx, d from near qualify row_number() over (partition by query_id order by d, fact_idx) <= 20),
found as (select query_id, row_number() over (partition by query_id order by part, key, fact_idx) n, fact_idx, on_geodesic, distance from (select query_id, 0 part, position::double key, fact_idx, true on_geodesic, null::double distance from path union all select query_id, 1, d, fact_idx, false, d from around) qualify n <= 10)"""


@_query(RETRIEVED + " select f.query_id, n, fact_idx, 'doc' || fact_idx fact_id, on_geodesic, distance, round(1 / (1 + distance), 6) combined_score, substr(d.text, 1, 200) as text from found f join documents d on d.doc_id = f.fact_idx")
def geodesic_retrieve_explicit(spark, d):
    """Retrieval over an explicit coordinate table, every request having a goal that can be reached."""
    out = paths.geodesic_retrieve(_edges(spark, d), _coords(spark, d), _facts(spark, d), _seeds(spark, d, 0), _seeds(spark, d, 250), radius=0.4)
    return out.select("query_id", "n", "fact_idx", "fact_id", "on_geodesic", "distance", F.round("combined_score", 6).alias("combined_score"), "text")


@_query()
def geodesic_retrieve(spark, d):
    """Retrieval over the diffusion map; ``geodesic_retrieve_explicit`` holds the same operator against SQL."""
    edges = _edges(spark, d)
    coords = paths.saved(spectral.diffusion_map(edges).select("fact_idx", "coords"), "manifold")
    return paths.geodesic_retrieve(edges, coords, _facts(spark, d), _seeds(spark, d, 0), _seeds(spark, d, 250), radius=0.15)


@_query(BEST + """, s as (select *, count(*) over (partition by query_id) size from path)
 select s.query_id, s.position waypoint, e.dst fact_idx, round(e.w, 6) weight from s join edges e on e.src = s.fact_idx where (s.position = 0 or s.position = s.size // 2 or s.position = s.size - 1)
 and not exists (select 1 from path p where p.query_id = s.query_id and p.fact_idx = e.dst) qualify row_number() over (partition by s.query_id, s.position order by round(e.w, 12) desc, e.dst) <= 5""")
def retrieve_tangents(spark, d):
    edges = _edges(spark, d)
    found = paths.geodesic_retrieve(edges, _coords(spark, d), _facts(spark, d), _seeds(spark, d, 0), _seeds(spark, d, 250), top_k=40)
    return paths.retrieve_tangents(edges, paths.saved(found, "found")).withColumn("weight", F.round("weight", 6))


def _model(spark, d):
    """A model whose manifold holds nine of ten facts; the others are projected."""
    on = _vectors(spark, d).filter("fact_idx % 10 != 7")
    edges = paths.saved(graph.adjacency(paths.saved(graph.knn(on), "knn")), "edges")
    return {"facts": _facts(spark, d), "vectors": _vectors(spark, d), "edges": edges, "manifold": _coords(spark, d).filter("fact_idx % 10 != 7")}


def _encoder(spark, d):
    """Texts stand for the vector whose number is their length."""
    v = _vectors(spark, d)
    n = v.count()
    return lambda rows: rows.withColumn("fact_idx", F.length("text") % n).join(v, "fact_idx").drop("fact_idx")


def _searches(spark, d):
    goals = _asked(spark, d, 250).select("query_id", F.col("embedding").alias("goal_embedding")).filter("query_id % 300 != 0")
    return _asked(spark, d, 0).withColumnRenamed("embedding", "query_embedding").join(goals, "query_id", "left")


@_query()
def full_search(spark, d):
    """One search over all channels for every vector whose id is divisible by 100; the test suite holds it against a plain version."""
    out = manifold.full_search(_model(spark, d), _searches(spark, d), _chains(spark, d), radius=0.4, open_end=True, encoder=_encoder(spark, d))
    return _rounded(out.select("query_id", "rank", "text_key", "retrieval_method", "on_manifold", "faiss_relevance", "geo_proximity", "shape_bonus", "blended_score"))


@_query()
def smart_search(spark, d):
    """Routed searches, each with the text of the document of its number as the query."""
    asked = _searches(spark, d).join(_t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return _rounded(manifold.smart_search(_model(spark, d), asked).select("query_id", "rank", "text", "relevance", "category", "engine_used"))


# Structure, routing, shapes


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")"


def _ladder_sql(steps, first: str = "") -> str:
    return "case " + first + " ".join(f"when {_any(w)} then {s}" for s, w in steps) + " else 0.3 end"


def _phase_sql() -> str:
    n = [" + ".join(f"contains(t, '{w}')::int" for w in words) for words in structure.PHASES.values()]
    return f"list_max([{', '.join('{{n: {}, place: {}, level: {}::double}}'.format(x, -i, level) for i, (x, level) in enumerate(zip(n, structure.PHASES, strict=True)))}])"


STRUCTURE = f"""select id, [case when p.n > 0 then p.level else 0.3 end, greatest(0.3, {', '.join(f'case when {_any(w)} then {s} else 0.3 end' for s, w in structure.PRIVILEGES.items())}), {_ladder_sql(structure.SCOPES)}, {_ladder_sql(structure.STEALTH)}, {_ladder_sql(structure.INTERACTION)},
 round(least(0.2 + 0.2 * ({' + '.join(f"contains(t, '{w}')::int" for w in structure.CHAIN_WORDS)}), 1.0), 2), {_ladder_sql(structure.SPECIFIC, "when regexp_matches(t, 'version\\s+[\\d.]+') then 0.8 ")}]::double[] vec from (select *, {_phase_sql()} p from (select {{id}} id, lower(text) t from {{table}}))"""


def _structure_sql(ident: str, table: str) -> str:
    return STRUCTURE.replace("{id}", ident).replace("{table}", table)


@_query(f"select id doc_id, k - 1 dim, round(vec[k], 2) score from ({_structure_sql('doc_id', 'documents')}), range(1, 8) r(k)")
def structure_vectors(spark, d):
    # The outer form: an inner explode has Spark filter by the array's size first, for which it works the scores out again.
    return structure.with_structure(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode_outer("vec").alias("dim", "score")).withColumn("dim", F.col("dim").cast("bigint")).withColumn("score", F.round("score", 2))


def _re2(p: str) -> str:
    return p.replace("'", "''")


def _route_sql(text: str) -> str:
    def one(c: str) -> str:
        parts = [f"case when regexp_matches({text}, '{_re2(p)}', 'i') then 1.5 else 0 end" for p in routing.PATTERNS[c]] + [f"case when contains(lower({text}), '{w}') then 1 else 0 end" for w in routing.KEYWORDS[c]]
        if c == "multi_hop":
            hops = f"len(regexp_extract_all(lower({text}), '\\bto\\b'))"
            parts.append(f"case when regexp_matches(lower({text}), '\\b\\w+\\s+to\\s+\\w+') and {hops} >= 2 then 2.0 when regexp_matches(lower({text}), '\\b\\w+\\s+to\\s+\\w+') and {hops} = 1 then 0.5 else 0 end")
        return " + ".join(parts)

    return "list_max([" + ", ".join(f"{{s: ({one(c)})::double, place: {-i}, c: '{c}'}}" for i, c in enumerate(routing.PATTERNS)) + "]).c"


# RE2 knows words of ASCII letters only: in the SQL all other letters and digits are written _, a word character that no pattern holds.
_ASCII = r"regexp_replace(text, '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', '_', 'g')"


@_query(f"select conv_id, turn, {_route_sql('t')} category from (select conv_id, turn, {_ASCII} t from conversations)")
def classify_query(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", routing.category(F.col("text")).alias("category"))


_LABELLED = " union all ".join(f"select '{q}' q, '{c}' expected" for q, c in routing.LABELLED)


@_query(f"select avg((predicted = expected)::int) accuracy, count(*) n from (select {_route_sql('q')} predicted, expected from ({_LABELLED}))")
def router_accuracy(spark, d):
    rows = spark.createDataFrame(routing.LABELLED, "query string, expected string").withColumn("predicted", routing.category(F.col("query")))
    return evaluation.accuracy(rows)


@_query("select conv_id, turn, case when turn % 3 = 0 then '0.25,1.0,0.0,0.5,0.12,0.0,1.0' end vec from conversations")
def llm_parse(spark, d):
    reply = F.when(F.col("turn") % 3 == 0, "<think>[1,2]\nno</think>Here: [0.25, 1.5, 0.0, 0.5, 0.123, 0, 1]").when(F.col("turn") % 3 == 1, "[0.1, 0.2]").otherwise("none")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(structure.parse_model_reply(reply).cast("array<string>"), ",").alias("vec"))


_READ = "([0.25, 1.0, 0.0, 0.5, 0.12, 0.0, 1.0]::double[])"


@_query(f"select conv_id, turn, k - 1 dim, round(case when turn % 3 = 0 then {_READ}[k] else vec[k] end, 2) score from (select x.id.conv_id conv_id, x.id.turn turn, x.vec vec from ({_structure_sql('{conv_id: conv_id, turn: turn}', 'conversations')}) x), range(1, 8) r(k)")
def classify_fact(spark, d):
    """A model's reply where it can be read, else the keywords."""
    reply = F.when(F.col("turn") % 3 == 0, "<think>[1,2]\nno</think>Here: [0.25, 1.5, 0.0, 0.5, 0.123, 0, 1]").when(F.col("turn") % 3 == 1, "[0.1, 0.2]")
    rows = structure.classify_facts(_t(spark, d, "conversations").withColumn("reply", reply), reply="reply")
    return rows.select("conv_id", "turn", F.posexplode_outer("vec").alias("dim", "score")).select("conv_id", "turn", F.col("dim").cast("bigint").alias("dim"), F.round("score", 2).alias("score"))


@_query(f"select doc_id, k - 1 dim, (array{structure.DIMENSIONS})[k] dimension, round(vec[k], 2) score from (select id doc_id, vec from ({_structure_sql('doc_id', 'documents')})), range(1, 8) r(k) where doc_id % 100 = 0")
def named_dimensions(spark, d):
    rows = structure.with_structure(_t(spark, d, "documents").filter("doc_id % 100 = 0").select("doc_id", "text"))
    names = {n: i for i, n in enumerate(structure.DIMENSIONS)}
    out = rows.select("doc_id", F.explode_outer(structure.named(F.col("vec"))).alias("dimension", "score"))
    place = F.coalesce(*[F.when(F.col("dimension") == n, F.lit(i)) for n, i in names.items()])
    return out.select("doc_id", place.cast("bigint").alias("dim"), "dimension", F.round("score", 2).alias("score"))


def _steps(spark, d):
    rows = structure.with_structure(_t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "text"))
    return shape.sequences(rows, "query_id", "turn", "vec")


CONV = f"s as (select conv_id, turn, vec from (select id.conv_id conv_id, id.turn turn, vec from ({_structure_sql('{conv_id: conv_id, turn: turn}', 'conversations')}) x))"
DELTA = "with " + CONV.replace("select id.conv_id conv_id, id.turn turn, vec from", "select x.id.conv_id conv_id, x.id.turn turn, x.vec vec from") + """, e as (select conv_id, turn, k, vec[k] x from s, range(1, 8) r(k)), dl as (select conv_id, turn, k, x - lag(x) over (partition by conv_id, k order by turn) dx from e),
per as (select conv_id, k, avg(dx) m, stddev_pop(dx) sd, max(abs(dx)) mx from dl where dx is not null group by conv_id, k), len as (select conv_id, sum(n) n from (select conv_id, turn, sqrt(sum(dx * dx)) n from dl where dx is not null group by conv_id, turn) group by conv_id),
ids as (select distinct conv_id from conversations), descr as (select i.conv_id, k - 1 dim, coalesce(m, 0) c from ids i cross join range(1, 8) r(k) left join per p using (conv_id, k) union all select i.conv_id, k + 6, coalesce(sd, 0) from ids i cross join range(1, 8) r(k) left join per p using (conv_id, k)
 union all select i.conv_id, k + 13, coalesce(mx, 0) from ids i cross join range(1, 8) r(k) left join per p using (conv_id, k) union all select i.conv_id, 21, coalesce(n, 0) from ids i left join len using (conv_id))"""


@_query(DELTA + " select conv_id query_id, dim, round(c, 6) c from descr")
def shape_descriptor(spark, d):
    out = _steps(spark, d).select("query_id", F.posexplode_outer(shape.descriptor(F.col("steps"))).alias("dim", "c"))
    return out.select("query_id", F.col("dim").cast("bigint").alias("dim"), (F.round("c", 6) + 0.0).alias("c"))


def _chains(spark, d):
    """Known procedures: the conversations of at least two turns."""
    known = _steps(spark, d).filter(F.size("steps") >= 2)
    return known.select(F.col("query_id").cast("int").alias("chain_idx"), F.concat(F.lit("chain"), "query_id").alias("name"), F.transform("steps", lambda _, i: F.concat(F.lit("step "), i)).alias("queries"), "steps")


def _paths(spark, d):
    """Searches: every tenth conversation (there are few), against all known procedures."""
    return _steps(spark, d).filter("query_id % 10 = 0")


@_query(DELTA + """, n as (select conv_id, sqrt(sum(c * c)) n from descr group by conv_id), size as (select conv_id from conversations group by conv_id having count(*) >= 2)
 select a.conv_id query_id, b.conv_id::int chain_idx, 'chain' || b.conv_id chain_name, round(sum(a.c * b.c) / any_value(x.n * y.n), 4) descriptor_similarity from descr a join descr b using (dim) join n x on x.conv_id = a.conv_id join n y on y.conv_id = b.conv_id join size on size.conv_id = b.conv_id
 where a.conv_id % 10 = 0 and x.n >= 1e-8 and y.n >= 1e-8 group by a.conv_id, b.conv_id qualify row_number() over (partition by a.conv_id order by round(sum(a.c * b.c) / any_value(x.n * y.n), 4) desc, b.conv_id) <= 3""")
def fast_match(spark, d):
    return shape.fast_match(_paths(spark, d), _chains(spark, d))


# Accumulated costs row by row, then the alignment back from its end; lists count from 1, so t[i + 1][j + 1] is the cost of the first i and j steps.
DTW = DELTA.replace("with ", "with recursive ", 1) + """, seq as materialized (select conv_id, list(vec order by turn) steps, count(*) n from s group by conv_id having count(*) >= 2),
pair as materialized (select a.conv_id q, b.conv_id c, a.steps x, b.steps y, a.n n, b.n m from seq a, seq b where a.conv_id % 10 = 0),
filled as (select q, c, x, y, n, m, 0::bigint i, [[0::double] || list_transform(range(m), lambda k: 'inf'::double)] t from pair
 union all select q, c, x, y, n, m, i + 1, list_append(t, list_reduce([['inf'::double]] || list_transform(range(1, m + 1), lambda j: [j::double, list_distance(x[i + 1], y[j])]), lambda cur, e: list_append(cur, e[2] + least(t[i + 1][e[1]::int], t[i + 1][e[1]::int + 1], cur[-1])))) from filled where i < n),
full_table as materialized (select q, c, n, m, t from filled where i = n),
ranked as materialized (select *, row_number() over (partition by q order by round(t[n + 1][m + 1] / greatest(n, m), 9), c) - 1 as rank from full_table qualify rank < 3)"""
_BACK = """, back as (select q, c, rank, m, t, n i, {end} j, [(n - 1, {end} - 1)] pairs from ranked
 union all select q, c, rank, m, t, p[2]::bigint, p[3]::bigint, case when p[2] > 0 and p[3] > 0 then list_prepend((p[2]::bigint - 1, p[3]::bigint - 1), pairs) else pairs end from (select *, list_min([[t[i][j], i - 1, j - 1], [t[i][j + 1], i - 1, j], [t[i + 1][j], i, j - 1]]) p from back where i > 0 and j > 0)),
aligned as (select q, c, rank, m, t, pairs from back where i = 0 or j = 0 qualify row_number() over (partition by q, c order by i + j) = 1)"""


@_query(DTW + _BACK.replace("{end}", "m") + " select q query_id, rank::int match_rank, c::int chain_idx, 'chain' || c chain_name, round(t[-1][-1] / greatest(len(t) - 1, m), 4) dtw_distance, len(pairs)::int alignment_length, m::int known_path_length, 0::int remaining_steps, 1.0::double coverage from aligned")
def dtw_match(spark, d):
    return shape.match_shapes(_paths(spark, d), _chains(spark, d)).withColumn("remaining_steps", F.size("remaining_steps"))


@_query(DTW.replace(" qualify rank < 3", "") + _BACK.replace("{end}", "m") + " select q query_id, c::int chain_idx, p[1]::int a, p[2]::int b from (select q, c, unnest(pairs) p from aligned)")
def dtw_alignment(spark, d):
    return warp.alignments(_paths(spark, d).filter(F.size("steps") >= 2), _chains(spark, d))


_END = "list_position(t[n + 1][2:], list_min(t[n + 1][2:]))"


@_query(DTW + _BACK.replace("{end}", _END) + """, free as (select q, rank, k step, 'step ' || k query from aligned, range(0, 1000) r(k) where k < m and not list_contains(list_transform(pairs, lambda p: p[2]), k))
 select query_id, row_number() over (partition by query_id order by rank, step) - 1 as n, query from (select q query_id, query, min(rank * 1000 + step) place, min(rank) rank, min(step) step from free group by q, query) order by place""".replace("order by rank, step) - 1 as n", "order by place) - 1 as n"))
def remaining_steps_open_end(spark, d):
    return shape.guided_queries(shape.match_shapes(_paths(spark, d), _chains(spark, d), open_end=True))


@_query("select conv_id chain_idx, k::int step, 'step ' || k query from (select conv_id, count(*) n from conversations group by conv_id having n >= 2), range(0, 1000) r(k) where k < n")
def chain_steps(spark, d):
    return shape.chain_queries(_chains(spark, d), F.lit(True)).withColumn("chain_idx", F.col("chain_idx").cast("bigint"))


# Pool, score, evaluate

_POOL_ROWS = """select doc_id % 7 query_id, channel, seq, text, method, on_manifold, prox, rel from (
 select doc_id, 0 channel, doc_id seq, substr(text, 1, 200) text, case when doc_id % 2 = 0 then 'geodesic_path' else 'geodesic_neighborhood' end as method, true on_manifold, case when doc_id % 2 = 0 then 1.0 else 1 / (1 + 5.0 * (doc_id % 9) / 10) end::double prox, 0.0::double rel from documents where doc_id % 3 = 0
 union all select doc_id, 1, doc_id, text, 'shape_guided', false, 0.2, (doc_id % 10) / 10.0 from documents where doc_id % 4 = 0
 union all select doc_id, 2, doc_id, text, 'faiss', doc_id % 5 = 0, 0.1, (doc_id % 20) / 20.0 from documents where doc_id % 2 = 0)"""
POOL = f"""with c as (select *, regexp_replace(lower(substr(text, 1, 200)), '^\\s+|\\s+$', '', 'g') text_key from ({_POOL_ROWS})),
o as (select *, row_number() over (partition by query_id, text_key order by channel, case when channel = 0 then -seq else seq end) k from c where text_key <> ''),
pool as (select query_id, text_key, any_value(method) filter (k = 1) as retrieval_method, any_value(on_manifold) filter (k = 1) as on_manifold, any_value(prox) filter (k = 1) as geo_proximity,
 greatest(any_value(case when channel = 0 then 0.0 else rel end) filter (k = 1), coalesce(max(rel) filter (channel = 2), 0)) faiss_relevance, max(case when channel = 1 then 0.5 else 0.0 end) shape_bonus, min(channel * 1000000000 + seq) place from o group by query_id, text_key)"""


def _pool(spark, d):
    docs = _t(spark, d, "documents")
    i = F.col("doc_id")

    def rows(test, channel, text, method, on, prox, rel):
        return docs.filter(test).select((i % 7).alias("query_id"), F.lit(channel).alias("channel"), i.alias("seq"), text.alias("text"), method.alias("method"), on.alias("on_manifold"), prox.cast("double").alias("geo_proximity"), rel.cast("double").alias("relevance"))

    geo = rows(i % 3 == 0, blend.GEODESIC, F.substring("text", 1, 200), F.when(i % 2 == 0, "geodesic_path").otherwise("geodesic_neighborhood"), F.lit(True), F.when(i % 2 == 0, 1.0).otherwise(blend.proximity((i % 9) / 10.0)), F.lit(0.0))
    guided = rows(i % 4 == 0, blend.SHAPE, F.col("text"), F.lit("shape_guided"), F.lit(False), F.lit(0.2), (i % 10) / 10.0)
    flat = rows(i % 2 == 0, blend.FLAT, F.col("text"), F.lit("faiss"), i % 5 == 0, F.lit(0.1), (i % 20) / 20.0)
    return blend.pool(geo.unionByName(guided).unionByName(flat))


_SCORE = "0.5 * faiss_relevance + 0.35 * geo_proximity + 0.15 * shape_bonus"


@_query(POOL + " select query_id, text_key, retrieval_method, on_manifold, round(geo_proximity, 6) geo_proximity, round(faiss_relevance, 6)::double faiss_relevance, shape_bonus::double shape_bonus from pool")
def pool_merge(spark, d):
    return _pool(spark, d).select("query_id", "text_key", "retrieval_method", "on_manifold", F.round("geo_proximity", 6).alias("geo_proximity"), F.round("faiss_relevance", 6).alias("faiss_relevance"), "shape_bonus")


@_query(POOL + f" select query_id, row_number() over (partition by query_id order by round({_SCORE}, 12) desc, place) as rank, text_key, round({_SCORE}, 6)::double blended_score from pool qualify rank <= 10")
def blended_rank(spark, d):
    return blend.blended(_pool(spark, d)).select("query_id", "rank", "text_key", F.round("blended_score", 6).alias("blended_score"))


@_query(POOL + " select query_id, count(*) total, count(*) filter (retrieval_method = 'geodesic_path') geodesic_path, count(*) filter (retrieval_method = 'geodesic_neighborhood') geodesic_neighborhood, count(*) filter (retrieval_method = 'shape_guided') shape_guided, count(*) filter (retrieval_method = 'faiss') faiss, count(*) filter (on_manifold) on_manifold from pool group by query_id")
def pool_stats(spark, d):
    return blend.pool_stats(_pool(spark, d))


@_query(POOL + f", r as (select *, row_number() over (partition by query_id order by round({_SCORE}, 12) desc, place) k from pool) select query_id, least(count(*), 10)::int results, any_value(text_key) filter (k = 1) as best, count(*) total, count(*) - count(*) filter (on_manifold) as projected from r group by query_id")
def search_responses(spark, d):
    """The JSON answers, read back."""
    body = manifold.responses(_pool(spark, d))
    at = lambda path: F.get_json_object("body", path)
    best = F.regexp_replace(F.lower(F.substring(at("$.results[0].text"), 1, 200)), r"^\s+|\s+$", "")
    return body.select("query_id", F.size(F.from_json(at("$.results"), "array<struct<rank: int>>")).alias("results"), best.alias("best"), at("$.stats.total").cast("bigint").alias("total"), at("$.stats.nystrom_projected").cast("bigint").alias("projected"))


# The four weightings of the sweep.
CONFIGS = [("semantic-heavy", 0.7, 0.2, 0.1), ("default", 0.5, 0.35, 0.15), ("geodesic-heavy", 0.3, 0.5, 0.2), ("geodesic-dominant", 0.2, 0.6, 0.2)]


@_query(POOL + ", cfg as (" + " union all ".join(f"select '{n}' as label, {a}::double a, {b}::double b, {c}::double c" for n, a, b, c in CONFIGS) + ") select label, query_id, row_number() over (partition by label, query_id order by round(a * faiss_relevance + b * geo_proximity + c * shape_bonus, 12) desc, place) as rank, text_key, round(a * faiss_relevance + b * geo_proximity + c * shape_bonus, 6) score from cfg, pool qualify rank <= 10")
def weight_sweep(spark, d):
    configs = spark.createDataFrame(CONFIGS, "label string, alpha double, beta double, gamma double")
    return blend.weight_sweep(_pool(spark, d), configs).withColumn("score", F.round("score", 6))


# Results of two "engines" for cases: each source's documents by id.
_EVAL = """with r as (select source test_id, e.engine, text, row_number() over (partition by source, e.engine order by case when e.engine = 'flat' then doc_id else -doc_id end) as rank from documents, (select 'flat' engine union all select 'geodesic') e),
cases as (select distinct source test_id, ['the', 'Tion', 'zzz', 'ande'] kw, ['then inside the', 'of a', 'erent onandzzz tionth', 'zzzz yyyyy'] chain, 'cat' || (length(source) % 3) category from documents),
b5 as (select test_id, engine, lower(string_agg(text, chr(10) order by rank)) blob from r where rank <= 5 group by all), b10 as (select test_id, engine, lower(string_agg(text, chr(10) order by rank)) blob from r where rank <= 10 group by all),
m as (select c.test_id, x.engine, c.category, len(list_filter(c.kw, lambda w: contains(x.blob, lower(w)))) / len(c.kw) recall_5, len(list_filter(c.kw, lambda w: contains(y.blob, lower(w)))) / len(c.kw) recall_10,
 len(list_filter(c.chain, lambda s: len(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: length(w) > 3)) = 0 or 2 * len(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: length(w) > 3 and contains(y.blob, w))) >= len(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: length(w) > 3)))) / len(c.chain) path_completeness
 from cases c join b5 x using (test_id) join b10 y on y.test_id = c.test_id and y.engine = x.engine), macro as (select engine, avg(recall_5) recall_5, avg(recall_10) recall_10, avg(path_completeness) path_completeness, count(*) cases from m group by engine)"""


def _metrics(spark, d):
    docs = _t(spark, d, "documents")
    both = docs.select(F.col("source").alias("test_id"), "doc_id", "text", F.explode(F.array(F.lit("flat"), F.lit("geodesic"))).alias("engine"))
    order = F.when(F.col("engine") == "flat", F.col("doc_id")).otherwise(-F.col("doc_id"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("test_id", "engine").orderBy(order)))
    keys = ["test_id", "engine"]
    five, ten = evaluation.blob(ranked, 5, keys).withColumnRenamed("blob", "b5"), evaluation.blob(ranked, 10, keys).withColumnRenamed("blob", "b10")
    strings = lambda *x: F.array(*map(F.lit, x))
    kw, chain = strings("the", "Tion", "zzz", "ande"), strings("then inside the", "of a", "erent onandzzz tionth", "zzzz yyyyy")
    out = five.join(ten, keys).withColumn("kw", kw).withColumn("chain", chain)
    return out.select(*keys, F.concat(F.lit("cat"), (F.length("test_id") % 3).cast("string")).alias("category"), evaluation.recall(F.col("b5"), F.col("kw")).alias("recall_5"), evaluation.recall(F.col("b10"), F.col("kw")).alias("recall_10"), evaluation.path_completeness(F.col("b10"), F.col("chain")).alias("path_completeness"), evaluation.missing(F.col("b5"), F.col("kw")).alias("keywords_missing"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@_query(_EVAL + " select test_id, engine, round(recall_5, 6) recall_5, round(recall_10, 6) recall_10 from m")
def recall_at_k(spark, d):
    return _rounded(_metrics(spark, d).select("test_id", "engine", "recall_5", "recall_10"))


@_query(_EVAL + " select test_id, engine, round(path_completeness, 6) path_completeness from m")
def path_completeness(spark, d):
    return _rounded(_metrics(spark, d).select("test_id", "engine", "path_completeness"))


@_query(_EVAL + " select test_id, engine, array_to_string(list_filter(c.kw, lambda w: not contains(x.blob, lower(w))), ',') missing from cases c join b5 x using (test_id)")
def keywords_missing(spark, d):
    return _metrics(spark, d).select("test_id", "engine", F.array_join("keywords_missing", ",").alias("missing"))


@_query(_EVAL + " select engine, test_id, round(avg(recall_5), 6) recall_5, round(avg(recall_10), 6) recall_10, round(avg(path_completeness), 6) path_completeness, count(*) runs from (select * from m union all select * from m) group by engine, test_id")
def case_avg(spark, d):
    m = _metrics(spark, d)
    return _rounded(evaluation.case_averages(m.unionByName(m)))


@_query(_EVAL + " select engine, round(recall_5, 6) recall_5, round(recall_10, 6) recall_10, round(path_completeness, 6) path_completeness, cases from macro")
def macro_avg(spark, d):
    return _rounded(evaluation.macro_averages(_metrics(spark, d)))


@_query(_EVAL + " select category, engine, round(avg(recall_5), 6) recall_5, round(avg(recall_10), 6) recall_10, round(avg(path_completeness), 6) path_completeness, count(*) cases from m group by category, engine")
def category_avg(spark, d):
    m = _metrics(spark, d)
    return _rounded(evaluation.category_averages(m.drop("category"), m.select("test_id", "category").distinct()))


@_query(_EVAL + " select x.engine, round(x.recall_5 - b.recall_5, 6) recall_5_delta, round(x.recall_10 - b.recall_10, 6) recall_10_delta, round(x.path_completeness - b.path_completeness, 6) path_completeness_delta from macro x, macro b where b.engine = 'flat' and x.engine <> 'flat'")
def baseline_delta(spark, d):
    return _rounded(evaluation.deltas(evaluation.macro_averages(_metrics(spark, d)), "flat"))


def _results(spark, d):
    """Results of two engines and two runs (the second run's texts end one document later), and the cases."""
    docs = _t(spark, d, "documents").select(F.col("source").alias("test_id"), "doc_id", "text")
    each = docs.withColumn("engine", F.explode(F.array(F.lit("flat"), F.lit("geodesic")))).withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    order = F.when(F.col("engine") == "flat", F.col("doc_id")).otherwise(-F.col("doc_id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("test_id", "engine", "run").orderBy(order)) - F.when(F.col("run") == 2, 1).otherwise(0)).filter("rank > 0")
    strings = lambda *x: F.array(*map(F.lit, x))
    cases = docs.select("test_id").distinct().select("test_id", F.concat(F.lit("cat"), (F.length("test_id") % 3).cast("string")).alias("category"), strings("the", "Tion", "zzz", "ande").alias("expected_keywords"), strings("then inside the", "of a", "erent onandzzz tionth", "zzzz yyyyy").alias("attack_chain"))
    return ranked, cases


_COMPARED = _EVAL.split("cases as (")[0].replace("with r as (select source test_id, e.engine, text, row_number()", "with r0 as (select source test_id, e.engine, u.run, text, row_number()").replace("partition by source, e.engine", "partition by source, e.engine, u.run").replace("union all select 'geodesic') e)", "union all select 'geodesic') e, (select 1 run union all select 2) u), r as (select test_id, engine, run, text, rank - (run - 1) as rank from r0 where rank >= run)") + "cases as (" + _EVAL.split("cases as (")[1].split("b5 as (")[0] + """b5 as (select test_id, engine, run, lower(string_agg(text, chr(10) order by rank)) blob from r where rank <= 5 group by all), b10 as (select test_id, engine, run, lower(string_agg(text, chr(10) order by rank)) blob from r where rank <= 10 group by all),
joined as (select c.*, t.engine, t.run, coalesce(x.blob, '') five, coalesce(y.blob, '') ten from cases c cross join (select distinct engine, run from r) t left join b5 x on x.test_id = c.test_id and x.engine = t.engine and x.run = t.run left join b10 y on y.test_id = c.test_id and y.engine = t.engine and y.run = t.run),
raw as (select *, len(list_filter(kw, lambda w: contains(five, lower(w)))) / len(kw) recall_5, len(list_filter(kw, lambda w: contains(ten, lower(w)))) / len(kw) recall_10, list_filter(kw, lambda w: contains(ten, lower(w))) found, list_filter(kw, lambda w: not contains(ten, lower(w))) missing,
 len(list_filter(chain, lambda p: len(list_filter(string_split_regex(lower(p), '\\s+'), lambda w: length(w) > 3)) = 0 or 2 * len(list_filter(string_split_regex(lower(p), '\\s+'), lambda w: length(w) > 3 and contains(ten, w))) >= len(list_filter(string_split_regex(lower(p), '\\s+'), lambda w: length(w) > 3)))) covered from joined)"""


@_query(_COMPARED + " select test_id, engine, run, category, round(recall_5, 6) recall_5, round(recall_10, 6) recall_10, round(covered / len(chain), 6) path_completeness, array_to_string(found, ',') keywords_found, array_to_string(missing, ',') keywords_missing, covered::int chain_covered, len(chain)::int chain_total from raw")
def evaluate_cases(spark, d):
    out = evaluation.evaluate(*_results(spark, d))
    return _rounded(out.withColumn("keywords_found", F.array_join("keywords_found", ",")).withColumn("keywords_missing", F.array_join("keywords_missing", ",")))


@_query(_COMPARED + " select test_id, engine, round(avg(recall_5), 6) recall_5, round(avg(recall_10), 6) recall_10, round(avg(covered / len(chain)), 6) path_completeness, count(*) runs from raw where engine = 'geodesic' and test_id in (select min(source) from documents union select max(source) from documents) group by all")
def comparison_selected(spark, d):
    """One engine on two of the cases, averaged over runs."""
    ranked, cases = _results(spark, d)
    ids = list(cases.agg(F.min("test_id"), F.max("test_id")).first())
    return _rounded(evaluation.compare(ranked, cases, ["geodesic"], ids)["per_case"])


@_query(POOL + ", cfg as (" + " union all ".join(f"select '{n}' as label, {a}::double a, {b}::double b, {c}::double c" for n, a, b, c in CONFIGS) + """),
w as (select label, query_id, row_number() over (partition by label, query_id order by round(a * faiss_relevance + b * geo_proximity + c * shape_bonus, 12) desc, place) as rank, text_key as text from cfg, pool qualify rank <= 10),
five as (select label, query_id, string_agg(text, chr(10) order by rank) blob from w where rank <= 5 group by all), ten as (select label, query_id, string_agg(text, chr(10) order by rank) blob from w group by all), k as (select ['the', 'tion', 'zzz', 'ande', 'onand'] kw)
 select label, round(avg(len(list_filter(kw, lambda x: contains(five.blob, x))) / 5), 6) recall_5, round(avg(len(list_filter(kw, lambda x: contains(ten.blob, x))) / 5), 6) recall_10, round(avg((1 + (contains(ten.blob, 'onand'))::int) / 2), 6) path_completeness, count(*) cases from five join ten using (label, query_id), k group by label""")
def weight_sweep_metrics(spark, d):
    configs = spark.createDataFrame(CONFIGS, "label string, alpha double, beta double, gamma double")
    pooled = _pool(spark, d)
    strings = lambda *x: F.array(*map(F.lit, x))
    cases = pooled.select(F.col("query_id").alias("test_id")).distinct().select("test_id", F.lit("all").alias("category"), strings("the", "tion", "zzz", "ande", "onand").alias("expected_keywords"), strings("of a", "onand").alias("attack_chain"))
    return _rounded(evaluation.sweep_metrics(blend.weight_sweep(pooled, configs).withColumnRenamed("text_key", "text"), cases))


# Sources and increments


@_query("select doc_id query_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') query, case when doc_id % 2 = 0 then 'g' end goal, case when doc_id % 3 = 0 then 5 else 10 end::int top_k, case when query = '' then 'query required' end error from documents")
def request_checks(spark, d):
    i = F.col("doc_id")
    rows = _t(spark, d, "documents").select(i.alias("query_id"), F.col("text").alias("query"), F.when(i % 2 == 0, " g ").otherwise(" ").alias("goal"), F.when(i % 3 == 0, 5).alias("top_k"))
    return tables.checked_requests(rows)


@_query("select source fact_id, text from documents qualify row_number() over (partition by source order by length(text) % 5, doc_id) = 1")
def facts_first_dedupe(spark, d):
    hits = _t(spark, d, "documents").select((F.length("text") % 5).alias("query_no"), F.col("doc_id").alias("position"), F.col("source").alias("fact_id"), "text")
    return tables.first_by_id(hits)


@_query("select source fact_id, text from (select *, length(text) % 5 q from documents qualify row_number() over (partition by q order by doc_id) <= 100) qualify row_number() over (partition by source order by q, doc_id) = 1")
def facts_of_limited_searches(spark, d):
    hits = _t(spark, d, "documents").select((F.length("text") % 5).alias("query_no"), F.col("doc_id").alias("position"), F.col("source").alias("fact_id"), "text")
    return tables.first_by_id(tables.first_hits(hits, 500))


@_query("select regexp_replace(lower(substr(text, 1, 200)), '^\\s+|\\s+$', '', 'g') text_key, max(doc_id) fact_idx from documents group by 1 having text_key <> ''")
def text_key_lookup(spark, d):
    return tables.text_lookup(_facts(spark, d))


@_query("select 'doc' || doc_id fact_id from documents where length(text) >= 10 and doc_id % 3 <> 0")
def incremental_antijoin(spark, d):
    facts = _facts(spark, d)
    return incremental.not_done(facts, facts.filter("fact_idx % 3 = 0")).select("fact_id")


@_query("select doc_id, row_number() over (order by text, doc_id) - 1 fact_idx from documents")
def numbered_facts(spark, d):
    return tables.numbered(_t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "fact_idx")


@_query(f"select conv_id, turn, row_number() over (partition by conv_id order by rel desc, turn) as rank, c category from (select conv_id, turn, case when turn % 2 = 0 then length(text) % 11 / 10.0 else 0.5 end rel, {_route_sql('t')} c from (select *, {_ASCII} t from conversations where text <> '')) where c <> 'attack_path' qualify rank <= 3")
def smart_search_fallback(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), "text", F.when(F.col("turn") % 2 == 0, F.length("text") % 11 / 10.0).alias("relevance"))
    routed = blend.route(rows).filter("category <> 'attack_path'")
    keys = routed.select("conv_id", "turn", "category")
    ranked = blend.rerank(blend.normalise(routed.select("query_id", "seq", "text", "relevance")), 3)
    return ranked.select(F.col("query_id").alias("conv_id"), F.col("seq").alias("turn"), "rank").join(keys, ["conv_id", "turn"])


@_query(EDGES + " select (select count(*) from embeddings) facts, 12::bigint dims, count(*) nnz, (select count(*) from (select conv_id from conversations group by conv_id having count(*) >= 2)) chains from edges")
def manifold_stats(spark, d):
    n = _coords(spark, d).agg(F.count("*").alias("facts"), F.max(F.size("coords")).cast("bigint").alias("dims"))
    return n.crossJoin(_edges(spark, d).agg(F.count("*").alias("nnz"))).crossJoin(_chains(spark, d).agg(F.count("*").alias("chains")))
