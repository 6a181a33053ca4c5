"""Each query on the small tables against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from pathspace.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.01")
FAST = ["batch_cosine_topk", "knn_graph", "symmetric_edges", "normalized_adjacency", "nystrom_project", "geodesic_path", "structure_vectors", "classify_query", "shape_descriptor", "fast_match", "pool_merge", "blended_rank", "weight_sweep", "path_completeness", "macro_avg", "text_key_lookup", "numbered_facts", "geodesic_retrieve_explicit", "retrieve_tangents", "cooccurrence_boost", "classify_fact", "dtw_match", "dtw_alignment", "remaining_steps_open_end", "evaluate_cases", "comparison_selected", "weight_sweep_metrics", "request_checks", "smart_search_fallback"]


def plain(df):
    def cell(x):
        x = x.item() if hasattr(x, "item") else x
        return f"{x + 0.0:.6f}" if isinstance(x, float) else x

    return sorted(repr([cell(x) for x in row]) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, str(DATA)).toPandas()) == plain(duck.execute(ORACLES[name]).df())
