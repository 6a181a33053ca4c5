"""The pipeline's stages on small tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    df = docs
    for name, stage in pipeline.STAGES:
        df = pipeline.stored(stage(spark, df, DATA), name)
        seen[name] = df
        if name != "packing":
            assert df.columns == docs.columns
    n = [seen[k].count() for k in ("quality_rules", "toxicity", "near_duplicates", "pii")]
    assert n[0] >= n[1] >= n[2] == n[3] > 0
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.filter("quality = 1 and toxic = 0").select("doc_id")
    clean = docs.join(good, "doc_id", "left_semi").count()
    assert seen["toxicity"].join(good, "doc_id", "left_semi").count() >= 0.85 * clean
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == {r.doc_id for r in seen["pii"].collect()}


def test_near_duplicates_keeps_one_row_per_component(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (None, text("c")), (None, text("d")), (None, text("d")), (2, text("a") + " more"), (2, text("e")), (3, text("f")), (4, text("f").upper()), (None, text("f")), (5, ""), (5, ""), (6, None), (6, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = pipeline.near_duplicates(spark, docs, DATA)
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (2, text("e")), (3, text("f")), (5, ""), (6, None), (None, ""), (None, "")]
    by = lambda x: (str(x[0]), str(x[1]))
    assert got.columns == docs.columns and sorted([(r.doc_id, r.text) for r in got.collect()], key=by) == sorted(want, key=by)


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Null, empty and repeated rows, ids that are null or equal, and a column whose name clashes with the operators' own."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None, 0, "x"), (1, "", 0, "x"), (None, "Write to a.b@mail.example.org and stay", 38, "x"), (None, None, None, "x"), (2, long, len(long), "y"), (2, long, len(long), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cls string")
    for name, stage in pipeline.STAGES:
        none = stage(spark, docs.limit(0), DATA)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
    assert pipeline.quality_rules(spark, docs, DATA).filter("text is null or text = ''").count() == 0
    kept = pipeline.toxicity(spark, docs, DATA).collect()
    assert len(kept) == len(rows)
    near = pipeline.near_duplicates(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in near) == [(0, 0), (0, 38), (1, 0), (1, 0), (2, len(long))]
    changed = {(r.doc_id, r.cls, r.n_chars, r.text) for r in pipeline.pii(spark, docs, DATA).collect()}
    mail = next(t for i, _, _, t in changed if t and "@" in t)
    assert "a.b@" not in mail and all(n == (None if t is None else len(t)) for _, _, n, t in changed) and len(changed) == 5
    packed = pipeline.packing(spark, docs, DATA).toPandas()
    assert len(packed) >= 8 and packed.doc_id.isna().sum() == 2 and packed.sequence_id.nunique() <= 1 + packed.length.sum() // 1024
