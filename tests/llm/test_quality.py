"""Importance resampling: accuracy on labels, exact top-k, edge cases."""

import math

from paperloom.llm.quality import Plan, kth_largest, resample
from paperloom.llm.queries import op9_quality_resampling

FOLDER = "/root/testdata/sf0.01"


def test_query_keeps_good_and_drops_bad(spark):
    rows = {r.doc_id: r for r in op9_quality_resampling(spark, FOLDER).collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_toxic_documents_get_no_room_and_clean_ones_stay(spark):
    rows = {r.doc_id: r.kept for r in op9_quality_resampling(spark, FOLDER).collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    clean = [rows[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    toxic = [rows[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 1]
    assert sum(rows.values()) == round(len(clean) / len(labels) * len(rows))
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(toxic) <= 0.9 * len(toxic)


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = labels.filter("quality = 1 and toxic = 0 and doc_id % 2 = 0")
    rows = {r.doc_id: r.log_weight for r in resample(docs, seen, 500).collect()}
    unseen = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.doc_id % 2]
    good = [w for w, q in unseen if q]
    bad = [w for w, q in unseen if not q]
    wins = sum(g > b for g in good for b in bad)
    assert wins >= 0.95 * len(good) * len(bad)


def test_exactly_k_and_noise_is_standard(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('w', id % 7) as text")
    none = docs.select("doc_id").limit(0)
    rows = resample(docs, none, 321, Plan(scale=0.0)).collect()
    order = sorted(rows, key=lambda r: -r.sample_key)
    assert [r.kept for r in order] == [True] * 321 + [False] * (2000 - 321)
    mean = sum(r.sample_key for r in rows) / len(rows)
    assert abs(mean - 0.5772) < 0.1


def test_kth_largest_with_ties(spark):
    frame = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 1, 9, -3, 1e9, 5]], "x double")
    want = [1e9, 9, 5, 5, 1, 1, 1, -3]
    assert [kth_largest(frame, "x", k) for k in range(1, 9)] == want
    assert kth_largest(frame, "x", 9) is None and kth_largest(frame, "x", 0) is None


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "a b"), (5, "x y " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "true as target", "1 as kept")
    ids = spark.createDataFrame([(4,), (4,), (None,), (77,)], "doc_id long")
    got = resample(docs, ids, 3).collect()
    assert len(got) == len(rows)
    assert all(r.log_weight == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(math.isfinite(r.sample_key) for r in got)
    assert len({r.sample_key for r in got if r.doc_id == 4}) == 1
    assert sum(r.kept for r in got) in (3, 4)
    assert not any(r.kept for r in resample(docs, ids, 0).collect())
    assert all(r.kept for r in resample(docs, ids, 99).collect())
    assert resample(docs.limit(0), ids, 3).count() == 0
    assert resample(docs, ids.limit(0), 3).count() == len(rows)
