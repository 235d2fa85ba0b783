"""Invariants of the jobs that SQL cannot state."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cadenza.operators import encode as EN
from cadenza.plans import bindings as B
from cadenza.plans.jobs import clamp_run_params, cluster_describe_job, theme_discovery

SF = "/root/testdata/sf0.001"


def test_theme_discovery_run(spark):
    songs = B.songs(spark, SF)
    run = theme_discovery(songs, n_samples=100, n_clusters=3, n_init=2)
    cards = run.cards.orderBy("id").collect()
    assert [c["id"] for c in cards] == [0, 1, 2]
    assert sum(c["song_count"] for c in cards) == run.metrics["total_songs"] == 100
    assert all(c["heading"] == f"Vibe {c['id'] + 1}" for c in cards)
    assert -1.0 <= run.metrics["silhouette_score"] <= 1.0 and run.metrics["inertia"] > 0
    assert set(run.metrics["timings"]) == {"data_loading", "encoding", "clustering", "themes"}
    # terms: at most 100 per cluster, weights in (0, 1], rank 1 has weight 1
    t = run.terms.collect()
    assert all(0 < r["weight"] <= 1 for r in t) and all(r["weight"] == 1.0 for r in t if r["rank"] == 1)


def test_parameters_are_neither_clamped_nor_capped(spark):
    songs = B.songs(spark, SF)
    with pytest.raises(ValueError):
        theme_discovery(songs, n_clusters=1)
    with pytest.raises(ValueError):
        theme_discovery(songs, n_samples=2, n_clusters=3)
    run = theme_discovery(songs, n_samples=60, n_clusters=16, n_init=1, silhouette=None)
    assert run.metrics["total_songs"] == 60 and run.assignments.select("cluster").distinct().count() == 16
    assert clamp_run_params(10, 99) == (100, 15) and clamp_run_params(9999, 1, cap_samples=True) == (5000, 2)


def test_describe_job_tables(spark, tmp_path):
    run = cluster_describe_job(B.songs(spark, SF), str(tmp_path / "out"))
    rows = run.describe.collect()
    assert sum(r["count"] for r in rows) == B.songs(spark, SF).count()
    assert all(r["freq"] <= r["count"] and r["unique"] >= 1 for r in rows)
    assert run.terms.groupBy("cluster").count().agg(F.max("count")).first()[0] <= 200


def test_tfidf_vectors_are_unit(spark):
    enc = EN.tfidf_encode(B.songs(spark, SF), "song_id", "corpus", 256)
    norms = enc.groupBy("song_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n")).collect()
    assert norms and all(abs(r["n"] - 1) < 1e-9 for r in norms)


def test_building_a_query_runs_no_hidden_stages(spark):
    """spread() must not execute the joins below it."""
    for key in ("clean_tokens", "cluster_terms", "cluster_bigrams", "term_counts_antijoin"):
        group = f"build-{key}"
        spark.sparkContext.setJobGroup(group, key)
        E.queries()[key](spark, SF)
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setJobGroup("other", "")
        tables = 2  # reading a schema may be a job of one task
        assert len(ids) <= tables and all(
            spark.sparkContext.statusTracker().getStageInfo(s).numTasks == 1
            for j in ids for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds), key


def test_assign_stream_equals_batch(spark):
    qs = E.queries()
    a = sorted(tuple(r) for r in qs["assign_clusters_stream"](spark, SF).collect())
    b = sorted(tuple(r) for r in qs["assign_clusters"](spark, SF).collect())
    assert a == b and len(a) == B.vectors(spark, SF).count()


def test_throttle_stream_equals_batch(spark):
    qs = E.queries()
    a = sorted(tuple(r) for r in qs["event_throttle_stream"](spark, SF).collect())
    b = sorted(tuple(r) for r in qs["event_throttle"](spark, SF).collect())
    assert a == b


def test_latest_stream_equals_batch(spark):
    qs = E.queries()
    a = sorted(tuple(r) for r in qs["latest_per_session_stream"](spark, SF).collect())
    b = sorted((r.user_id, r.event_id, r.event_type, r.value) for r in qs["latest_per_session"](spark, SF).collect())
    assert a == b
