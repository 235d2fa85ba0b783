import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.vectors import cosine
from cadenza.operators.topk import topk_cosine


def _brute(q, c, k):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    s = np.round(unit(q) @ unit(c).T, 12)
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k]
        out[i] = [(j, s[i, j]) for j in order]
    return out


def _frames(spark, q, c):
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "request_id bigint, embedding array<double>")
    cdf = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(c)], "song_id bigint, embedding array<double>")
    return qdf, cdf


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 200}, {"max_broadcast_bytes": 300}])
def test_topk_equals_brute_force_with_ties(spark, limits):
    rng = np.random.default_rng(7)
    c = rng.normal(size=(60, 8))
    c[10] = c[3]          # exact duplicates -> tied scores, tie-break by id
    c[11] = c[3] * 2.0    # same direction, different norm -> tie too
    c[20] = 0.0           # zero vector scores 0
    q = rng.normal(size=(7, 8))
    q[6] = 0.0            # zero query: every score 0, ids ascending
    qdf, cdf = _frames(spark, q, c)
    got = topk_cosine(qdf, cdf, 5, **limits).collect()
    exp = _brute(q, c, 5)
    by_q = {}
    for r in got:
        by_q.setdefault(r["request_id"], []).append((r["rank"], r["song_id"], r["similarity"]))
    for i, rows in by_q.items():
        rows.sort()
        assert [s for _, s, _ in rows] == [j for j, _ in exp[i]]
        assert np.allclose([v for _, _, v in rows], [v for _, v in exp[i]])
    assert sorted(by_q) == list(range(7))


def test_topk_k_larger_than_corpus(spark):
    rng = np.random.default_rng(1)
    qdf, cdf = _frames(spark, rng.normal(size=(2, 4)), rng.normal(size=(3, 4)))
    assert topk_cosine(qdf, cdf, 20).count() == 6


def test_cosine_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(cosine("a", "b")).first()[0] == 0.0


def test_running_topk_keeps_k_per_query_whatever_ties():
    from cadenza.operators.topk import RunningTopK

    rng = np.random.default_rng(2)
    best = RunningTopK(4, 5)
    ids = rng.permutation(600)
    scores = np.round(rng.integers(0, 4, size=(600, 4)) / 3.0, 12)
    scores[:, 3] = 0.0  # a zero vector ties with everything
    for at in range(0, 600, 100):
        order = at + np.argsort(ids[at:at + 100])
        best.add(0, scores[order, :2], ids[order])
        best.add(2, scores[order, 2:], ids[order])
    q, found, got = best.rows()
    assert len(q) == 20
    for i in range(4):
        want = sorted(zip(-scores[:, i], ids))[:5]
        assert [(-s, j) for s, j in zip(got[q == i], found[q == i])] == [(s, j) for s, j in want]


def test_topk_rejects_mixed_and_null_vectors(spark):
    qdf, cdf = _frames(spark, [[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]])
    mixed = qdf.unionByName(spark.createDataFrame([(9, [1.0])], qdf.schema))
    null = qdf.unionByName(spark.createDataFrame([(9, None)], qdf.schema))
    for bad in (mixed, null):
        with pytest.raises(ValueError):
            topk_cosine(bad, cdf, 2)
    # lengths whose total agrees must not pass unnoticed
    skew = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], cdf.schema)
    with pytest.raises(Exception, match="2 dimensions"):
        topk_cosine(qdf, skew, 2).collect()
    assert topk_cosine(qdf.limit(0), cdf, 2).collect() == []


@pytest.mark.parametrize("limits", [{"part_bytes": 2000}, {"part_bytes": 1 << 20}, {"part_bytes": 2000, "block_bytes": 64}])
def test_a_grid_of_parts_equals_brute_force(spark, limits):
    rng = np.random.default_rng(8)
    c = rng.normal(size=(300, 8))
    c[40:140] = c[3]  # more copies than k
    c[20] = c[21] = 0.0
    q = np.vstack([rng.normal(size=(30, 8)), c[3:4], np.zeros((1, 8))])
    qdf, cdf = _frames(spark, q, c)
    got = {}
    for r in topk_cosine(qdf, cdf, 5, scan_bytes=0, **limits).collect():
        got.setdefault(r["request_id"], []).append((r["rank"], r["song_id"], r["similarity"]))
    exp = _brute(q, c, 5)
    assert sorted(got) == list(range(len(q)))
    for i, rows in got.items():
        assert [(n, j) for n, j, _ in sorted(rows)] == [(n + 1, j) for n, (j, _) in enumerate(exp[i])]
        assert np.allclose([s for _, _, s in sorted(rows)], [s for _, s in exp[i]])


def test_a_task_of_the_grid_holds_candidates_of_its_own_queries_only(spark):
    """What many queries send on does not grow with the tasks that the corpus is read in."""
    rng = np.random.default_rng(9)
    qdf, cdf = _frames(spark, rng.normal(size=(50, 4)), rng.normal(size=(400, 4)))
    from cadenza.operators import topk as T

    q = qdf.toDF("qkey", "qvec")
    c = cdf.toDF("ckey", "cvec").repartition(16)
    assert T._grid(q, c, 3, 50, 4, 1 << 20, 1 << 20).count() == 50


def test_enrichment_ranks_once(spark, tmp_path, monkeypatch):
    from cadenza.plans import catalog as CT

    ran = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    schema = "request_id long, rank int, song_id long, song_name string, artist_name string, similarity double"
    ranked = spark.createDataFrame([(1, 1, 5, "a", "b", 0.5), (1, 11, 6, "c", "d", 0.4)], schema).mapInArrow(counted, schema)
    tracks = spark.createDataFrame([("t5", "A", "b ", [], None)], "track_id string, title string, artist string, images array<struct<url:string>>, preview_url string")
    monkeypatch.setattr(CT, "_ranked", lambda *_: ranked)
    monkeypatch.setattr(CT.B, "catalogue", lambda *_: tracks)
    assert len(CT.q_enrich_topk(spark, "").collect()) == 2 and ran.value == 2
