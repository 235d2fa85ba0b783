import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import clusters as CL
from cadenza.operators import kmeans as KM
from cadenza.operators import silhouette as S
from cadenza.operators.silhouette import asked_clusters, silhouette_exact, silhouette_samples


def _sil_brute(x, lab):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = np.zeros(n)
    for i in range(n):
        own = lab == lab[i]
        if own.sum() == 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s[i] = (b - a) / max(a, b)
    return s


def _points(spark, x, lab):
    return spark.createDataFrame(
        [(i, int(l), [float(v) for v in row]) for i, (row, l) in enumerate(zip(x, lab))],
        "song_id bigint, cluster int, embedding array<double>",
    )


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_silhouette_matches_brute_force_with_singleton(spark, block_bytes):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    lab = np.array([0] * 15 + [1] * 15 + [2] * 9 + [3])  # cluster 3 is a singleton
    pts = _points(spark, x, lab)
    exp = _sil_brute(x, lab)
    got = {r["song_id"]: r["s"] for r in silhouette_samples(pts, block_bytes=block_bytes).collect()}
    assert got[39] == 0.0
    assert np.allclose([got[i] for i in range(40)], exp, atol=1e-9)
    score = silhouette_exact(pts, block_bytes=block_bytes).first()["silhouette"]
    assert abs(score - round(exp.mean(), 6)) < 1e-6


def test_bounds_change_nothing_and_leave_far_clusters_out(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(scale=30, size=(12, 4))
    lab = rng.integers(0, 12, 360)
    x = centres[lab] + rng.normal(scale=0.3, size=(360, 4))
    x[:5], lab[:5] = x[0], 0  # one vector several times
    x[200:220] = rng.normal(scale=30, size=(20, 4))  # some points between the clusters
    pts = _points(spark, x, lab)
    plain = {r["song_id"]: r["s"] for r in silhouette_samples(pts, block_bytes=600, bounded=False).collect()}
    got = {r["song_id"]: r["s"] for r in silhouette_samples(pts, block_bytes=600).collect()}
    assert sorted(got) == list(range(360)) and np.allclose([got[i] for i in range(360)], [plain[i] for i in range(360)], atol=1e-9)
    assert np.allclose([got[i] for i in range(360)], _sil_brute(x, lab), atol=1e-9)
    assert asked_clusters(pts).count() < 4 * 360  # of 12 * 360


def test_blocks_meet_once_in_even_tasks():
    sizes = np.array([7000.0, 5000.0, 1.0, 3000.0])
    asked = np.array([[0, 7000, 0, 10], [5000, 0, 3, 0], [1, 0, 0, 0], [0, 3000, 0, 0]], dtype=float)
    grid = S._Grid(sizes, asked, 2048)
    assert grid.joint[0, 1] and grid.joint[1, 0] and not grid.joint[0, 3]  # all of both ask: computed once for both
    met = {}
    for c, n in enumerate(grid.members):
        for block in range(n):
            for task in grid.of_member(c, block):
                met.setdefault(task, []).append((c, block))
    for c, n in enumerate(grid.askers):
        for block in range(n):
            for task in grid.of_asker(c, block):
                met.setdefault(task, []).append(("asks", c, block))
    assert sorted(met) == list(range(grid.tasks))  # every task has its blocks, and no others
    assert all(len(sides) == grid.family(task)[3] for task, sides in met.items())
    assert len({tuple(sorted(map(str, sides))) for sides in met.values()}) == len(met)
    assert sum(grid.family(t)[0] == "own" for t in met) == 4 * 5 // 2 + 3 * 4 // 2 + 2 * 3 // 2


def test_empty_blocks_same_keys_and_no_keys(spark):
    rng = np.random.default_rng(9)
    x, lab = rng.normal(size=(90, 3)), np.repeat([0, 1, 2], 30)
    pts = _points(spark, x, lab).withColumn("song_id", F.when(F.col("song_id") % 10 == 3, F.lit(None)).when(F.col("song_id") % 10 > 5, F.lit(6)).otherwise(F.col("song_id")))
    rows = lambda sums: {(r["key"], r["own"], r["lab"]): r["dsum"] for r in sums.collect()}
    want = rows(S.distance_sums(pts))
    for block_bytes in (24, 24 * 7, 1 << 20):  # one row: most of the rows share few blocks, others are empty
        got = rows(S.bounded_sums(pts, block_bytes=block_bytes))
        assert got and all(abs(v - want[at]) < 1e-6 for at, v in got.items())
        assert {(at[0], at[1]) for at in got} == {(at[0], at[1]) for at in want}


def test_a_block_with_itself_is_computed_in_half():
    x = np.random.default_rng(10).normal(size=(S.TILE_ROWS * 2 + 5, 3))
    keys = np.ma.masked_array(np.arange(len(x)), mask=False)
    want = np.sqrt(np.square(x[:, None] - x[None]).sum(-1)).sum(1)
    assert np.allclose(S._pair_sums(x, keys, x, keys)[0], want)
    both = S._pair_sums(x[:700], keys[:700], x[700:], keys[700:], both=True)
    apart = np.sqrt(np.square(x[:700, None] - x[None, 700:]).sum(-1))
    assert np.allclose(both[0], apart.sum(1)) and np.allclose(both[1], apart.sum(0))


def test_kmeans_invariants(spark):
    rng = np.random.default_rng(5)
    centers = np.array([[0, 0], [10, 0], [0, 10]], dtype=float)
    x = np.vstack([c + rng.normal(scale=0.5, size=(20, 2)) for c in centers])
    pts = _points(spark, x, np.zeros(len(x), dtype=int)).drop("cluster")
    model, cost, costs = KM.fit_best(pts, k=3, n_init=3, seed=42)
    assert cost <= min(costs) + 1e-9
    labelled = KM.relabel_by_min_member(KM.predict(model, pts))
    rows = labelled.collect()
    assert len(rows) == 60 and sorted({r["cluster"] for r in rows}) == [0, 1, 2]
    # relabelled ids follow the smallest member id
    assert {r["song_id"]: r["cluster"] for r in rows}[0] == 0
    # every point is nearest to its own centroid
    lab = np.array([r["cluster"] for r in sorted(rows, key=lambda r: r["song_id"])])
    cent = np.array([x[lab == c].mean(0) for c in range(3)])
    near = np.argmin(((x[:, None, :] - cent[None]) ** 2).sum(-1), axis=1)
    assert (near == lab).all()


def test_kmeans_too_few_points(spark):
    pts = _points(spark, np.eye(2), np.zeros(2, dtype=int)).drop("cluster")
    with pytest.raises(ValueError):
        KM.fit_best(pts, k=3, n_init=1)


def _plain_lloyd(x, c, steps, tol):
    cost = 0.0
    for _ in range(steps):
        d2 = ((x[:, None, :] - c[None]) ** 2).sum(-1)
        at, cost = d2.argmin(1), d2.min(1).sum()
        moved = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        far, c = ((moved - c) ** 2).sum(1).max() > tol * tol, moved
        if not far:
            break
    return c, cost


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("steps", [2, 300])
def test_restarts_moved_together_are_those_moved_alone(spark, kind, steps):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 3)).astype(np.float32).astype(float)
    starts = [x[:4], x[50:54], np.vstack([x[7], x[7] + 900, x[9]])]  # the last has a centre without points, and one fewer
    pts = _points(spark, x, np.zeros(300, dtype=int)).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    centres, costs = KM.lloyd_together(KM._blocks(pts.repartition(5), "embedding", 3), starts, steps, 1e-4)
    for start, centre, cost in zip(starts, centres, costs):
        want, want_cost = _plain_lloyd(x, start, steps, 1e-4)
        assert np.allclose(centre, want, atol=1e-9) and abs(cost - want_cost) < 1e-6


def test_jobs_do_not_grow_with_restarts_times_steps(spark):
    x = np.random.default_rng(12).normal(size=(2000, 2))  # no clusters: many steps
    pts = _points(spark, x, np.zeros(2000, dtype=int)).drop("cluster").cache()
    pts.count()
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    _, cost, costs = KM.fit_best(pts, k=8, n_init=6, max_iter=40, tol=0.0)
    jobs = len(tracker.getJobIdsForGroup()) - before
    assert cost == min(costs) and len(costs) == 6
    assert jobs < 6 * 20 + 40  # alone, each restart has a job for each of its steps


def test_model_of_fewer_vectors_than_clusters(spark):
    pts = _points(spark, np.ones((6, 2)), np.zeros(6, dtype=int)).drop("cluster")
    labelled, model, cost, _ = KM.cluster_points(pts, 3, 2)
    assert len(model.clusterCenters()) == 1 and cost == 0 and {r["cluster"] for r in labelled.collect()} == {0}


def test_assign_nearest_and_inertia(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [10.0, 0.0], [11.0, 0.0]])
    pts = _points(spark, x, np.array([0, 0, 1, 1]))
    cents = CL.centroids(pts)
    got = {r["song_id"]: r["cluster"] for r in CL.assign_nearest(pts, cents).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}
    assert CL.inertia(pts, cents).first()["inertia_exact"] == 1.0


def test_assign_in_centroid_blocks_equals_one_block(spark):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(80, 3)), rng.normal(size=(11, 3))
    c[7] = c[2]  # a tie goes to the lower id, also across blocks
    pts = _points(spark, x, np.zeros(80, dtype=int))
    cents = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "cluster int, centroid array<double>")
    whole = sorted(map(tuple, CL.assign_nearest(pts, cents).collect()))
    parts = sorted(map(tuple, CL.assign_nearest(pts, cents, max_bytes=100).collect()))
    assert whole == parts == [(i, int(np.argmin(((c - r) ** 2).sum(1)))) for i, r in enumerate(x)]


def test_twenty_clusters_are_twenty(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(scale=50, size=(20, 3)), 4, axis=0) + rng.normal(scale=0.01, size=(80, 3))
    labelled, _, _, costs = KM.cluster_points(_points(spark, x, np.zeros(80, dtype=int)).drop("cluster"), 20, 3, 42)
    assert labelled.select("cluster").distinct().count() == 20 and len(costs) == 3


def test_silhouette_needs_two_labels(spark):
    with pytest.raises(ValueError):
        silhouette_exact(_points(spark, np.eye(3), np.zeros(3, dtype=int)))
