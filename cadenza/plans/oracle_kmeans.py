"""SQL (DuckDB dialect) of the reproducible clustering and of the jobs on it."""

from __future__ import annotations

from cadenza import constants as K
from cadenza.operators.kmeans_seeded import DRAW_BITS, ROUNDS


def kmeans_ctes(points: str, k: int = K.DEFAULT_CLUSTERS, seed: int = K.SEED, rounds: int = ROUNDS) -> str:
    """CTEs from ``points`` (song_id, e double list) to ``final_centres``
    (cluster, c) and ``labels`` (song_id, cluster), one seed and one Lloyd step
    after another."""

    def clock(step: int, d2: str) -> str:
        draw = f"(('0x' || substr(md5('{seed}:{step}:' || CAST(song_id AS VARCHAR)), 1, {DRAW_BITS // 4}))::BIGINT + 1) / {float(2**DRAW_BITS)!r}"
        return f"-ln({draw}) / {d2}"

    out = [f"seed0 AS MATERIALIZED (SELECT 0 AS cluster, e AS c FROM {points} ORDER BY {clock(0, '1.0')}, song_id LIMIT 1)",
           f"far0 AS MATERIALIZED (SELECT p.song_id, p.e, pow(list_distance(p.e, s.c), 2) AS d2 FROM {points} p, seed0 s)"]
    for i in range(1, k):
        out.append(f"seed{i} AS MATERIALIZED (SELECT {i} AS cluster, e AS c FROM far{i - 1} WHERE d2 > 0 ORDER BY {clock(i, 'd2')}, song_id LIMIT 1)")
        out.append(f"far{i} AS MATERIALIZED (SELECT f.song_id, f.e, least(f.d2, pow(list_distance(f.e, s.c), 2)) AS d2 FROM far{i - 1} f, seed{i} s)")
    out.append("centres0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM seed{i}" for i in range(k)) + ")")

    def near(r: int) -> str:
        return (f"near{r} AS MATERIALIZED (SELECT p.song_id, any_value(p.e) AS e, MIN({{'d': list_distance(p.e, c.c), 'cluster': c.cluster}}).cluster AS cluster "
                f"FROM {points} p, centres{r} c GROUP BY p.song_id)")

    for r in range(rounds):
        out.append(near(r))
        out.append(f"means{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, avg(x) AS m FROM ("
                   f"SELECT cluster, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM near{r}) GROUP BY cluster, i) GROUP BY cluster)")
        out.append(f"centres{r + 1} AS MATERIALIZED (SELECT o.cluster, COALESCE(m.c, o.c) AS c FROM centres{r} o LEFT JOIN means{r} m USING (cluster))")
    out.append(near(rounds))
    out.append(f"final_centres AS (SELECT * FROM centres{rounds})")
    out.append(f"ranked_clusters AS (SELECT cluster AS old, CAST(row_number() OVER (ORDER BY MIN(song_id)) - 1 AS INTEGER) AS cluster FROM near{rounds} GROUP BY cluster)")
    out.append(f"labels AS MATERIALIZED (SELECT n.song_id, r.cluster, n.e FROM near{rounds} n JOIN ranked_clusters r ON r.old = n.cluster)")
    return ",\n".join(out)


def minibatch_sql(with_points: str, batch_rows: int, steps: int, k: int = K.DEFAULT_CLUSTERS, seed: int = K.SEED) -> str:
    """Labels of the mini-batch clustering, step by step from the same seeds."""
    ctes = kmeans_ctes("points", k, seed, rounds=0).split(",\nnear0 AS")[0]
    out = [ctes, f"parts AS (SELECT greatest(1, CAST(ceil(COUNT(*) / {float(batch_rows)!r}) AS BIGINT)) AS m FROM points)",
           "state0 AS MATERIALIZED (SELECT cluster, c, 0 AS seen FROM centres0)"]
    near = ("near{r} AS MATERIALIZED (SELECT p.song_id, any_value(p.e) AS e, MIN({{'d': list_distance(p.e, c.c), 'cluster': c.cluster}}).cluster AS cluster "
            "FROM {src} p, state{r} c GROUP BY p.song_id)")
    for r in range(steps):
        draw = f"('0x' || substr(md5('{seed}:batch:{r}:' || CAST(song_id AS VARCHAR)), 1, 8))::BIGINT % m = 0"
        out.append(near.format(r=r, src=f"(SELECT song_id, e FROM points, parts WHERE {draw})"))
        out.append(f"sums{r} AS (SELECT cluster, list(m ORDER BY i) AS c, any_value(n) AS n FROM (SELECT cluster, i, avg(x) AS m, COUNT(*) AS n FROM ("
                   f"SELECT cluster, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM near{r}) GROUP BY cluster, i) GROUP BY cluster)")
        moved = "list_transform(list_zip(o.c, s.c), lambda z: z[1] + (z[2] - z[1]) * (s.n / (o.seen + s.n)))"
        out.append(f"state{r + 1} AS MATERIALIZED (SELECT o.cluster, CASE WHEN s.n IS NULL THEN o.c ELSE {moved} END AS c, o.seen + COALESCE(s.n, 0) AS seen "
                   f"FROM state{r} o LEFT JOIN sums{r} s USING (cluster))")
    out.append(near.format(r=steps, src="points"))
    out.append(f"ranked AS (SELECT cluster AS old, CAST(row_number() OVER (ORDER BY MIN(song_id)) - 1 AS INTEGER) AS cluster FROM near{steps} GROUP BY cluster)")
    return f"{with_points},\n" + ",\n".join(out) + f"\nSELECT n.song_id, r.cluster FROM near{steps} n JOIN ranked r ON r.old = n.cluster"


def dense_hash_ctes(src: str, text: str, hash_long: str, dim: int) -> str:
    """``points`` from the long-form hash encoding ``h`` of a table's texts."""
    return f"""{hash_long},
points AS MATERIALIZED (SELECT s.song_id, list(COALESCE(h.weight, 0.0) ORDER BY d.dim) AS e
  FROM {src} s CROSS JOIN (SELECT CAST(range AS INTEGER) AS dim FROM range({dim})) d LEFT JOIN h ON h.id = s.song_id AND h.dim = d.dim
  GROUP BY s.song_id)"""


SILHOUETTE = """sizes AS (SELECT cluster, COUNT(*) AS n FROM labels GROUP BY cluster),
pair_sums AS (SELECT a.song_id, a.cluster AS own, b.cluster AS other, SUM(list_distance(a.e, b.e)) AS s FROM labels a, labels b GROUP BY ALL),
per_point AS (SELECT p.song_id, any_value(o.n) AS n_own, MAX(CASE WHEN own = other AND o.n > 1 THEN s / (o.n - 1) END) AS a,
                     MIN(CASE WHEN own <> other THEN s / z.n END) AS b
              FROM pair_sums p JOIN sizes o ON o.cluster = p.own JOIN sizes z ON z.cluster = p.other GROUP BY p.song_id),
scored AS (SELECT CASE WHEN n_own <= 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM per_point)"""
