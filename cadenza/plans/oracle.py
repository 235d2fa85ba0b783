"""Independent SQL (DuckDB dialect) for every oracle-checkable query.

Each statement starts from the raw test tables (pre-registered views) and
re-derives the bindings itself, so it shares no code path with the Spark
side except the fixed word lists.
"""

from __future__ import annotations

from cadenza import constants as K
from cadenza.functions.text import offline_stopwords
from cadenza.operators.kmeans_seeded import ROUNDS
from cadenza.plans.bindings import with_ctes
from cadenza.plans.oracle_kmeans import SILHOUETTE, dense_hash_ctes, kmeans_ctes, minibatch_sql


def _lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + "]"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words)) + ")"


THEME_STOP = _lst(K.THEME_STOPWORDS_LISTED)
TRACK = K.TRACK_URL_PREFIX


WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"  # what Python's split() and strip() call whitespace


def TOKS(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '{WS}'), lambda w: w <> '')"


def KEPT(x: str) -> str:
    return (rf"list_filter({TOKS(x)}, lambda w: length(w) > 2 AND regexp_full_match(w, '\p{{L}}+') "
            rf"AND NOT list_contains({THEME_STOP}, w))")


def NK(x: str) -> str:
    return rf"lower(regexp_replace({x}, '^{WS}|{WS}$', '', 'g'))"


def MD5KEY(x: str) -> str:
    return f"md5('{K.SEED}:' || CAST({x} AS VARCHAR))"


CENT = """cent AS (
  SELECT cluster, list(m ORDER BY i) AS centroid FROM (
    SELECT cluster, i, avg(x) AS m FROM (
      SELECT cluster, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM vectors)
    GROUP BY cluster, i)
  GROUP BY cluster)"""


def HASH_LONG(name: str, src: str, id_col: str, text_col: str, dim: int = 64) -> str:
    return f"""{name}_t AS (
  SELECT {id_col} AS id, unnest({TOKS(text_col)}) AS w FROM {src}),
{name}_c AS (
  SELECT id, CAST((('0x' || substr(md5(w), 1, 7))::BIGINT) % {dim} AS INTEGER) AS dim, COUNT(*)::DOUBLE AS c
  FROM {name}_t GROUP BY ALL),
{name} AS (
  SELECT id, dim, c / sqrt(SUM(c * c) OVER (PARTITION BY id)) AS weight FROM {name}_c)"""


VALID = rf"""v AS (
  SELECT *,
    CASE WHEN COALESCE(mode, 'lyrics') = 'lyrics' THEN 'lyrics' ELSE 'song' END AS eff_mode,
    CASE WHEN COALESCE(mode, 'lyrics') = 'lyrics'
         THEN CASE WHEN lyrics IS NULL OR length(regexp_replace(lyrics, '^{WS}|{WS}$', '', 'g')) < {K.MIN_REQUEST_CHARS}
                   THEN 'too_short' ELSE 'ok' END
         ELSE CASE WHEN COALESCE(song_name, '') = '' OR COALESCE(artist_name, '') = ''
                   THEN 'missing_song_fields' ELSE 'ok' END
    END AS status
  FROM requests)"""

REJECTED = (f"CASE status WHEN 'too_short' THEN '{K.TOO_SHORT_MESSAGE.format(K.MIN_REQUEST_CHARS)}' "
            f"WHEN 'missing_song_fields' THEN '{K.MISSING_FIELDS_MESSAGE}' END")


def NOT_FOUND(t: str) -> str:
    before, between, after = K.NOT_FOUND_MESSAGE.split("%s")
    return f"'{before}' || {t}.song_name || '{between}' || {t}.artist_name || '{after}'"


FIRST_SONG = f"""first_song AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {NK('song_title')}, {NK('artist_name')} ORDER BY song_id) AS r
                 FROM songs) WHERE r = 1)"""

HITS = f"""hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {NK('title')}, {NK('artist')} ORDER BY track_id) AS r
                 FROM catalogue) WHERE r = 1)"""

INPUTS = f"""inputs AS (
  SELECT request_id, lyrics AS input_text FROM v WHERE eff_mode = 'lyrics' AND status = 'ok'
  UNION ALL
  SELECT q.request_id, f.corpus AS input_text FROM v q
  JOIN first_song f ON {NK('f.song_title')} = {NK('q.song_name')} AND {NK('f.artist_name')} = {NK('q.artist_name')}
  WHERE q.eff_mode = 'song' AND q.status = 'ok')"""

RANKED = f"""{VALID},
{FIRST_SONG},
{INPUTS},
{HASH_LONG('qh', 'inputs', 'request_id', 'input_text')},
{HASH_LONG('sh', 'songs', 'song_id', 'corpus')},
sims AS (
  SELECT qh.id AS request_id, sh.id AS song_id, round(SUM(qh.weight * sh.weight), 12) AS sim
  FROM qh JOIN sh USING (dim) GROUP BY ALL),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, song_id) AS rank FROM sims)
  WHERE rank <= {K.PLAYLIST_SIZE}),
playlist AS (
  SELECT r.request_id, CAST(r.rank AS INTEGER) AS rank, r.song_id, s.song_title AS song_name, s.artist_name, r.sim
  FROM ranked r LEFT JOIN songs s USING (song_id))"""

ENRICHED = f"""{HITS},
enriched AS (
  SELECT p.*,
    CASE WHEN p.rank <= {K.ENRICHED_ROWS} AND h.track_id IS NOT NULL THEN '{TRACK}' || h.track_id END AS track_url,
    CASE WHEN p.rank <= {K.ENRICHED_ROWS} THEN h.first_image END AS album_art,
    CASE WHEN p.rank <= {K.ENRICHED_ROWS} THEN h.preview_url END AS preview_url
  FROM playlist p LEFT JOIN hits h ON {NK('h.title')} = {NK('p.song_name')} AND {NK('h.artist')} = {NK('p.artist_name')})"""

EVENTS_RANKED = """er AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"""


def _throttle_sql(delta: float) -> str:
    cond = f"(e.event_type <> t.ls OR abs(e.value - t.lp) >= {delta})"
    return f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (
  SELECT user_id, rn, event_id, event_type, value, event_type AS ls, value AS lp, TRUE AS emit FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.event_type, e.value,
         CASE WHEN {cond} THEN e.event_type ELSE t.ls END,
         CASE WHEN {cond} THEN e.value ELSE t.lp END,
         {cond}
  FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
SELECT user_id, event_id, event_type, value FROM t WHERE emit"""


def _feed_sql(delta: float, limit_s: int) -> str:
    cond = f"(e.event_type <> t.ls OR abs(e.value - t.lp) >= {delta})"
    return f"""WITH RECURSIVE fs AS (SELECT user_id, MIN(ts) AS first_ts FROM events GROUP BY user_id),
seen AS (SELECT ev.* FROM events ev JOIN fs USING (user_id)
         WHERE ev.ts < fs.first_ts + INTERVAL {limit_s} SECOND),
term AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS t_id, MIN(ts) AS t_ts
         FROM seen WHERE event_type = '{K.TERMINAL_STEP}' GROUP BY user_id),
bef AS (SELECT s.* FROM seen s LEFT JOIN term USING (user_id)
        WHERE term.t_id IS NULL OR s.ts < term.t_ts OR (s.ts = term.t_ts AND s.event_id < term.t_id)),
e AS (SELECT user_id, event_id, event_type, value,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM bef),
t AS (
  SELECT user_id, rn, event_id, event_type, value, event_type AS ls, value AS lp, TRUE AS emit FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.event_type, e.value,
         CASE WHEN {cond} THEN e.event_type ELSE t.ls END,
         CASE WHEN {cond} THEN e.value ELSE t.lp END,
         {cond}
  FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)
SELECT user_id, 'running' AS status, event_id, event_type, value FROM t WHERE emit
UNION ALL
SELECT s.user_id, 'completed', s.event_id, s.event_type, s.value FROM seen s JOIN term ON term.t_id = s.event_id
UNION ALL
SELECT user_id, 'timeout', NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE FROM fs
WHERE user_id NOT IN (SELECT user_id FROM term)"""


def _silhouette_sql(dist: str) -> str:
    return f"""{with_ctes('vectors')},
p AS (SELECT song_id AS id, cluster AS c, embedding::DOUBLE[] AS e FROM vectors),
sz AS (SELECT c, COUNT(*) AS n FROM p GROUP BY c),
d AS (SELECT a.id, a.c AS own, b.c AS oc, SUM({dist}) AS s FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
per AS (
  SELECT d.id, d.own,
         MAX(CASE WHEN d.oc = d.own THEN d.s / (sz.n - 1) END) AS a,
         MIN(CASE WHEN d.oc <> d.own THEN d.s / sz.n END) AS b
  FROM d JOIN sz ON sz.c = d.oc GROUP BY ALL),
ss AS (
  SELECT per.id,
         CASE WHEN so.n <= 1 THEN 0.0 WHEN b IS NULL OR greatest(a, b) = 0 THEN 0.0
              ELSE (b - a) / greatest(a, b) END AS s
  FROM per JOIN sz so ON so.c = per.own)
SELECT COUNT(*) AS n_points, ROUND(AVG(s), 6) AS silhouette FROM ss"""


def oracle_sql() -> dict[str, str]:
    offline = _in(offline_stopwords())
    q: dict[str, str] = {}

    q["load_songs"] = f"{with_ctes('songs')} SELECT song_id, artist_name, song_title, corpus, song_url FROM songs"

    q["load_songs_csv"] = q["load_songs"]

    q["eligible_songs"] = f"""{with_ctes('songs')}
SELECT song_id, song_title, artist_name, CAST(length(corpus) AS BIGINT) AS n_chars
FROM songs WHERE corpus IS NOT NULL AND length(corpus) > {K.MIN_CORPUS_CHARS}"""

    q["sample_songs"] = f"""{with_ctes('songs')}
SELECT song_id, song_title, artist_name FROM songs
WHERE corpus IS NOT NULL AND length(corpus) > {K.MIN_CORPUS_CHARS}
ORDER BY {MD5KEY('song_id')}, song_id LIMIT {K.DEFAULT_SAMPLES}"""

    q["sample_merged"] = q["sample_songs"].replace("SELECT song_id, song_title, artist_name FROM", "SELECT song_id FROM")

    q["load_embeddings"] = f"""{with_ctes('vectors')}
SELECT COUNT(*) AS n_rows, COUNT(DISTINCT song_id) AS n_keys,
       CAST(MIN(len(embedding)) AS INTEGER) AS min_dim, CAST(MAX(len(embedding)) AS INTEGER) AS max_dim,
       ROUND(MIN(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS min_norm,
       ROUND(MAX(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS max_norm
FROM vectors"""

    q["join_embeddings"] = f"""{with_ctes('songs', 'vectors')}
SELECT v.song_id, v.cluster, CAST(len(v.embedding) AS INTEGER) AS dim, s.song_title, s.artist_name
FROM vectors v JOIN songs s USING (song_id)"""

    q["scan_clustered"] = f"""{with_ctes('clustered')}
SELECT song_id, song_title, artist_name, song_url FROM clustered WHERE cluster = 3"""

    q["sink_roundtrip"] = f"""{with_ctes('clustered')}
SELECT cluster, COUNT(*) AS n, CAST(SUM(song_id) AS BIGINT) AS sum_id, MIN(song_title) AS min_title
FROM clustered GROUP BY cluster"""

    q["run_summary"] = f"""{with_ctes('songs', 'vectors')}
SELECT (SELECT COUNT(*) FROM songs) AS total_songs,
       (SELECT COUNT(*) FROM vectors) AS corpus_size,
       (SELECT CAST(MAX(len(embedding)) AS INTEGER) FROM vectors) AS embedding_dimensions,
       (SELECT COUNT(DISTINCT cluster) FROM vectors) AS n_clusters"""

    q["cosine_scores"] = f"""{with_ctes('vectors')}, {CENT}
SELECT v.song_id, v.cluster,
       ROUND(CASE WHEN list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) = 0
                    OR list_dot_product(c.centroid, c.centroid) = 0 THEN 0.0
                  ELSE list_cosine_similarity(v.embedding::DOUBLE[], c.centroid) END, 6) AS cosine
FROM vectors v JOIN cent c USING (cluster)"""

    q["pairwise_euclidean"] = f"""{with_ctes('vectors')}, {CENT}
SELECT v.song_id, v.cluster, ROUND(list_distance(v.embedding::DOUBLE[], c.centroid), 6) AS distance
FROM vectors v JOIN cent c USING (cluster)"""

    q["parse_cluster_id"] = """
SELECT event_id, file_name,
       TRY_CAST(string_split(split_part(file_name, '.', 1), '_')[-1] AS INTEGER) AS cluster_id
FROM (SELECT event_id,
        CASE event_type
          WHEN 'view' THEN 'demo_cluster_' || json_extract_string(props, '$.k') || '.png'
          WHEN 'click' THEN 'cluster_' || json_extract_string(props, '$.k') || '.png'
          WHEN 'error' THEN 'x.png'
          ELSE event_type || '_cluster' || json_extract_string(props, '$.k') || '.jpg' END AS file_name
      FROM events)"""

    q["first_image"] = f"{with_ctes('catalogue')} SELECT track_id, first_image AS album_art FROM catalogue"

    q["parse_json_props"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"

    q["clean_tokens"] = f"""{with_ctes('songs')}
SELECT song_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(kept) AS BIGINT) AS n_kept,
       array_to_string(kept, ' ') AS clean_text
FROM (SELECT song_id, {TOKS('corpus')} AS t, {KEPT('corpus')} AS kept FROM songs)"""

    q["clean_corpus"] = rf"""{with_ctes('songs')}
SELECT song_id,
       array_to_string(list_filter(regexp_split_to_array(corpus, '{WS}'),
                                   lambda w: w <> '' AND lower(w) NOT IN {offline}), ' ') AS corpus_clean
FROM songs WHERE corpus IS NOT NULL"""

    q["stopword_union"] = f"""{with_ctes('songs')}
SELECT word, COUNT(*) AS n FROM (SELECT unnest({TOKS('corpus')}) AS word FROM songs)
WHERE word IN {offline} GROUP BY word"""

    q["cluster_terms"] = f"""{with_ctes('clustered')},
toks AS (SELECT cluster, unnest({KEPT('corpus')}) AS term FROM clustered),
counts AS (SELECT cluster, term, COUNT(*) AS n FROM toks GROUP BY ALL),
keep AS (SELECT cluster FROM counts GROUP BY cluster HAVING SUM(length(term) * n) + SUM(n) - 1 >= {K.MIN_THEME_CHARS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS rank FROM counts)
SELECT cluster, CAST(rank AS INTEGER) AS rank, term, n,
       ROUND(CAST(n AS DOUBLE) / MAX(n) OVER (PARTITION BY cluster), 6) AS weight
FROM ranked WHERE rank <= {K.THEME_TERMS} AND cluster IN (SELECT cluster FROM keep)"""

    q["cluster_terms_sketched"] = q["cluster_terms"]

    q["song_numbers"] = f"""{with_ctes('songs')}
SELECT song_id, song_title, row_number() OVER (ORDER BY song_id) - 1 AS row_number FROM songs
WHERE corpus IS NOT NULL AND length(corpus) > {K.MIN_CORPUS_CHARS}"""

    def TEXT(x: str) -> str:
        return f"array_to_string(list_filter(regexp_split_to_array(lower({x}), '{WS}'), lambda w: w <> ''), ' ')"

    grams = "list_distinct(list_transform(range(1, length(text) + 1), lambda i: substr(' ' || text || ' ', i, 3)))"
    q["song_search"] = f"""{with_ctes('requests', 'catalogue')},
asked AS (SELECT request_id, {TEXT("concat_ws('  ', upper(replace(song_name, 'song_', 'sng ')), artist_name)")} AS text FROM requests),
given AS (SELECT text, MIN(track_id) AS track_id, {grams} AS b FROM (SELECT track_id, {TEXT("concat_ws(' ', title, artist)")} AS text FROM catalogue) GROUP BY text),
wanted AS (SELECT DISTINCT text, {grams} AS a FROM asked),
scored AS (SELECT w.text, track_id, len(list_intersect(a, b)) AS shared, len(a) + len(b) - len(list_intersect(a, b)) AS n FROM wanted w, given),
best AS (SELECT text, track_id, shared / n AS similarity, row_number() OVER (PARTITION BY text ORDER BY shared / n DESC, track_id) AS r
         FROM scored WHERE 100 * shared >= 50 * n)
SELECT request_id, b.text IS NOT NULL AS found, track_id, ROUND(similarity, 6) AS similarity FROM asked a LEFT JOIN best b ON b.text = a.text AND r = 1"""

    def T(o, r, c):
        return f"(CASE WHEN {o} > 0 THEN {o} * ln({o} / ({r} * {c} / nn)) ELSE 0.0 END)"

    g2 = (f"2.0 * ({T('o11', '(o11 + o12)', '(o11 + o21)')} + {T('o12', '(o11 + o12)', '(o12 + o22)')}"
          f" + {T('o21', '(o21 + o22)', '(o11 + o21)')} + {T('o22', '(o21 + o22)', '(o12 + o22)')})")
    q["cluster_bigrams"] = f"""{with_ctes('clustered')},
toks AS (SELECT cluster, {KEPT('corpus')} AS t FROM clustered),
pairs AS (SELECT cluster, t[i] AS w1, t[i + 1] AS w2
          FROM (SELECT cluster, t, unnest(range(1, len(t))) AS i FROM toks)),
n12 AS (SELECT cluster, w1, w2, COUNT(*) AS n FROM pairs GROUP BY ALL),
f AS (SELECT cluster, w1, COUNT(*) AS n1 FROM pairs GROUP BY ALL),
s AS (SELECT cluster, w2, COUNT(*) AS n2 FROM pairs GROUP BY ALL),
tot AS (SELECT cluster, COUNT(*) AS nn0 FROM pairs GROUP BY ALL),
tab AS (
  SELECT n12.cluster, n12.w1, n12.w2, n12.n,
         CAST(n12.n AS DOUBLE) AS o11, CAST(f.n1 - n12.n AS DOUBLE) AS o12,
         CAST(s.n2 - n12.n AS DOUBLE) AS o21, CAST(tot.nn0 - f.n1 - s.n2 + n12.n AS DOUBLE) AS o22,
         CAST(tot.nn0 AS DOUBLE) AS nn
  FROM n12 JOIN f USING (cluster, w1) JOIN s USING (cluster, w2) JOIN tot USING (cluster)),
sc AS (SELECT cluster, w1 || ' ' || w2 AS bigram, n, ROUND({g2}, 6) AS g2 FROM tab),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY g2 DESC, bigram) AS rank FROM sc)
SELECT cluster, CAST(rank AS INTEGER) AS rank, bigram, n, g2 FROM rk WHERE rank <= {K.THEME_TERMS}"""

    q["term_counts_antijoin"] = rf"""{with_ctes('songs')}
SELECT term, COUNT(*) AS n
FROM (SELECT unnest(list_filter({TOKS('corpus')}, lambda w: length(w) > 2 AND regexp_full_match(w, '\p{{L}}+'))) AS term
      FROM songs)
WHERE term NOT IN {_in(K.THEME_STOPWORDS_LISTED)} GROUP BY term"""

    q["cluster_distribution"] = f"""{with_ctes('clustered')}
SELECT cluster, COUNT(*) AS n_songs FROM clustered GROUP BY cluster"""

    q["cluster_artist_describe"] = f"""{with_ctes('clustered')},
pv AS (SELECT cluster, artist_name, COUNT(*) AS freq FROM clustered WHERE artist_name IS NOT NULL GROUP BY ALL)
SELECT cluster, CAST(SUM(freq) AS BIGINT) AS "count", COUNT(*) AS "unique",
       first(artist_name ORDER BY freq DESC, artist_name) AS top, MAX(freq) AS freq
FROM pv GROUP BY cluster"""

    q["songs_by_cluster"] = f"""{with_ctes('clustered')}
SELECT song_id, COALESCE(song_title, '{K.UNKNOWN_NAME}') AS song_title, COALESCE(artist_name, '{K.UNKNOWN_NAME}') AS artist_name,
       COALESCE(song_url, '') AS song_url, cluster, row_number() OVER (PARTITION BY cluster ORDER BY song_id) AS pos
FROM clustered"""

    q["cluster_samples"] = f"""{with_ctes('clustered')}
SELECT cluster, CAST(pos AS INTEGER) AS pos, song_id, song_title
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY song_id) AS pos FROM clustered)
WHERE pos <= {K.SAMPLE_SONGS_PER_CARD}"""

    q["cluster_cards"] = f"""{with_ctes('clustered')},
ids AS (SELECT CAST(range AS INTEGER) AS cluster FROM range(12)),
cnt AS (SELECT cluster, COUNT(*) AS n FROM clustered GROUP BY cluster),
fs AS (SELECT cluster, list(song_title ORDER BY pos) AS titles
       FROM (SELECT cluster, song_title, row_number() OVER (PARTITION BY cluster ORDER BY song_id) AS pos FROM clustered)
       WHERE pos <= {K.SAMPLE_SONGS_PER_CARD} GROUP BY cluster)
SELECT i.cluster AS id, CAST(COALESCE(cnt.n, 0) AS BIGINT) AS song_count,
       'Vibe ' || CAST(i.cluster + 1 AS VARCHAR) AS heading,
       CAST(COALESCE(cnt.n, 0) AS VARCHAR) || ' songs' AS badge,
       array_to_string(COALESCE(fs.titles[1:2], []::VARCHAR[]), ', ') || '...' AS subtitle,
       array_to_string(COALESCE(fs.titles, []::VARCHAR[]), ' | ') AS sample_titles
FROM ids i LEFT JOIN cnt USING (cluster) LEFT JOIN fs USING (cluster)"""

    q["cluster_songs"] = f"""{with_ctes('clustered')}
SELECT song_id, song_title, artist_name, song_url FROM clustered WHERE cluster = 3"""

    q["cluster_lookup"] = f"""{with_ctes('vectors')},
stored AS (SELECT d.lang AS run_id, v.cluster, v.song_id FROM documents d JOIN vectors v ON v.song_id = d.doc_id),
runs AS (SELECT DISTINCT run_id FROM stored),
sizes AS (SELECT run_id, cluster, COUNT(*) AS n_songs FROM stored GROUP BY ALL),
req AS (SELECT event_id,
          CASE event_type WHEN 'view' THEN 'en' WHEN 'click' THEN 'fr' WHEN 'signup' THEN 'de'
                          WHEN 'error' THEN 'es' ELSE 'none' END AS session_id,
          CAST(floor(value / 25) AS INTEGER) AS cluster_id
        FROM events)
SELECT r.event_id, r.session_id, r.cluster_id,
       CASE WHEN ru.run_id IS NULL THEN 'session_not_found'
            WHEN r.cluster_id < 0 OR r.cluster_id >= 12 THEN 'cluster_not_found'
            WHEN s.n_songs IS NULL THEN 'empty_cluster' ELSE 'ok' END AS status,
       CAST(COALESCE(s.n_songs, 0) AS BIGINT) AS n_songs
FROM req r LEFT JOIN runs ru ON ru.run_id = r.session_id
LEFT JOIN sizes s ON s.run_id = r.session_id AND s.cluster = r.cluster_id"""

    q["random_song_per_cluster"] = f"""{with_ctes('clustered')}
SELECT cluster, song_id, song_title, artist_name
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {MD5KEY('song_id')}, song_id) AS r FROM clustered)
WHERE r = 1"""

    q["first_playable"] = f"""{with_ctes('clustered', 'catalogue')}, {HITS},
drawn AS (SELECT * FROM (SELECT cluster, song_id, song_title, artist_name,
                           row_number() OVER (PARTITION BY cluster ORDER BY {MD5KEY('song_id')}, song_id) AS draw
                         FROM clustered) WHERE draw <= 3),
found AS (SELECT d.*, h.track_id FROM drawn d
          JOIN hits h ON {NK('h.title')} = {NK('d.song_title')} AND {NK('h.artist')} = {NK('d.artist_name')}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY draw) AS rr FROM found) WHERE rr = 1),
cl AS (SELECT DISTINCT cluster FROM clustered)
SELECT cl.cluster, CASE WHEN b.track_id IS NOT NULL THEN 'found' ELSE 'not_found' END AS status,
       CAST(b.draw AS INTEGER) AS draw, b.song_id, b.song_title, b.artist_name, b.track_id
FROM cl LEFT JOIN best b USING (cluster)"""

    q["inertia"] = f"""{with_ctes('vectors')},
pts AS (SELECT song_id, cluster, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM vectors),
cm AS (SELECT cluster, i, avg(x) AS m FROM pts GROUP BY ALL)
SELECT ROUND(SUM((x - m) * (x - m)), 2) AS inertia, ROUND(SUM((x - m) * (x - m)), 6) AS inertia_exact
FROM pts JOIN cm USING (cluster, i)"""

    q["silhouette"] = _silhouette_sql("list_distance(a.e, b.e)")
    q["silhouette_squared"] = _silhouette_sql("list_distance(a.e, b.e) * list_distance(a.e, b.e)")

    assigned = f"""{with_ctes('vectors')}, {CENT},
dd AS (SELECT v.song_id, c.cluster, list_distance(v.embedding::DOUBLE[], c.centroid) AS dist FROM vectors v, cent c),
assigned AS (SELECT song_id, cluster FROM
  (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY dist, cluster) AS r FROM dd) WHERE r = 1)"""
    q["assign_clusters"] = f"{assigned} SELECT song_id, cluster FROM assigned"
    q["kmeans_lloyd_step"] = f"""{assigned},
px AS (SELECT a.cluster, unnest(range(0, len(v.embedding))) AS dim, unnest(v.embedding)::DOUBLE AS x
       FROM assigned a JOIN vectors v USING (song_id))
SELECT cluster, CAST(dim AS INTEGER) AS dim, ROUND(AVG(x), 6) AS value FROM px GROUP BY ALL"""

    q["encode_hash"] = f"""{with_ctes('songs')}, {HASH_LONG('h', 'songs', 'song_id', 'corpus')}
SELECT id AS song_id, dim, ROUND(weight, 6) AS weight FROM h"""

    q["recommend_text"] = f"""{with_ctes('songs', 'requests')},
lq AS (SELECT * FROM requests WHERE mode = 'lyrics'),
{HASH_LONG('qh', 'lq', 'request_id', 'lyrics')},
{HASH_LONG('sh', 'songs', 'song_id', 'corpus')},
sims AS (SELECT qh.id AS request_id, sh.id AS song_id, round(SUM(qh.weight * sh.weight), 12) AS sim
         FROM qh JOIN sh USING (dim) GROUP BY ALL)
SELECT request_id, CAST(rank AS INTEGER) AS rank, song_id, ROUND(sim, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, song_id) AS rank FROM sims)
WHERE rank <= {K.PLAYLIST_SIZE}"""

    q["validate_requests"] = f"""{with_ctes('requests')}, {VALID}
SELECT request_id, eff_mode, status,
       {REJECTED} AS error
FROM v"""

    q["resolve_song_requests"] = f"""{with_ctes('songs', 'requests')}, {VALID}, {FIRST_SONG}
SELECT q.request_id, CASE WHEN f.song_id IS NOT NULL THEN 'ok' ELSE 'not_found' END AS status,
       CASE WHEN f.song_id IS NULL THEN {NOT_FOUND('q')} END AS error, f.song_id
FROM v q LEFT JOIN first_song f
  ON {NK('f.song_title')} = {NK('q.song_name')} AND {NK('f.artist_name')} = {NK('q.artist_name')}
WHERE q.eff_mode = 'song' AND q.status = 'ok'"""

    q["playlist_top20"] = f"""{with_ctes('songs', 'vectors')},
qv AS (SELECT embedding::DOUBLE[] AS e FROM vectors WHERE song_id = 0),
sims AS (SELECT v.song_id,
           round(CASE WHEN list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) = 0
                        OR list_dot_product(qv.e, qv.e) = 0 THEN 0.0
                      ELSE list_cosine_similarity(qv.e, v.embedding::DOUBLE[]) END, 12) AS sim
         FROM vectors v, qv)
SELECT CAST(rank AS INTEGER) AS rank, song_id, s.song_title AS song_name, s.artist_name, ROUND(sim, 6) AS similarity
FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, song_id) AS rank FROM sims) r
LEFT JOIN songs s USING (song_id) WHERE rank <= {K.PLAYLIST_SIZE}"""

    q["playlist_topk"] = f"""{with_ctes('songs', 'requests')}, {RANKED}
SELECT request_id, rank, song_id, song_name, artist_name, ROUND(sim, 6) AS similarity FROM playlist"""

    q["playlist_indexed"] = q["playlist_topk"]

    q["enrich_topk"] = f"""{with_ctes('songs', 'requests', 'catalogue')}, {RANKED}, {ENRICHED}
SELECT request_id, rank, song_id, track_url, album_art, preview_url FROM enriched"""

    q["playlist_summary"] = f"""{with_ctes('songs', 'requests')}, {RANKED}
SELECT i.request_id, CAST(length(i.input_text) AS INTEGER) AS input_length, 64 AS embedding_dimensions,
       (SELECT COUNT(*) FROM songs) AS corpus_size, 'hash-bow-64' AS model,
       ROUND(COALESCE(MAX(p.sim), 0.0), 6) AS top_similarity,
       ROUND(COALESCE(AVG(p.sim), 0.0), 6) AS avg_similarity
FROM inputs i LEFT JOIN playlist p USING (request_id)
GROUP BY i.request_id, i.input_text"""

    q["track_lookup"] = f"""{with_ctes('songs', 'catalogue')}, {HITS}
SELECT s.song_id, 'track:' || s.song_title || ' artist:' || s.artist_name AS search_key,
       h.track_id IS NOT NULL AS found, h.track_id,
       CASE WHEN h.track_id IS NOT NULL THEN '{TRACK}' || h.track_id END AS track_url,
       h.first_image AS album_art, h.preview_url
FROM songs s LEFT JOIN hits h ON {NK('h.title')} = {NK('s.song_title')} AND {NK('h.artist')} = {NK('s.artist_name')}"""

    q["recommend_requests"] = f"""{with_ctes('songs', 'requests', 'catalogue')}, {RANKED}, {ENRICHED},
unresolved AS (
  SELECT q.request_id, {NOT_FOUND('q')} AS error FROM v q LEFT JOIN first_song f
    ON {NK('f.song_title')} = {NK('q.song_name')} AND {NK('f.artist_name')} = {NK('q.artist_name')}
  WHERE q.eff_mode = 'song' AND q.status = 'ok' AND f.song_id IS NULL)
SELECT request_id, 'ok' AS status, NULL::VARCHAR AS error, rank, song_id, song_name, artist_name, ROUND(sim, 6) AS similarity,
       track_url, album_art, preview_url FROM enriched
UNION ALL
SELECT request_id, status, {REJECTED}, NULL::INTEGER, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE,
       NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM v WHERE status <> 'ok'
UNION ALL
SELECT request_id, 'not_found', error, NULL::INTEGER, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE,
       NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM unresolved"""

    q["recommend_indexed"] = q["playlist_summary"]

    parsed = """parsed AS (
  SELECT request_id, COALESCE(mode, 'lyrics') AS mode, COALESCE(lyrics, '') AS lyrics,
         COALESCE(song_name, '') AS song_name, COALESCE(artist_name, '') AS artist_name FROM requests)"""
    q["parse_requests"] = f"""{with_ctes('requests')}, {parsed}, {VALID.replace('FROM requests', 'FROM parsed')}
SELECT request_id, mode, md5(lyrics) AS lyrics_md5, song_name, artist_name, eff_mode, status FROM v"""

    forms = f"""forms AS (
  SELECT request_id, CASE WHEN mode = 'song' THEN 'song' ELSE 'lyrics' END AS mode,
         CASE WHEN mode = 'song' THEN NULL WHEN lyrics = '{K.NO_INPUT}' THEN NULL ELSE lyrics END AS lyrics,
         song_name, artist_name FROM requests)"""
    q["form_requests"] = f"""{with_ctes('songs', 'requests')}, {forms},
{VALID.replace('FROM requests', 'FROM forms')}, {FIRST_SONG}
SELECT request_id, status, {REJECTED} AS error, CASE WHEN status = 'ok' THEN length(lyrics) END AS n_chars
FROM v WHERE NOT (eff_mode = 'song' AND status = 'ok')
UNION ALL
SELECT q.request_id, CASE WHEN f.song_id IS NULL THEN 'not_found' ELSE 'ok' END,
       CASE WHEN f.song_id IS NULL THEN {NOT_FOUND('q')} END, length(f.corpus)
FROM v q LEFT JOIN first_song f
  ON {NK('f.song_title')} = {NK('q.song_name')} AND {NK('f.artist_name')} = {NK('q.artist_name')}
WHERE q.eff_mode = 'song' AND q.status = 'ok'"""

    q["latest_per_session"] = f"""WITH {EVENTS_RANKED}
SELECT user_id, event_id, epoch_us(ts) AS ts_us, event_type, value FROM er WHERE r = 1"""

    q["session_status"] = f"""WITH {EVENTS_RANKED},
req AS (SELECT CAST(c_custkey AS BIGINT) AS session_id FROM customer),
done AS (SELECT user_id, MIN(ts) AS result_ts FROM events WHERE event_type = '{K.TERMINAL_STEP}' GROUP BY user_id),
latest AS (SELECT user_id, event_id, event_type, value FROM er WHERE r = 1)
SELECT q.session_id,
       CASE WHEN d.result_ts IS NOT NULL THEN 'completed' WHEN l.event_id IS NOT NULL THEN 'running'
            ELSE 'not_found' END AS status,
       CASE WHEN d.result_ts IS NULL AND l.event_id IS NOT NULL THEN l.event_type END AS step,
       CASE WHEN d.result_ts IS NULL AND l.event_id IS NOT NULL THEN l.value END AS progress
FROM req q LEFT JOIN done d ON d.user_id = q.session_id LEFT JOIN latest l ON l.user_id = q.session_id"""

    q["session_timeout"] = f"""
SELECT user_id, epoch_us(MIN(ts)) AS first_us,
       epoch_us(MIN(CASE WHEN event_type = '{K.TERMINAL_STEP}' THEN ts END)) AS terminal_us,
       CASE WHEN MIN(CASE WHEN event_type = '{K.TERMINAL_STEP}' THEN ts END) IS NOT NULL
             AND epoch_us(MIN(CASE WHEN event_type = '{K.TERMINAL_STEP}' THEN ts END)) - epoch_us(MIN(ts))
                 < {K.STREAM_TIMEOUT_SECONDS * 1_000_000}
            THEN 'completed' ELSE 'timeout' END AS status
FROM events GROUP BY user_id"""

    q["stage_timings"] = """WITH per AS (SELECT user_id, event_type AS stage, SUM(value) AS seconds FROM events GROUP BY ALL),
tot AS (SELECT user_id, SUM(value) AS total FROM events GROUP BY user_id)
SELECT per.user_id, stage, ROUND(seconds, 6) AS seconds, ROUND(total, 6) AS total_seconds
FROM per JOIN tot USING (user_id)"""

    q["event_throttle"] = _throttle_sql(K.THROTTLE_DELTA)
    q["event_throttle_wide"] = _throttle_sql(100.0)
    q["event_throttle_one_run"] = f"""WITH seq AS (SELECT list({{'v': value, 'ids': [event_id]}} ORDER BY ts, event_id) AS l FROM events),
emitted AS (SELECT unnest(list_reduce(l, lambda acc, x: CASE WHEN abs(x.v - acc.v) >= {K.THROTTLE_DELTA}
              THEN {{'v': x.v, 'ids': list_concat(acc.ids, x.ids)}} ELSE acc END).ids) AS event_id FROM seq)
SELECT event_id, value FROM events JOIN emitted USING (event_id)"""
    q["session_feed"] = _feed_sql(K.THROTTLE_DELTA, K.STREAM_TIMEOUT_SECONDS)
    q["session_feed_day"] = _feed_sql(K.THROTTLE_DELTA, 86400)
    q["progress_json"] = f"""WITH feed AS ({_feed_sql(K.THROTTLE_DELTA, 86400)})
SELECT user_id, status,
       'data: ' || CASE WHEN event_id IS NULL THEN json_object('status', status)::VARCHAR
                        ELSE to_json({{'status': status, 'event_id': event_id, 'event_type': event_type,
                                       'value': value}})::VARCHAR END AS payload
FROM feed"""
    q["event_throttle_stream"] = q["event_throttle"]
    q["session_feed_stream"] = q["session_feed_day"]
    q["event_throttle_late"] = q["event_throttle"]
    q["session_feed_late"] = q["session_feed_day"]
    q["latest_per_session_stream"] = f"""WITH {EVENTS_RANKED}
SELECT user_id, event_id, event_type, value FROM er WHERE r = 1"""
    q["assign_clusters_stream"] = q["assign_clusters"]

    q["encode_tfidf"] = f"""{with_ctes('songs')},
w AS (SELECT song_id, unnest({TOKS('corpus')}) AS w FROM songs),
tf AS (SELECT song_id, CAST((('0x' || substr(md5(w), 1, 7))::BIGINT) % 4096 AS INTEGER) AS dim, COUNT(*) AS tf FROM w GROUP BY ALL),
x AS (SELECT song_id, dim, tf * ln(((SELECT COUNT(*) FROM songs) + 1) / (COUNT(*) OVER (PARTITION BY dim) + 1)) AS x FROM tf)
SELECT song_id, dim, ROUND(x / sqrt(SUM(x * x) OVER (PARTITION BY song_id)), 6) AS weight FROM x QUALIFY x <> 0"""

    # the seeded clustering, step by step
    eligible_songs = f"eligible AS (SELECT * FROM songs WHERE corpus IS NOT NULL AND length(corpus) > {K.MIN_CORPUS_CHARS})"
    theme = f"""{with_ctes('songs')}, {eligible_songs},
{dense_hash_ctes('eligible', 'corpus', HASH_LONG('h', 'eligible', 'song_id', 'corpus'), 64)},
{kmeans_ctes('points')},
clustered AS (SELECT s.*, l.cluster FROM eligible s JOIN labels l USING (song_id))"""
    described = f"""{with_ctes('songs')},
based AS (SELECT song_id, artist_name, array_to_string(list_filter(list_filter(regexp_split_to_array(corpus, '{WS}'), lambda w: w <> ''),
            lambda w: lower(w) NOT IN {offline}), ' ') AS corpus_clean FROM songs WHERE corpus IS NOT NULL),
{dense_hash_ctes('based', 'corpus_clean', HASH_LONG('h', 'based', 'song_id', 'corpus_clean'), 64)},
{kmeans_ctes('points')},
clustered AS (SELECT s.song_id, s.artist_name, s.corpus_clean AS corpus, l.cluster FROM based s JOIN labels l USING (song_id))"""
    own_ctes = with_ctes('clustered')

    def over(query: str, ctes: str) -> str:
        assert q[query].startswith(own_ctes)
        return ctes + q[query][len(own_ctes):]

    q["kmeans_labels"] = f"""{with_ctes('vectors')}, points AS (SELECT song_id, embedding::DOUBLE[] AS e FROM vectors),
{kmeans_ctes('points')} SELECT song_id, cluster FROM labels"""
    vector_points = f"{with_ctes('vectors')}, points AS (SELECT song_id, embedding::DOUBLE[] AS e FROM vectors)"
    q["cluster_minibatch"] = minibatch_sql(vector_points, 200, 10)
    q["playlist_stream"] = q["playlist_topk"]
    q["theme_labels"] = f"{theme} SELECT song_id, cluster FROM labels"
    q["theme_cluster_terms"] = over("cluster_terms", theme)
    best_terms = q["theme_cluster_terms"][len(theme):]
    ctes, _, select = best_terms.rpartition("\nSELECT cluster, CAST(rank")
    cards = over("cluster_cards", theme + ctes).replace("range(12)", f"range({K.DEFAULT_CLUSTERS})")
    q["theme_cards"] = cards.replace("AS sample_titles", "AS sample_titles, top.top_terms").replace(
        "LEFT JOIN fs USING (cluster)", "LEFT JOIN fs USING (cluster) LEFT JOIN (SELECT cluster, string_agg(term, ' ' ORDER BY rank) AS top_terms "
        f"FROM (SELECT cluster, CAST(rank{select}) WHERE rank <= 10 GROUP BY cluster) top USING (cluster)")
    q["theme_scores"] = f"""{theme}, {SILHOUETTE},
spread AS (SELECT SUM(pow(list_distance(l.e, c.c), 2)) AS inertia FROM near{ROUNDS} l JOIN final_centres c USING (cluster))
SELECT (SELECT COUNT(*) FROM eligible) AS total_songs, (SELECT ROUND(inertia, 2) FROM spread) AS inertia, ROUND(AVG(s), 4) AS silhouette_score FROM scored"""
    q["describe_clusters"] = over("cluster_artist_describe", described)
    q["describe_cluster_terms"] = over("cluster_terms", described).replace(f"rank <= {K.THEME_TERMS}", f"rank <= {K.OFFLINE_TERMS}")

    # MLlib's clusterings: labels are not SQL, what holds whatever the labels is
    k = K.DEFAULT_CLUSTERS
    q["cluster_pluggable"] = f"SELECT COUNT(*) AS n_points, {k}::BIGINT AS n_labels, 0::BIGINT AS n_out_of_order FROM embeddings"
    q["kmeans_fit"] = q["cluster_pluggable"].replace(" FROM", ", 0::BIGINT AS n_misplaced FROM")
    q["cluster_corpus"] = q["kmeans_fit"].replace("FROM embeddings", "FROM documents")
    eligible = f"corpus IS NOT NULL AND length(corpus) > {K.MIN_CORPUS_CHARS}"
    q["theme_discovery"] = f"""{with_ctes('songs')}
SELECT {k}::BIGINT AS n_cards, COUNT(*) AS total_songs, 0::BIGINT AS n_without_terms FROM songs WHERE {eligible}"""
    q["theme_metrics"] = f"""{with_ctes('songs')}
SELECT COUNT(*) AS total_songs, {k}::INTEGER AS n_clusters, 64::INTEGER AS embedding_dimensions, 'hash-bow-64' AS model_used,
       'clustering,data_loading,encoding,themes' AS stages, TRUE AS in_range FROM songs WHERE {eligible}"""
    q["theme_terms"] = f"""{with_ctes('songs')}
SELECT term, COUNT(*) AS n FROM (SELECT unnest({KEPT('corpus')}) AS term FROM songs WHERE {eligible}) GROUP BY term"""
    q["theme_assignments"] = f"""{with_ctes('songs')}
SELECT artist_name, COUNT(*) AS n_songs FROM songs WHERE {eligible} GROUP BY artist_name"""
    q["cluster_describe_job"] = f"""{with_ctes('songs')}
SELECT {k}::BIGINT AS n_clusters, COUNT(artist_name) AS n_songs FROM songs WHERE corpus IS NOT NULL"""
    q["describe_terms"] = f"""{with_ctes('songs')}
SELECT term, COUNT(*) AS n FROM (
  SELECT unnest(list_filter({KEPT('corpus')}, lambda w: w NOT IN {offline})) AS term FROM songs WHERE corpus IS NOT NULL)
GROUP BY term"""
    return q
