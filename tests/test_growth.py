"""Steps whose work must grow no faster than their input."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import encode as EN
from cadenza.operators import heavy_hitters as HH
from cadenza.operators import song_search as SS
from cadenza.operators import themes as TH
from cadenza.operators import vector_index as VI
from cadenza.operators.topk import RunningTopK, topk_cosine
from test_vectors_topk import _frames


def _counted(spark, df):
    """``df`` with a count of the rows that are made of it, however often."""
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(pass_on, df.schema), made


def test_index_and_search_encode_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    qdf, cdf = _frames(spark, rng.normal(size=(40, 6)), rng.normal(size=(300, 6)))
    corpus, made = _counted(spark, cdf)
    index = VI.build_vector_index(corpus, f"{tmp_path}/i")
    assert made.value == 300
    queries, asked = _counted(spark, qdf)
    got, _ = VI.search(index, queries, 5, max_broadcast_bytes=8 << 10)
    rows = lambda df: sorted(map(tuple, df.select("request_id", "rank", "song_id", "similarity").collect()))
    assert rows(got) == rows(topk_cosine(qdf, cdf, 5)) and asked.value == 40


def test_best_rows_keep_nothing_below_what_is_known():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    every, some = RunningTopK(5, 10), RunningTopK(5, 10, np.full(5, 0.5))
    for best in (every, some):
        best.score(slice(None), x[:5], x, np.arange(200))
    taken = lambda best: {(int(q), int(i)): s for q, i, s in zip(*best.rows())}
    assert taken(some) == {at: s for at, s in taken(every).items() if s >= 0.5}


def _plan(spark, df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tfidf_moves_packed_counts_only_and_merges_rows_of_an_id(spark):
    words = ["rain", "sun", "wind", "snow", "fog"]
    texts = [(None if i % 7 == 0 else i // 3, None if i % 11 == 5 else " ".join(words[(i * j) % 5] for j in range(i % 6))) for i in range(60)]
    df = spark.createDataFrame(texts, "id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # an id goes on from batch to batch
    try:
        got = EN.tfidf_encode(df, "id", "text", 64)
        assert "Exchange" not in _plan(spark, got)  # weights need no other rows
        rows = {(r["id"], r["dim"]): r["weight"] for r in got.collect()}
        assert got.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tf = Counter((i, int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 64) for i, t in texts for w in (t or "").split())
    holders = Counter(d for _, d in tf)
    w = {at: n * np.log((len(texts) + 1) / (holders[at[1]] + 1)) for at, n in tf.items()}
    norm = {i: np.sqrt(sum(x * x for (j, _), x in w.items() if j == i)) for i, _ in w}
    assert rows.keys() == {at for at, x in w.items() if x} and all(abs(x - w[at] / norm[at[0]]) < 1e-9 for at, x in rows.items())


def test_sketched_terms_read_the_texts_once(spark):
    df = spark.createDataFrame([(i, i % 3, " ".join(f"w{chr(97 + (i * j) % 13)}x" for j in range(30))) for i in range(90)], "song_id long, cluster int, corpus string")
    counted, made = _counted(spark, df)
    got, full = HH.top_terms(counted, 5, capacity=4)
    rows = lambda t: sorted(map(tuple, t.collect()))
    assert rows(got) == rows(TH.cluster_terms(df, 5)) and made.value == 90 and full  # counted in full, too


def test_song_search_looks_at_what_may_follow_a_shared_trigram(spark):
    draw = np.random.default_rng(8)
    text = lambda: "".join(draw.choice(list("abc "), 9))
    songs, asked = [(f"t{i}", text(), None) for i in range(60)], [(i, text()) for i in range(40)]
    grams = lambda t: {f" {t} "[i:i + 3] for i in range(len(t))}
    clean = lambda t: " ".join(t.lower().split())
    for percent in (30, 50, 80):
        got = SS.search_songs(spark.createDataFrame(asked, "request_id long, text string"), spark.createDataFrame(songs, "track_id string, title string, artist string"),
                              min_percent=percent)
        assert "place" in SS._prefixes(spark.createDataFrame([("a", ["a"])], "text string, tokens array<string>"),
                                       spark.createDataFrame([("a", 1)], "token string, df long"), percent).columns
        found = {r["request_id"]: (r["track_id"], r["similarity"]) for r in got.collect()}
        for i, t in asked:
            a, best = grams(clean(t)), (None, None)
            for track, title, _ in songs:
                b = grams(clean(title))
                s = len(a & b) / len(a | b) if a | b else 0.0
                if a and 100 * s >= percent and (best[0] is None or (-s, track) < (-best[1], best[0])):
                    best = track, s
            assert found[i] == best


def _odd_texts(spark):
    draw = np.random.default_rng(1)
    parts = ["love", "Über", "İstanbul", "ΣΑΣ", "don't", "a1b", "the", "it", "日本語", "rain-drop", "ab", "abc", "_abc", "𝒜𝒷𝒸"]
    parts += [chr(c) for c in (9, 10, 11, 12, 13, 28, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0x200B, 0x180E, 0xFEFF)]
    texts = ["".join(draw.choice(parts, draw.integers(0, 40))) for _ in range(120)] + ["", " ", None]
    return spark.createDataFrame([(i, i % 3 if i % 7 else None, t) for i, t in enumerate(texts)], "id long, cluster int, corpus string")


def test_texts_are_split_in_the_tasks_as_natively(spark):
    df = _odd_texts(spark)
    assert "regex" not in _plan(spark, EN.hash_encode(df, "id", "corpus", 16)) and "split(" not in _plan(spark, EN.hash_encode(df, "id", "corpus", 16))
    counts = {r["id"]: np.zeros(16) for r in df.collect()}
    for r in df.select("id", F.explode(EN.token_buckets("corpus", 16)).alias("b")).collect():
        counts[r["id"]][r["b"]] += 1
    for r in EN.hash_encode(df, "id", "corpus", 16).collect():
        assert np.allclose(r["embedding"], counts[r["id"]] / max(np.linalg.norm(counts[r["id"]]), 1e-9))


def test_terms_are_counted_before_they_are_rows(spark):
    df = _odd_texts(spark)
    assert "Generate" not in _plan(spark, TH.cluster_terms(df, 5, min_chars=1))  # no row for each token
    rows = lambda t: sorted(map(str, t.collect()))
    for stop in (None, [], ["love"]):
        assert rows(TH.term_counts(df, "corpus", stop)) == rows(TH.cluster_tokens(df, "corpus", stop).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n")))


def test_text_is_split_in_bounded_slices():
    import pyarrow as pa

    texts = ["a b"] * 50 + [None, "", " c  c "] + ["x" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    runs = list(EN.split_slices(batch, 60))
    assert sum(b.num_rows for b, *_ in runs) == len(texts) and all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 60 for b, *_ in runs)
    assert sum(len(rows) for _, rows, _, _ in runs) == 50 * 2 + 2 + 1
