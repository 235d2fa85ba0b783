import hashlib
import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import encode as EN
from cadenza.operators.recommend import validate_requests


def test_pluggable_encoder_equals_native_hash(spark):
    df = spark.createDataFrame(
        [(1, "Love love fire"), (2, ""), (3, None), (4, "Night\nday  night")], "song_id bigint, corpus string"
    )
    a = {r["song_id"]: np.array(r["embedding"]) for r in EN.hash_encode(df, "song_id", "corpus", 16).collect()}
    b = {r["song_id"]: np.array(r["embedding"]) for r in
         EN.encode(df, "song_id", "corpus", lambda: EN.HashingEncoder(16), 16, batch_size=2).collect()}
    assert sorted(a) == sorted(b) == [1, 2, 3, 4]
    for k in a:
        assert np.allclose(a[k], b[k])
    assert not a[2].any() and not a[3].any()
    assert abs(np.linalg.norm(a[1]) - 1.0) < 1e-12


def test_native_bucket_rule_matches_python(spark):
    df = spark.createDataFrame([("hello world été",)], "t string")
    native = df.select(EN.token_buckets(F.col("t"), 64)).first()[0]
    assert native == list(EN._md5_bucket(["hello", "world", "été"], 64))


def test_validate_requests_routing(spark):
    # F5-F7: missing mode = lyrics, anything else = song mode
    df = spark.createDataFrame(
        [(1, None, "short", None, None), (2, "lyrics", "long enough text", None, None),
         (3, "song", None, "t", "a"), (4, "other", None, "t", ""), (5, None, "\n  123456789 \n", None, None)],
        "request_id bigint, mode string, lyrics string, song_name string, artist_name string",
    )
    got = {r["request_id"]: (r["eff_mode"], r["status"]) for r in validate_requests(df).collect()}
    assert got == {1: ("lyrics", "too_short"), 2: ("lyrics", "ok"), 3: ("song", "ok"),
                   4: ("song", "missing_song_fields"), 5: ("lyrics", "too_short")}


def test_encoder_registry():
    import pytest

    assert EN.model_dimensions("all-MiniLM-L6-v2") == 384
    assert EN.model_dimensions("bert-base-nli-mean-tokens") == 768
    assert EN.model_dimensions(EN.BUILTIN_MODEL) == 64
    with pytest.raises(ValueError):
        EN.model_dimensions("no-such-model")


def test_corpus_index_gives_same_playlist(spark, tmp_path):
    from cadenza.operators import recommend as RC
    from cadenza.plans import bindings as B

    d = "/root/testdata/sf0.001"
    songs, req, cat = B.songs(spark, d), B.requests(spark, d), B.catalogue(spark, d)
    RC.build_corpus_index(songs, str(tmp_path / "idx"))
    a, _ = RC.recommend(req, songs, cat)
    b, _ = RC.recommend(req, songs, cat, corpus=RC.load_corpus_index(spark, str(tmp_path / "idx")))
    key = lambda r: (r["request_id"], r["rank"] or 0)
    assert sorted(map(tuple, a.collect()), key=lambda t: (t[0], t[2] or 0)) == \
        sorted(map(tuple, b.select(*a.columns).collect()), key=lambda t: (t[0], t[2] or 0))


def test_silhouette_sample_size(spark):
    import numpy as np
    from cadenza.operators.silhouette import silhouette_exact
    from cadenza.plans import bindings as B

    v = B.vectors(spark, "/root/testdata/sf0.001")
    full = silhouette_exact(v).first()
    part = silhouette_exact(v, sample_size=100).first()
    assert part["n_points"] == 100 and full["n_points"] == v.count()
    assert -1 <= part["silhouette"] <= 1


def test_json_bodies_and_forms(spark):
    from cadenza.operators.recommend import form_requests, parse_requests, request_inputs

    bodies = spark.createDataFrame(
        [(1, '{"lyrics": "long enough text"}'), (2, '{"mode": "song", "song_name": "t"}'), (3, "{}"), (4, "no json"), (5, None),
         (6, '{"mode": null, "lyrics": "0123456789", "more": 1}')], "request_id bigint, body string")
    got = {r["request_id"]: r for r in validate_requests(parse_requests(bodies)).collect()}
    assert [got[i]["status"] for i in range(1, 7)] == ["ok", "missing_song_fields", "too_short", "too_short", "too_short", "ok"]
    songs = spark.createDataFrame([(7, "a", "T", "words of the song", None)],
                                  "song_id bigint, artist_name string, song_title string, corpus string, song_url string")
    forms = spark.createDataFrame([(1, "None", " t", "A "), (2, "None", "x", "y"), (3, "none of it here", "", ""), (4, "None", "", "y")],
                                  "request_id bigint, user_input string, song_name string, artist_name string")
    got = {r["request_id"]: (r["status"], r["input_text"], r["error"]) for r in request_inputs(form_requests(forms), songs).collect()}
    assert got[1] == ("ok", "words of the song", None) and got[3][:2] == ("ok", "none of it here")
    assert got[2] == ("not_found", None, 'Could not find lyrics for "x" by y') and got[4][0] == "missing_song_fields"


def test_unicode_whitespace(spark):
    df = spark.createDataFrame([(1, "one\u00a0two\u3000three\x1cfour\x85five\u2028six")], "song_id bigint, corpus string")
    from cadenza.functions.text import split_ws, strip_ws

    assert df.select(split_ws("corpus")).first()[0] == ["one", "two", "three", "four", "five", "six"]
    pad = spark.createDataFrame([("\u00a0 \u3000x y\n\x1f",)], "t string")
    assert pad.select(strip_ws("t")).first()[0] == "x y"
    a = EN.hash_encode(df, "song_id", "corpus", 16).first()["embedding"]
    b = EN.encode(df, "song_id", "corpus", lambda: EN.HashingEncoder(16), 16).first()["embedding"]
    assert np.allclose(a, b)


def test_user_encoder_is_built_once_per_worker(spark, tmp_path):
    marks = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(marks, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return EN.HashingEncoder(8)

    df = spark.range(200).selectExpr("id AS song_id", "'love fire' AS corpus").repartition(40)
    assert EN.encode(df, "song_id", "corpus", factory, 8).count() == 200
    EN.encode(df, "song_id", "corpus", factory, 8).agg(F.max(F.size("embedding"))).collect()
    import os

    pids = [f.split("-")[0] for f in os.listdir(marks)]
    assert len(pids) == len(set(pids))


def test_a_batch_is_counted_in_slices_of_bounded_tokens():
    import pyarrow as pa

    from cadenza.operators import encode as EN

    lists = [["a"] * 40, None, [], ["b"] * EN.SLICE_TOKENS, ["c"] * 2, ["d"]] + [["e"] * 100] * 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["id", "t"])
    parts = list(EN._slices(batch, EN.SLICE_TOKENS))
    assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([batch]).combine_chunks())
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= EN.SLICE_TOKENS for p in parts)
    out = list(EN._hash_batches(64, "id", "v")([batch]))
    assert len(out) == len(parts) and sum(b.num_rows for b in out) == len(lists)
    assert out[0].column("v")[1].as_py() == [0.0] * 64


def test_buckets_of_words_that_come_once(spark):
    """The hashing of a word keeps nothing of it for later."""
    words = [f"w{i}é" for i in range(3000)]
    assert list(EN._md5_bucket(words, 64)) == list(EN._md5_bucket([w.encode() for w in words], 64))
    assert list(EN._md5_bucket(words[:5], 7)) == [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 7 for w in words[:5]]
    assert len(EN._md5_bucket([], 64)) == 0
