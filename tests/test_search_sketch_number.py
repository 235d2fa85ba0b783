"""Forgiving search, heavy hitters, bottom-k sketches and dense numbers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import heavy_hitters as HH
from cadenza.operators import themes as TH
from cadenza.operators.numbering import dense_number
from cadenza.operators.sample import bottom_k, merge_bottom_k, sample_exact
from cadenza.operators.song_search import search_songs


def _grams(text):
    text = " ".join((text or "").lower().split())
    s = f" {text} "
    return {s[i:i + 3] for i in range(len(s) - 2)} if text else set()


@pytest.mark.parametrize("percent", [40, 70])
def test_search_is_the_best_of_all_pairs(spark, percent):
    draw = random.Random(percent)
    words = ["love", "lovely", "night", "nite", "Fire", "the", "a", "sòng", "blue", "moon"]
    songs = [(f"t{i:03}", " ".join(draw.choices(words, k=draw.randint(1, 4))), draw.choice(["ann", "The Bobs", None, ""])) for i in range(150)]
    songs += [(f"u{i:03}", "love the night", "ann") for i in range(60)] + [("v0", None, None), ("v1", "", "")]
    asked = [(i, " ".join(draw.choices(words, k=3)) + draw.choice([" ann", "  BOBS", ""])) for i in range(60)]
    asked += [(100, None), (101, "  "), (102, "x"), (103, "Love  the NIGHT\tann"), (103, "lov the nigt ann"), (104, "zzz qqq")]
    got = search_songs(spark.createDataFrame(asked, "request_id long, text string").withColumn("size", F.lit(1)),
                       spark.createDataFrame(songs, "track_id string, title string, artist string").withColumn("n", F.lit(2)), min_percent=percent)
    want = []
    for i, text in asked:
        a, hits = _grams(text), []
        for track, title, artist in songs:
            b = _grams(" ".join(x for x in (title, artist) if x is not None))
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                hits.append((-len(a & b) / len(a | b), track))
        best = min(hits) if hits else None
        want.append((i, best is not None, best and best[1], best and round(-best[0], 9)))
    key = lambda r: repr(r)
    assert sorted(((r["request_id"], r["found"], r["track_id"], r["similarity"] and round(r["similarity"], 9)) for r in got.collect()), key=key) == sorted(want, key=key)


def _clustered(spark, rows):
    return spark.createDataFrame(rows, "cluster int, corpus string").repartition(4)


def test_sketched_terms_equal_the_full_count(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefg", k=4)) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(draw.choice([0, 0, 0, 1]), " ".join(draw.choices(words, weights, k=30))) for _ in range(300)]
    rows += [(2, " ".join(draw.choices(words, k=40))) for _ in range(30)] + [(3, "short"), (4, None), (5, "")]
    df = _clustered(spark, rows)
    want = sorted(map(tuple, TH.cluster_terms(df, 5).collect()))
    for capacity, most in ((5000, 0), (200, 3), (12, 3)):  # nothing dropped; dropped and proven or counted in full
        got, full = HH.top_terms(df, 5, capacity=capacity)
        assert sorted(map(tuple, got.collect())) == want and full <= most
    skewed = _clustered(spark, [(0, "love love love night night fire " + " ".join(draw.choices(words, k=3))) for _ in range(300)])
    got, full = HH.top_terms(skewed, 3, capacity=60)
    assert full == 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, TH.cluster_terms(skewed, 3).collect()))
    assert HH.top_terms(_clustered(spark, []))[0].collect() == []


def test_merged_sketches_are_the_sample(spark):
    df = spark.range(3000).selectExpr("id as song_id", "case when id % 3 < 2 then 0 else id % 7 end as day", "'x' as note")
    parts = bottom_k(df, 40, part=["day"])
    assert parts.groupBy("day").count().agg(F.max("count")).first()[0] == 40
    weeks = merge_bottom_k(parts.withColumn("half", F.col("day") % 2), 40, part=["half"])
    merged = {r["song_id"] for r in merge_bottom_k(weeks, 40).collect()}
    assert merged == {r["song_id"] for r in sample_exact(df, 40).collect()}
    assert merge_bottom_k(bottom_k(df.limit(5), 40, part=["day"]), 40).count() == 5
    assert bottom_k(df.limit(0), 3).collect() == []


def test_dense_numbers_have_no_gaps(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 as song_id", "case when id % 3 = 0 then null else id % 5 end as g").filter("song_id % 4 <> 0").repartition(6)
    got = sorted((r["song_id"], r["row_number"]) for r in dense_number(df, ["song_id"]).collect())
    assert [n for _, n in got] == list(range(750))
    by = {}
    for r in dense_number(df, ["song_id"], ["g"], "pos", 1).collect():
        by.setdefault(r["g"], []).append((r["song_id"], r["pos"]))
    assert sum(map(len, by.values())) == 750 and None in by
    assert all([p for _, p in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())
    assert dense_number(df.limit(0), ["song_id"]).collect() == []
