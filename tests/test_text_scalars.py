from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions import text as TX
from cadenza.functions.scalars import cluster_id_from_name, first_image_url
from cadenza.plans.jobs import clamp_run_params


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_stop_lists_sizes():
    assert len(K.THEME_STOPWORDS_LISTED) == 172
    assert len(K.theme_stopwords()) == 168
    assert len(K.CUSTOM_STOPWORDS_LISTED) == 31
    assert len(K.custom_stopwords()) == 30
    eng = TX.english_stopwords()
    assert "the" in eng and len(eng) > 100


def test_theme_tokens_drop_punctuated_and_short(spark):
    # X1-X2: lower-case; "love," and "don't" are dropped (not stripped),
    # short and non-letter tokens dropped, stop words dropped
    r = _one(spark, F.array_join(TX.theme_tokens(F.col("x")), " "), "Love, love don't the ÉTÉ ab abc1")
    assert r == "love été"


def test_offline_clean_keeps_case(spark):
    # X4: stop words compared lower-cased, original case and punctuation kept
    r = _one(spark, TX.drop_stopwords_keep_case(F.col("x"), ["the", "is", "like"]), "The Night is Like, fire")
    assert r == "Night Like, fire"


def test_strip_any_whitespace(spark):
    # SQL trim keeps newlines; ours strips them
    assert _one(spark, F.length(TX.strip_ws(F.col("x"))), "\n  123456789 \n") == 9
    assert _one(spark, F.length(TX.strip_ws(F.col("x"))), "1234567890") == 10


def test_cluster_id_from_name(spark):
    # X6
    assert _one(spark, cluster_id_from_name(F.col("x")), "demo_cluster_10.png") == 10
    assert _one(spark, cluster_id_from_name(F.col("x")), "cluster_0.png") == 0
    assert _one(spark, cluster_id_from_name(F.col("x")), "x.png") is None


def test_first_image(spark):
    # X9: empty image list -> null, else the first url
    df = spark.createDataFrame(
        [(1, []), (2, [{"url": "u"}, {"url": "v"}]), (3, None)],
        "id int, images array<struct<url:string>>",
    )
    got = dict(df.select("id", first_image_url("images").alias("u")).collect())
    assert got == {1: None, 2: "u", 3: None}


def test_na_strings_become_null(spark):
    df = spark.createDataFrame([(v,) for v in ["NA", "None", "", "null", "ok"]], "x string")
    got = [r[0] for r in df.select(TX.null_na_strings("x")).collect()]
    assert got == [None, None, None, None, "ok"]


def test_param_clamps():
    # samples floor 100 (cap 5000 only on request), clusters 2..15
    assert clamp_run_params(10, 1) == (100, 2)
    assert clamp_run_params(9999, 99) == (9999, 15)
    assert clamp_run_params(9999, 99, cap_samples=True) == (5000, 15)
