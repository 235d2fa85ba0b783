"""The estimator as part of pyspark.ml, and requests answered on a stream."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cadenza.operators import kmeans as KM
from cadenza.operators.estimator import MiniBatchKMeans, MiniBatchKMeansModel
from cadenza.operators import vector_index as VI
from cadenza.plans import jobs as J
from test_silhouette_kmeans import _points


def _blobs(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([c + rng.normal(scale=0.4, size=(40, 2)) for c in ([0, 0], [9, 0], [0, 9])])
    return _points(spark, x, np.zeros(120, dtype=int)).drop("cluster")


def test_a_saved_model_labels_as_before(spark, tmp_path):
    pts = _blobs(spark)
    est = MiniBatchKMeans(k=3, batchRows=30, maxIter=6, featuresCol="embedding")
    est.save(f"{tmp_path}/estimator")
    model = MiniBatchKMeans.load(f"{tmp_path}/estimator").fit(pts)
    model.save(f"{tmp_path}/model")
    loaded = MiniBatchKMeansModel.load(f"{tmp_path}/model")
    a, b = (sorted(map(tuple, m.transform(pts).select("song_id", "cluster").collect())) for m in (est.fit(pts), loaded))
    assert a == b and len(loaded.clusterCenters()) == 3
    labels = dict(a)
    assert [len({labels[i] for i in range(s, s + 40)}) for s in (0, 40, 80)] == [1, 1, 1] and len(set(labels.values())) == 3


def test_it_fits_into_pipelines_and_the_pluggable_job(spark):
    pts = _blobs(spark)
    feats = pts.withColumn("features", array_to_vector("embedding")).withColumn("note", F.lit("kept"))
    out = Pipeline(stages=[MiniBatchKMeans(k=3, predictionCol="label")]).fit(feats).transform(feats)
    assert out.columns == [*feats.columns, "label"] and out.count() == 120
    labelled = KM.fit_estimator(pts, MiniBatchKMeans(k=3, batchRows=50))
    assert {r["cluster"] for r in labelled.collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        MiniBatchKMeans(k=500, featuresCol="embedding").fit(pts)


def test_a_batch_is_a_part_of_the_rows(spark):
    pts = _blobs(spark)
    sizes = [pts.filter(MiniBatchKMeans(batchRows=1)._drawn(s, 4)).count() for s in range(8)]
    assert all(5 <= n <= 60 for n in sizes) and len({tuple(r["song_id"] for r in pts.filter(MiniBatchKMeans()._drawn(s, 4)).collect()) for s in range(4)}) == 4


def test_requests_on_a_stream_and_after_a_restart(spark, tmp_path):
    songs = spark.createDataFrame([(i, f"t{i}", "a", f"word{i} word{i % 3} common text", None) for i in range(30)],
                                  "song_id long, song_title string, artist_name string, corpus string, song_url string")
    index = VI.build_vector_index(J.EN.hash_encode(songs, "song_id", "corpus", 64), f"{tmp_path}/index")
    schema = "request_id long, mode string, lyrics string, song_name string, artist_name string"
    batches = [[(1, "lyrics", "word1 word2 common", None, None), (2, "song", None, "t5", "a")], [(3, "lyrics", "short", None, None), (4, None, "word7 word1 text", None, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.recommend_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), songs, index, f"{tmp_path}/out", 5).awaitTermination()
    got = spark.read.schema(J.RANKED).parquet(f"{tmp_path}/out/ranked")
    everything = spark.createDataFrame(batches[0] + batches[1], schema)
    inputs = J.RC.request_inputs(everything, songs).filter("status = 'ok'")
    want = VI.search(index, J.EN.hash_encode(inputs, "request_id", "input_text", 64), 5)[0]
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.select("request_id").distinct().count() == 3
