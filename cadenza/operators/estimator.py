"""Mini-batch KMeans as a ``pyspark.ml`` Estimator and Model.

Seeds are drawn as in :mod:`cadenza.operators.kmeans_seeded`.  Each step assigns
one batch, the rows whose hash for that step falls into a share of about
``batchRows`` rows, and moves every centre towards its rows' mean by their part
of all rows it has seen.  A step reads one batch, so a fit costs ``maxIter``
batches whatever the table's size.  The model is its centres: it saves and loads
with its params, and labels static and streaming tables alike.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasMaxIter, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.operators import clusters as CL
from cadenza.operators.kmeans_seeded import centre_table, seed_centres

BATCH_ROWS = 100_000
STEPS = 10


class _Params(HasFeaturesCol, HasPredictionCol, HasSeed, HasMaxIter):
    k = Param(Params._dummy(), "k", "number of clusters", TypeConverters.toInt)
    batchRows = Param(Params._dummy(), "batchRows", "rows of a step, about", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "column with the row's id, which draws it", TypeConverters.toString)

    def _vectors(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with its features, an ML vector or an array, as array ``name``."""
        col = self.getFeaturesCol()
        return df.withColumn(name, vector_to_array(col) if df.schema[col].dataType.typeName() == "udt" or "vector" in df.schema[col].dataType.simpleString() else F.col(col))

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)


class MiniBatchKMeans(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, k: int = K.DEFAULT_CLUSTERS, seed: int = K.SEED, maxIter: int = STEPS, batchRows: int = BATCH_ROWS, idCol: str = "song_id",
                 featuresCol: str = "features", predictionCol: str = "cluster"):
        super().__init__()
        self._setDefault(k=K.DEFAULT_CLUSTERS, seed=K.SEED, maxIter=STEPS, batchRows=BATCH_ROWS, idCol="song_id", featuresCol="features", predictionCol="cluster")
        self._set(**self._input_kwargs)

    def _drawn(self, step: int, parts: int) -> Column:
        """Whether a row is in the batch of a step: one part of ``parts`` by md5."""
        key = F.md5(F.concat_ws(":", F.lit(f"{self.getSeed()}:batch:{step}"), F.col("song_id").cast("string")))
        return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % parts == 0

    def _fit(self, dataset: DataFrame) -> MiniBatchKMeansModel:
        k, seed = self.getOrDefault("k"), self.getSeed()
        points = self._vectors(dataset, "embedding").select(F.col(self.getOrDefault("idCol")).cast("long").alias("song_id"), "embedding")
        parts = max(1, -(-points.count() // self.getOrDefault("batchRows")))
        centres = seed_centres(points, k, seed)
        seen = np.zeros(len(centres))
        for step in range(self.getMaxIter()):
            batch = CL.assign_nearest(points.filter(self._drawn(step, parts)), centre_table(points, centres), keep=("song_id", "embedding"))
            for r in CL.centroids(batch).collect():  # k rows
                seen[r["cluster"]] += r["n"]
                centres[r["cluster"]] += (np.array(r["centroid"]) - centres[r["cluster"]]) * (r["n"] / seen[r["cluster"]])
        model = MiniBatchKMeansModel()
        return self._copyValues(model)._set(centres=centres.tolist())


class MiniBatchKMeansModel(Model, _Params, DefaultParamsReadable, DefaultParamsWritable):
    centres = Param(Params._dummy(), "centres", "the centres, a vector for each cluster", TypeConverters.toListListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(k=K.DEFAULT_CLUSTERS, seed=K.SEED, maxIter=STEPS, batchRows=BATCH_ROWS, idCol="song_id", featuresCol="features", predictionCol="cluster")

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.getOrDefault("centres")]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cents = centre_table(dataset, np.array(self.getOrDefault("centres")))
        return CL.assign_nearest(self._vectors(dataset, "_features"), cents, vec="_features", out=self.getPredictionCol(), keep=tuple(dataset.columns))
