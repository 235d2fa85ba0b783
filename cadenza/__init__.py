"""cadenza: song / lyrics analytics as Spark DataFrame, SQL, MLlib and
Structured Streaming operators.

Sub-packages
------------
sources    readers and sinks (songs CSV/parquet, embeddings, clustered tables, run store)
functions  column expressions (text cleaning, vector math, scalar parsers, sample keys)
operators  DataFrame operators (exact-n sample, top-k cosine, silhouette, KMeans,
           cluster terms, explore / enrichment joins, encoders)
plans      end-to-end jobs and the registered query catalogue
streaming  keyed progress-event operators (throttle, latest, status, time-out) and
           streaming cluster assignment
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside Python workers (Arrow kernels,
# grouped-map functions) are serialised by value, so executors need nothing
# installed and no extra files shipped.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from cadenza.session import checkpoint_dir, clear_intermediate, get_spark  # noqa: E402,F401

__version__ = "0.1.0"
