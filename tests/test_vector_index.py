"""The stored inverted file against brute force, and the work it saves."""

import numpy as np
import pytest

from cadenza.operators import vector_index as VI
from cadenza.operators.topk import topk_cosine
from test_vectors_topk import _frames


def _rows(df):
    return sorted((r["request_id"], r["rank"], r["song_id"], r["similarity"]) for r in df.collect())


def _clustered(rng, n, dim, groups, spread=0.05):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)), centres


@pytest.mark.parametrize("options", [{}, {"first_rows": 1}, {"max_broadcast_bytes": 900}])
def test_search_equals_the_full_scan(spark, tmp_path, options):
    rng = np.random.default_rng(5)
    c, centres = _clustered(rng, 600, 6, 9)
    c[50:250] = c[50]  # a third of the corpus is one vector: ties by id
    c[20] = c[30] = 0.0
    q = np.vstack([centres + 0.02, rng.normal(size=(4, 6)), c[50:51], np.zeros((1, 6))])
    qdf, cdf = _frames(spark, q, c)
    index = VI.build_vector_index(cdf, f"{tmp_path}/i", cells=12, block_rows=16)
    assert index.blocks["rows"].max() <= 16 and index.blocks["rows"].sum() == 600
    got, _ = VI.search(VI.open_vector_index(spark, f"{tmp_path}/i"), qdf, 7, **options)
    assert _rows(got) == _rows(topk_cosine(qdf, cdf, 7))


def test_most_of_a_clustered_corpus_is_skipped(spark, tmp_path):
    rng = np.random.default_rng(6)
    c, centres = _clustered(rng, 4000, 8, 20)
    qdf, cdf = _frames(spark, centres[:5], c)
    index = VI.build_vector_index(cdf, f"{tmp_path}/i", cells=40, block_rows=64)
    got, work = VI.search(index, qdf, 10, first_rows=100)
    assert _rows(got) == _rows(topk_cosine(qdf, cdf, 10))
    assert work.skipped > 0.8 and work.cells_read < work.cells


def test_a_corpus_without_structure_is_scanned(spark, tmp_path):
    rng = np.random.default_rng(7)
    qdf, cdf = _frames(spark, rng.normal(size=(3, 24)), rng.normal(size=(500, 24)))
    got, work = VI.search(VI.build_vector_index(cdf, f"{tmp_path}/i"), qdf, 20, first_rows=30)
    assert _rows(got) == _rows(topk_cosine(qdf, cdf, 20))
    assert work.scored <= work.pairs


def test_small_and_empty_tables(spark, tmp_path):
    qdf, cdf = _frames(spark, np.eye(2), np.eye(2))
    index = VI.build_vector_index(cdf, f"{tmp_path}/i")
    assert _rows(VI.search(index, qdf, 5)[0]) == _rows(topk_cosine(qdf, cdf, 5))
    assert VI.search(index, qdf.limit(0), 5)[0].collect() == []
    empty = VI.build_vector_index(cdf.limit(0), f"{tmp_path}/e")
    assert VI.search(empty, qdf, 5)[0].collect() == []
    zeros = VI.build_vector_index(_frames(spark, np.eye(2), np.zeros((3, 2)))[1], f"{tmp_path}/z")
    assert [r[1:3] for r in _rows(VI.search(zeros, qdf.limit(1), 2)[0])] == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        VI.search(index, _frames(spark, np.eye(3), np.eye(2))[0], 5)
