"""Text -> vector encoders.

``hash_encode``     default encoder: lower-case whitespace tokens, bucket ``int(md5(w)[:7], 16) % dim`` -- the same
                    rule as the native :func:`token_bucket` --, term counts per
                    bucket (one ``np.bincount`` per slice), L2-normalised.
                    Row-local: no shuffle.
``tfidf_encode``    TF-IDF over the same buckets, in long form; counted like
                    that, merged by id.
``encode``          any user encoder object with ``encode(list[str]) ->
                    array (n, d)`` run in Arrow batches by ``mapInPandas``;
                    the object is built once per Python worker by a factory
                    and fed ``batch_size`` texts per call.
"""

from __future__ import annotations

import hashlib
import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import split_ws
from cadenza.operators.parallel import spread
from cadenza.session import checkpoint_dir

DEFAULT_DIM = 64
SLICE_TOKENS = 1 << 17  # counted at once, whatever a batch holds
SLICE_ROWS = 2048
SLICE_BYTES = 4 << 20  # of text, split at once
BUILTIN_MODEL = f"hash-bow-{DEFAULT_DIM}"


def model_dimensions(name: str) -> int:
    """Dimensions of a registered encoder name; unknown names fail before
    any work starts (the built-in hashed encoder is ``hash-bow-<dim>``)."""
    from cadenza.constants import MODEL_REGISTRY

    if name.startswith("hash-bow-") and name[len("hash-bow-"):].isdigit():
        return int(name[len("hash-bow-"):])
    for model_id, _, dims in MODEL_REGISTRY:
        if model_id == name:
            return dims
    raise ValueError(f"unknown encoder {name!r}")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def token_bucket(w, dim: int) -> F.Column:
    return F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def token_buckets(text, dim: int) -> F.Column:
    """``array<int>`` of bucket ids, one per whitespace token of the
    lower-cased text, fully native (reference form of the bucket rule)."""
    return F.transform(split_ws(F.lower(text)), lambda w: token_bucket(w, dim))


def _md5_bucket(words: list[str] | list[bytes], dim: int) -> np.ndarray:
    """Buckets of distinct words, as text or as its UTF-8 bytes."""
    md5 = hashlib.md5
    digests = b"".join([md5(w.encode("utf-8") if isinstance(w, str) else w).digest() for w in words])
    return (np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) >> 4) % dim  # the first 7 hexadecimal digits


def _buckets(words, dim: int) -> np.ndarray:
    """Of an Arrow array of distinct words."""
    import pyarrow as pa

    return _md5_bucket(words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), dim)


def _runs(batch, lengths, most: int):
    """A batch in runs of rows whose lengths come to ``most``, or of one row."""
    ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def _slices(batch, tokens: int):
    """A batch ``(id, tokens)`` in runs of at most ``tokens`` tokens."""
    return _runs(batch, batch.column(1).value_lengths(), tokens)


def split_slices(batch, most: int = SLICE_BYTES):
    """A batch ``(key, text)`` in runs of at most ``most`` bytes of text, or one
    ``(key, tokens)`` in runs of ``SLICE_TOKENS``: the run, for each token the
    place of its row in it and of its word in the last, the distinct words.
    Arrow splits at the whitespace of :func:`~cadenza.functions.text.split_ws`;
    empty tokens are dropped."""
    import pyarrow as pa
    import pyarrow.compute as pc

    listed = pa.types.is_list(batch.column(1).type)
    for b in _slices(batch, SLICE_TOKENS) if listed else _runs(batch, pc.binary_length(batch.column(1)), most):
        toks = b.column(1) if listed else pc.utf8_split_whitespace(b.column(1))
        words = pc.dictionary_encode(pc.list_flatten(toks))
        rows, at, words = pc.list_parent_indices(toks).to_numpy().astype(np.int64), words.indices.to_numpy(), words.dictionary
        empty = pc.index(words, pa.scalar("", words.type)).as_py()
        if empty >= 0:
            rows, at = rows[at != empty], at[at != empty]
        yield b, rows, at, words


def _hash_batches(dim: int, id_col: str, out_col: str):
    """``mapInArrow`` body: ``(id, lower-case text or its tokens)`` batches ->
    ``(id, embedding list<double>)``.  Splitting, parent indices and the
    vocabulary are computed by Arrow in C++, for a bounded slice of a batch at
    a time; only distinct tokens are hashed in Python."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for b, rows, at, words in split_slices(batch):
                n = b.num_rows
                buckets = _buckets(words, dim)[at]
                counts = np.bincount(rows * dim + buckets, minlength=n * dim).reshape(n, dim).astype(np.float64)
                norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
                nz = norms > 0
                counts[nz] /= norms[nz, None]
                offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
                emb = pa.ListArray.from_arrays(offsets, pa.array(counts.reshape(-1), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0), emb], names=[id_col, out_col])

    return run


def hash_encode(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM,
                out_col: str = "embedding") -> DataFrame:
    """``(id, embedding array<double>)``: hashed bag-of-words, L2-normalised;
    a text without tokens (or null) gets the zero vector.  Row-local (no
    shuffle): texts are lower-cased natively in the JVM and split by Arrow in
    the task; each slice hashes its distinct tokens once and counts buckets
    with ``np.bincount``."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    src = spread(df.select(id_col, text_col)).select(F.col(id_col), text.alias("_text"))
    id_type = df.schema[id_col].dataType.simpleString()
    return src.mapInArrow(_hash_batches(dim, id_col, out_col), f"{id_col} {id_type}, {out_col} array<double>")


def hash_encode_long(df: DataFrame, id_col: str, text_col: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """Long form ``(id, dim, weight)`` of :func:`hash_encode`, non-zero
    buckets only."""
    enc = hash_encode(df, id_col, text_col, dim, "_v")
    return (
        enc.select(id_col, F.posexplode("_v").alias("dim", "weight"))
        .filter(F.col("weight") != 0)
        .select(id_col, F.col("dim").cast("int").alias("dim"), "weight")
    )


def _count_batches(dim: int):
    """``mapInArrow`` body: ``(id, tokens)`` -> ``(id, dims, tfs)``, for each
    slice of a batch one row for each id that has tokens."""
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            for b in _slices(batch, SLICE_TOKENS):
                flat = pc.list_flatten(b.column(1))
                if not len(flat):
                    continue
                ids = b.column(0).dictionary_encode(null_encoding="encode")
                parents = ids.indices.to_numpy().astype(np.int64)[pc.list_parent_indices(b.column(1)).to_numpy()]
                enc = pc.dictionary_encode(flat)
                buckets = _buckets(enc.dictionary, dim)[enc.indices.to_numpy()]
                yield _packed(ids.dictionary, parents * dim + buckets, None, dim)

    return run


def _packed(ids, entries: np.ndarray, counts: np.ndarray | None, dim: int):
    """A row for each id with its dims and their counts, of entries (place of
    the id x dim + bucket)."""
    import pyarrow as pa

    entries, at = np.unique(entries, return_inverse=True)
    tfs = np.bincount(at, weights=counts, minlength=len(entries)).astype(np.int64)
    starts = np.flatnonzero(np.diff(entries // dim, prepend=-1))
    ends = pa.array(np.append(starts, len(entries)).astype(np.int32))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(entries[starts] // dim)), pa.ListArray.from_arrays(ends, pa.array((entries % dim).astype(np.int32))),
                                       pa.ListArray.from_arrays(ends, pa.array(tfs))], names=["id", "dims", "tfs"])


def _merge_batches(dim: int):
    """``mapInArrow`` body over rows in order of id: one row for each id."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        last = None  # the id that may go on in the next batch, its dims and tfs
        for b in batches:
            if not b.num_rows:
                continue
            ids, parents = b.column(0), pc.list_parent_indices(b.column(1)).to_numpy().astype(np.int64)
            dims, tfs = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            if last is not None:
                ids, parents = pa.concat_arrays([last.column(0).cast(ids.type), ids]), np.concatenate([np.zeros(len(last.column(1)[0]), dtype=np.int64), parents + 1])
                dims, tfs = (np.concatenate([last.column(i).flatten().to_numpy(), x]) for i, x in ((1, dims), (2, tfs)))
            ids = ids.dictionary_encode(null_encoding="encode")
            place = ids.indices.to_numpy().astype(np.int64)
            merged = _packed(ids.dictionary, place[parents] * dim + dims, tfs, dim)
            last = merged.slice(merged.num_rows - 1)
            yield merged.slice(0, merged.num_rows - 1)
        if last is not None:
            yield last

    return run


def tfidf_encode(df: DataFrame, id_col: str, text_col: str, num_features: int = 1 << 12) -> DataFrame:
    """TF-IDF over the md5 buckets, L2-normalised, as ``(id, dim, weight)``
    with a row for each non-zero entry: tf = count in the text, idf =
    ln((N + 1) / (df + 1)).  Long form, so a row costs its own words and not
    ``num_features``.  A text is counted where it lies; the counts, packed in a
    row for each id, are shuffled once and stored, and the ``num_features``
    weights go to the tasks."""
    import pyarrow as pa

    id_type = df.schema[id_col].dataType.simpleString()
    packed = f"id {id_type}, dims array<int>, tfs array<bigint>"
    toks = split_ws(F.lower(F.col(text_col)))
    texts = spread(df.select(id_col, text_col)).select(F.col(id_col).alias("id"), toks.alias("toks"))
    counted = texts.mapInArrow(_count_batches(num_features), packed).repartition("id").sortWithinPartitions("id")
    counted = _written(counted.mapInArrow(_merge_batches(num_features), packed), "tfidf-counts")
    total = df.select(F.count(F.lit(1)).alias("N")).first()["N"]

    def holders(batches):
        n = np.zeros(num_features, dtype=np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=num_features)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["dim", "df"])

    idf = np.zeros(num_features)
    seen = counted.select("dims").mapInArrow(holders, "dim int, df bigint").groupBy("dim").agg(F.sum("df").alias("df"))
    for r in seen.select("dim", F.log((F.lit(total) + 1) / (F.col("df") + 1)).alias("idf")).collect():  # num_features rows at most
        idf[r["dim"]] = r["idf"]

    def weigh(batches):
        for b in batches:
            for part in (b.slice(at, SLICE_ROWS) for at in range(0, b.num_rows, SLICE_ROWS)):
                dims, tfs = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
                row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                w = tfs * idf[dims]
                norm = np.sqrt(np.bincount(row, weights=w * w, minlength=part.num_rows))
                at = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[at])), pa.array(dims[at]), pa.array(w[at] / norm[row[at]])],
                                                 names=[id_col, "dim", "weight"])

    return counted.mapInArrow(weigh, f"{id_col} {id_type}, dim int, weight double")


# ------------------------------------------------------------ user encoders

def encode(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], object], dim: int,
           batch_size: int = 32, out_col: str = "embedding") -> DataFrame:
    """Run a user encoder over a text column.  ``factory()`` must return an
    object with ``encode(list[str]) -> array-like (n, dim)``; it is called
    once per Python worker and cached there, by a digest of the pickled factory.  Texts are fed ``batch_size`` at
    a time in input order; null text is encoded as ``""``."""
    from pyspark import cloudpickle

    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def run(batches):
        # a module of the worker outlives a task; this function does not
        held = sys.modules.setdefault("_cadenza_encoders", types.ModuleType("_cadenza_encoders")).__dict__
        if key not in held:
            held[key] = factory()
        enc = held[key]
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            parts = [np.asarray(enc.encode(texts[i:i + batch_size]), dtype=np.float64)
                     for i in range(0, len(texts), batch_size)]
            mat = np.vstack(parts) if parts else np.zeros((0, dim))
            if mat.shape[1] != dim:
                raise ValueError(f"encoder returned {mat.shape[1]} dims, expected {dim}")
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), out_col: list(mat)})

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, {out_col} array<double>")


class HashingEncoder:
    """A plain-Python encoder with the user-encoder contract, equal to
    :func:`hash_encode` (used to test the pluggable path)."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim

    def encode(self, texts):
        out = np.zeros((len(texts), self.dim))
        for r, t in enumerate(texts):
            for w in t.lower().split():
                out[r, int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % self.dim] += 1.0
        n = np.linalg.norm(out, axis=1)
        nz = n > 0
        out[nz] /= n[nz, None]
        return out
