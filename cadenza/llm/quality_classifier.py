"""Document quality by Bradley-Terry pairwise ranking.

A labelled good document is preferred to a labelled bad one with probability
sigmoid(w . (x_good - x_bad)).  The weights minimise the logistic loss over
such pairs of feature differences; a document's strength is w . x.  The cut
between good and bad is a quantile of the strengths of all labelled documents:
the share of bad labels.  Strengths are mapped to scores in (0, 1) so that the
cut has the score ``CUT_SCORE``.

Features describe the form of a whole text (shares of character classes and
of pairs of them, word and line statistics) and are computed by one function
in the fit and in scoring.  Only the fit is bounded: it takes a sample of about
``FIT_ROWS`` labelled documents, drawn by a hash of the id and, of an id with
more than ``ID_ROWS`` rows, about so many of them, and ``PAIRS_PER_ROW`` pairs for
each.  Texts are scored where they lie; only ids and strengths are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table

FIT_ROWS = 10_000
ID_ROWS = 20
SLICE_ROWS = 256
PAIRS_PER_ROW = 4
RIDGE = 3e-3
CUT_SCORE = 0.3
CLIP = 8.0
SEED = 17

CLASSES = {  # byte classes; bytes beyond ASCII and the rest are classes of their own
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t",
    "line": b"\n\r", "stop": b".", "comma": b",;:", "shout": b"!", "ask": b"?", "bar": b"|", "symbol": b"#*$%&<>=+~^_\\/@",
    "quote": b"\"'`-()[]{}",
}
N_CLASSES = len(CLASSES) + 2
_CLASS = np.full(256, N_CLASSES - 1, dtype=np.int64)
for _i, _chars in enumerate(CLASSES.values()):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = N_CLASSES - 2
N_STATS = 8
N_FEATURES = N_CLASSES * (N_CLASSES + 1) + N_STATS


def features(text: str | None) -> np.ndarray:
    """Features of a whole text; all zero for null and empty texts."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8")
    kinds = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    single = np.bincount(kinds, minlength=N_CLASSES) / len(kinds)
    pairs = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES**2) / len(kinds)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    stats = (math.log1p(n), len(raw) / (n + 1), len(set(words)) / (n + 1), len(set(lines)) / (len(lines) + 1),
             math.log1p(len(lines)), n / (len(lines) + 1), len({*zip(words, words[1:])}) / (n + 1), n < 20)
    # square roots spread the small shares that tell texts apart
    return np.concatenate([np.sqrt(single), np.sqrt(pairs), np.array(stats, dtype=float)])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # strength at the quantile of bad labels
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + math.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_bradley_terry(x: np.ndarray, good: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = RIDGE) -> Model:
    """Weights by Newton's method on the logistic loss of pairs (good, bad).
    Every row takes part in ``pairs_per_row`` drawn pairs or more.  With one
    label only nothing can be preferred: all weights are 0."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = np.where((s := x.std(axis=0)) > 1e-9, s, 1.0) if len(x) else np.ones(x.shape[1])
    w = np.zeros(x.shape[1])
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(ups) or not len(downs):
        return Model(mean, scale, w, 0.0 if len(downs) else -1.0, 1.0)
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    draw = np.random.default_rng(SEED)
    n = pairs_per_row * max(len(ups), len(downs))
    a, b = np.resize(draw.permutation(ups), n), draw.choice(downs, n)
    diff = z[a] - z[b]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance of the wrong order
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w)), diff.T @ p / n - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    cut = float(np.quantile(strength, len(downs) / len(x)))
    return Model(mean, scale, w, cut, _slope(strength - cut, good))


def _slope(s: np.ndarray, good: np.ndarray) -> float:
    """Slope of the score by maximum likelihood, at the fixed cut."""
    at, slope = math.log(CUT_SCORE / (1 - CUT_SCORE)), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * s + at, -30, 30)))
        curve = float((s * s * p * (1 - p)).mean()) + 1e-6
        step = float((s * (good - p)).mean()) / curve
        slope = min(20.0, max(0.05, slope + max(-1.0, min(1.0, step))))
        if abs(step) < 1e-6:
            break
    return slope


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass(frozen=True)
class Trained:
    model: Model
    labelled: DataFrame  # (lid, quality, n): each usable labelled id and its rows
    bad_share: float  # of all labelled rows
    sample: tuple[np.ndarray, np.ndarray]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Trained:
    """Fit on labelled rows outside the held-out fifth.  Labels other than 0
    and 1 and null ids are not used; an id with several labels has that of the
    majority, good if even."""
    usable = labels.select(F.col("doc_id").alias("lid"), "quality").filter(
        F.col("quality").isin(0, 1) & F.col("lid").isNotNull() & (remainder(F.col("lid")) != 0)).groupBy("lid").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("quality"))
    rows_of = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    labelled = shared_table(usable.join(rows_of, F.col("doc_id") == F.col("lid")).select("lid", "quality", "n"), "quality-labels")
    n, bad, weighed = labelled.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in (
        F.col("n"), F.when(F.col("quality") == 0, F.col("n")).otherwise(0), F.least("n", F.lit(ID_ROWS)))]).first()
    share = min(1.0, fit_rows / max(1, weighed))
    drawn = shared_table(labelled.filter(F.pmod(F.xxhash64("lid", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)), "quality-sample")

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tolist() for t in texts], dtype=object)

    side = F.broadcast(drawn) if drawn.count() <= 4 * fit_rows else drawn
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    one_row = F.pmod(F.xxhash64("doc_id", "place", F.lit(SEED)), F.lit(1_000_000)) < F.lit(1_000_000) * ID_ROWS / F.col("n")
    rows = given.join(side, F.col("doc_id") == F.col("lid")).filter(one_row)
    sample = rows.select("quality", described(F.col("text")).alias("x"), F.hash("doc_id", "text").alias("h"))
    held = sample.sort("h", "quality").toPandas()  # about fit_rows rows
    x = np.array(held["x"].tolist(), dtype=float).reshape(len(held), N_FEATURES)
    good = held["quality"].to_numpy() == 1
    return Trained(fit_bradley_terry(x, good), labelled, bad / max(1, n), (x, good))


def with_cut(trained: Trained, strengths: DataFrame) -> Model:
    """The model with the cut at the quantile of bad labels among all labelled
    rows of ``strengths`` (doc_id, strength); with one label the fit's own."""
    model = trained.model
    if not 0 < trained.bad_share < 1 or not model.weights.any():
        return model
    mine = strengths.join(trained.labelled, F.col("doc_id") == F.col("lid"))
    cut = mine.agg(F.percentile_approx("strength", F.lit(trained.bad_share), F.lit(10_000))).first()[0]
    x, good = trained.sample
    return replace(model, cut=cut, slope=_slope(model.strength(x) - cut, good))


def strength_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def strong(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for a in range(0, len(texts), SLICE_ROWS):  # the features of a slice are held at once
            part = texts.iloc[a:a + SLICE_ROWS]
            out[a:a + len(part)] = model.strength(np.array([features(t) for t in part]).reshape(len(part), N_FEATURES))
        return pd.Series(out)

    return strong(text)


def score_of(strength: Column, model: Model) -> Column:
    at = math.log(CUT_SCORE / (1 - CUT_SCORE))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.slope) * (strength - F.lit(model.cut)) + F.lit(at)))
    return 1 / (1 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document.

    Null and empty texts are scored as texts without any character.  A null
    id is not held out.  Repeated rows each keep a row.  Without usable labels
    of both kinds all documents get one score.  Empty input: no rows.  Other
    columns are not read."""
    trained = train(docs, labels, id_col, text_col, fit_rows)
    strengths = shared_table(docs.select(F.col(id_col).alias("doc_id"), strength_column(F.col(text_col), trained.model).alias("strength")), "quality-strengths")
    scored = strengths.select("doc_id", score_of(F.col("strength"), with_cut(trained, strengths)).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the documents that :func:`classify` predicts 0."""
    trained = train(docs, labels, id_col, text_col, fit_rows)
    # each text's strength is computed once; it travels with its row in a written table
    held = shared_table(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"),
                                    strength_column(F.col(text_col), trained.model).alias("strength")), "quality-strengths")
    model = with_cut(trained, held.select("doc_id", "strength"))
    return held.filter(score_of(F.col("strength"), model) >= CUT_SCORE).select("row.*")
