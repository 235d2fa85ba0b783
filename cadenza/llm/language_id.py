"""Language identification by averaged hashed subword embeddings.

A text is lower-cased and everything but letters becomes one space.  Its
subwords, the runs of 1 to ``MAX_GRAM`` characters, are hashed to ``BUCKETS``
rows of an embedding table; the mean of their embeddings, and of ``PRIOR``
zeros, goes through a linear softmax.  Embeddings and softmax are trained
together by stochastic gradient descent in numpy.

Only the fit is bounded: it takes at most ``FIT_ROWS`` labelled documents, the
languages in equal parts as far as they go, drawn by a hash.  A
fifth of them is kept from the descent for calibration: a temperature that
makes the scores probabilities, and the score below which a prediction is
rejected, which only ``REJECT_SHARE`` of right languages fall under.

As the mean and the softmax are both linear, prediction needs one table of
(buckets, languages): a pass over whole texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table

UNKNOWN = "und"
BUCKETS = 1 << 15  # a power of two
MAX_GRAM = 4
DIM = 16
FIT_ROWS = 4_000
EPOCHS = 8
BATCH = 32
PRIOR = 30  # subwords without a language that every text has besides its own: short texts are less certain
RATE = 0.5
CALIBRATION = 5  # every fifth row of the sample
REJECT_SHARE = 0.01
PIECE = 1 << 17  # characters that are hashed at once
SEED = 23
_SPACE = 32


def _letters() -> np.ndarray:
    """Which code points are letters, as ``str.isalpha`` has them."""
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), dtype=bool, count=0x30000)


LETTER_RANGE = r"\p{L}"
_TABLE: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0][np.minimum(codes, len(_TABLE[0]) - 1)]


def _spaced(text: str) -> np.ndarray:
    """Code points of a lower-cased piece, each run of others than letters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    letter = _is_letter(codes)
    codes[~letter] = _SPACE
    return codes[letter | np.concatenate(([True], letter[:-1]))]


def subword_counts(text: str | None, n_buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's subwords occur.  Texts are read by pieces of
    ``PIECE`` characters, each with a space at either end."""
    out, shift = np.zeros(n_buckets, dtype=np.int64), np.uint64(64 - (n_buckets - 1).bit_length())
    text = text or ""
    for at in range(0, len(text), PIECE):
        codes = np.concatenate(([_SPACE], _spaced(text[at:at + PIECE]), [_SPACE])).astype(np.uint64)
        h, found = codes, []
        for k in range(MAX_GRAM):
            if k:
                h = h[:-1] * np.uint64(0x100000001B3) + codes[k:]
            found.append(((h + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
        out += np.bincount(np.concatenate(found).view(np.int64), minlength=n_buckets)
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place in languages, score) of each text."""
        z = np.empty((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            counts = subword_counts(text, len(self.table))
            z[i] = counts @ self.table / (counts.sum() + PRIOR) + self.bias
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str], label: np.ndarray, n_buckets: int = BUCKETS,
        epochs: int = EPOCHS) -> Model:
    """Train on rows of (buckets, shares) with the place of their language."""
    draw = np.random.default_rng(SEED)
    aside = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
    embed = draw.normal(0, 1 / DIM, (n_buckets, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(languages)), dtype=np.float32), np.zeros(len(languages), dtype=np.float32)
    weights += draw.normal(0, 1, weights.shape).astype(np.float32)
    train = np.flatnonzero(~aside)
    steps, done = max(1, epochs * -(-len(train) // BATCH)), 0
    for _ in range(epochs):
        order = draw.permutation(train)
        for a in range(0, len(order), BATCH):
            at = order[a:a + BATCH]
            # only the rows of the embedding table that the batch touches
            used, where = np.unique(np.concatenate([rows[i][0] for i in at]), return_inverse=True)
            x = np.zeros((len(at), len(used)), dtype=np.float32)
            x[np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at]), where] = np.concatenate([rows[i][1] for i in at])
            hidden = x @ embed[used]
            error = _softmax(hidden @ weights + bias)
            error[np.arange(len(at)), label[at]] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = error @ weights.T
            weights -= rate * (hidden.T @ error)
            bias -= rate * error.mean(axis=0)
            # a subword has a small share of a text: scale its step as if its texts were all of it
            embed[used] -= rate * (x.T @ back) / np.maximum(x.sum(axis=0), 1e-6)[:, None] / np.float32(len(at))
            done += 1
    table = embed @ weights
    z = np.array([rows[i][1] @ table[rows[i][0]] + bias for i in np.flatnonzero(aside)]).reshape(-1, len(languages))
    temperature, reject_below = calibrate(z, label[aside])
    return Model(languages, table.astype(np.float64), bias.astype(np.float64), temperature, reject_below)


def calibrate(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(temperature of least negative log likelihood, score that all but
    ``REJECT_SHARE`` of the right languages reach).  As many rows as there are
    cannot show certainty: one more of each language counts as wrong.  Without
    rows: (1, 0)."""
    if not len(z):
        return 1.0, 0.0
    tried = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    doubt = 1 / (len(z) + z.shape[1])
    loss = []
    for t in tried:
        logs = np.log(np.maximum(_softmax(z / t), 1e-12))
        loss.append(-((1 - doubt) * logs[np.arange(len(z)), label] + doubt * logs.mean(axis=1)).mean())
    t = float(tried[int(np.argmin(loss))])
    return t, float(np.quantile(_softmax(z / t)[np.arange(len(z)), label], REJECT_SHARE))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text) of at most ``fit_rows`` labelled documents outside the
    held-out fifth: of each language the first of a hash order, as many as its
    part.  Rows far beyond a language's part are passed over before texts move."""
    usable = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(LETTER_RANGE) & (remainder(F.col("doc_id")) != 0))
    sizes = shared_table(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    n_languages = sizes.count()
    part = max(1, fit_rows // max(1, n_languages))
    # beyond fit_rows languages the largest are learned
    quota = sizes.orderBy(F.col("n").desc(), "lang").limit(fit_rows).select(F.col("lang").alias("of"), "n")
    # rows are drawn, not ids or texts: one that is repeated is neither all in nor all out
    draw = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id(), F.lit(SEED)), F.lit(1_000_000))
    likely = usable.withColumn("draw", draw).join(F.broadcast(quota), F.col("lang") == F.col("of")).filter(
        F.col("draw") < F.ceil(F.lit(2_000_000.0) * part / F.col("n")) + 200)
    by_draw = Window.partitionBy("lang").orderBy("draw", "doc_id")
    return likely.withColumn("place", F.row_number().over(by_draw)).filter(F.col("place") <= part).select("lang", "text", "draw", "doc_id")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS,
          n_buckets: int = BUCKETS) -> Model | None:
    """The model, or None without a labelled text."""

    @F.pandas_udf("struct<at: array<int>, share: array<float>>")
    def described(texts: pd.Series) -> pd.DataFrame:
        ats, shares = [], []
        for text in texts:
            counts = subword_counts(text, n_buckets)
            at = np.flatnonzero(counts)
            ats.append(at.astype(np.int32))
            shares.append((counts[at] / (counts.sum() + PRIOR)).astype(np.float32))
        return pd.DataFrame({"at": ats, "share": shares})

    drawn = sample(docs, id_col, text_col, lang_col, fit_rows)
    # at most fit_rows rows of at most n_buckets shares each reach the driver
    held = shared_table(drawn.select("lang", "draw", "doc_id", described("text").alias("x")), "language-sample").sort(
        "draw", "doc_id", "lang").select("lang", "x.at", "x.share")
    names, rows = [], []
    for row in held.toLocalIterator():
        names.append(row["lang"])
        rows.append((np.array(row["at"], dtype=np.int64), np.array(row["share"], dtype=np.float32)))
    if not rows:
        return None
    languages = sorted(set(names))
    label = np.array([languages.index(x) for x in names])
    return fit(rows, languages, label, n_buckets)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), a row for each document.

    ``rejected`` marks predictions whose score is below the calibrated cut.
    Null texts and texts without a letter, or all texts if none is labelled,
    are ``und`` with score 0, and rejected.  A null id is not held out and not
    learned from.  Repeated rows each keep a row.  Empty input: no rows.  Other
    columns are not read."""
    model = train(docs, id_col, text_col, lang_col, fit_rows)
    readable = F.coalesce(F.col("text").rlike(LETTER_RANGE), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        best, score = held.value.predict(texts.tolist())
        return pd.DataFrame({"lang": [held.value.languages[i] for i in best], "score": score})

    out = rows.select("doc_id", "held_out", readable.alias("readable"), predicted("text").alias("p"))
    score = F.when(F.col("readable"), F.col("p.score")).otherwise(0.0)
    return out.select("doc_id", "held_out", F.when(F.col("readable"), F.col("p.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                      score.alias("score"), (~F.col("readable") | (F.col("p.score") < model.reject_below)).alias("rejected"))
