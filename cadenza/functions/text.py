"""Text column expressions: tokenising, cleaning, stop-word filters.

All of these are native Spark expressions (higher-order array functions), so
they run inside the JVM with no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza import constants as K

# Whitespace as Python's ``str.split()`` and ``str.strip()`` see it: the Unicode
# spaces and the four information separators, which regexes do not count.
WS_CLASS = r"[\s\x1C-\x1F\x{85}\p{Z}]"
WS = WS_CLASS + "+"
LETTERS_ONLY = r"^\p{L}+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _distinct(words: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(words))


def split_ws(text) -> Column:
    """Split on whitespace runs and drop empty tokens (Python ``str.split()``)."""
    parts = F.split(_col(text), WS)
    return F.filter(parts, lambda w: w != F.lit(""))


def theme_tokens(text, stopwords: Iterable[str] | None = None) -> Column:
    """Lower-case tokens kept for themes: not a stop word, longer than two
    code points and letters only.  ``love,`` and ``don't`` are dropped, not
    stripped."""
    # ``isin`` over more than a handful of literals becomes a hash-set lookup
    stop = _distinct(K.THEME_STOPWORDS_LISTED if stopwords is None else stopwords)
    toks = split_ws(F.lower(_col(text)))
    return F.filter(
        toks,
        lambda w: (F.length(w) > 2) & w.rlike(LETTERS_ONLY) & (~w.isin(stop) if stop else F.lit(True)),
    )


def drop_stopwords_keep_case(text, stopwords: Iterable[str]) -> Column:
    """Offline cleaning: split on whitespace, drop tokens whose lower-case form
    is a stop word, keep the original case and punctuation, join with one
    space."""
    stop = _distinct(stopwords)
    toks = split_ws(_col(text))
    return F.array_join(F.filter(toks, lambda w: ~F.lower(w).isin(stop)), " ")


def strip_ws(text) -> Column:
    """Strip leading and trailing whitespace of any kind (SQL ``trim`` only
    strips spaces)."""
    return F.regexp_replace(_col(text), rf"^{WS}|{WS}\z", "")


def null_na_strings(c, na: Iterable[str] = K.NA_STRINGS) -> Column:
    """Turn the pandas default NA strings into null."""
    col = _col(c)
    return F.when(col.isin(list(na)), F.lit(None).cast("string")).otherwise(col)


def english_stopwords() -> list[str]:
    """Spark MLlib's default English stop-word list (the general list the
    offline job unions with its custom words).  Read straight from the MLlib
    jar so no JVM is needed -- the SQL oracle uses the very same list; falls
    back to ``StopWordsRemover`` when the jar is not on disk."""
    import glob
    import os
    import zipfile

    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if jars:
        with zipfile.ZipFile(jars[0]) as z:
            return z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8").split()
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def offline_stopwords() -> list[str]:
    """General English list united with the offline job's custom words."""
    return list(dict.fromkeys(english_stopwords() + list(K.CUSTOM_STOPWORDS_LISTED)))
