"""Text quality rules, judged per host.

Each text is measured once and put to every rule: too short, repeated passages,
symbols, repeated lines.  A rule's failures are summed by host, each host's
failure rate is shrunk towards that of all hosts with a beta prior of the rule,
fitted to the hosts by the method of moments, and the verdict on a host, which
no rule may fail too often, is joined back to its documents.  The sums are
partial aggregates, so a host with a third of all rows is no hot key; the join
sees one row for each host.

A text is read in pieces: what is held of it is a number for each word, its
distinct words and a short digest of each long line.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
MAX_SYMBOL_PERCENT = 20  # of the characters in words
MAX_DUP_LINE_PERCENT = 50  # of the lines with a word
SPACES = " \t\n\r\x0b\x0c"
PIECE = 1 << 20  # characters that become words at once
_SPACE = re.compile(f"[{SPACES}]")
SHORT_LINE = 64


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that end where a word does."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def word_numbers(text: str) -> tuple[np.ndarray, int]:
    """(a number for each word, equal for equal words; distinct words)."""
    ids: dict[bytes, int] = {}
    parts = [np.zeros(0, dtype=np.int64)]
    for piece in _pieces(text):
        words = piece.encode("utf-8").split()
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words)))
    return np.concatenate(parts), len(ids)


def repeated_words(seq: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the text has
    twice or more, all occurrences included."""
    n = len(seq) - window + 1
    if n < 2:
        return 0
    key, top = seq[:n], distinct
    for k in range(1, window):
        if top * distinct >= 2**63:  # renumber before a key outgrows 64 bits
            key, top = np.unique(key, return_inverse=True)[1], n
        key, top = key * np.int64(distinct) + seq[k:n + k], top * distinct
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(seq), dtype=bool)
    for k in range(window):
        covered[k:n + k] |= hit
    return int(covered.sum())


def line_counts(text: str) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    seen: set[str | bytes] = set()
    lines = 0
    for line in io.StringIO(text, newline="\n"):
        line = line.removesuffix("\n")
        if line.strip(SPACES):
            lines += 1
            seen.add(line if len(line) <= SHORT_LINE else hashlib.blake2b(line.encode("utf-8"), digest_size=16).digest())
    return lines, lines - len(seen)


def measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    seq, distinct = word_numbers(text)
    lines, dup = line_counts(text)
    return (len(seq), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(seq, distinct), lines)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure_column(text: Column) -> Column:
    """The measures of a text as a struct."""

    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        return pd.DataFrame(np.array([measures(t) for t in texts], dtype=np.int64).reshape(-1, len(names)), columns=names)

    return measured(text)


def rules(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> dict[str, Column]:
    """Whether a document fails each rule, over the measured columns."""
    return {
        "short": F.col("n_words") < min_words,
        "repeats": 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }


BASE_RULES = ("short", "repeats")  # a document that fails one of these goes, whatever its host


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, rate_<rule>..., host_rate, host_ok) from (host, fails_<rule>...),
    a row for each host, null included; ``host_rate`` is the largest.  A rule's
    prior has the mean of all rows and, as its weight, what the spread between
    hosts beyond chance calls for; where hosts do not differ beyond chance the
    weight is all rows."""
    names = [c.removeprefix("fails_") for c in judged.columns if c.startswith("fails_")]
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in names])
    each = hosts.select("host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("f")) for r in names])).alias("x")).select(
        "host", "n", "x.rule", "x.f")
    total = each.groupBy("rule").agg(F.sum("n").alias("N"), F.sum("f").alias("f_all"), F.count(F.lit(1)).alias("H"),
                                     F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")).select(
        "rule", "N", "H", (F.col("f_all") / F.col("N")).alias("mean"), "ff")
    mean = F.col("mean")
    chance = mean * (1 - mean) * F.col("H") / F.col("N")
    between = F.col("ff") / F.col("N") - mean * mean - chance
    weight = F.when(between > 1e-12, F.greatest(F.lit(1.0), F.least(F.col("N").cast("double"), mean * (1 - mean) / between - 1))
                    ).otherwise(F.col("N").cast("double"))
    prior = total.select("rule", "mean", weight.alias("weight"))
    rated = each.join(F.broadcast(prior), "rule").withColumn("rate", (F.col("f") + mean * F.col("weight")) / (F.col("n") + F.col("weight")))  # a row for each rule
    wide = rated.groupBy("host").agg(*[F.max(F.when(F.col("rule") == r, F.col("rate"))).alias(f"rate_{r}") for r in names])
    return wide.withColumn("host_rate", F.greatest(*[F.col(f"rate_{r}") for r in names])).withColumn("host_ok", F.col("host_rate") <= max_rate)


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, host, the measures, fails_<rule>..., base_failed,
    rate_<rule>..., host_rate, kept), a row for each document.

    Null and empty texts have no words and fail.  Null hosts are one host of
    their own.  Repeated rows each count.  Empty input: no rows.  Other
    columns are not read."""
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                           measure_column(F.col(text_col)).alias("m")).select("doc_id", "host", "m.*")
    failures = {f"fails_{name}": fails for name, fails in rules().items()}
    base = F.lit(False)
    for name in BASE_RULES:
        base = base | F.col(f"fails_{name}")
    judged = shared_table(measured.withColumns(failures).withColumn("base_failed", base), "host-judged")
    verdicts = shared_table(host_verdicts(judged, max_rate), "host-verdicts")
    named = verdicts.withColumnRenamed("host", "of_host")
    rates = {c: F.round(c, 6) for c in verdicts.columns if "rate" in c}
    return judged.join(named, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host").withColumn(
        "kept", ~F.col("base_failed") & F.col("host_ok")).withColumns(rates).drop("host_ok")
