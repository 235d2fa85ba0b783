"""Song search that forgives: the best catalogue hit of a free text.

Texts and catalogue entries (title and artist) become sets of character
trigrams; a hit has a Jaccard similarity of at least ``min_percent``.  The best
is that of the greatest similarity, then of the smallest track id.

A set-similarity join without all pairs: trigrams have one global order, rarest
in the catalogue first, and two sets that are similar enough share one of the
first ``size - ceil(t * size) + 1`` of each.  Only those are joined, and only
pairs whose sizes allow the similarity are compared, once what may follow the
first shared trigram on either side is enough for it.  Equal texts on either side
are one row, so copies of a song or of a request cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions.scalars import track_url
from cadenza.functions.text import split_ws

MIN_PERCENT = 50


def search_text(*parts: Column) -> Column:
    """Lower case, parts and words joined by one space."""
    return F.lower(F.array_join(split_ws(F.concat_ws(" ", *parts)), " "))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text with a space at either end; empty for an empty text."""
    spaced = F.concat(F.lit(" "), text, F.lit(" "))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(spaced, i, F.lit(3)))
    return F.when(F.length(text) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _prefixes(sets: DataFrame, frequency: DataFrame, min_percent: int) -> DataFrame:
    """A row for each trigram of a set's prefix: (text, size, tokens, place, token)."""
    token = sets.select("text", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    ordered = token.groupBy("text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("by_rarity"))  # of one text
    size = F.size("by_rarity")
    least = F.floor((size * min_percent + 99) / 100)
    return ordered.select("text", size.alias("size"), F.col("by_rarity.token").alias("tokens"),
                          F.posexplode(F.slice(F.col("by_rarity.token"), F.lit(1), (size - least + 1).cast("int"))).alias("place", "token"))


def search_songs(requests: DataFrame, catalogue: DataFrame, text: str = "text", min_percent: int = MIN_PERCENT,
                 url_prefix: str = K.TRACK_URL_PREFIX) -> DataFrame:
    """``requests`` with ``found``, ``track_id``, ``track_url`` and
    ``similarity`` of the best hit in ``catalogue`` (track_id, title, artist).
    A request without a hit, or with a null or empty text, keeps its row."""
    asked = requests.select("*", F.coalesce(search_text(F.col(text)), F.lit("")).alias("_text"))
    songs = catalogue.select("track_id", search_text(F.col("title"), F.col("artist")).alias("text")).groupBy("text").agg(F.min("track_id").alias("track_id"))
    given = songs.select("text", trigrams(F.col("text")).alias("tokens"))
    wanted = asked.select(F.col("_text").alias("text")).distinct().select("text", trigrams(F.col("text")).alias("tokens"))
    frequency = given.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    left = _prefixes(wanted, frequency, min_percent).select(F.col("text").alias("_text"), F.col("size").alias("n"), F.col("tokens").alias("a"), F.col("place").alias("i"), "token")
    right = _prefixes(given, frequency, min_percent).select("text", F.col("size").alias("m"), F.col("tokens").alias("b"), F.col("place").alias("j"), "token")
    # at the first trigram they share, a pair has at most the shorter rest in common; s of n + m - s are shared
    enough = (100 + min_percent) * F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= min_percent * (F.col("n") + F.col("m"))
    near = left.join(right, "token").filter((100 * F.least("n", "m") >= min_percent * F.greatest("n", "m")) & enough)
    shared = F.size(F.array_intersect("a", "b"))
    scored = near.select("_text", "text", shared.alias("shared"), (F.col("n") + F.col("m") - shared).alias("union")).filter(
        100 * F.col("shared") >= min_percent * F.col("union"))
    similarity = F.col("shared") / F.col("union")
    best = scored.join(songs, "text").groupBy("_text").agg(
        F.min_by(F.struct("track_id", similarity.alias("similarity")), F.struct(-similarity, "track_id")).alias("hit"))
    return asked.join(best, "_text", "left").select(
        *requests.columns, F.col("hit").isNotNull().alias("found"), F.col("hit.track_id").alias("track_id"),
        F.when(F.col("hit").isNotNull(), track_url(F.col("hit.track_id"), url_prefix)).alias("track_url"), F.col("hit.similarity").alias("similarity"))
