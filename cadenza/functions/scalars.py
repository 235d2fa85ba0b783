"""Scalar column helpers: parsers, lookups, deterministic random keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cluster_id_from_name(name) -> Column:
    """``demo_cluster_10.png`` -> 10: text before the first ``.``, last ``_``
    part, as int; anything unparsable -> null."""
    stem = F.split_part(_col(name), F.lit("."), F.lit(1))
    last = F.element_at(F.split(stem, "_"), -1)
    return last.try_cast("int")


def first_image_url(images) -> Column:
    """URL of the first element of ``array<struct<url>>``; null when empty or
    null (``get`` never throws, unlike ``element_at`` under ANSI)."""
    return F.get(_col(images), 0).getField("url")


def track_query(title, artist) -> Column:
    """Search key ``track:{title} artist:{artist}``."""
    return F.concat(F.lit("track:"), _col(title), F.lit(" artist:"), _col(artist))


def track_url(track_id, prefix: str = K.TRACK_URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), _col(track_id))


def sample_key(id_col, seed: int = K.SEED) -> Column:
    """Hex md5 of ``'{seed}:{id}'``: a reproducible pseudo-random order that
    does not depend on partitioning.  Sorting by it (then by id) draws a
    uniform sample without replacement."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), _col(id_col).cast("string")))


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp column, read as
    wall-clock time (works for TIMESTAMP_NTZ and does not depend on the
    session time zone)."""
    return F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(ts).cast("timestamp_ntz")
    )
