"""Removal of repeated byte strings by two-stage suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere
in the corpus is removed.  Suffix arrays of a whole corpus do not fit a task,
so equal strings are first brought together:

1. *Sampling.*  Hashes of ``GRAM`` bytes are sampled by minima over sliding
   windows; which ones a string samples depends on the string alone.  Samples
   are counted over the corpus with partial sums.
2. *Fragments.*  A string that repeats has only repeated samples.  The maximal
   runs of such strings with one least sample (the key) are cut out of the
   texts as fragments; equal strings lie in fragments of one key.
3. *Equal fragments* are counted with partial sums; two or more repeat as a
   whole.  Their bytes travel once from each task.
4. *Suffix sorting.*  The different fragments of a key meet in a task, which
   sorts their suffixes in two stages: suffixes smaller than their successors
   are sorted directly, all others are induced by scanning the buckets of
   first bytes.  Neighbours in the suffix array with a common prefix of
   ``LENGTH`` bytes repeat.
5. Keys with more than ``HOT_FRAGMENTS`` different fragments (text around a
   line that is everywhere) would make one task long: their strings are dealt
   out by a 128-bit hash of the string and compared by it, exactly as often.
6. Repeated strings are mapped back through the fragments to documents.

Nothing is dropped or capped: steps 1 and 2 only leave out strings that cannot
repeat.  A task holds fragments of about ``SORT_BYTES`` at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table

LENGTH = 200
GRAM = 16
SAMPLE = 128  # grams in a sampling window; with GRAM at most LENGTH bytes
HOT_FRAGMENTS = 400
SORT_BYTES = 2_000_000
SEEN_FRAGMENTS = 200_000  # equal fragments that a task remembers
SCAN_STRINGS = 1 << 20  # longer texts are scanned piece by piece
PARTITION_BYTES = 16_000_000
_U = np.uint64
_MIX, _BASE = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of each ``gram`` bytes; ``gram`` a power of two."""
    h = (text.astype(np.uint64) + _U(1)) * _U(_MIX)
    h ^= h >> _U(31)
    step, base = 1, _BASE
    while step < gram:
        h = h[:-step] * _U(base) + h[step:]
        step, base = 2 * step, base * base % 2**64
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def sliding(values: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours, by doubling."""
    out, step = values, 1
    while 2 * step <= width:
        out, step = least(out[:-step], out[step:]), 2 * step
    return out if step == width else least(out[:len(out) - (width - step)], out[width - step:])


def pieces(raw: bytes, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces that together hold each string once."""
    n = len(raw) - length + 1
    for at in range(0, n, SCAN_STRINGS):
        yield at, np.frombuffer(raw, dtype=np.uint8, count=min(SCAN_STRINGS, n - at) + length - 1, offset=at)


def samples(piece: np.ndarray) -> np.ndarray:
    """The hash of each sampled position of a piece, with repeats."""
    h = gram_hashes(piece)
    low = sliding(h, SAMPLE)
    edge = np.zeros(SAMPLE - 1, dtype=np.uint64)
    return h[sliding(np.concatenate([edge, low, edge]), SAMPLE, np.maximum) == h]


def fragments(raw: bytes, repeated: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, bool]]:
    """(key, start, strings, inner) of the runs of strings all of whose samples
    are in ``repeated`` (sorted) and whose least sample is the key; ``inner``:
    the run has the key more than once, so its strings may repeat in it."""
    for offset, piece in pieces(raw, length):
        hashes = gram_hashes(piece)
        low = sliding(hashes, SAMPLE)
        at = np.minimum(np.searchsorted(repeated, low), len(repeated) - 1)
        unique = np.concatenate(([0], np.cumsum(repeated[at] != low)))
        per = length - GRAM + 1 - SAMPLE + 1  # sampling windows in a string
        good = unique[per:] == unique[:-per]
        key = sliding(low, per)
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (good[1:] != good[:-1]))))
        ends = np.append(cut[1:], len(key))
        for a, b in zip(cut[good[cut]].tolist(), ends[good[cut]].tolist()):
            yield int(key[a]), offset + a, b - a, np.count_nonzero(hashes[a:b + length - GRAM] == key[a]) > 1


# --- two-stage suffix sorting -------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions of ``text`` (which ends in ``depth`` + 8 zero bytes that
    are no positions) by their suffixes, exact to ``depth`` bytes at least.

    Stage one sorts the suffixes that are smaller than their successors, eight
    bytes at a time and only while ties remain.  Stage two scans the buckets of
    first bytes in order: the predecessor of a suffix that is in place, if it
    is larger than that suffix, comes next in the bucket of its own byte."""
    n = len(text) - depth - 8
    words = _words(text)
    step = np.sign(text[1:n + 1].astype(np.int16) - text[:n])
    where = np.where(step != 0, np.arange(n), n - 1)
    decides = np.minimum.accumulate(where[::-1])[::-1]  # next place where neighbours differ
    smaller = step[decides] > 0
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    head = np.concatenate(([True], words[direct[1:]] != words[direct[:-1]])) if len(direct) else np.empty(0, dtype=bool)
    group = np.cumsum(head)
    active = _tied(head)
    for d in range(8, depth, 8):
        if not len(active):
            break
        own, tie = words[direct[active] + d], group[active]
        order = np.lexsort((own, tie))
        direct[active], own = direct[active][order], own[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (tie[1:] != tie[:-1])))
        head[active] = new
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))] + n
        active = active[_tied(new)]
    ready = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    none = np.empty(0, dtype=np.int64)
    waiting: list[list[np.ndarray]] = [[none] for _ in range(256)]
    if n and not smaller[n - 1]:  # its successor, the padding, comes before all
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level, larger = np.concatenate(waiting[c]), []
        while len(level):
            larger.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & ~smaller[before]]
        bucket = np.concatenate(larger + [ready[c]]).astype(np.int64)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > c)]
        by = text[before]
        order = np.argsort(by, kind="stable")
        for own in np.split(before[order], np.flatnonzero(np.diff(by[order])) + 1):
            if len(own):
                waiting[text[own[0]]].append(own)
    return np.concatenate(out)


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a number of the same order."""
    n = len(text) - 8
    out = np.zeros(n + 1, dtype=np.uint64)
    for k in range(8):
        out = (out << _U(8)) | text[k:n + 1 + k]
    return out


def _tied(head: np.ndarray) -> np.ndarray:
    """Places in groups of two or more; ``head`` marks the first of a group."""
    last = np.append(head[1:], True)
    return np.flatnonzero(~(head & last))


def repeated_strings(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its strings of ``length`` bytes occur twice or
    more among all parts."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"".join(parts) + bytes(length + 8), dtype=np.uint8)
    n = int(sizes.sum())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    left = np.repeat(starts + sizes, sizes) - np.arange(n)
    whole = left >= length  # strings that do not run into the next part
    order = suffix_order(text, length)
    words = _words(text)
    same = np.arange(1, n)  # neighbours with a common prefix of `length` bytes
    for d in [*range(0, length - 7, 8), length - 8]:
        same = same[words[order[same - 1] + d] == words[order[same] + d]]
    head = np.ones(n, dtype=bool)
    head[same] = False
    group = np.cumsum(head) - 1
    found = np.zeros(n, dtype=bool)
    found[order] = np.bincount(group, weights=whole[order])[group] > 1
    found &= whole
    return [found[a:a + s - length + 1] for a, s in zip(starts.tolist(), sizes.tolist())]


# --- the same, as a Spark job -------------------------------------------------------

def _ranges(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    yield from edge.reshape(-1, 2).tolist()


def _sample_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, found = [], []
        for k, text in zip(batch["k1"], batch["text"]):
            own = [samples(piece) for _, piece in pieces(text.encode("utf-8"))]
            found += own
            keys += [k] * len(own)
        if found:
            yield pd.DataFrame({"k1": np.repeat(np.array(keys, dtype=np.int64), [len(x) for x in found]),
                                "sample": np.concatenate(found).view(np.int64)})


def _fragment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each fragment; its bytes come with the first of equal ones."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        rows = []
        for k1, k2, text, known in zip(batch["k1"], batch["k2"], batch["text"], batch["known"]):
            raw = text.encode("utf-8")
            for key, start, strings, inner in fragments(raw, np.sort(np.asarray(known, dtype=np.int64).view(np.uint64))):
                part = raw[start:start + strings + LENGTH - 1]
                f = np.frombuffer(xxhash.xxh3_128_digest(part), dtype=np.int64).tolist()
                new = (f[0], f[1]) not in seen
                if new:
                    if len(seen) >= SEEN_FRAGMENTS:
                        seen.clear()
                    seen.add((f[0], f[1]))
                rows.append((key, f[0], f[1], k1, k2, start, strings, inner, part if new else None))
        if rows:
            out = pd.DataFrame(rows, columns=["key", "f1", "f2", "k1", "k2", "start", "strings", "inner", "part"])
            yield out.assign(key=out["key"].to_numpy(dtype=np.uint64).view(np.int64))


def _sort_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments ordered by key to ranges of repeated strings: whole keys are
    gathered to about ``SORT_BYTES`` and sorted together.  Equal fragments
    from several tasks are one."""

    def solved(held: dict) -> pd.DataFrame:
        flags = repeated_strings(list(held.values()))
        out = [(*f, a, b) for f, own in zip(held, flags) for a, b in _ranges(own)]
        return pd.DataFrame(out, columns=["f1", "f2", "first", "last"])

    held: dict[tuple[int, int], bytes] = {}
    own: dict[tuple[int, int], bytes] = {}  # of the key at hand
    key, several, size = None, False, 0
    for batch in batches:
        for k, f1, f2, inner, part in zip(batch["key"], batch["f1"], batch["f2"], batch["inner"], batch["part"]):
            if k != key:
                if several or len(own) > 1:  # one fragment without its key twice has nothing to sort
                    held |= own
                    size += sum(map(len, own.values()))
                key, own, several = k, {}, False
                if size >= SORT_BYTES:
                    yield solved(held)
                    held, size = {}, 0
            own[f1, f2] = part
            several |= inner
    if several or len(own) > 1:
        held |= own
    if held:
        yield solved(held)


def _string_hashes(part: bytes) -> np.ndarray:
    """Two 64-bit hashes of each string of a fragment."""
    text = np.frombuffer(part, dtype=np.uint8).astype(np.uint64) + _U(1)
    out = []
    for base in (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93):
        power, h, done = base, text * _U(_MIX), 1
        whole, have = None, 0
        while True:  # strings of LENGTH bytes from those of powers of two
            if LENGTH & done:
                whole = h if whole is None else whole[:len(whole) - done] * _U(power) + h[have:]
                have += done
                if have == LENGTH:
                    break
            h = h[:-done] * _U(power) + h[done:]
            power, done = power * power % 2**64, 2 * done
        n = len(part) - LENGTH + 1
        h = whole[:n].copy()
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> _U(32)))
    return np.stack(out, axis=1)


def _deal_rows(buckets: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of hot fragments, packed by bucket of their hash."""
    for batch in batches:
        if not len(batch):
            continue
        hashes = [_string_hashes(p) for p in batch["part"]]
        n = [len(h) for h in hashes]
        packed = np.column_stack([np.concatenate(hashes), np.repeat(batch[["f1", "f2"]].to_numpy(dtype=np.int64).view(np.uint64), n, axis=0),
                                  np.concatenate([np.arange(x, dtype=np.uint64) for x in n])])
        yield _packed("bucket", packed, (packed[:, 0] % _U(buckets)).astype(np.int64))


def _by_bucket(name: str, batches: Iterator[pd.DataFrame], width: int) -> Iterator[np.ndarray]:
    """The packed rows of each whole bucket, from rows in order of bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, packed in zip(batch[name], batch["packed"]):
            if held and b != bucket:
                yield np.concatenate(held)
                held = []
            bucket = b
            held.append(np.frombuffer(packed, dtype=np.uint64).reshape(-1, width))
    if held:
        yield np.concatenate(held)


def _packed(name: str, rows: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return pd.DataFrame([(int(bucket[own[0]]), rows[own].tobytes()) for own in np.split(order, cut) if len(own)],
                        columns=[name, "packed"])


def _sorted_rows(rows: np.ndarray) -> np.ndarray:
    """Rows in order, each once."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate(([True], np.any(rows[1:] != rows[:-1], axis=1)))]


def _compare_rows(buckets: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings dealt by hash to the repeated ones, packed by fragment."""
    for rows in _by_bucket("bucket", batches, 5):
        rows = _sorted_rows(rows)
        rows = rows[_tied(np.concatenate(([True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)))), 2:]
        yield _packed("home", rows, (rows[:, 0] % _U(buckets)).astype(np.int64))


def _range_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated strings of a fragment to ranges of them."""
    for rows in _by_bucket("home", batches, 3):
        rows = _sorted_rows(rows)
        new = np.concatenate(([True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1) | (rows[1:, 2] != rows[:-1, 2] + _U(1))))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        f = rows[first, :2].view(np.int64)
        yield pd.DataFrame({"f1": f[:, 0], "f2": f[:, 1], "first": rows[first, 2].astype(np.int64),
                            "last": rows[last, 2].astype(np.int64) + 1})


def remove_spans(raw: bytes, starts, ends) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, the rest) for the strings that
    start in [start, end), given as arrays in any order."""
    out, removed, runs, at = [], 0, 0, 0
    order = np.argsort(starts, kind="stable")
    begin = end = -1
    for a, b in [*zip(np.asarray(starts)[order].tolist(), (np.asarray(ends)[order] + LENGTH - 1).tolist()), (len(raw) + 1, 0)]:
        if a > end:
            if end >= 0:
                out.append(raw[at:begin])
                removed, runs, at = removed + end - begin, runs + 1, end
            begin, end = a, b
        else:
            end = max(end, b)
    return removed, runs, b"".join(out) + raw[at:]


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(k1, k2, starts, ends): for each text with repeated strings, ranges of
    their starts, from (k1, k2, text) with a 128-bit key of each row.  Rows
    that share a key are repeats of one another.

    Samples carry half of the key: texts that share it would only be handed
    each other's repeated samples too, which changes no result."""
    schema = "key long, f1 long, f2 long, k1 long, k2 long, start long, strings long, inner boolean, part binary"
    spans, packed = "f1 long, f2 long, first long, last long", "long, packed binary"
    sampled = shared_table(texts.select("k1", "text").mapInPandas(_sample_rows, "k1 long, sample long"), "suffix-samples")
    repeated = shared_table(sampled.groupBy("sample").count().filter("count > 1").select("sample"), "suffix-repeated")
    known = sampled.join(repeated, "sample").groupBy("k1").agg(F.collect_set("sample").alias("known"))
    cut = shared_table(texts.join(known, "k1").mapInPandas(_fragment_rows, schema), "suffix-fragments")
    counts = shared_table(cut.groupBy("key", "f1", "f2", "strings").agg(F.count(F.lit(1)).alias("n")), "suffix-counts")
    hot_keys = shared_table(counts.groupBy("key").count().filter(F.col("count") > HOT_FRAGMENTS).select("key"), "suffix-hot")
    parts = cut.filter("part IS NOT NULL").select("key", "f1", "f2", "inner", "part")
    size = cut.agg(F.sum(F.length("part"))).first()[0] or 0
    hot_strings = counts.join(hot_keys, "key", "left_semi").agg(F.sum("strings")).first()[0] or 0
    at_least = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_cold = max(at_least, math.ceil(size / PARTITION_BYTES))
    n_hot = max(at_least, math.ceil(40 * hot_strings / PARTITION_BYTES))
    cold = (parts.join(hot_keys, "key", "left_anti").repartition(n_cold, "key")
            .sortWithinPartitions("key").mapInPandas(_sort_rows, spans))
    dealt = (parts.join(hot_keys, "key", "left_semi").select("f1", "f2", "part")
             .mapInPandas(lambda b: _deal_rows(n_hot, b), f"bucket {packed}"))
    hot = (dealt.repartition(n_hot, "bucket").sortWithinPartitions("bucket")
           .mapInPandas(lambda b: _compare_rows(n_hot, b), f"home {packed}")
           .repartition(n_hot, "home").sortWithinPartitions("home").mapInPandas(_range_rows, spans))
    whole = counts.filter("n > 1").select("f1", "f2", F.lit(0).cast("long").alias("first"), F.col("strings").alias("last"))
    found = shared_table(whole.unionByName(cold).unionByName(hot), "suffix-found")
    return (cut.select("f1", "f2", "k1", "k2", "start").join(found, ["f1", "f2"]).groupBy("k1", "k2").agg(
        F.collect_list(F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last")).alias("b"))).alias("own"))
        .select("k1", "k2", F.col("own.a").alias("starts"), F.col("own.b").alias("ends")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each
    document, over its UTF-8 bytes.  Bytes are judged on the input, overlaps
    included; strings never cross documents.

    Null texts are empty; texts under ``LENGTH`` bytes stay whole.  Rows that
    repeat, with or without an id, are documents of their own and repeat each
    other.  Empty input: no rows.  Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = rows.select("doc_id", "text", F.xxhash64(name, "text").alias("k1"), F.xxhash64(F.lit(LENGTH), "text", name).alias("k2"))
    ranges = repeated_ranges(keyed.select("k1", "k2", "text"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def cleaned(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(texts, starts, ends):
            raw = text.encode("utf-8")
            removed, runs, rest = (0, 0, raw) if a is None else remove_spans(raw, a, b)
            out.append((len(raw), removed, runs, hashlib.sha256(rest).hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed.join(ranges, ["k1", "k2"], "left")
    return joined.select("doc_id", cleaned("text", "starts", "ends").alias("m")).select("doc_id", "m.*")
