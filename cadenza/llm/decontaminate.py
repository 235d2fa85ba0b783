"""Benchmark leaks by template windows and slot consistency.

Texts become sequences of canonical tokens: numbers, units after a number and
names inside a sentence are typed placeholders (slots), other tokens their
lower-case letters and digits.  Windows of ``WINDOW`` canonical tokens of all
benchmark items form a hash table, and so do their windows of lower-case words
as they are, also those of mostly slots: a copy in other case, or with a name
where a sentence begins, is found by the second.  Windows of the documents are
looked up in both forms, and a word agrees in either.  A hit is extended to both sides, over gaps of at most ``MAX_SHIFT`` words
on either side after which ``RESYNC`` words agree again, to a chain of matched
words.  A chain is split where a value of the item would stand for a second
value of the document.  A document is contaminated by an item if a chain fills
at least ``MIN_COVERAGE`` of the item's windows: with n matched words as many
as n words in a row have.  A verbatim copy maps every value to itself; a
question with other numbers, names or units, or with words put in, left out or
changed, is caught as well.

Items under ``LONG_WORDS`` words start from shorter windows, so that one changed
word leaves a whole one.  Items under ``MIN_WORDS`` words are too common inside
other text; they leak as a line or text of their own.  Scripts written without
spaces have a word for each character.

The benchmark is read in chunks of at most ``CHUNK_WINDOWS`` windows, so what
a task holds is bounded whatever its size; each chunk is one pass over the
documents, without a shuffle.  Hits are checked in the task that finds them,
so a passage that a third of the documents share is no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
LONG_WORDS = 16
SHORT_WINDOWS = ((8, 3), (LONG_WORDS, 4))  # of items under so many words
MIN_WORDS = 5  # shorter items leak as a line of their own only
MIN_COVERAGE = 0.5
MIN_PLAIN = 0.5  # of a window's tokens, so that slots alone never match
MAX_SHIFT = 8  # words of a gap in a chain, on either side
RESYNC, SHORT_RESYNC = 3, 2  # words that agree after a gap, in items of LONG_WORDS words and in shorter ones
CHUNK_WINDOWS = 2_000_000
CACHE_WORDS = 500_000
SLICE_CHARS = 2_000_000

#: Units of measure after a number.
UNITS = frozenset((
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce "
    "ounces ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week "
    "weeks month months year years percent dollar dollars euro euros cent cents degree degrees watt watts volt volts mph").split())

#: Numbers as words ("one" is more often none).
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

#: Ranges of scripts that are written without spaces (Thai to Lao, Burmese, Khmer, kana, ideographs).
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")
_NUMBER = re.compile(r"[$€£+-]?[0-9]+(?:[.,:/][0-9]+)*(?:%|st|nd|rd|th)?$")
_EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
_SLOT_HASH = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D


def split_words(text: str | None) -> list[str]:
    """The words of a text; each character of a script without spaces is one."""
    if not text:
        return []
    return (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).split()


def seed_window(n_words: int, window: int) -> int:
    """The window length from which a copy of an item is found."""
    return min(window, next((w for under, w in SHORT_WINDOWS if n_words < under), window))


class Words(dict):
    """Facts about raw words, computed once for each: row number in the
    tables.  ``core`` is the lower-case word without punctuation around it."""

    def __init__(self):
        super().__init__()
        self.core: list[str] = []
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.ends: list[bool] = []

    def __missing__(self, word: str) -> int:
        core = _EDGES.sub("", word)
        low = core.lower()
        number = bool(_NUMBER.match(core)) or low in NUMBER_WORDS
        capital = core[:1].isupper() and core[1:].islower() and len(core) > 1
        self[word] = row = len(self.core)
        self.core.append(low)
        self.hash.append(xxhash.xxh64_intdigest(low))
        self.kind.append(NUMBER if number else UNIT if low in UNITS else NAME if capital else PLAIN)
        self.ends.append(word.rstrip("\"')]»”")[-1:] in ".!?:;" if word else True)
        return row

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (np.array(self.hash, dtype=np.uint64), np.array(self.kind, dtype=np.int8), np.array(self.ends, dtype=bool))


def canonical(words: Words, ids: np.ndarray, first: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, slot types) of a token sequence; ``first`` marks the first
    token of each text.  A unit counts after a number, a name inside a
    sentence; otherwise they are plain."""
    hashes, kinds, ends = tables
    kind = kinds[ids]
    before = np.concatenate(([PLAIN], kind[:-1]))
    opens = np.concatenate(([True], ends[ids][:-1])) | first
    slot = np.where((kind == NUMBER) | ((kind == UNIT) & (before == NUMBER) & ~first) | ((kind == NAME) & ~opens), kind, PLAIN)
    return np.where(slot == PLAIN, hashes[ids], _SLOT_HASH[slot]), slot


def rolling(hashes: np.ndarray, window: int) -> np.ndarray:
    """Hash of each window of canonical tokens."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, window):
        out *= np.uint64(_BASE)
        out += hashes[k:n + k]
    return out ^ (out >> np.uint64(29))


_GAP = np.arange(MAX_SHIFT + 1)
_GAP_COST = 2 * np.add.outer(_GAP, _GAP) + np.abs(np.subtract.outer(_GAP, _GAP))


def _agree(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether two rows of hashes agree, column by column."""
    return (item == text).any(axis=0)


def runs(item: np.ndarray, text: np.ndarray, resync: int = RESYNC) -> Iterator[tuple[int, int, int]]:
    """(place, at, length) of the runs of words in which item and text agree,
    from the start of both on, over gaps after which ``resync`` words agree.
    Hashes have a row for each kind."""
    p = a = 0
    while n := min(item.shape[1] - p, text.shape[1] - a):
        same = _agree(item[:, p:p + n], text[:, a:a + n])
        length = n if same.all() else int(same.argmin())
        if length:
            yield p, a, length
        if length == n:
            return
        p, a, span = p + length, a + length, MAX_SHIFT + resync
        same = _agree(item[:, p:p + span, None], text[:, None, a:a + span])
        rows, cols = (max(0, k - resync + 1) for k in same.shape)
        again = np.ones((rows, cols), dtype=bool)
        for k in range(resync):
            again &= same[k:rows + k, k:cols + k]
        if not again.any():
            return
        skip, skipped = divmod(int(np.where(again, _GAP_COST[:rows, :cols], 99).argmin()), cols)
        p, a = p + skip, a + skipped


class Benchmark:
    """A chunk of benchmark items with its hash tables, one for each window
    length (:func:`seed_window`), and the short items as a whole."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        words = Words()
        self.ids, self.cores, self.slots, self.hashes, self.usable = [], [], [], [], []
        self.whole: dict[tuple[str, ...], list] = {}
        entries: dict[int, list] = {}
        for item_id, text in items:
            ids = np.array([words[w] for w in split_words(text)], dtype=np.int64)
            if len(ids) < MIN_WORDS:
                if len(ids):
                    self.whole.setdefault(tuple(words.core[i] for i in ids), []).append(item_id)
                continue
            first = np.zeros(len(ids), dtype=bool)
            first[0] = True
            hashes, slot = canonical(words, ids, first, words.tables())
            length = seed_window(len(ids), window)
            plain = np.concatenate(([0], np.cumsum(slot == PLAIN)))
            usable = plain[length:] - plain[:-length] >= MIN_PLAIN * length
            at = len(self.ids)
            self.ids.append(item_id)
            self.cores.append([words.core[i] for i in ids])
            self.slots.append(slot)
            plain_hashes = words.tables()[0][ids]
            self.hashes.append(np.stack([hashes, plain_hashes]))
            self.usable.append(usable)
            rolled, exact = rolling(hashes, length), rolling(plain_hashes, length)
            places, slotted = np.flatnonzero(usable), np.flatnonzero(~usable | (rolled != exact))
            entries.setdefault(length, []).append((np.concatenate([rolled[places], exact[slotted]]),
                                                   np.full(len(places) + len(slotted), at), np.concatenate([places, slotted])))
        self.tables = {}
        for length, parts in entries.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((place, item, h))
            h = h[order]
            seen = np.zeros(2**20, dtype=bool)  # a quick no for almost all windows
            seen[(h & np.uint64(2**20 - 1)).astype(np.int64)] = True
            self.tables[length] = h, seen, item[order], place[order]

    def hits(self, texts: list[str | None], words: Words) -> Iterator[tuple[int, int, int, float]]:
        """(row, item_id, windows, coverage) of the contaminated texts."""
        if self.whole:
            yield from self._alone(texts, words)
        split = [split_words(t) for t in texts]
        lengths = np.array([len(w) for w in split], dtype=np.int64)
        if not lengths.sum():
            return
        ids = np.fromiter((words[w] for ws in split for w in ws), dtype=np.int64, count=int(lengths.sum()))
        row = np.repeat(np.arange(len(split)), lengths)
        first = np.concatenate(([True], row[1:] != row[:-1]))
        begins = np.concatenate(([0], np.cumsum(lengths)))
        tables = words.tables()
        hashes = np.stack([canonical(words, ids, first, tables)[0], tables[0][ids]])
        for length, (known, seen, items, places) in self.tables.items():
            rolled, exact = rolling(hashes[0], length), rolling(hashes[1], length)
            other = np.flatnonzero(rolled != exact)
            window, at = np.concatenate([rolled, exact[other]]), np.concatenate([np.arange(len(rolled)), other])
            maybe = seen[(window & np.uint64(2**20 - 1)).astype(np.int64)]
            window, at = window[maybe], at[maybe]
            inside = row[at] == row[at + length - 1]
            window, at = window[inside], at[inside]
            lo, hi = np.searchsorted(known, window, "left"), np.searchsorted(known, window, "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(at):
                continue
            entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            item, place = items[entry], places[entry]
            order = np.lexsort((place, at, item, row[at]))
            key = np.stack([row[at], item])[:, order]
            cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
            for group in np.split(order, cuts):
                r, k = int(row[at[group[0]]]), int(item[group[0]])
                lo, hi = begins[r], begins[r + 1]
                filled, coverage = self._best(k, place[group], at[group] - lo, length, hashes[:, lo:hi], words, ids[lo:hi])
                if coverage >= MIN_COVERAGE:
                    yield r, self.ids[k], filled, coverage

    def _alone(self, texts: list[str | None], words: Words) -> Iterator[tuple[int, int, int, float]]:
        """Short items that a line, or the whole text, consists of."""
        for row, text in enumerate(texts):
            found = {}
            for line in {text or "", *(text or "").split("\n")}:
                if len(line) and len(w := split_words(line)) < MIN_WORDS:
                    found |= dict.fromkeys(self.whole.get(tuple(words.core[words[x]] for x in w), ()))
            yield from ((row, item_id, 1, 1.0) for item_id in found)

    def _best(self, k: int, places: np.ndarray, at: np.ndarray, length: int, text: np.ndarray,
              words: Words, ids: np.ndarray) -> tuple[int, float]:
        """(windows, coverage) of the best chain through hits of one item."""
        codes, left, best = places + at * len(self.cores[k]), np.ones(len(at), dtype=bool), (0, 0.0)
        while best[1] < 1.0 and left.any():
            one = int(left.argmax())
            p, a = self._chain(k, int(places[one]), int(at[one]), text)
            left &= ~np.isin(codes, p + a * len(self.cores[k]))
            left[one] = False
            for part in self._consistent(k, p, a, words, ids):
                best = max(best, self._filled(k, p[part], a[part], length), key=lambda x: x[1])
        return best

    def _chain(self, k: int, place: int, at: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matched places and positions around a hit, both rising."""
        item = self.hashes[k]
        resync = RESYNC if item.shape[1] >= LONG_WORDS else SHORT_RESYNC
        before = [(place - p - n, at - a - n, n) for p, a, n in runs(item[:, :place][:, ::-1], text[:, :at][:, ::-1], resync)]
        found = before[::-1] + [(place + p, at + a, n) for p, a, n in runs(item[:, place:], text[:, at:], resync)]
        return tuple(np.concatenate([np.arange(f[i], f[i] + f[2]) for f in found]) for i in (0, 1))

    def _consistent(self, k: int, p: np.ndarray, a: np.ndarray, words: Words, ids: np.ndarray) -> Iterator[slice]:
        """Parts of a chain in which each value of the item stands for one
        value of the text."""
        there: dict[tuple[int, str], str] = {}
        start = 0
        for i in np.flatnonzero(self.slots[k][p] != PLAIN).tolist():
            own = int(self.slots[k][p[i]]), self.cores[k][p[i]]
            other = words.core[ids[a[i]]]
            if there.setdefault(own, other) != other:
                yield slice(start, i)
                start, there = i, {own: other}
        yield slice(start, len(p))

    def _filled(self, k: int, p: np.ndarray, a: np.ndarray, length: int) -> tuple[int, float]:
        """Windows that so many words in a row have, and their share; where
        windows of slots are out of the table, at least the share of those in it."""
        n = max(0, len(p) - length + 1)
        if not n:
            return 0, 0.0
        usable = self.usable[k]  # none: only the share of all counts
        whole = (p[length - 1:] - p[:n] == length - 1) & (a[length - 1:] - a[:n] == length - 1)
        return n, float(max(n / len(usable), usable[p[:n][whole]].sum() / max(1, usable.sum())))


def chunks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           most: int = CHUNK_WINDOWS) -> Iterator[Benchmark]:
    """The benchmark in chunks of at most ``most`` words, fetched a partition
    at a time; an item beyond that is cut into pieces, each an item."""
    items, size = [], 0
    for item_id, text in benchmark.select(id_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(split_words(text))
        pieces = [text] if n <= most else [" ".join(split_words(text)[a:a + most]) for a in range(0, n, most)]
        for piece in pieces:
            n = min(n, most)
            if items and size + n > most:
                yield Benchmark(items)
                items, size = [], 0
            items.append((item_id, piece))
            size += n
    if items:
        yield Benchmark(items)


def _batches(held: Benchmark, texts: list, words: Words) -> Iterator[tuple[int, int, int, float]]:
    """Hits of a batch, found slice by slice: the words of a slice are held at
    once, those of a batch need not fit."""
    at = 0
    while at < len(texts):
        if len(words) > CACHE_WORDS:
            words.clear()
            words.__init__()
        end, size = at, 0
        while end < len(texts) and (end == at or size < SLICE_CHARS):
            size += len(texts[end] or "")
            end += 1
        for r, *rest in held.hits(texts[at:end], words):
            yield at + r, *rest
        at = end


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, contaminated): a row for each
    document and item that leaks into it, ``contaminated`` true.  Clean
    documents have no row.

    Null and empty texts are clean, and so are null and empty items.  An item
    under ``MIN_WORDS`` words leaks into documents with a line, or a whole
    text, of its words only.  Repeated documents or items each have their rows,
    and so has each piece of an item beyond ``CHUNK_WINDOWS`` words; null ids
    stay null.  Empty input: no rows.  Other columns are
    not read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("ticket"), F.col(text_col).alias("text"))
    schema = "ticket string, item_id long, n_windows long, coverage double"
    found = spark.createDataFrame([], schema)
    for chunk in chunks(benchmark):
        table = spark.sparkContext.broadcast(chunk)  # at most CHUNK_WINDOWS windows

        def look_up(batches: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
            words = Words()
            for batch in batches:
                tickets = batch["ticket"].tolist()
                hits = [(tickets[r], k, n, c) for r, k, n, c in _batches(table.value, batch["text"].tolist(), words)]
                if hits:
                    yield pd.DataFrame(hits, columns=["ticket", "item_id", "n_windows", "coverage"])

        found = found.unionByName(rows.mapInPandas(look_up, schema))
    kind = docs.select(id_col).schema[0].dataType
    return found.select(F.col("ticket").cast(kind).alias("doc_id"), "item_id", "n_windows", "coverage",
                        F.lit(True).alias("contaminated"))


def contaminated_column(text: Column, chunk_table) -> Column:
    """Whether a text leaks an item of a broadcast chunk."""

    @F.pandas_udf("boolean")
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for texts in parts:
            out = np.zeros(len(texts), dtype=bool)
            for r, *_ in _batches(chunk_table.value, texts.tolist(), words):
                out[r] = True
            yield pd.Series(out)

    return leaks(text)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that :func:`find_leaks` names, all
    columns as they were."""
    sc = docs.sparkSession.sparkContext
    for chunk in chunks(benchmark):
        docs = docs.filter(~contaminated_column(F.col(text_col), sc.broadcast(chunk)))
    return docs
