"""Secrets in whole texts behind a trigram inverted index.

1. From each rule's regex a Boolean query over trigrams is derived: every
   match contains one of some literal strings, so all trigrams of that string.
2. The index holds postings (trigram, document) for the trigrams that the
   queries ask for, written once to the shared folder.
3. Postings are intersected: a document is a candidate of a rule if it has all
   trigrams of one of its alternatives.  Rules without mandatory trigrams
   make every document a candidate.
4. Candidates are verified with the regex itself, over the whole text.

DataFrame functions only.  Regexes use the syntax that Java and Python share.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` matches leftmost, without overlaps; matches are dropped,
    not retried, where ``group`` has fewer than ``min_chars`` characters."""

    kind: str
    pattern: str
    min_chars: int
    group: int = 0
    base: bool = False


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Kinds in listed order; the first three are the base of the contract.  A run
#: that is long enough is found whole by {24,} or {16,}, and one that is not
#: holds no other match, so these two need no later check of their length.
RULES = (
    SecretRule("assign", ASSIGN, 6, 2, base=True),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", 20, base=True),
    SecretRule("hex", r"[0-9a-f]{24,}", 24, base=True),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    SecretRule("google", r"AIza[A-Za-z0-9_-]+", 39),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)


# --- step 1: Boolean trigram queries ------------------------------------------------

def _strings(tree, limit: int) -> tuple[list[list[str]], list[str] | None]:
    """(cuts, open): literal strings of a parsed regex.  ``open`` are all
    strings a match can consist of, None if they cannot be listed; ``cuts``
    are lists of alternatives of which each match contains one."""
    cuts: list[list[str]] = []
    now: list[str] | None = [""]

    def cut():
        nonlocal now
        if now is not None:
            cuts.append(now)
        now = [""]

    whole = True
    for op, arg in tree:
        options: list[str] | None = None
        if op is rc.LITERAL:
            options = [chr(arg).lower()]
        elif op is rc.IN and arg[0][0] is not rc.NEGATE:
            chars = set()
            for kind, x in arg:
                if kind is rc.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is rc.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars |= {None}
            options = None if None in chars or len(chars) > 8 else sorted(chars)
        elif op is rc.SUBPATTERN:
            inner, options = _strings(arg[3], limit)
            cuts += inner
        elif op is rc.BRANCH:
            inner = [_strings(x, limit) for x in arg[1]]
            if all(x[1] is not None for x in inner):
                options = sorted({s for x in inner for s in x[1]})
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, item = arg
            inner, own = _strings(item, limit)
            if low:
                cuts += inner
            if own is not None and (low, high) in ((0, 1), (1, 1)):
                options = own + ([""] if not low else [])
        elif op is rc.AT:
            continue
        if options is None or len(now) * len(options) > limit:
            cut()
            whole = False
        else:
            now = [a + b for a in now for b in options]
    if whole:
        return cuts, now
    cut()
    return cuts, None


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives, each a list of trigrams (lower case) that a text with a
    match has all of; empty if the regex has no mandatory trigrams."""
    cuts, whole = _strings(rp.parse(pattern), MAX_ALTERNATIVES)
    if whole is not None:
        cuts.append(whole)
    usable = [c for c in cuts if all(len(s) >= 3 for s in c)]
    if not usable:
        return []
    best = max(usable, key=lambda c: (min(map(len, c)), -len(c)))
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in best}
    return sorted(sorted(s) for s in sets if not any(other < s for other in sets))  # a superset asks for nothing new


# --- steps 2 and 3: postings and candidates -----------------------------------------

def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) for the asked trigrams, from (doc_id, text),
    over lower-cased texts; rows without an id have none."""
    low = docs.filter("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams)))
    return low.select("doc_id", F.explode(present).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[int, list[list[str]]]) -> DataFrame:
    """(doc_id, rules): the rules, as a bit set of their numbers, that a
    document's trigrams allow.  The queries, a literal, are spread over the
    postings of their trigrams; alternatives count what they need."""
    needs: dict[str, list[tuple[int, int, int]]] = {}
    for rule, alternatives in queries.items():
        for k, alternative in enumerate(alternatives):
            for t in alternative:
                needs.setdefault(t, []).append((rule, k, len(alternative)))
    if not needs:
        return postings.select("doc_id", F.lit(0).cast("long").alias("rules")).limit(0)
    asked = F.create_map(*(x for t, uses in sorted(needs.items()) for x in (F.lit(t), F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(k).alias("k"), F.lit(n).alias("need")) for r, k, n in uses)))))
    used = postings.distinct().select("doc_id", F.inline(asked[F.col("trigram")]))
    met = used.groupBy("doc_id", "rule", "k", "need").count().filter("count = need")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


# --- step 4: spans ------------------------------------------------------------------

def running_sums(values: Column, block: int = 64) -> Column:
    """Running sums of an array, by blocks, so that long arrays cost about
    size * block, not the square.  The array must not be empty."""
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    n_blocks = F.ceil(F.size(values) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    sums = F.transform(blocks, total)
    starts = F.transform(blocks, lambda _, b: total(F.slice(sums, F.lit(1), b)))
    return F.flatten(F.zip_with(blocks, starts, lambda own, start: F.transform(
        own, lambda _, i: start + total(F.slice(own, F.lit(1), i + 1)))))


def spans(texts: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(doc_id, spans) from (doc_id, text, rules): an array of (start, kind
    number, end) for each row, by start, then kind; offsets in code points,
    end exclusive.  The pieces between a rule's matches come from splitting at
    the same regex, and running sums of the lengths give the offsets."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    strings = F.array().cast("array<string>")
    asked = lambda i: F.shiftright("rules", i).bitwiseAND(F.lit(1)) == 1
    found = texts.select("doc_id", "text", *(
        F.when(asked(i), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(strings).alias(f"m{i}")
        for i, r in enumerate(rules)), *(
        F.when(asked(i), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).alias(f"g{i}")
        for i, r in enumerate(rules) if r.group))
    found = found.select("*", *(
        F.when(F.size(f"m{i}") > 0, F.split("text", r.pattern, -1)).alias(f"p{i}") for i, r in enumerate(rules))).drop("text")
    length = lambda x: F.length(x).cast("long")

    def located(i: int, r: SecretRule) -> Column:
        m, g, p = F.col(f"m{i}"), F.col(f"g{i}" if r.group else f"m{i}"), F.col(f"p{i}")
        ends = running_sums(F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda a, b: length(a) + length(b)))
        made = F.zip_with(ends, F.arrays_zip(m.alias("m"), g.alias("g")), lambda end, x: F.struct(
            (end - length(x["m"])).alias("start"), F.lit(i).alias("kind"), end.alias("end"), length(x["g"]).alias("chars")))
        good = F.filter(made, lambda x: x["chars"] >= r.min_chars)
        return F.when(F.size(m) > 0, F.transform(good, lambda x: F.struct(
            x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))).otherwise(empty)

    every = F.concat(*(located(i, r) for i, r in enumerate(rules)))
    return found.select("doc_id", F.array_sort(every).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> for each base kind, base_sha256, spans, n_spans), a
    row for each document.  ``spans`` lists kind:start:end of all kinds by
    start, then kind as listed; ``base_sha256`` is the SHA-256 of the same
    list for the base kinds alone.

    Null and empty texts have no spans (the hash is that of the empty text).
    Rows without an id cannot be indexed, so every rule is verified on them.
    Rows that share an id are candidates together.  Empty input: no rows.
    Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    scanned = sum(1 << i for i, q in queries.items() if not q)
    queries = {i: q for i, q in queries.items() if q}
    postings = shared_table(trigram_index(rows, sorted({t for q in queries.values() for a in q for t in a})), "trigram-postings")
    chosen = shared_table(candidates(postings, queries), "secret-candidates").withColumnRenamed("doc_id", "chosen_id")
    joined = rows.join(chosen, F.col("doc_id") == F.col("chosen_id"), "left").select(
        "doc_id", "text", F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(
            F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(scanned))).cast("long").alias("rules"))
    located = spans(joined, rules)
    names = F.array(*(F.lit(r.kind) for r in rules))
    n_base = sum(r.base for r in rules)
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    kind_is = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    return located.select(
        "doc_id", *(kind_is(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] < n_base)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
