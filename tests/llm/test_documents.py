"""SimHash, mixing, host rules and decontamination against brute force and edges."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import components as CC
from cadenza.llm import decontaminate as DE
from cadenza.llm import host_rules as HR
from cadenza.llm import mixing as MX
from cadenza.llm import simhash as SH

WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "is", "or", "und")]


def _prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


# --- connected components -----------------------------------------------------------

def test_components_path_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 302), (302, 300), (9, 9), (None, 4)]
    got = dict(map(tuple, CC.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300, 302: 300}
    assert CC.connected_components(spark.createDataFrame([], "src string, dst string")).collect() == []


# --- simhash ------------------------------------------------------------------------

def _plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "Ünï CÖDE x\x0by", "a b c a b c a b c", "x " * 9000])
def test_fingerprint(text):
    assert SH.fingerprint(text) == _plain_fingerprint(text)


def _brute_components(codes, bits):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1:] ^ codes[i]) <= bits) + i + 1:
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(codes))]


def _same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("bits", [0, 2, 3])
def test_gray_index_links_what_brute_force_links(spark, bits):
    draw = np.random.default_rng(bits)
    codes = draw.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + draw.integers(0, 2, 300, dtype=np.uint64)
    for _ in range(3):  # clusters and chains around some of them
        flips = np.uint64(1) << draw.integers(0, 64, 200, dtype=np.uint64)
        codes = np.unique(np.concatenate([codes, draw.choice(codes, 200) ^ flips]))
    codes = np.unique(np.append(codes, [np.uint64(0), SH.ALL, np.uint64(3)]))
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    edges = SH.hamming_edges(frame, bits, block=32)
    found = dict(map(tuple, CC.connected_components(edges).collect()))
    got = [found.get(int(c), int(c)) for c in codes.view(np.int64)]
    assert _same_partition(got, _brute_components(codes, bits))


def test_simhash_query_edges(spark, docs_of):
    draw = random.Random(4)
    text = _prose(draw, 200)
    rows = [(5, text), (3, text.upper()), (9, text + " "), (9, text), (None, text), (7, None), (8, ""), (2, _prose(draw, 50))]
    got = SH.simhash_near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = Counter((r["doc_id"], r["component_id"]) for r in got)
    assert by == Counter({(5, 3): 1, (3, 3): 1, (9, 3): 2, (None, 3): 1, (7, 7): 1, (8, 7): 1, (2, 2): 1})
    assert {r["fingerprint"] for r in got if r["doc_id"] in (7, 8)} == {"0" * 16}
    assert SH.simhash_near_duplicates(docs_of([])).collect() == []
    kept = SH.keep_one_per_component(docs_of(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 7] and all(len(r) == 5 for r in kept)
    only_null = SH.keep_one_per_component(docs_of([(None, text), (None, text)])).collect()
    assert len(only_null) == 1
    clash = docs_of(rows).withColumn("fp", F.lit("mine")).withColumn("component", F.lit(1)).withColumn("row", F.lit(2))
    assert sorted(r["doc_id"] for r in SH.keep_one_per_component(clash).collect()) == [2, 3, 7]


# --- mixing -------------------------------------------------------------------------

def _plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def _docs_with_sources(draw):
    rows = []
    for k, (source, n) in enumerate([("b", 400), ("a", 30), ("ä", 60), (None, 50), ("c", 5), ("z", 3), ("empty", 2)]):
        for i in range(n):
            rows.append((1000 * k + i, "" if source == "empty" else _prose(draw, draw.randint(1, 60)), source))
    return rows


def test_mix_meets_targets(docs_of):
    rows = _docs_with_sources(random.Random(1))
    got = MX.mix(docs_of(rows), bucket_docs=64).collect()
    again = MX.mix(docs_of(rows).repartition(5), bucket_docs=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    sizes, taken, source_of = Counter(), Counter(), {r[0]: r[2] for r in rows}
    text_of = {r[0]: r[1] for r in rows}
    for r in got:
        assert r["size"] == len(text_of[r["doc_id"]].split()) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        sizes[source_of[r["doc_id"]]] += r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
    want = _plain_targets(dict(sizes))
    for r in got:
        assert r["target"] == pytest.approx(want[source_of[r["doc_id"]]], rel=1e-9)
        assert r["source_size"] == sizes[source_of[r["doc_id"]]]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in want:
        assert abs(taken[s] - want[s]) <= 60 + 0.01 * want[s], s


def test_rows_of_one_id_and_size_are_spread(spark):
    """A third of all rows share id, source and size: no bucket gathers them."""
    rows = spark.range(9000).selectExpr("case when id < 3000 then null else id end as doc_id", "case when id < 3000 then 'a b' else repeat('w ', int(id % 50)) end as text",
                                        "'en' as lang", "cast(id % 2 as string) as source", "id as n_chars").selectExpr("*", "1 as place", "2 as salt").repartition(6)
    dealt = MX._dealt(*MX._planned(rows, "doc_id", "text", "source", MX.WEIGHTS, 3, 100), 100)
    assert dealt.groupBy("source", "bucket").count().agg(F.max("count")).first()[0] < 400
    got = MX.mix(rows, bucket_docs=100).collect()
    assert len(got) == 9000 and sum(r["doc_id"] is None for r in got) == 3000
    taken, target = Counter(), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 60 for s in target)


def test_the_level_of_many_sources(spark):
    draw = random.Random(4)
    sizes = {f"h{i:03}": draw.choice([0, 1, 7, 100, 5000, 10**6]) for i in range(200)} | {None: 50, "ä": 3}
    got = {r["source"]: r["target"] for r in MX.capped_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    want = _plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def test_mix_edges(docs_of):
    assert MX.mix(docs_of([])).collect() == []
    got = {r["doc_id"]: r for r in MX.mix(docs_of([(1, None, "a"), (2, "x y", "a"), (None, "z", None)])).collect()}
    assert got[1]["taken"] == 0 and got[2]["size"] == 2 and got[None]["size"] == 1
    none = MX.mix(docs_of([(1, "", "a"), (2, None, "b")])).collect()
    assert [r["taken"] for r in none] == [0, 0] and [r["target"] for r in none] == [0.0, 0.0]
    one = docs_of([(1, "a b c", "s")]).withColumn("copy", F.lit("mine")).withColumn("n", F.lit(0))
    assert [(r["doc_id"], r["copy"], r["n"]) for r in MX.mixed_copies(one).collect()] == [(1, 1, 0)]
    many = MX.mixed_copies(docs_of(_docs_with_sources(random.Random(2))))
    assert many.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).filter("m <> n OR n > 3").count() == 0


def test_entropy_balance_of_two_margins(spark):
    draw = random.Random(3)
    rows = [(draw.choice("abc"), draw.choice(["x", "y", None]), draw.randint(1, 50)) for _ in range(300)]
    docs = spark.createDataFrame(rows, "s string, l string, size long")
    total = sum(r[2] for r in rows)
    goal_s = spark.createDataFrame([("a", total * 0.5), ("b", total * 0.3), ("c", total * 0.2)], "s string, target double")
    goal_l = spark.createDataFrame([("x", total * 0.25), ("y", total * 0.25), (None, total * 0.5)], "l string, target double")
    cells = MX.entropy_balance(docs, "size", {"s": goal_s, "l": goal_l}).collect()
    for col, share in (("s", {"a": .5, "b": .3, "c": .2}), ("l", {"x": .25, "y": .25, None: .5})):
        for level, part in share.items():
            assert sum(c["mass"] * c["rate"] for c in cells if c[col] == level) == pytest.approx(total * part, rel=1e-6)
    # an exponential tilt: the log rates are sums of a term for each level
    rate = {(c["s"], c["l"]): np.log(c["rate"]) for c in cells}
    assert rate["a", "x"] + rate["b", "y"] == pytest.approx(rate["a", "y"] + rate["b", "x"])


# --- host rules ---------------------------------------------------------------------

def _plain_measures(text):
    words, flags = [], "#*$%&|<>"
    for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "").split(" "):
        words += [w] if w else []
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    n_lines = sum(bool(line.strip(" \t\r\x0b\x0c")) for line in lines)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in flags), dup, len(covered), n_lines


@pytest.mark.parametrize("piece", [HR.PIECE, 7])
def test_measures(monkeypatch, piece):
    monkeypatch.setattr(HR, "PIECE", piece)
    monkeypatch.setattr(HR, "SHORT_LINE", 3)
    draw = random.Random(6)
    texts = [None, "", "a b c a b c", "a a a a", "x\n\nx\n \n \ny#|", "w " * 5000, "é ü ö\x0bä"]
    texts += ["".join(draw.choice(["a", "b", " ", "\n", "#", "é"]) for _ in range(draw.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert HR.measures(t) == _plain_measures(t), t


def test_host_verdicts(docs_of):
    draw = random.Random(2)
    good, bad = lambda: _prose(draw, 80), lambda: "buy now " * 40
    rows = [(i, good(), "fine") for i in range(60)] + [(100 + i, bad() if i % 5 else good(), "spam") for i in range(60)]
    rows += [(200, bad(), "new"), (201, good(), "new"), (None, None, None), (300, good(), None)]
    got = HR.host_quality(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i in range(60)) and not any(by[100 + i]["kept"] for i in range(60))
    assert by[105]["base_failed"] is False and by[105]["host_rate"] > 0.5  # a good text of a bad host
    assert by[201]["kept"] and by[200]["base_failed"] and not by[None]["kept"] and by[None]["n_words"] == 0
    assert 0.1 < by[201]["host_rate"] < 0.9  # two texts say little about a host
    assert by[105]["rate_repeats"] > 0.5 > by[105]["rate_symbols"]
    rows = [(i, "| # " * 40 + good(), "pipes") for i in range(40)] + [(50 + i, good(), "fine") for i in range(80)]
    by = {r["doc_id"]: r for r in HR.host_quality(docs_of(rows).withColumn("n_words", F.lit(1)).withColumn("host", F.lit("x"))).collect()}
    assert not any(by[i]["kept"] or by[i]["base_failed"] for i in range(40)) and all(by[50 + i]["kept"] for i in range(80))  # by the host's symbols alone
    assert HR.host_quality(docs_of([])).collect() == []
    assert [r["kept"] for r in HR.host_quality(docs_of([(1, good(), "x")] * 3)).collect()] == [True] * 3


# --- decontamination ----------------------------------------------------------------

ITEMS = [
    (1, "A train leaves Paris at 9 and covers 120 km in 2 hours before it meets another train from Lyon at noon"),
    (2, "Today Anna has 12 apples and gives 3 of them to Boris while Anna keeps 9 apples for the winter season at home"),
    (3, "short one"), (4, None), (5, ""),
    (6, "seven plain words are here to see"),
]


def _leaks(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return DE.find_leaks(docs, items), items


def test_leaks_verbatim_reparameterised_and_inconsistent(spark, docs_of):
    draw = random.Random(5)
    pre, post = _prose(draw, 40), _prose(draw, 40)
    rows = [
        (1, f"{pre} {ITEMS[0][1]} {post}"),
        (2, pre + "\n" + ITEMS[1][1].replace("Anna", "Clara").replace("Boris", "Dieter").replace("12", "20").replace("9", "17") + " " + post),
        # one name of the item stands for two in the text: not the same question
        (3, pre + " " + ITEMS[1][1].replace("while Anna", "while Clara") + " " + post),
        (4, pre), (5, None), (6, ""), (7, "x " + ITEMS[5][1].upper() + "! y"), (8, "short one " * 30), (None, ITEMS[0][1]), (1, ITEMS[0][1])]
    found, items = _leaks(spark, docs_of(rows))
    got = Counter((r["doc_id"], r["item_id"]) for r in found.collect())
    assert got == Counter({(1, 1): 2, (2, 2): 1, (7, 6): 1, (None, 1): 1})
    kept = DE.drop_leaks(docs_of(rows).withColumn("item_id", F.lit("mine")), items).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 4, 5, 6, 8] and kept[0]["item_id"] == "mine"
    assert DE.find_leaks(docs_of([]), items).collect() == []
    assert DE.find_leaks(docs_of(rows), items.limit(0)).collect() == []


@pytest.mark.parametrize("size", [20, 40, 200])
@pytest.mark.parametrize("change", ["insert", "drop", "replace", "two"])
def test_leaks_with_changed_words(size, change):
    draw = random.Random(size)
    item = [f"w{i}{draw.choice(WORDS)}" for i in range(size)]
    for at in (7, size // 2, size - 9):
        copy = {"insert": item[:at] + ["new"] + item[at:], "drop": item[:at] + item[at + 1:], "replace": item[:at] + ["new"] + item[at + 1:],
                "two": item[:at] + ["new", "ones"] + item[at + 1:]}[change]
        text = " ".join([_prose(draw, 30), *copy, _prose(draw, 30)])
        (_, found, _, coverage), = DE.Benchmark([(5, " ".join(item))]).hits([text], DE.Words())
        assert found == 5 and 0.75 <= coverage <= 1.0, at


def test_leaks_with_slots_of_other_lengths_and_equal_values():
    bench = DE.Benchmark([ITEMS[1]])
    text = ITEMS[1][1].replace("Anna", "Mary Ann").replace("12", "twenty five")
    got = list(bench.hits([text, ITEMS[1][1].replace("9", "3"), " ".join(ITEMS[1][1].split()[:12])], DE.Words()))
    assert [(r, k) for r, k, _, _ in got] == [(0, 2), (1, 2)]  # two values may become one; the first half is no leak


@pytest.mark.parametrize("item, text", [
    ("3 14 15 92 65 35 89 79 32 38 46", "pi is 3 14 15 92 65 35 89 79 32 38 46 and so on"),  # slots only
    ("The Old Man And The Sea By Ernest Hemingway From Cuba", "I read The Old Man And The Sea By Ernest Hemingway From Cuba twice"),
    ("What is the capital of France?", "Question 5\nWhat is the capital of France?\nAnswer"),
    ("Today Anna has many apples and gives some of them to Boris", "x today anna has many apples and gives some of them to boris"),
    ("Today Anna has many apples and gives some of them to Boris", "X TODAY ANNA HAS MANY APPLES AND GIVES SOME OF THEM TO BORIS"),
])
def test_verbatim_copies_in_any_case_are_leaks(item, text):
    (_, found, _, coverage), = DE.Benchmark([(5, item)]).hits([text], DE.Words())
    assert found == 5 and coverage == 1.0
    assert not list(DE.Benchmark([(5, item)]).hits([" ".join(text.split()[:5]), "1 2 3 4 5 6 7 8 9 10 11 12"], DE.Words()))


def test_chunks_of_the_benchmark_give_the_same(spark, docs_of):
    draw = random.Random(8)
    items = [(i, _prose(draw, draw.randint(5, 60))) for i in range(60)]
    rows = [(i, _prose(draw, 30) + " " + items[i % 60][1] + " " + _prose(draw, 500)) if i % 3 else (i, _prose(draw, 300)) for i in range(90)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i % 60) for i in range(90) if i % 3}
    assert {(r["doc_id"], r["item_id"]) for r in DE.find_leaks(docs_of(rows), bench).collect()} >= want
    sizes = [len(c.ids) for c in DE.chunks(bench, most=200)]
    assert len(sizes) > 3 and sum(sizes) == 60


@pytest.mark.parametrize("size", [5, 6, 8, 9, 12, 15])
def test_short_items_with_a_changed_word(size):
    """One word changed anywhere: a window must be left, and half of the windows matched."""
    draw = random.Random(size)
    item = [f"w{i}{draw.choice(WORDS)}" for i in range(size)]
    window = DE.seed_window(size, DE.WINDOW)
    bench = DE.Benchmark([(5, " ".join(item))])
    for at in range(size):
        text = " ".join([_prose(draw, 30), *item[:at], "new", *item[at + 1:], _prose(draw, 30)])
        less, more = sorted([at, size - at - 1])
        matched = more + (less if less >= DE.SHORT_RESYNC else 0)
        found = more >= window and matched - window + 1 >= DE.MIN_COVERAGE * (size - window + 1)
        assert [r[1] for r in bench.hits([text], DE.Words())] == [5] * found, at
        assert found or size == 5
    assert not list(bench.hits([_prose(draw, 400), " ".join(item[:2] + item[-2:])], DE.Words()))


def test_spelled_numbers_are_numbers():
    bench = DE.Benchmark([(1, "Ann buys twelve apples and eats five of them today so how many remain")])
    text = "Ann buys seven apples and eats three of them today so how many remain"
    assert [(r[1], r[3]) for r in bench.hits([text], DE.Words())] == [(1, 1.0)]


def test_items_without_spaces_and_very_short_ones(spark, docs_of):
    items = spark.createDataFrame([(1, "中国的首都是哪一座城市请回答"), (2, "short one"), (3, "Yes!"), (4, "東京"), (5, "日本で一番高い山は何ですか")], "item_id long, text string")
    rows = [(1, "他问我中国的首都是哪一座城市请回答我不知道"), (2, "first line\nSHORT one.\nlast"), (3, "short one " * 30), (4, "yes"), (5, "oh yes it is"),
            (6, "東京"), (7, "東京は大きい"), (8, "昔日本で一番高い山は何ですかと聞いた"), (9, "中国的山"), (10, None)]
    got = {(r["doc_id"], r["item_id"]) for r in DE.find_leaks(docs_of(rows), items).collect()}
    assert got == {(1, 1), (2, 2), (4, 3), (6, 4), (8, 5)}
    assert {r["doc_id"] for r in DE.drop_leaks(docs_of(rows), items).collect()} == {3, 5, 7, 9, 10}


def test_a_benchmark_item_beyond_a_chunk_is_cut(spark):
    words = [f"w{i}" for i in range(900)]
    bench = spark.createDataFrame([(1, "\n".join(words)), (2, "\t".join(words[:50]))], "item_id long, text string")
    sizes = [[len(c) for c in chunk.cores] for chunk in DE.chunks(bench, most=200)]
    assert max(map(sum, sizes)) <= 200 and sum(map(sum, sizes)) == 950
