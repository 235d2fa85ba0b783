"""Lexical search, language identification and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import language_id as LI
from cadenza.llm import lexical_search as LS
from cadenza.llm import prefix_trie as PT
from test_oracle_fixtures import _same

# --- lexical search -----------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def _ranked(docs, items, k=50):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        hits = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(_terms(text)) if t in c)
            if score > 0:
                hits.append((-score, d if d is not None else -math.inf, d))
        hits.sort(key=lambda x: x[:2])
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(hits[:k])]
    return sorted(out, key=repr)


def _search_case(spark, docs, items, k=50, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("terms", F.lit("x")).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(1)).withColumn("rank", F.lit(2))
    return sorted((tuple(r) for r in LS.search(LS.build_index(d), i, k, **options).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["é", "ſtraße", "AbC", "naïve9", "中文"]
    docs = []
    for i in range(400):
        n = draw.choice([1, 3, 20, 200])
        docs.append((i, draw.choice([" ", "-", "\n\t"]).join(draw.choices(words, [1 / (j + 1) for j in range(len(words))], k=n))))
    docs += [(1000 + i, docs[7][1]) for i in range(120)]  # ties, more than fit
    docs += [(None, docs[7][1]), (1000, docs[7][1]), (2000, None), (2001, ""), (2002, " .,-"), (2003, "w1 " * 300), (2004, "w0 w1 " * 30_000)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 4, 12])))) for i in range(12)]
    items += [(3, docs[7][1]), (90, None), (91, ""), (92, "?!"), (93, "unseen"), (None, "w1 W1 w2"), (95, docs[7][1])]
    return docs, items


def test_search_is_that_of_brute_force(spark, corpus):
    assert _search_case(spark, *corpus) == _ranked(*corpus)


def test_search_in_small_blocks_and_slices(spark, corpus, monkeypatch):
    assert _search_case(spark, *corpus, k=7, block_terms=10) == _ranked(*corpus, k=7)


def test_search_of_empty_tables(spark):
    assert _search_case(spark, [], [(1, "a")]) == []
    assert _search_case(spark, [(1, None)], [(1, "a")]) == []
    assert _search_case(spark, [(1, "a")], []) == []


def test_bounds_are_never_below_scores_and_often_equal(corpus):
    docs, items = corpus
    queries = [q for _, t in items if (q := [x.encode() for x in dict.fromkeys(_terms(t))])]
    block = LS.Block.of(list(range(len(queries))), queries)
    weights = np.arange(1, len(block.vocabulary) + 1)
    searcher = LS.Searcher(block, weights, np.zeros(len(queries), dtype=np.int64), 5)
    scored = 0
    for _, text in docs:
        found = Counter(x.encode() for x in _terms(text))
        if not found:
            continue
        counts = np.array(list(found.values()), dtype=np.uint32)
        m = np.array([50 + len(text)])
        bounds = searcher.bounds(LS.sketch_of(list(found), counts)[None, :], m)[0]
        exact = [sum(w * LS.impact(found[t], int(m[0])) for t, w in q if t in found) for q in searcher.by_query]
        assert (bounds >= exact).all()
        scored += int((bounds == exact).sum())
    assert scored > 0.4 * len(queries) * len(docs)


def test_search_sql_on_odd_rows(spark, tmp_path, corpus):
    docs, items = corpus
    docs = [d for d in docs if d[0] is not None and d[0] != 1000]
    items = [x for x in dict(items).items() if x[0] is not None]
    _same(spark, "op11_lexical_search", tmp_path, {
        "documents": spark.createDataFrame(docs, "doc_id long, text string"), "benchmark": spark.createDataFrame(items, "item_id long, text string")})


# --- language identification --------------------------------------------------------

SAMPLE = {"en": "the river that runs with other things which think this whole thought through",
          "fr": "le château où les élèves étaient près des fenêtres avec une très vieille fête",
          "ru": "там где большая река течёт через поле и тихо поёт ветер над водой",
          "zh": "这是一个关于河流和山的故事他们住在那里很久了"}


def _written(draw, lang, n):
    words = SAMPLE[lang].split() if " " in SAMPLE[lang] else list(SAMPLE[lang])
    return (" " if " " in SAMPLE[lang] else "").join(draw.choices(words, k=n))


def _held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_languages_of_unseen_texts(spark):
    draw = random.Random(5)
    rows = [(i, _written(draw, lang := draw.choice(list(SAMPLE)), draw.choice([5, 30])), lang) for i in range(600)]
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, "123 !? 45\n", "fr"), (9003, "the river", None), (None, "the river that runs", "zh"),
           (9004, "THE RIVER THAT RUNS WITH OTHER THINGS. " * 20_000, "ru"), (5, "the other thing", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as at", "'y' as n").repartition(4)
    out = LI.identify_languages(df, fit_rows=200)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "rejected"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) + len(odd)
    by_id = {r[0]: r for r in got if r[0] != 5}
    want = {i: lang for i, _, lang in rows if i != 5}
    assert all(by_id[i][1] == _held_out(i) for i in want)
    unseen = [i for i in want if _held_out(i)]
    assert sum(by_id[i][2] == want[i] for i in unseen) >= 0.99 * len(unseen)
    assert all(by_id[i][2:] == ("und", 0.0, True) for i in (9000, 9001, 9002))
    assert by_id[9003][2] == "en" and by_id[None][1:3] == (False, "en") and by_id[9004][2] == "en"
    assert all(0 <= r[3] <= 1 for r in got)
    assert sorted(map(repr, LI.identify_languages(df, fit_rows=200).collect())) == sorted(map(repr, out.collect()))


def test_languages_without_labels_and_without_rows(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(1, "the", None), (2, None, "en")], schema)
    assert sorted(tuple(r) for r in LI.identify_languages(none).collect()) == [(1, _held_out(1), "und", 0.0, True), (2, _held_out(2), "und", 0.0, True)]
    assert LI.identify_languages(spark.createDataFrame([], schema)).collect() == []


def test_the_sample_is_bounded_when_one_row_is_repeated(spark):
    rows = spark.range(3000).selectExpr("cast(1 as long) as doc_id", "'the river' as text", "'en' as lang").unionByName(
        spark.range(300).selectExpr("id as doc_id", "concat('le fete ', id) as text", "'fr' as lang"))
    got = dict(LI.sample(rows, fit_rows=100).groupBy("lang").count().collect())
    assert got["en"] == 50 and 30 <= got["fr"] <= 50


def test_what_is_unlike_all_languages_is_rejected():
    draw = random.Random(1)
    langs = sorted(SAMPLE)
    texts = [(_written(draw, langs[i % 4], 30), i % 4) for i in range(300)]
    rows = []
    for text, _ in texts:
        counts = LI.subword_counts(text)
        at = np.flatnonzero(counts)
        rows.append((at, (counts[at] / (counts.sum() + LI.PRIOR)).astype(np.float32)))
    model = LI.fit(rows, langs, np.array([k for _, k in texts]))
    best, score = model.predict([_written(draw, langs[i % 4], 30) for i in range(200)])
    assert (best == np.arange(200) % 4).mean() == 1.0
    assert (score < model.reject_below).mean() <= 0.1
    assert (model.predict(["qxzjw " * 5, "kvpq", "ȡȡ ȴȴ"])[1] < model.reject_below).all()


def test_gradient_steps_lower_the_loss_and_long_texts_are_read_whole():
    counts = LI.subword_counts("a" * (2 * LI.PIECE) + "z" * 10)
    assert counts.sum() >= 4 * 2 * LI.PIECE
    assert (LI.subword_counts("z" * 10) > 0).sum() < (counts > 0).sum()


# --- prefix trie --------------------------------------------------------------------

def _trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, sha), role, text))
    own = {c: [(r, x) for _, r, x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    saved, leaves, children = Counter(), Counter(), Counter()
    for node, who in members.items():
        if node:
            children[node[:-1]] += 1
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    for node in members:
        if not children[node]:
            for d in range(len(node) + 1):
                leaves[node[:d]] += 1
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as depth", "2 as base", "'x' as keys").repartition(3)


def _some_conversations():
    draw = random.Random(11)
    rows = []
    for c in list(range(230)) + [-7, -205, 1010, 1011, 5000]:
        rows += [(c, t if draw.random() < 0.95 else None, draw.choice(["user", "assistant", None]), draw.choice(["hi", "é𝄞", "", None, "go on"]))
                 for t in range(draw.choice([1, 2, 4, 9]))]
    rows += [(None, 1, "user", "lost"), (150, 3, "user", "same"), (150, 3, "user", "same"), (150, 3, "user", "other")]
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 2060) for t in range(12)]  # one group of copies
    rows += [(c, t, "user", "deep") for c in (3000, 3001) for t in range(700)]
    return rows


def test_trie_is_that_of_brute_force(spark):
    rows = _some_conversations()
    assert sorted((tuple(r) for r in PT.prefix_trie(_conversations(spark, rows)).collect()), key=repr) == _trie(rows)


def test_trie_cut_into_small_segments_and_shards(spark, monkeypatch):
    """Segments, spans and slices of a few turns, so that every carry is used."""
    for name, value in {"SEGMENT": 3, "SPAN": 16, "SLICE_TURNS": 40, "CHUNK_IDS": 5}.items():
        monkeypatch.setattr(PT, name, value)
    rows = _some_conversations()
    assert sorted((tuple(r) for r in PT.prefix_trie(_conversations(spark, rows)).collect()), key=repr) == _trie(rows)


def test_trie_of_few_rows(spark):
    assert PT.prefix_trie(_conversations(spark, [])).collect() == []
    assert PT.prefix_trie(_conversations(spark, [(None, 1, "a", "b")])).collect() == []
    for rows in ([(c, 1, "a", "b")] for c in range(8)):  # some of them are turnless
        assert sorted((tuple(r) for r in PT.prefix_trie(_conversations(spark, rows)).collect()), key=repr) == _trie(rows)


def test_colliding_digests_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(PT, "_bases", lambda seed: np.zeros(PT.LANES, dtype=np.int64))
    with pytest.raises(RuntimeError):
        PT.prefix_trie(_conversations(spark, _some_conversations()[:40]))


def test_trie_sql_on_odd_rows(spark, tmp_path):
    rows = [r for r in _some_conversations() if r[0] is None or r[0] < 3000]
    _same(spark, "op13_prefix_trie", tmp_path, {"conversations": spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")})


def test_slots_are_minimal_and_verified():
    draw = np.random.default_rng(2)
    keys = [draw.integers(-2**62, 2**62, 5000), np.arange(5000)]
    slots = PT.Slots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(5000))
    assert (slots.find([keys[0], keys[1] + 1]) == -1).all()
    assert len(PT.Slots([keys[0][:0], keys[1][:0]])) == 0
