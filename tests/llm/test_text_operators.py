"""Personal data, suffix dedup, quality classifier and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import pii as PI
from cadenza.llm import quality_classifier as QC
from cadenza.llm import suffix_dedup as SD

# --- personal data ------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_plain_identifiers_equal_the_patterns():
    draw = random.Random(1)
    bits = ["a", "Z9", "@", ".", "-", "+", " ", "(", ")", "1", "25", "0", "255", "256", "x.y", "4035787455641871", "é", "\n", "000"]
    for _ in range(20000):
        t = "".join(draw.choice(bits) for _ in range(draw.randint(0, 30)))
        assert PI.plain_spans(t) == _plain_spans(t), t


@pytest.mark.parametrize("text, kind, source", [
    ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("mail john [AT] mail.example [dot] com", "email", "john [AT] mail.example [dot] com"),
    ("j.doe at mail dot example dot org.", "email", "j.doe at mail dot example dot org"),
    ("jоhn@example.cоm", "email", "jоhn@example.cоm"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("ip １９２.168.0.1 here", "ip", "１９２.168.0.1"),
    ("card ４035787455641871.", "card", "４035787455641871"),
    ("jo​hn@exa​mple.com", "email", "jo​hn@exa​mple.com"),
])
def test_disguises_map_back_to_the_source(text, kind, source):
    _, added = PI.personal_data(text)
    assert [(PI.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, source)]
    assert PI.redacted(text) == text.replace(source, f"<{kind.upper()}>")


@pytest.mark.parametrize("text, kind, source", [
    ("mail jane at example.com now", "email", "jane at example.com"),
    ("mail jane @ example . com now", "email", "jane @ example . com"),
    ("mail jane@ example.com, please", "email", "jane@ example.com"),
    ("mail jane dot doe at example dot com now", "email", "jane dot doe at example dot com"),
    ("mail j dot m dot doe at mail.example dot com.", "email", "j dot m dot doe at mail.example dot com"),
    ("ip ๑๙๒.168.0.1 here", "ip", "๑๙๒.168.0.1"),
    ("ip ১৯২.১৬৮.০.১ here", "ip", "১৯২.১৬৮.০.১"),
    ("mail 𝐣𝐚𝐧𝐞@𝑒𝓍𝖺𝗆𝗉𝗅𝖾.com", "email", "𝐣𝐚𝐧𝐞@𝑒𝓍𝖺𝗆𝗉𝗅𝖾.com"),
    ("call +49 30 12 34 five six seven", "phone", "+49 30 12 34 five six seven"),
    ("ip 192.168.zero.1 here", "ip", "192.168.zero.1"),
    ("card 4035 7874 5564 one eight seven 1", "card", "4035 7874 5564 one eight seven 1"),
])
def test_disguises_without_brackets_or_of_few_words(text, kind, source):
    _, added = PI.personal_data(text)
    assert [(PI.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, source)]
    assert PI.redacted(text) == text.replace(source, f"<{kind.upper()}>")


def test_spelled_dots_before_a_plain_address():
    assert PI.redacted("ask jane dot doe@example.com or ｊoe@x.org six") == "ask <EMAIL> or <EMAIL> six"
    assert PI.redacted("card ４035787455641871 one") == "card <CARD> one"  # the word beside it hides nothing
    for text in ("hi @user.name and bye", "he was at home . Then he left", "a.b@ c", "12 of two 3 at 4", " at " * 30000, "a dot " * 20000 + "@x.org"):
        PI.redacted(text)
    for text in ("hi @user.name and bye", "he was at home . Then he left", "a.b@ c", "12 of two 3 at 4", " at " * 30000):
        assert PI.redacted(text) == text


@pytest.mark.parametrize("text", [
    "", "we met at noon and the dot on the map was red", "one two three four five six", "eins zwei drei vier", "f(at) cats and [dot] matrix",
    "null eins", "La émentelletion éen éoipa", "price at 5 dot 3", "a" * 50000 + "@" * 3, "1" * 100000])
def test_clean_texts_stay(text):
    assert PI.personal_data(text) == ([], []) and PI.redacted(text) == text


#: prose where nothing may be redacted, and disguises with what must be
PROSE = [
    "He stayed at home.Then he left.", "visit us at example.com today", "prices @ 5.Each one", "I was at work.It rained all day.",
    "She looked at him.He smiled.", "we meet at noon.In the evening we ate", "available at example.org now", "more at www.example.com and elsewhere",
    "they arrived at 5.Two of them slept", "find it at shop.example.net", "the cat sat at the door.It was open", "score @ home.Not away",
    "look at this.me and you", "room 12 at example.com is free", "version 2 point 5 point 1 is out", "192 points at home.Then 168", "sold @ 3.Please pay",
    "he pointed at me.you know", "I bought 4 @ 20.The rest @ 30.", "we live at number 5.no more", "contact us at example.com", "reach them at example.org",
    "It ended at last.So we went.", "born at sea.Or so they say", "dot at dot", "meet at cafe.now or never", "She works at Acme.Com they say"]
DISGUISED = [
    ("mail jane at example.com now", "jane at example.com"), ("j.doe at example.com", "j.doe at example.com"), ("ask jane99 at example.org", "jane99 at example.org"),
    ("jane at example dot com", "jane at example dot com"), ("jane @ example . com", "jane @ example . com"), ("jane@ example.com", "jane@ example.com"),
    ("jane (at) example.com", "jane (at) example.com"), ("jane dot doe at example dot co dot uk", "jane dot doe at example dot co dot uk"),
    ("write to peter at firm.de", "peter at firm.de"), ("her email is anna at post.at", "anna at post.at"), ("first_last at corp.io", "first_last at corp.io"),
    ("ɴᴀᴍᴇ@example.com", "ɴᴀᴍᴇ@example.com"), ("ⓙⓐⓝⓔ@example.com", "ⓙⓐⓝⓔ@example.com"), ("jane﹫example.com", "jane﹫example.com"),
    ("host 192 dot 168 dot 0 dot 1 is up", "192 dot 168 dot 0 dot 1"), ("at 10 punkt 0 punkt 0 punkt 7", "10 punkt 0 punkt 0 punkt 7"),
    ("192 dot 168.0 dot 1", "192 dot 168.0 dot 1"), ("JANE AT EXAMPLE DOT COM", "JANE AT EXAMPLE DOT COM")]


def test_precision_and_recall_of_disguises():
    wrong = [t for t in PROSE if PI.redacted(t) != t]
    found = [t for t, source in DISGUISED if [t[a:b] for a, _, b in PI.personal_data(t)[1]] == [source]]
    assert not wrong and len(found) == len(DISGUISED), (wrong, [t for t, _ in DISGUISED if t not in found])


def test_pii_query_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "a@b.com 1.2.3.4"), (3, "a@b.com 1.2.3.4"), (None, "x (at) y (dot) org"), (4, "é " * 40000 + "a@b.co")]
    got = PI.find_pii(docs_of(rows).withColumn("spans", F.lit("mine"))).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert by[1]["spans"] == by[2]["spans"] == "" and by[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[3]["spans"] == "email:0:7,ip:8:15" and (by[3]["n_email"], by[3]["n_ip"]) == (1, 1)
    assert by[None]["spans"] == "email:0:18" and by[None]["n_email"] == 0 and by[None]["n_added"] == 1
    assert by[4]["spans"] == "email:80000:80006"
    assert PI.find_pii(docs_of([])).collect() == []


# --- suffix dedup -------------------------------------------------------------------

def test_suffix_order_is_sorted():
    draw = random.Random(5)
    for _ in range(300):
        depth, letters = draw.choice([8, 16, 24]), draw.choice([b"ab", b"abcde", bytes(range(256)), b"\0a"])
        raw = bytes(draw.choice(letters) for _ in range(draw.randint(1, 200))) * draw.choice([1, 1, 2])
        text = raw + bytes(depth + 8)
        order = SD.suffix_order(np.frombuffer(text, dtype=np.uint8), depth).tolist()
        assert sorted(order) == list(range(len(raw)))
        keys = [text[i:i + depth] for i in order]
        assert keys == sorted(keys)


def test_repeated_strings_equal_counting():
    draw = random.Random(6)
    for _ in range(150):
        n = draw.choice([8, 12, 20])
        parts = [bytes(draw.choice(b"ab\0") for _ in range(draw.randint(n, 60))) for _ in range(draw.randint(1, 6))]
        count = Counter(p[i:i + n] for p in parts for i in range(len(p) - n + 1))
        for p, flags in zip(parts, SD.repeated_strings(parts, n)):
            assert flags.tolist() == [count[p[i:i + n]] > 1 for i in range(len(p) - n + 1)]


def test_string_hashes_tell_strings_apart():
    draw = random.Random(7)
    part = bytes(draw.choice(b"ab") for _ in range(900))
    part += part[100:500]
    strings = [part[i:i + 200] for i in range(len(part) - 199)]
    assert len({tuple(h) for h in SD._string_hashes(part).tolist()}) == len(set(strings))
    same = {}
    for s, h in zip(strings, SD._string_hashes(part).tolist()):
        assert same.setdefault(s, h) == h


def _brute_removal(rows):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[k:k + 200] for _, r in raws for k in range(len(r) - 199))
    out = []
    for i, r in raws:
        cover = bytearray(len(r))
        for k in range(len(r) - 199):
            if count[r[k:k + 200]] > 1:
                cover[k:k + 200] = b"\1" * 200
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        rest = bytes(b for b, c in zip(r, cover) if not c)
        out.append((i, len(r), sum(cover), runs, hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def _dedup_rows():
    draw = random.Random(9)
    noise = lambda n: "".join(draw.choice("abcdefghij éü\n\0") for _ in range(n))
    passage, line, page = noise(260), noise(90), noise(1500)
    rows = [(1, None), (2, ""), (3, noise(199)), (4, "xy" * 400), (5, "a" * 199), (6, "a" * 200), (7, "a" * 201)]
    rows += [(10 + i, noise(draw.randint(0, 300)) + passage + noise(draw.randint(0, 300))) for i in range(40)]
    rows += [(100 + i, noise(draw.randint(50, 250)) + line + noise(draw.randint(50, 250))) for i in range(60)]
    rows += [(200 + i, page[:400 + 7 * i] + noise(draw.randint(0, 2)) + page[400 + 7 * i:]) for i in range(30)]
    return rows + [(300, page), (300, page), (None, page), (None, noise(500)), (301, noise(400) * 2)]


@pytest.mark.parametrize("hot, piece, sort", [(400, 1 << 20, 2_000_000), (3, 1 << 20, 2_000_000), (400, 300, 2_000)])
def test_removal_equals_brute_force(docs_of, monkeypatch, hot, piece, sort):
    monkeypatch.setattr(SD, "HOT_FRAGMENTS", hot)
    monkeypatch.setattr(SD, "SCAN_STRINGS", piece)
    monkeypatch.setattr(SD, "SORT_BYTES", sort)
    rows = _dedup_rows()
    got = SD.remove_repeats(docs_of(rows).withColumn("k1", F.lit("mine")))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == _brute_removal(rows)


def test_removal_of_nothing(docs_of):
    assert SD.remove_repeats(docs_of([])).collect() == []
    assert [r["n_removed"] for r in SD.remove_repeats(docs_of([(1, "short"), (2, None)])).collect()] == [0, 0]


# --- quality classifier -------------------------------------------------------------

def _labelled(draw, n):
    words = ["the", "over", "river", "house", "and", "green", "was", "slowly", "under", "light"]
    docs, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        text = " ".join(draw.choice(words) for _ in range(draw.randint(30, 80))).capitalize() + "."
        if not good:
            text = draw.choice([text.upper().replace(" ", "!! "), text.replace(" ", "$$$ "), (text[:40] + "\n") * 9])
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_classifier_on_held_out_rows(spark, docs_of):
    docs, labels = _labelled(random.Random(3), 400)
    table = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    extra = docs + [(1000, None), (1001, ""), (None, docs[0][1]), (5, docs[5][1])]
    got = QC.classify(docs_of(extra).withColumn("score", F.lit("mine")).withColumn("quality", F.lit(0)), table).collect()
    assert len(got) == len(extra)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    # ids and held-out labels are no inputs: one text, one score; other held-out labels, the same scores
    one = {r["score"] for r in got if r["doc_id"] in (None, 0)}
    assert len(one) == 1
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = QC.classify(docs_of(extra), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    kept = QC.keep_good(docs_of(extra), table)
    assert kept.count() == sum(r["predicted"] for r in got) and len(kept.columns) == 5


def test_classifier_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(i, 1, 0) for i in range(9)], none.schema)
    for labels in (none, ones):
        got = QC.classify(docs_of([(1, "a b"), (2, None)]), labels).collect()
        assert {r["predicted"] for r in got} == {1} and len({r["score"] for r in got}) == 1
    assert QC.classify(docs_of([]), ones).collect() == []


def test_an_id_with_many_rows_is_drawn_row_by_row(spark, monkeypatch):
    """One labelled id with most rows: what the fit sees stays about fit_rows."""
    docs = spark.range(6000).selectExpr("case when id < 4000 then 7 else id end as doc_id", "concat('some words of row ', id % 97) as text").unionByName(
        spark.range(50).selectExpr("10000 + id as doc_id", "'$$$ !!! ###' as text")).repartition(4)
    labels = spark.range(10050).selectExpr("id as doc_id", "int(id < 10000) as quality", "0 as toxic")
    labels = labels.unionByName(labels.limit(3000).withColumn("quality", F.lit(0)))  # repeated ids of two minds
    seen = []
    fit = QC.fit_bradley_terry
    monkeypatch.setattr(QC, "fit_bradley_terry", lambda x, good: (seen.append(len(x)), fit(x, good))[1])
    got = QC.classify(docs, labels, fit_rows=300)
    assert got.count() == 6050 and 150 < seen[0] < 500


def test_the_fit_is_at_the_optimum_of_its_loss():
    """The gradient is zero there, and plain gradient descent finds nothing lower."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 4))
    good = x @ [1.0, -0.5, 0.0, 0.3] + draw.normal(size=300) > 0.4
    model = QC.fit_bradley_terry(x, good)
    z = np.clip((x - model.mean) / model.scale, -QC.CLIP, QC.CLIP)
    ups, downs, rng = np.flatnonzero(good), np.flatnonzero(~good), np.random.default_rng(QC.SEED)
    n = QC.PAIRS_PER_ROW * max(len(ups), len(downs))
    diff = z[np.resize(rng.permutation(ups), n)] - z[rng.choice(downs, n)]
    loss = lambda w: np.log1p(np.exp(-(diff @ w))).mean() + QC.RIDGE / 2 * (w @ w)
    slope = lambda w: -(diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) + QC.RIDGE * w
    assert np.abs(slope(model.weights)).max() < 1e-5
    w = np.zeros(4)
    for _ in range(3000):
        w -= 0.5 * slope(w)
    assert loss(model.weights) <= loss(w) + 1e-9 and np.allclose(w, model.weights, atol=1e-3)


def test_fit_ranks_by_the_feature_that_tells():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 5))
    good = x[:, 2] + 0.3 * draw.normal(size=400) > -0.5
    model = QC.fit_bradley_terry(x, good)
    assert np.argmax(np.abs(model.weights)) == 2 and model.weights[2] > 0
    assert np.mean((model.score(x) >= 0.3) == good) > 0.85
    # the cut is the quantile of bad labels
    assert abs(np.mean(model.strength(x) < model.cut) - np.mean(~good)) < 0.01


# --- pipeline -----------------------------------------------------------------------

def _write(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    labelled, labels = _labelled(random.Random(3), 300)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = "which of the seven rivers under the green house was slowly over the light and under the river"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return item


def test_pipeline_stages_take_effect(spark, docs_of, tmp_path):
    rows, _ = _labelled(random.Random(3), 300)
    item = "which of the seven rivers under the green house was slowly over the light and under the river"
    prose = random.Random(11)
    words = ["over", "river", "house", "green", "slowly", "under", "light", "and", "the", "was"]
    clean = lambda n: " ".join(prose.choice(words) for _ in range(n)).capitalize() + "."
    copy = clean(60)
    rows = rows + [(900, copy), (901, copy.lower()), (902, clean(30) + "\n" + item + " " + clean(30)),
                   (903, clean(40) + " Mail a.b@mail.example.com now. " + clean(30)), (904, None), (904, None)]
    docs = docs_of(rows)
    path = str(tmp_path / "sf")
    _write(spark, path, docs)
    assert [n for n, _ in corpus_pipeline.STAGES][1:3] == ["simhash_near_dedup", "benchmark_decontamination"]
    at, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, path).persist()
        assert at.columns == docs.columns
        seen.append({r["doc_id"]: r for r in at.collect()})
    quality, near, clean_of_leaks, private = seen
    assert {900, 901, 902, 903} <= set(quality)
    assert (900 in near) and (901 not in near) and set(near) <= set(quality)
    assert set(near) - set(clean_of_leaks) == {902}
    assert set(private) == set(clean_of_leaks) and "<EMAIL>" in private[903]["text"] and "a.b@" not in private[903]["text"]
    assert private[903]["n_chars"] == len(private[903]["text"])
    final = corpus_pipeline.run(spark, path)
    assert final.columns == docs.columns + ["copy"] and {r["doc_id"] for r in final.collect()} <= set(private)
    assert final.filter("copy > 3 OR text LIKE '%a.b@mail%'").count() == 0


def test_pipeline_of_an_empty_table(spark, docs_of, tmp_path):
    path = str(tmp_path / "sf")
    _write(spark, path, docs_of([]))
    assert corpus_pipeline.run(spark, path).collect() == []
