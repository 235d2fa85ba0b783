"""Url filter, licence scan and secret scan against brute force and edges."""

import hashlib
import re

import pytest

from cadenza.llm import license_scan as LI
from cadenza.llm import secret_scan as SE
from cadenza.llm import url_filter as UF

PAGES = "page_id long, url string, html string"


def _verdicts(spark, rows):
    return {r["page_id"]: r for r in UF.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}


def test_rules_and_parts(spark):
    got = _verdicts(spark, [
        (1, "http://A.B.Example.NET/en/x?q#f", None), (2, "http://x.net/de/", ""), (3, "https://x.example.com/de/a", ""),
        (4, "https://x.example.com/de", ""), (5, None, ""), (6, "no scheme", ""), (7, "http://net", ""), (8, "http://fakenet/", ""),
        (9, "x://y.org?z=1#://other.net/", ""), (10, "http://q.org/fr/", ""), (11, "http://net/", ""), (11, "http://net/", "")])
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.b.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("net/", "block")
    assert (got[3]["rule"], got[3]["verdict"]) == ("example.com/de/", "block")
    for i in (4, 5, 6, 7, 8):
        assert (got[i]["rule"], got[i]["verdict"]) == (None, "allow")
    assert (got[5]["host"], got[5]["path"]) == ("", "") == (got[6]["host"], got[6]["path"])
    assert (got[9]["host"], got[9]["path"]) == ("y.org", "")
    assert got[10]["rule"] == "org/fr/" and got[11]["verdict"] == "block"


def test_aliases_take_block_and_allow_outranks_it(spark):
    canon = '<html><head><LINK href="{}" rel="canonical"></head>'
    refresh = '<meta http-equiv=refresh content="0; url={}">'
    got = _verdicts(spark, [
        (1, "http://a.com/1", canon.format("http://b.com/1")), (2, "http://b.com/1", refresh.format("//c.com/1")),
        (3, "http://c.com/1", canon.format("http://bad.net/x")),  # chain to a blocked address that is no page
        (4, "http://d.com/1", canon.format("http://bad.net/y")), (5, "http://e.com/1", canon.format("http://d.com/1")),
        (6, "http://e.com/1#again", canon.format("http://good.org/fr/z")),  # allowed member of the same component
        (7, "http://f.com/1", canon.format("/self")), (8, "http://bad.net/x", None)])
    assert [got[i]["verdict"] for i in range(1, 9)] == ["block"] * 3 + ["allow"] * 4 + ["block"]
    assert got[1]["rule"] is None


CANON, REFRESH = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
LINK_CASES = [
    ("http://a.com/d/p.html", CANON.format("page.html"), ["http://a.com/d/page.html"]),
    ("http://a.com/d/p?x=1", CANON.format("?id=2"), ["http://a.com/d/p?id=2"]),
    ("http://a.com/d/e/p", CANON.format("../x?q=../y"), ["http://a.com/d/x?q=../y"]),
    ("http://a.com", CANON.format("./x/./y/.."), ["http://a.com/x/"]),
    ("http://a.com/d/", CANON.format("/../a/../b"), ["http://a.com/b"]),
    ("http://a.com/d/p", CANON.format("/login?next=https://spam.net/x"), ["http://a.com/login?next=https://spam.net/x"]),
    ("http://a.com/d/p", CANON.format("go?u=http://spam.net/"), ["http://a.com/d/go?u=http://spam.net/"]),
    ("http://a.com/", CANON.format("http://b.com/?x=1&amp;y=2&#38;z=&#x33;&amp;lt;&unknown;&copy=1"),
     ["http://b.com/?x=1&y=2&z=3&lt;&unknown;&copy=1"]),
    ("http://a.com/", CANON.format("/1") + REFRESH.format("/3") + CANON.format("/2") + REFRESH.format("4"),
     ["http://a.com/1", "http://a.com/2", "http://a.com/3", "http://a.com/4"]),
    ("http://a.com/d/p", '<base href="//c.org/e/f">' + CANON.format("g"), ["http://c.org/e/g"]),
    ("http://a.com/d/p", '<base href="../h/">' + CANON.format("g"), ["http://a.com/h/g"]),
    ("http://a.com/d/p", CANON.format("mailto:x@y.z") + CANON.format("HTTPS://B.com/"), ["HTTPS://B.com/"]),
    (None, CANON.format("x"), []), ("none", CANON.format("x"), []), ("http://a.com/", None, []),
]


def test_link_targets_are_resolved(spark):
    canon = CANON
    cases = LINK_CASES
    got = {}
    rows = [(i, u, h) for i, (u, h, _) in enumerate(cases)]
    for i, (u, h, want) in enumerate(cases):
        frame = spark.createDataFrame([rows[i]], PAGES)
        got[i] = sorted(r["target"] for r in UF.alias_links(frame).collect())
        assert got[i] == sorted(want), u
    blocked = _verdicts(spark, [(1, "http://a.com/p", canon.format("/login?next=https://spam.net/x")),
                                (2, "http://a.com/q", canon.format("r?x=1&amp;y=2")), (3, "http://a.com/r?x=1&y=2", canon.format("//bad.net/"))])
    assert [blocked[i]["verdict"] for i in (1, 2, 3)] == ["allow", "block", "block"]


def test_many_rules_are_joined(spark, monkeypatch):
    """The joined table gives what the expression gives."""
    rules = UF.RULES + (UF.Rule("block", "a.com", "/x"), UF.Rule("allow", "a.com", "/x/y"), UF.Rule("block", "b.a.com", "/"), UF.Rule("allow", "com", "/x/yyy"),
                        UF.Rule("allow", "x.org", "/f"), UF.Rule("block", "x.org", "/f"), UF.Rule("block", "q", ""))
    urls = [f"http://{h}{p}" for h in ("a.com", "b.a.com", "c.b.a.com", "xa.com", "com", "x.org", "example.net", "q", "z.q", "") for p in (
        "", "/", "/x", "/x/y", "/x/yyyy", "/f/1", "/fr/", "/en/q?x")] + [None, "none"]
    frame = spark.createDataFrame([(i, u, CANON.format("http://b.a.com/k") if i % 9 == 0 else None) for i, u in enumerate(urls)], PAGES)
    want = sorted(map(repr, UF.filter_urls(frame, rules).collect()))
    monkeypatch.setattr(UF, "MAX_RULES", 3)
    assert sorted(map(repr, UF.filter_urls(frame, rules).collect())) == want


def test_urls_empty_and_clashing_columns(spark):
    assert UF.filter_urls(spark.createDataFrame([], PAGES)).collect() == []
    df = spark.createDataFrame([(1, "http://x.net/", None, "mine")], PAGES + ", verdict string")
    assert [r["verdict"] for r in UF.filter_urls(df).collect()] == ["block"]


def _licences(docs):
    return {r["doc_id"]: r for r in LI.scan_licenses(docs).collect()}


def test_licences(docs_of):
    got = _licences(docs_of([
        (1, "prose here\nReleased under the MIT License.\nmore prose"), (2, "LICENSED under the Apache-License version 2.0!"),
        (3, None), (4, ""), (5, "released under the terms of a license"), (6, "This work is licensed under the GNU General Public License, version 3.\n" * 2),
        (7, "Released under\nthe MIT License"), (8, "word " * 30000 + "\nLicensed under CC BY-NC 4.0.")]))
    assert {k: v["licenses"] for k, v in got.items()} == {
        1: "MIT", 2: "Apache-2.0", 3: "", 4: "", 5: "", 6: "GPL-3.0", 7: "MIT", 8: "CC-BY-NC-4.0"}
    assert got[6]["n_passages"] == 2 and got[1]["best_score"] == 1.0 and got[3]["best_license"] is None
    assert _licences(docs_of([])) == {}


def _dice(a, b):
    grams = lambda t: {tuple(x) for w in [re.sub(r"[\W_]+", " ", t.lower()).split()] for x in zip(w, w[1:])}
    a, b = grams(a), grams(b)
    return 2 * len(a & b) / max(1, len(a) + len(b))


def _best_licence(text):
    """The highest score over the text, its lines and all windows that have a bigram of a template's rarest in its place."""
    found = [_dice(p, t) for p in [text, *text.split("\n")] for _, t in LI.TEMPLATES]
    words = LI.template_words(text)
    for _, t in LI.TEMPLATES + LI.FULL_TEXTS:
        tw = LI.template_words(t)
        grams = list(dict.fromkeys(zip(tw, tw[1:])))
        rare = sorted(grams, key=lambda g: (-len(" ".join(g)), " ".join(g)))[:len(grams) - -(-2 * len(grams) // 3) + 1]
        for at in range(-len(tw), len(words)):
            if any((words[at + i], words[at + i + 1]) in rare and (words[at + i], words[at + i + 1]) == (tw[i], tw[i + 1])
                   for i in range(max(0, -at), min(len(tw) - 1, len(words) - 1 - at))):
                found.append(_dice(" ".join(words[max(0, at):at + len(tw)]), t))
    return max(x if x >= LI.THRESHOLD else 0 for x in found)


def test_licence_pruning_loses_nothing(docs_of):
    import random

    draw = random.Random(3)
    rows = []
    for i in range(150):
        words = draw.choice(LI.TEMPLATES + LI.FULL_TEXTS)[1].split()
        for _ in range(draw.randint(0, 3 + len(words) // 12)):
            words[draw.randrange(len(words))] = draw.choice(["x", "the", "License"])
        if i % 3 == 0:
            words = ["some", "prose"] * draw.randint(0, 9) + words + ["more"] * draw.randint(0, 9)
        rows.append((i, "".join(w + draw.choice([" ", " ", " ", "\n", "\n * "]) for w in words)))
    got = _licences(docs_of(rows))
    for i, text in rows:
        assert abs(got[i]["best_score"] - _best_licence(text)) < 1e-12, text


@pytest.mark.parametrize("wrap", [40, 75])
def test_full_texts_and_headers_are_found(docs_of, wrap):
    """Wrapped, in comments, inside longer files and lines, with a few words changed."""
    import textwrap

    rows, want = [], {}
    for i, (name, text) in enumerate(LI.FULL_TEXTS):
        lines = textwrap.wrap(text, wrap)
        words = text.split()
        words[len(words) // 2] = "another"
        for j, made in enumerate(["\n".join(lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint main() {}", "\n".join(f"# {x}" for x in lines),
                                  "Readme\n\nSome words about it.\n\n" + "\n".join(lines) + "\n\nand so on. " * 40, " ".join(words)]):
            rows.append((10 * i + j, made))
            want[10 * i + j] = name
    rows += [(900, "MIT License\n\nCopyright (c) 2020 A B\n\n" + "\n".join(textwrap.wrap(LI.FULL_TEXTS[0][1], wrap))),
             (901, "This project is Licensed under the MIT License. See file."), (902, "Permission was granted to go, free of charge, to any person."),
             (903, "\n".join(textwrap.wrap(LI.FULL_TEXTS[0][1], wrap)) + "\n\nThird party\n\n" + "\n".join(textwrap.wrap(LI.FULL_TEXTS[1][1], wrap)))]
    got = _licences(docs_of(rows))
    for i, name in want.items():
        assert got[i]["best_license"] == name, (i, name, got[i])
    assert got[900]["licenses"] == "MIT" and got[901]["licenses"] == "MIT" and got[902]["licenses"] == ""
    assert got[903]["licenses"] == "ISC,MIT" and got[903]["n_passages"] == 2


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_against_python(docs_of):
    import random

    draw = random.Random(9)
    bits = ["token", "secret", "API_KEY", "apikey", "passwd", "Password", " = ", ":", '"', "'", "abc", "abcdef", "é𝄞", "\n", "AKIA",
            "ABCDEFGH12345678", "0a1b2c3d4e5f", " ", "=", "ghp_", "x" * 36, "tok", "en"]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randint(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "token: abcdef " * 3000), (None, "secret=abcdefg"), (7, rows[7][1])]
    got = [(r["doc_id"], r["base_sha256"], r["n_assign"], r["spans"]) for r in SE.scan_secrets(docs_of(rows)).collect()]
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(hashlib.sha256(_base(text).encode()).hexdigest())
    assert len(got) == len(rows)
    for i, h, _, _ in got:
        assert h in want[i]
    assert [n for i, _, n, _ in got if i == 1002] == [3000] and [s for i, _, _, s in got if i is None] == ["assign:0:14"]
    assert [s for i, _, _, s in got if i == 1002][0] == _base("token: abcdef " * 3000)


def test_secret_kinds_added_and_empty(docs_of):
    got = SE.scan_secrets(docs_of([(1, "x ghp_" + "A" * 36 + " y"), (2, "-----BEGIN RSA PRIVATE KEY-----")])).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {1: "github:2:42", 2: "pem:0:31"}
    assert SE.scan_secrets(docs_of([])).collect() == []


def test_trigram_queries_are_mandatory():
    q = SE.trigram_query(SE.ASSIGN)
    assert ["ken", "oke", "tok"] in q and SE.trigram_query("[0-9a-f]{24,}") == []
    for text in ("my token=abcdefg", "API_KEY : 'abcdefg", "apikey=abcdefg", "PASSWD:abcdefg"):
        assert ASSIGN.search(text) and any(all(t in text.lower() for t in a) for a in q)
