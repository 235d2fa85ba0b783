"""DuckDB SQL of the queries that SQL can express, written from the raw
tables; it shares only rules, templates and thresholds with the operators."""

from __future__ import annotations

import math
import re
import string

from cadenza.llm import host_rules as HR
from cadenza.llm import license_scan as LI
from cadenza.llm import secret_scan as SE
from cadenza.llm import url_filter as UF


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any_case(word: str) -> str:
    """A regex for a word in ASCII letters of either case (case folding of the
    engine would take further letters in)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# --- urls ---------------------------------------------------------------------------

def _host(url: str) -> str:
    return (f"translate(COALESCE(regexp_extract({url}, '://([^/?#]*)', 1), ''), "
            f"'{string.ascii_uppercase}', '{string.ascii_lowercase}')")


def _path(url: str) -> str:
    return f"COALESCE(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '')"


def _address(url: str) -> str:
    query = rf"COALESCE(regexp_extract({url}, '://[^/?#]*[^?#]*(\?[^#]*)', 1), '')"
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || {_path(url)} || {query} END"


def _rule(host: str, path: str, value) -> str:
    longest_first = sorted(UF.RULES, key=lambda r: (-len(r.text), r.verdict, r.text))
    cases = " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') "
                     f"THEN '{value(r)}'" for r in longest_first)
    return f"CASE {cases} END"


def _ascii_cases(pattern: str) -> str:
    """A pattern of ``(?is)`` whose letters match in either ASCII case only."""
    cases = re.sub(r"\\.|[a-z]", lambda m: m[0] if m[0][0] == "\\" else f"[{m[0].upper()}{m[0]}]", pattern.removeprefix("(?is)"))
    return _text("(?s)" + cases)


def _decode(href: str) -> str:
    """Character references of a link replaced, each once."""
    rest = "regexp_replace(p, '^&[^;]*;', '')"
    number = ("CASE WHEN regexp_matches(p, '^&#[xX][0-9a-fA-F]{1,8};') THEN ('0x' || regexp_extract(p, '^&#[xX]([0-9a-fA-F]{1,8});', 1))::BIGINT "
              "WHEN regexp_matches(p, '^&#[0-9]{1,9};') THEN regexp_extract(p, '^&#([0-9]{1,9});', 1)::BIGINT END")
    named = " ".join(f"WHEN starts_with(p, '&{name};') THEN {_text(value)} || {rest}" for name, value in UF.ENTITIES.items())
    part = (f"CASE WHEN ({number}) BETWEEN 1 AND 55295 OR ({number}) BETWEEN 57344 AND 1114111 THEN chr(CAST({number} AS INTEGER)) || {rest} "
            f"{named} ELSE p END")
    return (f"(string_split({href}, '&')[1] || array_to_string(list_transform(list_transform(string_split({href}, '&')[2:], "
            f"lambda p: '&' || p), lambda p: {part}), ''))")


def _undotted(path: str) -> str:
    parts = f"string_split(regexp_replace({path}, '/(\\.\\.?)$', '/\\1/'), '/')[2:]"
    return (f"('/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({parts}, lambda x: [x])), lambda kept, x: "
            "CASE WHEN x[1] = '..' THEN CASE WHEN len(kept) > 1 THEN kept[1:len(kept) - 1] ELSE CAST([] AS VARCHAR[]) END "
            "WHEN x[1] = '.' THEN kept ELSE list_concat(kept, x) END), '/'))")


def _resolve(href: str, base: str) -> str:
    scheme, root = f"regexp_extract({base}, '^(.*?)://', 1)", f"regexp_extract({base}, '^(.*?)://', 1) || '://' || {_host(base)}"
    path, rest = f"regexp_extract({href}, '(?s)^([^?#]*)', 1)", f"regexp_extract({href}, '(?s)^[^?#]*(.*)$', 1)"
    query = rf"regexp_extract({base}, '://[^/?#]*[^?#]*(\?[^#]*)', 1)"
    folder = f"regexp_replace(CASE WHEN {_path(base)} = '' THEN '/' ELSE {_path(base)} END, '[^/]*$', '')"
    return f"""CASE WHEN {href} = '' THEN NULL WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {href}
    WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN {_host(base)} = '' THEN NULL WHEN starts_with({href}, '/') THEN {root} || {_undotted(path)} || {rest}
    WHEN starts_with({href}, '?') THEN {root} || {_path(base)} || {href} WHEN starts_with({href}, '#') THEN {root} || {_path(base)} || {query} || {href}
    ELSE {root} || {_undotted(f"{folder} || {path}")} || {rest} END"""


def url_filter_sql() -> str:
    def hrefs(tag: str, value: str) -> str:
        return f"list_transform(COALESCE(regexp_extract_all(html, {_ascii_cases(tag)}), []), lambda x: regexp_extract(x, {_ascii_cases(value)}, 1))"

    own = f"regexp_extract(regexp_extract(html, {_ascii_cases(UF.BASE_TAG)}), {_ascii_cases(UF.LINK_HREF)}, 1)"
    verdict = _rule(_host("url"), _path("url"), lambda r: r.verdict)
    return f"""WITH RECURSIVE found AS (
  SELECT url, {own} AS own, list_filter(list_concat({hrefs(UF.LINK_TAG, UF.LINK_HREF)}, {hrefs(UF.REFRESH_TAG, UF.REFRESH_URL)}),
                                        lambda t: t <> '') AS hrefs FROM pages),
based AS (SELECT url, {_decode('own')} AS own, unnest(hrefs) AS raw FROM found),
given AS (SELECT url, COALESCE({_resolve('own', 'url')}, url) AS base, {_decode('raw')} AS href FROM based),
resolved AS (SELECT url, {_resolve('href', 'base')} AS target FROM given),
links AS (SELECT url, target FROM resolved WHERE {_address('url')} IS NOT NULL AND {_address('target')} IS NOT NULL),
ends AS (SELECT url, {_address('url')} AS node FROM (SELECT url FROM links UNION ALL SELECT target FROM links)),
edges AS (SELECT DISTINCT a, b FROM (
  SELECT {_address('url')} AS a, {_address('target')} AS b FROM links
  UNION ALL SELECT {_address('target')}, {_address('url')} FROM links) WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
said AS (SELECT DISTINCT node, {verdict} AS v FROM ends),
decided AS (SELECT r.node, MAX((s.v = 'allow')::INT) AS allowed, MAX((s.v = 'block')::INT) AS blocked
            FROM reach r JOIN said s ON s.node = r.other GROUP BY r.node),
judged AS (SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_address('url')} AS address FROM pages)
SELECT page_id, host, path, {_rule('host', 'path', lambda r: r.text)} AS rule,
       COALESCE({_rule('host', 'path', lambda r: r.verdict)},
                CASE WHEN d.blocked = 1 AND COALESCE(d.allowed, 0) = 0 THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN decided d ON d.node = judged.address"""


# --- licences -----------------------------------------------------------------------

def license_scan_sql() -> str:
    rows, windows, anchors = [], [], []
    for k, (name, text) in enumerate(LI.TEMPLATES + LI.FULL_TEXTS):
        words = LI.template_words(text)
        grams = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        if k < len(LI.TEMPLATES):
            rows.append(f"('{name}', [{', '.join(map(_text, grams))}])")
        windows.append(f"({k}, '{name}', {len(words)}, [{', '.join(map(_text, grams))}])")
        # the longest bigrams, one more than a match may lack
        rare = set(sorted(grams, key=lambda g: (-len(g), g))[:len(grams) - math.ceil(LI.THRESHOLD * len(grams) / (2 - LI.THRESHOLD) - 1e-9) + 1])
        anchors += [f"({k}, {_text(f'{a} {b}')}, {i})" for i, (a, b) in enumerate(zip(words, words[1:])) if f"{a} {b}" in rare]
    return rf"""WITH tpl(license, tb) AS (VALUES {', '.join(rows)}),
wtpl(k, license, n_words, tb) AS (VALUES {', '.join(windows)}),
anchor(k, g, place) AS (VALUES {', '.join(anchors)}),
norm AS (SELECT doc_id, regexp_replace(lower(COALESCE(text, '')), '[^\p{{L}}\p{{N}}
]+', ' ', 'g') AS n FROM documents),
lines AS (SELECT doc_id, unnest(string_split(n, chr(10))) AS l, unnest(range(len(string_split(n, chr(10))))) AS line FROM norm
          UNION ALL SELECT doc_id, replace(n, chr(10), ' '), -1 FROM norm),
words AS (SELECT doc_id, line, list_filter(string_split(l, ' '), lambda w: w <> '') AS w FROM lines),
grams AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
          FROM words WHERE len(w) > 1),
scored AS (SELECT doc_id, line, license, 2 * len(list_intersect(b, tb)) / CAST(len(b) + len(tb) AS DOUBLE) AS score FROM grams, tpl),
near AS (SELECT * FROM scored WHERE score >= {LI.THRESHOLD} QUALIFY score = MAX(score) OVER (PARTITION BY doc_id, line)),
places AS (SELECT doc_id, i - 1 AS i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words WHERE line = -1)),
starts AS (SELECT DISTINCT doc_id, k, i - place AS begins FROM places JOIN anchor USING (g)),
spans AS (SELECT doc_id, license, tb, w, greatest(begins, 0) AS s, least(begins + n_words, len(w)) AS e FROM starts JOIN wtpl USING (k)
          JOIN (SELECT * FROM words WHERE line = -1) USING (doc_id)),
windows AS (SELECT doc_id, license, s, e, tb, list_distinct(list_transform(range(s + 1, e), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM spans),
reached AS (SELECT * FROM (SELECT doc_id, license, s, e, 2 * len(list_intersect(b, tb)) / CAST(len(b) + len(tb) AS DOUBLE) AS score FROM windows)
            WHERE score >= {LI.THRESHOLD}),
free AS (SELECT * FROM reached x WHERE NOT EXISTS (SELECT 1 FROM reached y WHERE y.doc_id = x.doc_id AND y.score > x.score AND y.s < x.e AND x.s < y.e)),
every AS (SELECT doc_id, line, NULL AS s, license, score FROM near UNION ALL SELECT doc_id, NULL, s, license, score FROM free),
hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
                first(license ORDER BY score DESC, license) AS best_license, MAX(score) AS best_score,
                greatest(COUNT(DISTINCT line) FILTER (line >= 0), COUNT(DISTINCT s), 1) AS n_passages
         FROM every GROUP BY doc_id)
SELECT d.doc_id, COALESCE(licenses, '') AS licenses, best_license, COALESCE(best_score, 0.0) AS best_score,
       COALESCE(n_passages, 0) AS n_passages FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id"""


# --- secrets ------------------------------------------------------------------------

def secret_scan_sql() -> str:
    keywords = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    parts = []
    for i, rule in enumerate(SE.RULES):
        pattern = _text(rule.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", f"({keywords})"))
        parts.append(f"""SELECT doc_id, {i} AS k, regexp_extract_all(t, {pattern}, 0) AS m,
       regexp_extract_all(t, {pattern}, {rule.group}) AS g, string_split_regex(t, {pattern}) AS p, {rule.min_chars} AS least
FROM docs WHERE regexp_matches(t, {pattern})""")
    names = "[" + ", ".join(f"'{r.kind}'" for r in SE.RULES) + "]"
    base = sum(r.base for r in SE.RULES)
    counts = ", ".join(f"COUNT(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(SE.RULES) if r.base)
    return f"""WITH docs AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, k, m, g, p, least, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (SELECT doc_id, k, least, length(g[i]) AS chars,
                 list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS e,
                 length(m[i]) AS n FROM each),
good AS (SELECT doc_id, k, CAST(e - n AS BIGINT) AS s, {names}[k + 1] || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) AS listed
         FROM spans WHERE chars >= least),
sums AS (SELECT doc_id, {counts}, string_agg(listed, ',' ORDER BY s, k) FILTER (k < {base}) AS base,
                string_agg(listed, ',' ORDER BY s, k) AS spans, COUNT(*) AS n_spans FROM good GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'COALESCE(n_{r.kind}, 0) AS n_{r.kind}' for r in SE.RULES if r.base)},
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(n_spans, 0) AS n_spans
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id"""


# --- host rules ---------------------------------------------------------------------

def host_rules_sql() -> str:
    space = r"[\x20\x09-\x0D]+"
    return rf"""WITH docs AS (SELECT doc_id, source AS host, COALESCE(text, '') AS t FROM documents),
words AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '{space}'), lambda w: w <> '') AS w FROM docs),
windows AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
repeats AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (
              SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)
          WHERE regexp_replace(l, '{space}', '', 'g') <> '' GROUP BY doc_id),
measured AS (
  SELECT w.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         COALESCE(l.n, 0) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words, COALESCE(l.n_lines, 0) AS n_lines
  FROM words w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN repeats r ON r.doc_id = w.doc_id),
judged AS (SELECT *, n_words < {HR.MIN_WORDS} AS fails_short, 100 * n_repeat_words > {HR.MAX_REPEAT_PERCENT} * n_words AS fails_repeats,
                  100 * n_symbols > {HR.MAX_SYMBOL_PERCENT} * word_chars AS fails_symbols,
                  100 * n_dup_lines > {HR.MAX_DUP_LINE_PERCENT} * n_lines AS fails_dup_lines FROM measured),
each AS (SELECT host, rule, COUNT(*) AS n, CAST(SUM(fails::INT) AS BIGINT) AS f FROM (
           SELECT host, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule,
                  unnest([fails_short, fails_repeats, fails_symbols, fails_dup_lines]) AS fails FROM judged) GROUP BY host, rule),
total AS (SELECT rule, SUM(n)::DOUBLE AS nn, SUM(f) / SUM(n)::DOUBLE AS mean, COUNT(*) AS h, SUM(f * f / n::DOUBLE) AS ff FROM each GROUP BY rule),
spread AS (SELECT rule, nn, mean, ff / nn - mean * mean - mean * (1 - mean) * h / nn AS between_hosts FROM total),
prior AS (SELECT rule, mean, CASE WHEN between_hosts > 1e-12 THEN greatest(1.0, least(nn, mean * (1 - mean) / between_hosts - 1)) ELSE nn END AS weight
          FROM spread),
rates AS (SELECT host, rule, (f + mean * weight) / (n + weight) AS rate FROM each JOIN prior USING (rule)),
verdicts AS (SELECT host, MAX(rate) FILTER (rule = 'short') AS rate_short, MAX(rate) FILTER (rule = 'repeats') AS rate_repeats,
                    MAX(rate) FILTER (rule = 'symbols') AS rate_symbols, MAX(rate) FILTER (rule = 'dup_lines') AS rate_dup_lines,
                    MAX(rate) AS host_rate FROM rates GROUP BY host)
SELECT j.*, fails_short OR fails_repeats AS base_failed, ROUND(rate_short, 6) AS rate_short, ROUND(rate_repeats, 6) AS rate_repeats,
       ROUND(rate_symbols, 6) AS rate_symbols, ROUND(rate_dup_lines, 6) AS rate_dup_lines, ROUND(host_rate, 6) AS host_rate,
       NOT (fails_short OR fails_repeats) AND host_rate <= {HR.MAX_HOST_RATE} AS kept
FROM judged j JOIN verdicts v ON v.host IS NOT DISTINCT FROM j.host"""


# --- lexical search -----------------------------------------------------------------

def lexical_search_sql() -> str:
    def terms(table: str, key: str) -> str:
        lowered = f"translate(COALESCE(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
        return (f"SELECT row_number() OVER () AS r, {key}, "
                rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table}")

    return f"""WITH docs AS (SELECT * FROM ({terms('documents', 'doc_id')}) WHERE len(w) > 0),
items AS ({terms('benchmark', 'item_id')}),
total AS (SELECT COUNT(*) AS n_docs, CAST(SUM(len(w)) AS BIGINT) AS n_terms FROM docs),
sized AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM docs, total),
occurs AS (SELECT r, t, COUNT(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * COUNT(*) + 1))) AS BIGINT) AS weight
            FROM occurs, total GROUP BY t),
asked AS (SELECT r AS q, item_id, unnest(list_distinct(w)) AS t FROM items),
scored AS (SELECT q, item_id, o.r, CAST(SUM(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM asked JOIN occurs o USING (t) JOIN weights USING (t) JOIN sized s ON s.r = o.r GROUP BY q, item_id, o.r),
ranked AS (SELECT item_id, doc_id, score,
                  row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank
           FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


# --- prefix trie --------------------------------------------------------------------

def _crc32(value: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce(list_prepend(xor(acc, x), range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    codes = f"list_transform(string_split({value}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda acc, x: {byte}), 4294967295)"


def prefix_trie_sql() -> str:
    return f"""WITH given AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS sha, length(text) AS n FROM given),
turns AS (SELECT conv_id, sha, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS pos FROM hashed),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM turns),
parts AS (SELECT c.conv_id, 0 AS part, pos, sha, n FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
          UNION ALL SELECT c.conv_id, 1, pos, sha, n FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
paths AS (SELECT conv_id, n, row_number() OVER w AS depth, string_agg(sha, '') OVER w AS path FROM parts
          WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
          UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (SELECT path, conv_id, depth, n, depth = MAX(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (SELECT path, depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, any_value(n) AS n,
                 string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ends FROM members GROUP BY path, depth),
children AS (SELECT path[:64 * (depth - 1)] AS path, COUNT(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path),
up AS (SELECT path[:64 * i] AS above, saved, leaf FROM (
         SELECT path, (n_convs - 1) * n AS saved, (n_children = 0)::INT AS leaf, unnest(range(0, depth + 1)) AS i FROM full_nodes)),
sums AS (SELECT above, SUM(saved) AS saved_tokens, SUM(leaf) AS n_leaves FROM up GROUP BY above)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(COALESCE(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.above = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:64 * (n.depth - 1)]"""


def llm_oracle() -> dict[str, str]:
    return {"op3_url_filter": url_filter_sql(), "op4_license_scan": license_scan_sql(), "op5_secret_scan": secret_scan_sql(),
            "op9_host_rules": host_rules_sql(), "op11_lexical_search": lexical_search_sql(), "op13_prefix_trie": prefix_trie_sql()}
