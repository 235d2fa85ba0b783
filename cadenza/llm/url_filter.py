"""Block and allow rules for urls, spread over redirect equivalence.

A rule fits its host and all subdomains where the url's path starts with the
rule's path; the longest rule that fits decides.  Urls without a rule take
the decision of their alias group: the connected component over canonical
links and redirects found in the pages.  In a component one explicitly
allowed member outranks any number of blocked ones; without either the
verdict is allow.

DataFrame functions only.  Up to ``MAX_RULES`` rules become one expression;
more of them are a table, joined on the rule's host (each suffix of the url's
host) and on as long a prefix of the path as some rule of that host has.  Links
are found in one scan of the pages and only they enter the component search, so
pages without links cost no shuffle beyond one join with the decided addresses.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import connected_components
from cadenza.llm.shared import shared_table

MAX_RULES = 500  # so many are compiled into the plan, more are joined


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
LINK_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
BASE_TAG = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"
REFRESH_URL = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>;]*;\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Identity of a url: host, path and query without scheme and fragment;
    null without a host."""
    host = host_of(url)
    query = F.coalesce(F.regexp_extract(url, r"://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host != "", F.concat(host, path_of(url), query))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; among rules
    of one length an allow comes first, then the smaller text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    best_last = sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", [-ord(c) for c in r.text]))
    for r in best_last:  # the last one wraps all others, so it is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def with_rule(urls: DataFrame, rules: tuple[Rule, ...], host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` with ``found``, the (rule, verdict) of :func:`rule_of`."""
    if len(rules) <= MAX_RULES:
        return urls.withColumn("found", rule_of(F.col(host), F.col(path), rules))
    listed = urls.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, said string")
    lengths = listed.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    asked = urls.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = asked.withColumn("labels", F.split("h", r"\.")).withColumn(
        "rule_host", F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")))
    tried = labels.join(lengths, "rule_host").select("h", "p", "rule_host", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("p")).select(
        "h", "p", "rule_host", F.substring("p", F.lit(1), F.col("n")).alias("rule_path"))
    # the longest rule; of one length an allow, then the smaller text, as in rule_of
    text = F.concat("rule_host", "rule_path")
    rank = F.struct(-F.length(text), F.col("said") != "allow", text)
    best = tried.join(listed, ["rule_host", "rule_path"]).groupBy("h", "p").agg(
        F.min_by(F.struct(text.alias("rule"), F.col("said").alias("verdict")), rank).alias("found"))
    return urls.join(best, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left").drop("h", "p")


#: Named references that stand in urls; numbers are decoded whatever they are.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "quest": "?", "equals": "=",
            "num": "#", "period": ".", "percnt": "%", "comma": ",", "semi": ";", "plus": "+", "lowbar": "_"}
ABSOLUTE = r"(?i)^[a-z][a-z0-9+.-]*://"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _decoded(href: Column) -> Column:
    """Character references replaced, each once."""
    def first(part: Column) -> Column:
        rest = F.regexp_replace(part, "^&[^;]*;", "")
        number = F.coalesce(F.conv(F.nullif(F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]{1,8});", 1), F.lit("")), 16, 10),
                            F.nullif(F.regexp_extract(part, "^&#([0-9]{1,9});", 1), F.lit(""))).cast("long")
        fits = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        named = F.lit(None).cast("string")
        for name, value in ENTITIES.items():
            named = F.when(part.startswith(f"&{name};"), F.concat(F.lit(value), rest)).otherwise(named)
        return F.when(fits, F.concat(char, rest)).otherwise(F.coalesce(named, part))

    return F.when(href.contains("&"), F.array_join(F.transform(F.split(href, "(?=&)"), first), "")).otherwise(href)


def _without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    def step(kept: Column, part: Column) -> Column:
        return (F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
                .when(part == ".", kept).otherwise(F.concat(kept, F.array(part))))

    parts = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _resolved(href: Column, base: Column) -> Column:
    """A link target as an absolute url; null for targets without a place."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    path, rest = F.regexp_extract(href, r"(?s)^([^?#]*)", 1), F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    query = F.regexp_extract(base, r"://[^/?#]*[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), "[^/]*$", "")
    return (F.when(href == "", None)
            .when(href.rlike(ABSOLUTE), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.rlike(SCHEME), None)
            .when(host_of(base) == "", None)
            .when(href.startswith("/"), F.concat(root, _without_dots(path), rest))
            .when(href.startswith("?"), F.concat(root, path_of(base), href))
            .when(href.startswith("#"), F.concat(root, path_of(base), query, href))
            .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest)))


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) for each canonical link and meta refresh of a page,
    relative ones against its base tag or else its url."""
    url, html = F.col("url"), F.col("html")

    def hrefs(tag: str, value: str) -> Column:
        tags = F.coalesce(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), F.array().cast("array<string>"))
        return F.transform(tags, lambda x: F.regexp_extract(x, value, 1))

    def targets(found: Column) -> Column:
        own = _let(_decoded(F.regexp_extract(F.regexp_extract(html, BASE_TAG, 0), LINK_HREF, 1)), lambda b: _resolved(b, url))
        resolve = lambda base: F.transform(F.transform(found, _decoded), lambda h: _resolved(h, base))
        return F.when(F.size(found) > 0, _let(F.coalesce(own, url), resolve))

    each = F.filter(F.concat(hrefs(LINK_TAG, LINK_HREF), hrefs(REFRESH_TAG, REFRESH_URL)), lambda t: t != "")
    return (pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
            .select("url", F.explode(_let(each, targets)).alias("target"))
            .filter(address_of(F.col("url")).isNotNull() & address_of(F.col("target")).isNotNull()))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id",
                url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each page.

    Null urls and urls without ``://`` have empty host and path, no rule and
    are allowed.  Null html has no links.  Repeated urls and ids each keep
    their row.  Empty input: no rows.  Other columns are not read."""
    links = shared_table(alias_links(pages, url_col, html_col), "url-links")
    edges = links.select(address_of(F.col("url")).alias("src"), address_of(F.col("target")).alias("dst"))
    members = connected_components(edges)
    ends = links.select("url").unionByName(links.select(F.col("target").alias("url"))).distinct()
    ended = ends.select(address_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = with_rule(ended, rules).select("node", F.col("found.verdict").alias("said"))
    groups = members.join(ruled, "node").groupBy("component").agg(
        F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    decided = shared_table(
        members.join(groups, "component").select(
            F.col("node").alias("address"),
            F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("alias_verdict")),
        "url-decided")
    url = F.col("url")
    judged = with_rule(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address")), rules)
    return judged.join(decided, "address", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
