"""URL filtering by host and path rules, spread over redirect-equivalent addresses.

A url is judged by the longest rule that fits it.  Urls that no rule fits take the decision of their
equivalence class: addresses joined by canonical links, refresh redirects and an optional redirect
table.  Inside a class an explicit allow beats every block.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import stored
from docstrata.llm.components import connected_components

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The address in a canonical link or a refresh redirect, attributes in either order.
CANONICAL = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
)
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text (host and path together) and its verdict; null where none fits.

    Among fitting rules the hosts are suffixes of one host, so length orders them; rules of equal
    length go by their order in ``rules``.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def address_key(url: Column) -> Column:
    """An address without its fragment and with its host lower-cased: the node of the redirect graph."""
    host, _ = url_parts(url)
    rest = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host, rest))


def decoded(address: Column) -> Column:
    """An address from HTML with its references to ``&`` replaced, the only ones that addresses need."""
    return F.regexp_replace(address, r"&(?:amp|AMP|#0*38|#[xX]0*26);", "&")


def without_dots(path: Column) -> Column:
    """A path that starts with ``/``, its ``.`` and ``..`` segments resolved."""
    start = F.array().cast("array<string>")
    step = lambda acc, x: (
        F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    )
    joined = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    return F.when(path.rlike(r"/\.\.?\z"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolved(target: Column, base: Column) -> Column:
    """``target`` as seen from the page ``base``; null for a relative one where ``base`` is no address."""
    site = F.regexp_extract(base, r"(?s)^([^:]*://[^/?#]*)", 1)
    _, path = url_parts(base)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    full = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(F.coalesce(site, F.lit("")) == "", F.lit(None))
        .when(target.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(target.startswith("#"), base)
        .when(own == "", F.concat(site, path, rest))
        .otherwise(F.concat(site, without_dots(full), rest))
    )


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict, inherited.

    Every canonical link and refresh redirect of a page is an edge, and ``redirects(source, target)`` adds
    others.  Relative targets are resolved against the
    address they stand at (a ``base`` element is not read).  A page without a usable url is ignored: its
    host and path are empty, no rule fits and it gets ``default``.
    Null html has no links.  Repeated pages get equal verdicts; an empty table an empty result.
    ``inherited`` says that the verdict comes from the page's class.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = (
        pages.select("page_id", "url", host.alias("host"), path.alias("path"), address_key(F.col("url")).alias("address"))
        .withColumn("rule", rule)
        .withColumn("own", verdict)
    )
    html = F.coalesce(F.col("html"), F.lit(""))
    links = pages.select(
        "url",
        F.explode(F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1)))).alias("to"),
    )
    seen = resolved(decoded(F.col("to")), F.col("url"))
    links = links.filter("to <> ''").select(address_key(F.col("url")).alias("a"), address_key(seen).alias("b"))
    if redirects is not None:
        seen = resolved(F.col("target"), F.col("source"))
        links = links.unionByName(redirects.select(address_key(F.col("source")).alias("a"), address_key(seen).alias("b")))
    links = stored(links.filter("a <> b").distinct(), "links")
    if links.isEmpty():
        final = own.withColumn("class_verdict", F.lit(None).cast("string"))
    else:
        # A class hears the rules of its pages and of the addresses that only links name.
        classes = stored(connected_components(links), "classes")
        h, p = url_parts(F.col("node"))
        _, said = matched_rule(F.col("h"), F.col("p"), rules)
        heard = classes.select("component", h.alias("h"), p.alias("p")).select("component", said.alias("said")).filter("said IS NOT NULL")
        # 'allow' sorts before 'block', so the smallest verdict is the explicit allow.
        decided = heard.groupBy("component").agg(F.min("said").alias("class_verdict"))
        by_address = classes.join(decided, "component").select(F.col("node").alias("address"), "class_verdict")
        final = own.join(by_address, "address", "left")
    return final.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", "class_verdict", F.lit(default)).alias("verdict"),
        F.expr("own IS NULL AND class_verdict IS NOT NULL").alias("inherited"),
    )
