"""URL filters over redirect equivalence.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
fitting rule decides a url, an allow before a block of equal length. Urls that no rule fits take the decision of their
aliases: urls are nodes under a canonical key (host without www. or m., path without index page, .html and last slash,
query without tracking parameters, no scheme, no fragment), redirects and canonical links are edges between keys, and
connected components spread decisions. One explicit allow in a component goes before all of its blocks; a component
without any decision is allowed. A target that was not crawled is judged by its own url and takes part.

Only DataFrame functions; texts never leave the scan, components run over narrow edges, and a key with very many urls is
pre-aggregated.

Defined results: null urls and urls without :// have empty host and path, no rule and no aliases, and are allowed;
repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import read, stored
from ledgerloom.llm.components import connected_components

#: Fixed values of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
TRACKING = r"^(?:utm_[^=&]*|ref|fbclid|gclid)(?:=|$)"
PAGE_END = r"(?:/index\.html?|\.html?|/)+$"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(h: Column, p: Column, rules=None) -> Column:
    """struct<length, allow, rule> of the longest fitting rule, else null. The list of rules is the caller's and goes into the plan."""
    fits = []
    for verdict, rh, rp in RULES if rules is None else rules:
        named = F.struct(F.lit(len(rh) + len(rp)).alias("length"), F.lit(verdict == "allow").alias("allow"), F.lit(rh + rp).alias("rule"))
        fits.append(F.when(((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp)), named))
    return fits[0] if len(fits) == 1 else F.greatest(*fits) if fits else F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")


def key(url: Column) -> Column:
    """The canonical key, null where there is no host."""
    bare = F.regexp_replace(host(url), r"^(?:www|m)\.", "")
    params = F.filter(F.split(F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit("")), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path(url), PAGE_END, ""), F.lit("?"), F.array_join(F.array_sort(params), "&")))


def resolved(href: Column, url: Column) -> Column:
    """href as an absolute url, seen from url."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    scheme = F.concat(F.substring_index(url, "://", 1), F.lit(":"))
    site = F.concat(scheme, F.lit("//"), host(url))
    return (
        F.when(F.contains(href, F.lit("://")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(site, href))
        .otherwise(F.concat(site, F.when(path(url) == "", F.lit("/")).otherwise(F.regexp_replace(path(url), "[^/]*$", "")), href))
    )


def link_targets(html: Column, url: Column) -> Column:
    """Absolute urls that a page names as its canonical url or redirects to."""
    tags = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
    )
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(F.filter(tags, lambda t: t != ""), lambda t: resolved(t, url)), none)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, rules=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of). redirects: (src, dst) absolute urls seen by a crawler, beside the links in html."""
    u = F.col(url)
    targets = link_targets(F.col(html), u) if html else F.array().cast("array<string>")
    rows = pages.select(F.col(page_id).alias("page_id"), u.alias("url"), targets.alias("targets"))
    rows = rows.select("page_id", "targets", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), key(F.col("url")).alias("key"))
    rows = stored(rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)), "url-rows")
    found = rows.select("key", F.explode("targets").alias("dst"))
    if redirects is not None:
        # both ends of a redirect are urls that may be judged, crawled or not
        found = found.union(redirects.select(key(F.col("src")), "dst")).union(redirects.select(key(F.col("src")), "src"))
    found = found.select("key", key(F.col("dst")).alias("other"), fitting_rule(host(F.col("dst")), path(F.col("dst")), rules).alias("fit"))
    own = rows.select("key", "fit").union(found.select("other", "fit")).filter("key IS NOT NULL")
    flags = own.groupBy("key").agg(F.max(F.col("fit.allow")).alias("allow"), F.max(~F.col("fit.allow")).alias("block"))
    member = connected_components(found.select("key", "other").filter("key <> other"), "key", "other")
    named = flags.join(member.withColumnRenamed("node", "key"), "key", "left").withColumn("alias_of", F.coalesce("component", "key"))
    whole = named.groupBy("alias_of").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    # keys without a decision of their component need no row: they are allowed as they are
    decided = named.select("key", "alias_of", "component").join(whole, "alias_of").filter("allow OR block OR component IS NOT NULL")
    out = rows.join(decided.select("key", "alias_of", "allow", "block"), "key", "left")
    spread = F.when(F.coalesce("allow", F.lit(False)), "allow").when(F.coalesce("block", F.lit(False)), "block").otherwise("allow")
    verdict = F.when(F.col("fit.allow"), "allow").when(~F.col("fit.allow"), "block").otherwise(spread)
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("alias_of", "key").alias("alias_of"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql() -> str:
    e = lambda s: s.replace("'", "''")
    lower_sql = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host_sql = lambda x: lower_sql(f"coalesce(regexp_extract({x}, '{e(URL)}', 1), '')")
    path_sql = lambda x: f"coalesce(regexp_extract({x}, '{e(URL)}', 2), '')"
    key_sql = lambda x: (
        f"CASE WHEN {host_sql(x)} <> '' THEN regexp_replace({host_sql(x)}, '^(?:www|m)\\.', '') || regexp_replace({path_sql(x)}, '{e(PAGE_END)}', '') || '?' || "
        f"coalesce(array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract({x}, '{e(QUERY)}', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{e(TRACKING)}'))), '&'), '') END"
    )
    fits = " ".join(
        f"WHEN (h = '{h}' OR ends_with(h, '.{h}')) AND starts_with(p, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0]))
    )
    href = f"regexp_extract(tag, '{e(HREF)}', 1)"
    to = f"regexp_extract(tag, '{e(REFRESH_URL)}', 1)"
    return f"""
WITH RECURSIVE
t AS (SELECT page_id, {host_sql("url")} AS h, {path_sql("url")} AS p, {key_sql("url")} AS k, url, html FROM pages),
tags AS (SELECT k, unnest(regexp_extract_all(html, '{e(CANONICAL)}')) AS tag, true AS link FROM t UNION ALL SELECT k, unnest(regexp_extract_all(html, '{e(REFRESH)}')), false FROM t),
goal AS (SELECT k, CASE WHEN link THEN {href} ELSE {to} END AS url FROM tags),
far AS (SELECT k AS src, {key_sql("url")} AS k, {host_sql("url")} AS h, {path_sql("url")} AS p FROM goal WHERE url <> ''),
pairs AS (SELECT src AS a, k AS b FROM far WHERE src <> k UNION SELECT k, src FROM far WHERE src <> k),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, n.b FROM reach AS r JOIN pairs AS n ON r.b = n.a),
own AS (SELECT k, CASE {fits} END AS fit FROM t UNION ALL SELECT k, CASE {fits} END FROM far),
flags AS (SELECT k, bool_or(fit LIKE 'allow %') AS allow, bool_or(fit LIKE 'block %') AS block FROM own WHERE k IS NOT NULL GROUP BY k),
names AS (SELECT k, least(k, coalesce((SELECT min(b) FROM reach WHERE a = k), k)) AS c FROM flags),
whole AS (SELECT c, bool_or(allow) AS allow, bool_or(block) AS block FROM flags JOIN names USING (k) GROUP BY c)
SELECT page_id, h AS host, p AS path, substr(fit, 7) AS rule,
coalesce(left(fit, 5), CASE WHEN allow THEN 'allow' WHEN block THEN 'block' ELSE 'allow' END) AS verdict, c AS alias_of
FROM (SELECT *, CASE {fits} END AS fit FROM t) LEFT JOIN names USING (k) LEFT JOIN whole USING (c)
"""


OP1_SQL = _sql()
