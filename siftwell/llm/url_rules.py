"""URL filters with redirect equivalence.

A rule (block or allow; host and path) fits its host and all subdomains where the URL's path starts with the rule's path;
the longest wins, and of equally long ones an allowing rule. Pages without a rule take the verdict of their aliases:
URLs that differ only in what servers commonly redirect (scheme, www. or m., default port, trailing slash, index page,
.html, tracking parameters, fragment) are one node; canonical links and refresh targets in the HTML, and a table of
known redirects, are edges; connected components over them carry the decisions. In a component, one alias that a rule
explicitly allows outweighs those that rules block; without either, pages are allowed.

Null URLs and URLs without :// have empty host and path, no rule and no aliases, and are allowed. Null HTML has no link.
Repeated rows are judged alike. An empty table gives no rows; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, read
from .components import components

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that only track.
TRACKING = r"(?:utm_[^=&]*|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src)"
CANONICAL = (r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
REFRESH = (r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """The struct (rule, verdict) that decides, or null."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    fits = [((h == r[1]) | h.endswith(f".{r[1]}")) & p.startswith(r[2]) for r in order]
    picked = [F.when(f, F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for f, r in zip(fits, order, strict=True)]
    return F.coalesce(*picked) if picked else F.lit(None).cast("struct<rule:string,verdict:string>")


def alias(url: Column) -> Column:
    """What URLs that redirect to each other by convention have in common; null without host."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^[^@]*@", ""), r"(^(?:www|m)\.(?=[^.]+\.)|\.?(?::80|:443)?$)", "")
    p = F.regexp_replace(path(url), r"(?:/(?:index\.(?:html?|php))?|\.html?)$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^{TRACKING}(?:=|$)"))
    return F.when(F.length(h) > 0, F.concat(h, p, F.lit("?"), F.array_join(F.array_sort(kept), "&")))


def target(html: Column, url: Column, found: tuple[str, str]) -> Column:
    """The absolute URL that a canonical link or refresh names; null if none."""
    raw = F.regexp_replace(F.regexp_extract(F.regexp_extract(html, found[0], 0), found[1], 1), "&amp;", "&")
    root = F.regexp_extract(url, "^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, "^([^/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), raw).when(raw.startswith("//"), F.concat(F.regexp_extract(url, "^([^/?#]*:)//", 1), raw)).when(
        raw.startswith("/"), F.concat(root, raw)).when(raw != "", F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), raw))


def links(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges a, b between hashed alias keys: canonical links and refreshes in the HTML; redirects has from_url and to_url."""
    named = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select(F.col("url").alias("from_url"), F.explode(F.array(*(target(F.col("html"), F.col("url"), x) for x in (CANONICAL, REFRESH)))).alias("to_url"))
    every = named if redirects is None else named.unionAll(redirects.select("from_url", "to_url"))
    keys = every.select(alias(F.col("from_url")).alias("f"), alias(F.col("to_url")).alias("t")).where("f is not null and t is not null and f <> t")
    return keys.select(F.xxhash64("f").alias("a"), F.xxhash64("t").alias("b"))


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and by (rule, alias or default)."""
    url = F.col("url")
    first = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.xxhash64(alias(url)).alias("node"), alias(url).isNotNull().alias("known"))
    ruled = first.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    label = components(links(pages.select("url", "html"), redirects))
    # a node without edges is its own component
    placed = materialise(ruled.join(label, "node", "left").withColumn("component", F.when(F.col("known"), F.coalesce("component", "node"))), "pages")
    decided = placed.where("r is not null and component is not null").groupBy("component").agg(F.max(F.col("r.verdict") == "allow").alias("allowed"))
    sides = materialise(decided, "decided")
    both = placed.drop("node", "known").join(sides, "component", "left")
    own = F.col("r.verdict")
    verdict = F.when(own.isNotNull(), own).when(~F.col("allowed"), "block").otherwise("allow")
    by = F.when(own.isNotNull(), "rule").when(F.col("allowed").isNotNull(), "alias").otherwise("default")
    return both.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"))


#: For pages whose HTML holds no canonical link and no refresh: then conventional redirects alone make aliases.
SQL = r"""
with h as (select page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'allow example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'block example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'allow org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'block net/' end as r,
  regexp_replace(regexp_replace(host, '^[^@]*@', ''), '\.?(:80|:443)?$', '') as bare from h),
a as (select *, case when regexp_matches(bare, '^(www|m)\.[^.]+\.') then regexp_replace(bare, '^(www|m)\.', '') else bare end as server,
  list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=&]*|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid|ref|ref_src)(=|$)'))) as query from r),
k as (select *, case when server <> '' then server || regexp_replace(path, '(/(index\.(html?|php))?|\.html?)$', '') || '?' || array_to_string(query, '&') end as node from a),
d as (select node, bool_or(starts_with(r, 'allow')) as allowed from k where r is not null and node is not null group by 1)
select page_id, host, path, split_part(r, ' ', 2) as rule,
  case when r is not null then split_part(r, ' ', 1) when not allowed then 'block' else 'allow' end as verdict,
  case when r is not null then 'rule' when allowed is not null then 'alias' else 'default' end as by
from k left join d using (node)
"""
