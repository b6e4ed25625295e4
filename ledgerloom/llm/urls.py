"""URL filters: rules on hosts and paths, with block decisions carried over redirect and canonical-link aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if, connected_components, stage

#: Fixed rules of the contract: verdict, host and path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))


def split_url(df: DataFrame) -> DataFrame:
    """Adds host and path to ``df``, which has a column url (both empty for null, or without ``://``)."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def alias_key(df: DataFrame) -> Column:
    """Name under which spellings of one address meet: no scheme, fragment, closing slash or utm_ parameters. Needs url, host, path."""
    query = F.regexp_extract(F.coalesce(_rest(F.col("url")), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    return F.concat("host", F.regexp_replace("path", r"/$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def rule_of(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the longest rule that fits, both null if none does. Ties go to allow.

    A few hundred rules become one CASE expression; more are joined on the host's suffixes.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    if len(ranked) <= 200:
        fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ranked]
        case = lambda values: reduce(lambda c, x: c.when(*x), list(zip(fits, map(F.lit, values), strict=True))[1:], F.when(fits[0], values[0])) if fits else F.lit(None).cast("string")
        return df.withColumn("rule", case([h + p for _, h, p in ranked])).withColumn("rule_verdict", case([v for v, _, _ in ranked]))
    table = df.sparkSession.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(ranked)], "v string, rh string, rp string, i int")
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    places = df.select("host", "path").distinct()
    hit = places.select("host", "path", F.explode(tails).alias("rh")).join(table, "rh").where(F.col("path").startswith(F.col("rp")))
    best = hit.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("rh", "rp").alias("rule"), F.col("v").alias("rule_verdict")), "i").alias("b"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, "b.rule", "b.rule_verdict")


def page_links(pages: DataFrame) -> DataFrame:
    """(key, host, path, href) of each page's canonical link and refresh redirect, with what a relative one needs; ``&amp;`` is taken back."""
    tag = F.regexp_extract("html", r"(?i)<link\s[^<>]*rel\s*=\s*[\"']?canonical[^<>]*>", 0)
    jump = F.regexp_extract("html", r"(?i)<meta\s[^<>]*http-equiv\s*=\s*[\"']?refresh[^<>]*>", 0)
    links = F.array(F.regexp_extract(tag, r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1), F.regexp_extract(jump, r"(?i)url\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    return pages.select("key", "host", "path", F.explode(F.filter(links, lambda x: x != "")).alias("href")).withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&")))


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    The rule's verdict if one fits. Else block if the page's address is equivalent, over
    redirects (``redirects``: columns from_url, to_url), canonical links and spellings of
    one address, to one that a rule blocks; else allow. An explicit allow is never overruled.
    Null urls have empty host and path and stand alone; repeated rows are judged alike;
    other columns are ignored; an empty table gives no rows.
    """
    base = pages.select("page_id", "url", "html").withColumn("url", F.col("url").cast("string"))
    base = rule_of(split_url(base), rules)
    base = base.withColumn("key", F.when(F.col("host") != "", alias_key(base)))
    links = page_links(base.where("key is not null"))
    folder = F.when(F.col("path") == "", "/").otherwise(F.regexp_replace("path", "[^/]*$", ""))
    full = F.when(F.instr("href", "://") > 0, F.col("href")).when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href"))
    full = full.when(F.col("href").startswith("/"), F.concat(F.lit("http://"), "host", "href")).otherwise(F.concat(F.lit("http://"), "host", folder, "href"))
    far = split_url(links.select(F.col("key").alias("a"), full.alias("url")))
    edges = far.select("a", alias_key(far).alias("b"))
    if redirects is not None:
        ends = [split_url(redirects.select("from_url", "to_url", F.col(c).alias("url"))) for c in ("from_url", "to_url")]
        one = ends[0].withColumn("a", alias_key(ends[0])).select("a", F.col("to_url").alias("url"))
        two = split_url(one)
        edges = edges.unionByName(two.select("a", alias_key(two).alias("b")))
    roots = stage(connected_components(edges.where("a is not null and b is not null"), "url"), "url-roots")
    alone = F.concat(F.lit("\0"), F.xxhash64("page_id", "host", "path").cast("string"))  # rows without a key match nothing, each for itself
    known = base.drop("html", "url").join(broadcast_if(roots, roots.count()), F.coalesce("key", alone) == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    # Only groups that hold both a blocked page and one without a rule pass a decision on; those are few, and known by name.
    sides = known.where("root is not null and (rule_verdict is null or rule_verdict = 'block')").groupBy("root").agg(F.max(F.col("rule_verdict").isNull()).alias("open"), F.max(F.col("rule_verdict").isNotNull()).alias("bad"))
    blocked = stage(sides.where("open and bad").select("root", "bad"), "url-blocked")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), "block"), F.lit("allow"))
    blocked = broadcast_if(blocked.withColumnRenamed("root", "_root"), blocked.count())
    return known.join(blocked, F.coalesce("root", alone) == F.col("_root"), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
