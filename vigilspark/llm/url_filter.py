"""URL block lists that follow redirects.

URLs that redirect to one another, or name the same canonical link, are one resource. The classes
are the connected components of those edges, found by distributed star contraction. A block rule
that meets one alias blocks all of them; an explicit allow rule for a URL wins over any block. Rules
are tables, met by equality joins on the URL, on the host and each domain above it, and on parts of hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, maybe_broadcast

#: (kind, value): 'host' is a host or the domain above it, 'url' a normalised URL, 'word' a part of the host.
BLOCK = (("word", "casino"), ("word", "cheap-pills"), ("word", "adult"), ("word", "spam"), ("word", "free-bets"), ("host", "ads-track.example.com"))
ALLOW = (("host", "adult-education.example.org"), ("url", "tionsh.example.net/en/1"))

_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?i)[\s"'/]rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?i)[\s"'/]http-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?i)[\s"'/]href\s*=\s*["']?\s*([^"'\s>]+)"""
_TO = r"""(?i)[\s"';]url\s*=\s*["']?\s*([^"'\s>]+)"""
_AND = "(?i)&(amp|#38|#x26);"


def normal_form(url: Column) -> Column:
    """Without scheme, user, fragment, tracking parameters, 'www.', 'm.', a file ending of .html, and closing slashes; lower-case host."""
    u = F.trim(url)
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    u = F.regexp_replace(u, r"^[^/?@]*@", "")
    u = F.regexp_replace(u, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", r"$1")
    u = F.regexp_replace(u, r"([?&])&+", r"$1")
    u = F.regexp_replace(u, r"[?&]+$", "")
    host, rest = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    rest = F.regexp_replace(rest, r"(/index)?\.html?(\?|$)", "$2")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def host_of(form: Column) -> Column:
    return F.regexp_extract(form, r"^([^/?:]*)", 1)


def without_dots(url: Column) -> Column:
    """The segments '.' and '..' of the path resolved; the host and what follows '?' as they are."""
    root, rest = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    path, tail = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1)
    step = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x))
    folded = F.aggregate(F.slice(F.split(path, "/"), 2, 1_000_000), F.lit(""), step)
    return F.when(path.contains("/."), F.concat(root, folded, tail)).otherwise(url)


def resolved(target: Column, page: Column) -> Column:
    """A link of a page as a URL, by RFC 3986: whole, or relative to the page's scheme, root, folder or path; null for other schemes and links within the page."""
    root = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    t = F.regexp_replace(target, _AND, "&")
    whole = (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | t.startswith("#") | (root == ""), F.lit(None))
        .when(t.startswith("//"), F.concat(F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(root, path, t))
        .otherwise(F.concat(root, F.lit("/"), F.regexp_extract(path, "^/?(.*/)?[^/]*$", 1), t))
    )
    return without_dots(whole)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): normal forms of a page and of every canonical link and refresh target in its HTML."""
    tags = pages.select(F.col(url_col).alias("u"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_TAG), F.lit(0))).alias("tag")).where("u is not null")
    tag = F.col("tag")
    to = F.when(tag.rlike(_CANONICAL), F.regexp_extract(tag, _HREF, 1)).when(tag.rlike(_REFRESH), F.regexp_extract(tag, _TO, 1))
    found = tags.select("u", to.alias("to")).where("to != ''")
    return found.select(normal_form(F.col("u")).alias("a"), normal_form(resolved(F.col("to"), F.col("u"))).alias("b")).where("a != b")


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] | DataFrame) -> DataFrame:
    """Distinct (kind, value) without nulls."""
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "kind string, value string")
    return cut(table.select("kind", "value").where("kind is not null and value != ''").distinct())


def meeting(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(node,) of those that a rule meets, once each. Hosts are looked up once, whatever their number of URLs."""
    of = lambda kind: maybe_broadcast(rules.where(F.col("kind") == kind).select("value"))
    hosts = nodes.select(host_of(F.col("node")).alias("host")).where("host != ''").distinct()
    label = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    met = hosts.select("host", F.explode(above).alias("value")).join(of("host"), "value", "left_semi").select("host")
    sizes = [r[0] for r in rules.where("kind = 'word'").select(F.length("value")).distinct().collect()]  # lengths of words, no more than a host has characters
    if sizes:
        of_size = "if(length(host) >= {0}, transform(sequence(1, length(host) - {0} + 1), i -> substring(host, i, {0})), array())"
        parts = F.expr("concat(" + ", ".join(of_size.format(n) for n in sorted(sizes)) + ")")
        met = met.union(hosts.select("host", F.explode(F.array_distinct(parts)).alias("value")).join(of("word"), "value", "left_semi").select("host"))
    met = maybe_broadcast(cut(met.distinct()))
    by_host = nodes.join(met, host_of(F.col("node")) == F.col("host"), "left_semi")
    return by_host.union(nodes.join(of("url").withColumnRenamed("value", "node"), "node", "left_semi")).distinct()


def filter_urls(
    pages: DataFrame, redirects: DataFrame | None = None, block: tuple | DataFrame = BLOCK, allow: tuple | DataFrame = ALLOW, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, resource, decision), a row for each row of ``pages``.

    ``redirects`` may add edges (source, target) of URLs. ``block`` and ``allow`` are tables or tuples of
    (kind, value): 'host' is a host or the domain above it, 'url' a normal form, 'word' a part of a host.
    ``resource`` is the smallest normal form of the aliases. The decision is 'allow' for a URL that an
    allow rule meets, else 'block' if a block rule meets any alias that isn't allowed itself, else 'pass'.

    A null or empty URL has no resource and passes. Null HTML has no edges; HTML is read whole, however
    long, and all of its links count; a ``base`` element doesn't. Chains, loops and rings of redirects are
    one resource; more than 60 rounds of contraction, a diameter beyond any real one, raise. Repeated rows
    repeat their result, ties can't occur; other columns aren't read, whatever their names; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    form = F.nullif(normal_form(F.col(url_col)), F.lit(""))
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(normal_form(F.col("source")).alias("a"), normal_form(F.col("target")).alias("b"))
        edges = edges.union(more.where("a != b"))
    classes = cut(connected_components(cut(edges.where("a != '' and b != ''").distinct())))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), form.alias("form"))
    # the rules are asked once for each alias: of pages, and of edges whose page isn't in the table
    known = rows.select(F.col("form").alias("node")).where("node is not null").union(classes.select("node")).distinct()
    known = cut(known.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("resource")))
    allowed = cut(meeting(known.select("node"), rule_table(spark, allow)))
    allowed = maybe_broadcast(allowed.withColumn("allowed", F.lit(True)))
    bad = meeting(known.select("node"), rule_table(spark, block)).join(allowed, "node", "left_anti")
    bad = cut(known.join(bad, "node", "left_semi").select("resource").distinct().withColumn("blocked", F.lit(True)))
    decided = known.join(allowed, "node", "left").join(maybe_broadcast(bad), "resource", "left").select(
        F.col("node").alias("form"), "resource", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("pass").alias("decision")
    )
    return rows.join(decided, "form", "left").select("page_id", "url", "resource", F.coalesce("decision", F.lit("pass")).alias("decision"))
