"""URL filtering under redirect equivalence: rules decide, and blocks spread to what redirects or canonical links join.

All of it is DataFrame work; connected components are found by the distributed star steps of ``common``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convrecall.llm.common import checkpoint, components

#: Host, path and verdict of each rule.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Java patterns for the tags that name a page's equivalents, and for the url in them.
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a url; both empty for null and for what has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    fine = url.isNotNull()
    return F.when(fine, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(""), F.when(fine, path).otherwise("")


def located(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host`` (A-Z in lower case) and ``path``."""
    host, path = _parts(F.col(url))
    return df.withColumn("host", host).withColumn("path", path)


def ruled(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``df`` with ``rule`` and ``decided``: the longest rule that fits host and path, and its verdict; else null.

    A rule fits its host and all subdomains. Longest is by the whole rule's length; of equal ones the first stands.
    """
    rule = decided = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), -rules.index(r))):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, decided = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    return df.withColumn("rule", rule).withColumn("decided", decided)


def edges(pages: DataFrame) -> DataFrame:
    """``(url, target)`` of the canonical links and refresh redirects in ``(url, html)``.

    Targets may be absolute, ``//host/path`` or ``/path``; others are taken for relative to the page's last slash.
    """
    page = pages.select("url", "html").where(F.lower("html").rlike("canonical|refresh"))
    found = page.select(
        "url",
        F.explode(
            F.concat(
                F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), 0), lambda t: F.regexp_extract(t, HREF, 1)),
                F.transform(F.regexp_extract_all("html", F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, TARGET, 1)),
            )
        ).alias("to"),
    )
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    top = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(top, F.regexp_replace(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), r"[^/]*$", ""))
    to = F.col("to")
    return found.where("to <> ''").select(
        "url",
        F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(top, to)).otherwise(F.concat(F.when(folder == top, F.concat(top, F.lit("/"))).otherwise(folder), to))
        .alias("target"),
    )


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every row of ``pages`` (page_id, url, html).

    Where a rule fits, its verdict stands. Other pages are blocked if a block rule fits any address that edges join
    with theirs, unless an allow rule fits one too: explicit permission comes first. The rest are allowed. Addresses
    are host and path; queries, fragments and schemes don't tell them apart. ``redirects`` (url, target) are edges
    beside those in the html. Null urls, and urls without ``://``, have empty host and path and join with nothing.
    Repeated rows are judged alike.
    """
    told = edges(pages) if redirects is None else edges(pages).unionByName(redirects.select("url", "target"))
    joined = located(told).withColumnsRenamed({"host": "host_a", "path": "path_a"})
    joined = located(joined.drop("url").withColumnRenamed("target", "url"))
    address = lambda h, p: F.struct(F.col(h).alias("host"), F.col(p).alias("path"))
    links = joined.where("host <> '' and host_a <> ''").select(address("host_a", "path_a").alias("a"), address("host", "path").alias("b"))
    groups = checkpoint(components(links))
    known = ruled(groups.select("component", "node.host", "node.path"), rules)
    spread = (
        known.groupBy("component")
        .agg(F.bool_or(F.col("decided") == "block").alias("bad"), F.bool_or(F.col("decided") == "allow").alias("good"))
        .where("bad and not coalesce(good, false)").select("component")
    )
    blocked = groups.join(spread, "component").select(F.col("node.host").alias("host"), F.col("node.path").alias("path"), F.lit(True).alias("alias"))
    own = ruled(located(pages.select("page_id", "url")), rules)
    return own.join(blocked, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("alias"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_FIT = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS v, {i} AS n" for i, (h, p, v) in enumerate(RULES))

OP5_SQL = rf"""
WITH RECURSIVE rules AS ({_FIT}),
tags AS (
  SELECT url, regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') AS dst FROM (
    SELECT url, unnest(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is')) AS t FROM pages)
  UNION ALL
  SELECT url, regexp_extract(t, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is') FROM (
    SELECT url, unnest(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is')) AS t FROM pages)
), bases AS (
  SELECT url, dst, regexp_extract(url, '^(.*?)://', 1, 's') AS scheme, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS top,
    regexp_replace(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '[^/]*$', '') AS folder
  FROM tags WHERE dst <> ''
), told AS (
  SELECT url, CASE WHEN contains(dst, '://') THEN dst WHEN starts_with(dst, '//') THEN scheme || ':' || dst
    WHEN starts_with(dst, '/') THEN top || dst WHEN folder = '' THEN top || '/' || dst ELSE top || folder || dst END AS target
  FROM bases
), addresses AS (
  SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM told))
), fits AS (
  SELECT a.url, a.host, a.path, r.rh || r.rp AS rule, r.v,
    row_number() OVER (PARTITION BY a.url ORDER BY length(r.rh || r.rp) DESC, r.n) AS k
  FROM addresses a JOIN rules r ON (a.host = r.rh OR ends_with(a.host, '.' || r.rh)) AND starts_with(a.path, r.rp)
), links AS (
  SELECT DISTINCT [a.host, a.path] AS x, [b.host, b.path] AS y FROM told t JOIN addresses a ON a.url = t.url JOIN addresses b ON b.url = t.target
  WHERE a.host <> '' AND b.host <> ''
), sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x, y FROM sym UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x),
near AS (SELECT x, y FROM reach UNION SELECT x, x FROM sym),
bad AS (
  SELECT n.x FROM near n LEFT JOIN fits f ON f.k = 1 AND n.y = [f.host, f.path]
  GROUP BY n.x HAVING bool_or(f.v = 'block') AND NOT coalesce(bool_or(f.v = 'allow'), false)
)
SELECT p.page_id, coalesce(a.host, '') AS host, coalesce(a.path, '') AS path, f.rule,
  coalesce(f.v, CASE WHEN b.x IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN addresses a ON a.url = p.url LEFT JOIN fits f ON f.url = p.url AND f.k = 1 LEFT JOIN bad b ON b.x = [a.host, a.path]
"""
