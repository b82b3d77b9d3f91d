r"""URL rules indexed by their rarest literal token.

A rule is a Java regular expression over ``host + path`` and the literal tokens (runs of
``[a-z0-9]``) that every URL it fits must hold. Token counts over all URLs choose each rule's
rarest token; a URL's own tokens fetch candidate rules by an equi-join on that token, and only those
run their expression. A rule without a literal is tested on every URL.

Results for odd input: a null URL, or one without ``://``, has an empty host and path and fits no
rule that names a host; repeated rows are judged alike; a very long URL is one like others; of rules of
equal rank the one with the greatest name wins; an empty table gives no rows; extra columns are
passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustrate.scratch import Scratch, small

#: Bytes of the rule index that may be broadcast; a larger one is joined by a shuffle.
INDEX_BYTES = 16 << 20


@dataclass(frozen=True)
class UrlRule:
    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str
    rank: int
    site: bool = False


def site_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host, its subdomains, and the paths that start with ``path``; longer ones win."""
    name = f"{host}{path}"
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    # The last run of the path may go on in the URL, so it is no whole token unless a delimiter ends it.
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path)
    return UrlRule(name, pattern, tuple(whole), verdict, 1_000_000 + len(name), True)


def word_rule(name: str, pattern: str, literals: tuple[str, ...], verdict: str, rank: int = 0) -> UrlRule:
    return UrlRule(name, pattern, literals, verdict, rank)


#: The site rules that the query is asked for.
SITE_RULES = (
    site_rule("net", "/", "block"),
    site_rule("example.net", "/en/", "allow"),
    site_rule("example.com", "/de/", "block"),
    site_rule("org", "/fr/", "allow"),
)

#: The library's own patterns for hosts that sell or farm links.
PATTERN_RULES = (
    word_rule("link-farm", r"^[^/]*\bspam-farm\b", ("spam", "farm"), "block", 3),
    word_rule("pill-shop", r"^[^/]*\bcheap-pills\b", ("cheap", "pills"), "block", 3),
    word_rule("casino", r"\bcasino\b", ("casino",), "block", 2),
    word_rule("adult", r"\bxxx\b", ("xxx",), "block", 2),
)


#: What ``^`` stands for in filter lists: an ASCII letter other than ``A-Za-z0-9_.%-``.
SEPARATOR = r"[\x00-\x24\x26-\x2c\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]"


def list_rule(line: str) -> UrlRule | None:
    """A line of a filter list as published for ad blockers: ``||host^path``, ``*``, ``^``, a closing
    ``|``, ``@@`` for exceptions, which outrank blocks. None for comments and for what a host and path
    alone can't decide (options, element rules, schemes) or no literal narrows (expressions)."""
    text = line.strip()
    allow = text.startswith("@@")
    body = text[2:] if allow else text
    if not body.strip("*^|") or body[0] in "![" or "$" in body or "##" in body or "#@#" in body or "://" in body:
        return None
    if len(body) > 1 and body[0] == body[-1] == "/":
        return None
    domain, ends = body.startswith("||"), body.endswith("|")
    body = body[2 if domain else 0 : -1 if ends else None]
    if "|" in body:
        return None
    shape = re.sub(r"\*+", "*", body)
    parts = [".*" if c == "*" else f"(?:{SEPARATOR}|\\z)" if c == "^" else re.escape(c) for c in shape]
    pattern = "(?is)" + (r"^(?:[^/?#]*\.)?" if domain else "") + "".join(parts) + (r"\z" if ends else "")
    # A run of letters and digits is a whole token of the URL where ASCII signs or anchors enclose it.
    framed = ("." if domain else "a") + shape.lower() + ("." if ends else "a")
    whole = re.findall(r"(?<=[\x00-\x29\x2b-\x2f\x3a-\x60\x7b-\x7f])[a-z0-9]+(?=[\x00-\x29\x2b-\x2f\x3a-\x60\x7b-\x7f])", framed)
    return UrlRule(text, pattern, tuple(dict.fromkeys(whole)), "allow" if allow else "block", len(text) + (1 << 20) * allow)


def split_url(url):
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, shape, 1), upper, lower), F.regexp_extract(text, shape, 2)


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...], url: str = "url") -> DataFrame:
    """Distinct URLs of ``df`` with ``host``, ``path``, ``site`` and ``pattern`` (best rule of each
    kind, a struct of rank, name and verdict, or null)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = split_url(F.col(url))
    urls = df.select(F.col(url).alias("url")).distinct().withColumns({"host": host, "path": path})
    urls = urls.withColumn("target", F.concat("host", "path"))
    words = urls.select("url", "target", F.explode(F.array_distinct(F.filter(F.split(F.lower("target"), "[^a-z0-9]+"), lambda t: t != ""))).alias("token"))

    given = [(i, r.name, r.pattern, r.verdict, r.rank, r.site) for i, r in enumerate(rules)]
    table = spark.createDataFrame(given, "id int, name string, pattern string, verdict string, rank int, site boolean")
    literals = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in r.literals], "id int, token string")

    seen = words.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literals.join(seen, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    index = scratch.save(table.join(rarest, "id", "left"), "index")

    held = small(index.where("token IS NOT NULL"), 512, INDEX_BYTES)
    candidates = words.select("url", "target", "token").join(held, "token").drop("token")
    if index.where("token IS NULL").head(1):
        # Without a literal there is nothing to look up: these few rules run on every URL.
        always = small(index.where("token IS NULL"), 512, INDEX_BYTES).drop("token")
        candidates = candidates.unionByName(urls.select("url", "target").withColumn("_k", F.lit(0)).join(always.withColumn("_k", F.lit(0)), "_k").drop("_k"))
    fits = candidates.where(F.expr("target RLIKE pattern"))
    best = lambda kind: F.max(F.when(F.col("site") == kind, F.struct("rank", "name", "verdict")))
    found = fits.groupBy("url").agg(best(True).alias("site"), best(False).alias("pattern"))
    return urls.drop("target").join(found, "url", "left")


def op7_url_rules(spark, sf_dir):
    """Every page's URL under the site rules, and under the pattern rules where none of them fits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge_urls(pages, SITE_RULES + PATTERN_RULES).select("url", "site", "pattern")
    host, path = split_url(F.col("url"))
    return pages.join(judged.withColumnRenamed("url", "_url"), F.col("url").eqNullSafe(F.col("_url")), "left").select(
        "page_id", host.alias("host"), path.alias("path"), F.col("site.name").alias("rule"),
        F.coalesce("site.verdict", "pattern.verdict", F.lit("allow")).alias("verdict"),
    )


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '\b(spam-farm|cheap-pills)\b') OR regexp_matches(host || path, '\b(casino|xxx)\b') THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b ON s.page_id = b.page_id
"""
