"""URL filters: prefix rules by host and path, and pattern rules indexed by their rarest literal token.

Every rule has literal tokens that a matching URL must hold.  The corpus is counted
once for the tokens of the rules, and each rule is filed under the token that the
fewest URLs hold.  A URL's tokens fetch the rules filed under them; only
those run their regular expressions.  Up to INLINE_RULES rules the index is a literal
map and no row of the table is shuffled to be judged; more rules are a table that the tokens of different
hosts and paths are joined to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import clashing

#: Rules that are looked up in a literal map; more are joined.
INLINE_RULES = 2_000

#: Fixed values: (verdict, prefix of host and path).
PREFIX_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Hosts and paths of advertising, adult, gambling and spam pages; host and path together are matched.
PATTERN_RULES = [
    r"(^|[.-])adult-x\.",
    r"(^|[.-])ads-track\.",
    r"(^|[.-])casino-win\.",
    r"(^|[.-])cheap-pills\.",
    r"(^|[.-])free-bets\.",
    r"(^|[.-])spam-farm\.",
]

_AFTER = "substring(url, position('://', url) + 3)"


def parts(pages: DataFrame) -> DataFrame:
    """pages with host (lower case) and path; both empty without :// in url."""
    after = F.when(F.col("url").contains("://"), F.expr(_AFTER)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every match of the pattern holds whole: runs of letters and digits outside groups and
    classes, with a literal separator or an anchor at either side."""
    plain = re.sub(r"\(\^\|\[[./-]+\]\)", "(", pattern)  # a separator or the start
    plain = re.sub(r"\((?:[^()\\]|\\.)+\)[*+?]?|\[[^\]]*\][*+?]?", "\0", plain)
    return [m[2].lower() for m in re.finditer(r"(^\^|[(]|\\[./-]|[-/])([A-Za-z0-9]+)(?=\\[./-]|[-/]|\$$)", plain)]


def prefix_pattern(prefix: str) -> str:
    """The regular expression of a prefix rule over host and path: the host or a subdomain, then the start of the path."""
    host, slash, path = prefix.partition("/")
    return rf"^([^/]*\.)?{re.escape(host)}{slash}{re.escape(path)}"


def prefix_tokens(prefix: str) -> list[str]:
    """Tokens that a URL under the prefix holds whole; a path cut inside a token has none there."""
    host, _, path = prefix.partition("/")
    whole = [t for t in re.split("[^a-z0-9]+", host.lower()) if t]
    return whole + [t for t in re.split("[^A-Za-z0-9]+", path.lower())[:-1] if t]


def rarest(pages: DataFrame, rules: list[list[str]]) -> list[str]:
    """For each rule its token that the fewest URLs of the whole table hold; ties to the first in the alphabet."""
    wanted = sorted({t for r in rules for t in r})
    held = pages.select(F.explode(F.array_intersect(tokens(F.concat("host", "path")), F.array(*[F.lit(t) for t in wanted]))).alias("t"))
    counts = {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}  # one row for each token of a rule
    return [min(r, key=lambda t: (counts.get(t, 0), t)) for r in rules]


def verdicts(pages: DataFrame, prefixes: list[tuple[str, str]] = PREFIX_RULES, patterns: list[str] = PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row.

    rule: the longest prefix rule that fits, else null; its verdict stands.  Without one
    a URL that a pattern matches is blocked and any other allowed; pattern is the one that
    matched, of several the last in the alphabet.  Null urls and urls without :// have empty host and path
    and are allowed.  Repeated rows are judged alike; nothing is dropped."""
    rules = [(len(p), p, v, prefix_pattern(p), prefix_tokens(p)) for v, p in prefixes] + [(0, p, "block", p, literal_tokens(p)) for p in patterns]
    for rule in rules:
        if not rule[4]:
            raise ValueError(f"no literal token in rule {rule[1]!r}")
    pages = parts(pages)
    filed: dict[str, list] = {}
    for rule, token in zip(rules, rarest(pages, [r[4] for r in rules]), strict=True):
        filed.setdefault(token, []).append(rule[:4])
    judged = _looked_up(pages, filed) if len(rules) <= INLINE_RULES else _joined(pages, filed)
    own = F.col("best.length") > 0
    return judged.select(
        "page_id", "host", "path",
        F.when(own, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~own, F.col("best.name")).alias("pattern"),
    )


_RULE = ["length", "name", "verdict", "regex"]


def _looked_up(pages: DataFrame, filed: dict[str, list]) -> DataFrame:
    """pages with best, the longest rule that matches: the filed tokens that a URL holds fetch their rules, which alone run."""
    if not filed:
        return pages.withColumn("best", F.lit(None).cast("struct<length:int,name:string,verdict:string>"))
    full = F.concat("host", "path")
    index = F.create_map(*[c for token, under in sorted(filed.items()) for c in (F.lit(token), F.array(*[F.struct(*(F.lit(x).alias(n) for x, n in zip(r, _RULE, strict=True))) for r in under]))])
    have = F.array_intersect(tokens(full), F.array(*[F.lit(t) for t in sorted(filed)]))
    hits = F.filter(F.flatten(F.transform(have, lambda t: index[t])), lambda r: F.rlike(F.concat("host", "path"), r["regex"]))
    return pages.withColumn("best", F.array_max(hits))


def _joined(pages: DataFrame, filed: dict[str, list]) -> DataFrame:
    """The same through a join of the tokens of different hosts and paths with the table of rules."""
    rows = [(token, *r) for token, under in sorted(filed.items()) for r in under]
    rules = pages.sparkSession.createDataFrame(rows, "token string, length int, name string, verdict string, regex string")
    urls = pages.select("host", "path").distinct()
    met = urls.select("host", "path", F.explode(tokens(F.concat("host", "path"))).alias("token")).join(rules, "token")
    met = met.where(F.rlike(F.concat("host", "path"), F.col("regex"))).groupBy("host", "path").agg(F.max(F.struct(*_RULE)).alias("best"))
    return pages.join(met, ["host", "path"], "left")


def op5_url_filters(pages: DataFrame) -> DataFrame:
    """The digest: one row for each row of pages, null page_id and repeated rows included; extra columns, whatever their names,
    are ignored; an empty table gives no rows."""
    return verdicts(clashing(pages, ["page_id", "url"]))


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), matched AS (
  SELECT *,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    CASE WHEN regexp_matches(host || path, '(^|[.-])spam-farm[.]') THEN 'spam-farm' WHEN regexp_matches(host || path, '(^|[.-])free-bets[.]') THEN 'free-bets'
         WHEN regexp_matches(host || path, '(^|[.-])cheap-pills[.]') THEN 'cheap-pills' WHEN regexp_matches(host || path, '(^|[.-])casino-win[.]') THEN 'casino-win'
         WHEN regexp_matches(host || path, '(^|[.-])adult-x[.]') THEN 'adult-x' WHEN regexp_matches(host || path, '(^|[.-])ads-track[.]') THEN 'ads-track' ELSE '' END AS bad
  FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad <> '' THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL AND bad <> '' THEN '(^|[.-])' || bad || '\\.' END AS pattern
FROM matched
"""
