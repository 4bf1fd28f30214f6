"""URL filters: pattern rules, each filed under its rarest literal token.

Two kinds of rules. A host rule is a host with a path prefix (`example.net/en/`): it fits the host and all its subdomains where the
URL's path starts with the rule's, the longest that fits wins, and it decides before any pattern. A pattern (`||ads.*^banner`)
is a filter-list line: `||` stands for the start of the host or of one of its labels, a single `|` at either end for that end,
`^` for one separator or the end, `*` for anything; `@@` in front makes it an exception. Without a host rule, a URL is blocked
if a pattern fits it and no exception does. Patterns are compared without regard to the case of A-Z, paths of host rules with it.

1. Every rule becomes one regular expression and the set of its literal tokens: runs of a-z and 0-9 that are bounded within the
   rule, so that a URL that fits holds each of them as a token of its own.
2. All URLs' tokens that some rule has are counted, and each rule is filed under the one that fewest URLs hold. A rule without
   such a token is filed under the empty token, which every URL has: no rule is dropped.
3. A URL's tokens fetch its candidates by an equi-join, and only those run their expressions. What fits is reduced to one row a
   URL before it meets the pages, so a page travels as its columns and URL only, and a URL that half of all pages share is one
   row on the other side, whose partitions adaptive execution may split.

Rules may be a table of any size: whether the index is broadcast is left to Spark, which knows how large it is.

Defined results: a URL that is null or has no `://` has an empty host and path, fits nothing and is allowed; repeated pages are
judged alike; rules that are null, empty or lack a host fit nothing; of two equal host rules a block wins; an empty table of
pages gives no row, an empty table of rules allows all; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import boxed, save, unboxed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "verdict string, text string, kind string"
#: Host rules and patterns of the registered query.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PATTERNS = (
    "||adult-*.", "||ads-track.", "||casino-*.", "||cheap-pills.", "||free-bets.", "||spam-farm.", "/wp-login.php", "/cart^", "/signin^", "^sessionid=", "^phpsessid=", ".exe|", "@@||spam-farm.example.org^fr^",
)


def rule_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    rows = [(v, t, "host") for v, t in host_rules] + [("allow" if p.startswith("@@") else "block", p.removeprefix("@@"), "pattern") for p in patterns]
    return spark.createDataFrame(rows, RULES)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*((?s:.*))\z", 1), F.lit(""))


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")


def compiled(rules: DataFrame) -> DataFrame:
    """verdict, text, kind, regex and tokens of every rule that can fit something."""
    t, is_host = F.col("text"), F.col("kind") == "host"
    own_host = ascii_lower(F.substring_index(t, "/", 1))
    bounded = F.when(F.contains(t, F.lit("/")), F.lit("")).otherwise(r"(?=[/?#]|\z)")
    host_rule = F.concat(F.lit(r"^(?:[^/?#]*\.)?"), _quoted(own_host), _quoted(F.substr(t, F.length(own_host) + 1)), bounded)
    body = F.regexp_replace(F.regexp_replace(ascii_lower(t), r"^\|\|?", ""), r"\|\z", "")
    body = F.regexp_replace(F.regexp_replace(_quoted(body), r"\\\*", ".*"), r"\\\^", r"(?:[^a-z0-9_.%\\-]|\\z)")
    start = F.when(t.startswith("||"), r"^(?:[^/?#]*\.)?").when(t.startswith("|"), "^").otherwise("")
    pattern = F.concat(F.lit("(?s)"), start, body, F.when(t.endswith("|"), r"\z").otherwise(""))
    marked = F.when(is_host, F.concat(F.lit("|"), own_host, F.substr(t, F.length(own_host) + 1), F.when(F.contains(t, F.lit("/")), "").otherwise("|"))).otherwise(t)
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(marked), F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))
    useful = F.when(is_host, own_host != "").otherwise(F.regexp_replace(t, r"[|*]", "") != "")
    return rules.filter(useful).select("verdict", "text", "kind", F.when(is_host, host_rule).otherwise(pattern).alias("regex"), tokens.alias("tokens"))


def _subjects(pages: DataFrame) -> DataFrame:
    """url, place (host and path, for host rules), whole (host and all that follows, in small letters, for patterns), tokens."""
    u = F.col("url")
    held = pages.select("url").filter(F.contains(u, F.lit("://"))).select(u, F.concat(host(u), path(u)).alias("place"), ascii_lower(F.concat(host(u), _after_host(u))).alias("whole"))
    return held.withColumn("tokens", F.array_distinct(F.split("whole", "[^a-z0-9]+")))


def index(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """token, verdict, text, kind, regex: every rule under the one of its tokens that fewest URLs hold, or under none ('')."""
    own = compiled(rules)
    asked = save(own.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    met = _subjects(pages).select(F.explode("tokens").alias("token")).join(asked, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    each = own.select("verdict", "text", "kind", "regex", F.explode_outer("tokens").alias("token")).join(met, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "token"))
    return each.groupBy("verdict", "text", "kind", "regex").agg(F.coalesce(rarest, F.lit("")).alias("token"))


def fits(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of every distinct URL that some rule fits; rule is null where a pattern decides."""
    urls = _subjects(pages)
    filed = save(index(rules, pages), "rules")  # of known size: broadcast if it is small, before any URL is dealt out by token
    every = F.array_union("tokens", F.array(F.lit(""))) if filed.filter("token = ''").limit(1).count() else F.col("tokens")
    candidates = urls.select("url", "place", "whole", F.explode(every).alias("token")).join(filed, "token")
    hit = candidates.filter(F.rlike(F.when(F.col("kind") == "host", F.col("place")).otherwise(F.col("whole")), F.col("regex")))
    is_host, blocks = F.col("kind") == "host", F.col("verdict") == "block"
    best = hit.groupBy("url").agg(
        F.max_by(F.struct("text", "verdict"), F.when(is_host, F.struct(F.length("text"), blocks, "text"))).alias("h"),
        F.bool_or(~is_host & blocks).alias("blocked"),
        F.bool_or(~is_host & ~blocks).alias("excepted"),
    )
    by_pattern = F.when(F.col("blocked") & ~F.col("excepted"), "block").otherwise("allow")
    return best.select("url", F.col("h.text").alias("rule"), F.coalesce("h.verdict", by_pattern).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """_row (the columns of pages, see boxed()), host, path, rule, verdict."""
    best = fits(pages, rules).withColumnRenamed("url", "_url")
    own = pages.select(boxed(pages).alias("_row"), F.col("url").alias("_own"))
    out = own.join(best, F.col("_own") == F.col("_url"), "left")
    return out.select("_row", host(F.col("_own")).alias("host"), path(F.col("_own")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def apply(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages whose URL is allowed."""
    return judge(pages, rules).filter("verdict = 'allow'").select(*unboxed(pages.columns))


def digest(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    rules = rule_table(pages.sparkSession) if rules is None else rules
    return judge(pages.select("page_id", "url"), rules).select(F.col("_row.c0").alias("page_id"), "host", "path", "rule", "verdict")
