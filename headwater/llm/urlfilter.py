"""URL filtering: rules are found by their rarest literal token, and only rules so found run their pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.storage import materialize

RULES = "rule string, site boolean, verdict string, pattern string, tokens array<string>"

# The rules of the registered query (host and path prefix).
SITE_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# Words of addresses that the method itself blocks where no site rule fits, by the place they stand in.
DIRECTORIES = ["ad", "ads", "adserver", "banner", "banners", "login", "signin", "signup", "register", "cart", "checkout"]
SUBDOMAINS = ["ad", "ads", "track", "tracker", "tracking", "pixel"]
HOST_WORDS = [
    "ads", "adserver", "adult", "bet", "bets", "betting", "casino", "casinos", "escort", "escorts", "gambling", "lottery", "poker",
    "porn", "porno", "roulette", "sex", "slots", "viagra", "webcam", "webcams", "xxx",
]
PARAMETERS = ["sessionid", "phpsessid", "jsessionid"]


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def site_rule(rule: str, verdict: str) -> tuple:
    """A rule for a host with its subdomains and a path prefix."""
    host, slash, path = rule.partition("/")
    # A word at the very end of a prefix may go on in an address, so it is no token.
    tokens = _words(host) + _words(re.sub("[A-Za-z0-9]+$", "", path))
    return rule, True, verdict, rf"^//(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}", tokens


def method_rules() -> list[tuple]:
    """Patterns over ``//host/path?query``, each round one literal word: a directory, a first label, a word of any part
    of the host between marks, a parameter."""
    made = [(w, rf"^//[^?#]*/{w}(?:[/?#.]|$)") for w in DIRECTORIES]
    made += [(w, rf"^//{w}\.") for w in SUBDOMAINS]
    made += [(w, rf"^//(?:[^/?#]*[^a-z0-9/?#])?{w}(?:[^a-z0-9]|$)") for w in HOST_WORDS]
    made += [(w, rf"[?&]{w}=") for w in PARAMETERS]
    return [(pattern, False, "block", pattern, [w]) for w, pattern in made]


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def _parts(urls: DataFrame) -> DataFrame:
    """``url, host, path, address``: the address is ``//host`` in lower case with all that follows."""
    rest = urls.selectExpr(
        "url", "if(locate('://', coalesce(url, '')) > 0, substring(url, locate('://', url) + 3), '') rest"
    )
    cut = rest.selectExpr("url", "rest", "regexp_extract(rest, '^[^/?#]*', 0) raw")
    cut = cut.selectExpr(
        "url",
        "translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host",
        "substring(rest, length(raw) + 1) tail",
    )
    return cut.selectExpr(
        "url", "host", "regexp_extract(tail, '^[^?#]*', 0) path", "concat('//', host, tail) address"
    )


def judge_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, host, path, rule, verdict, pattern)`` for each distinct address of ``urls(url)``.

    Every rule stands in the index once, under that of its literal tokens which fewest addresses hold (under the empty
    token if it has none). An address fetches the rules under its own tokens, and those alone run their pattern. Of
    fitting site rules the longest wins (of equal ones block, then the first by name); where none fits, a method rule
    blocks; else the address is allowed. ``pattern`` is the deciding method rule.

    A null address, or one without ``://``, has an empty host and path, which no rule fits.
    """
    parts = materialize(_parts(urls.select("url").distinct()), "urls")
    words = parts.select(
        "url", "address",
        F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.expr("regexp_extract_all(lower(address), '[a-z0-9]+', 0)")))).alias("token"),
    )
    held = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    tokens = rules.select("*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    index = (
        tokens.join(held, "token", "left")
        .groupBy("rule", "site", "verdict", "pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).getField("token").alias("token"))
    )
    fits = words.join(index, "token").where("address rlike pattern")
    rank = F.struct("site", F.length("rule").alias("size"), (F.col("verdict") == "block").alias("block"), F.col("rule").alias("rule"), "verdict")
    # max takes the largest name; method rules only need one that blocks.
    best = fits.groupBy("url").agg(F.max(rank).alias("best"))
    found = parts.join(best, parts["url"].eqNullSafe(best["url"]), "left").select(parts["*"], "best")
    return found.select(
        "url", "host", "path",
        F.when(F.col("best.site"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.site"), F.col("best.rule")).alias("pattern"),
    )


def filter_urls(pages: DataFrame, page_id: Column, url: Column, rules: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict, pattern)`` per row: ``judge_urls`` on the distinct addresses, joined back.

    Repeated rows and null ids each get their row. No rows give no rows.
    """
    rows = pages.select(page_id.alias("page_id"), url.cast("string").alias("url"))
    judged = judge_urls(rows, rules).withColumnRenamed("url", "judged")
    return rows.join(judged, rows["url"].eqNullSafe(judged["judged"]), "left").select(
        "page_id", "host", "path", "rule", "verdict", "pattern"
    )
