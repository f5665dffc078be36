"""URL filter: pattern rules indexed by their rarest literal token [native].

A URL is cut into literal tokens. Each rule is filed under the one of its literal tokens that the
fewest URLs of the table hold, a URL fetches only the rules filed under its own tokens, and only
those run their regular expressions. Everything is DataFrame functions; the rule index is
broadcast in blocks of at most `MAX_BLOCK` rules, so its size is bounded whatever the rule list.

Defined cases: a null url, or one without `://`, has empty host and path, no tokens, no rule and
the default verdict. Repeated rows are judged one by one and all returned. Rules that tie in
length are settled by the smaller rule text. Of pattern rules that match, a block wins over an
allow. An empty table gives an empty result; columns beside the two that are named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules to one broadcast index; longer lists go in several blocks, one join each.
MAX_BLOCK = 20_000

TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule. With `host` it is a host/path rule; with `pattern` it is a regular expression whose
    matches must hold every token of `literals`."""

    verdict: str
    host: str | None = None
    path: str = ""
    pattern: str | None = None
    literals: str = ""

    @property
    def name(self) -> str:
        return self.pattern if self.host is None else self.host + self.path

    @property
    def regex(self) -> str:
        """Searched in host + path for host rules, in the lower-cased URL for pattern rules."""
        return self.pattern if self.host is None else r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", self.host + self.path)

    def tokens(self) -> set[str]:
        if self.host is None:
            return set(re.findall(TOKEN, self.literals.lower()))
        # the last path piece may go on in the URL, so it is no whole token there unless it is closed
        whole = self.path if re.search(r"[^A-Za-z0-9]$", self.path) else re.sub(r"[A-Za-z0-9]+$", "", self.path)
        return set(re.findall(TOKEN, self.host + whole.lower()))


#: Host and path rules of the standard list.
HOST_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Patterns that judge what no host rule fits.
PATTERN_RULES = tuple(
    Rule("block", pattern=rf"(?:^|[^a-z0-9]){words}(?:[^a-z0-9]|$)", literals=words)
    for words in ("spam-farm", "cheap-pills", "casino", "free-bets", "ads-track", "adult", "free-money", "xxx")
)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rarest_tokens(tokens: DataFrame, rules: Sequence[Rule]) -> dict[Rule, str]:
    """Each rule's token with the fewest URLs. tokens: (token), one row per URL and distinct token.
    What comes to the driver is bounded by the rules' own tokens."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if any(not r.tokens() for r in rules):
        raise ValueError("a rule needs a literal token to be found by")
    counts: dict[str, int] = {}
    for i in range(0, len(wanted), MAX_BLOCK):
        some = tokens.sparkSession.createDataFrame([(t,) for t in wanted[i : i + MAX_BLOCK]], "token string")
        counts |= {t: n for t, n in tokens.join(F.broadcast(some), "token").groupBy("token").count().collect()}
    return {r: min(r.tokens(), key=lambda t: (counts.get(t, 0), t)) for r in rules}


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: Sequence[Rule] = HOST_RULES,
    pattern_rules: Sequence[Rule] = PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """Returns one row per input row: the id, url, host, path, rule (the longest fitting host rule),
    pattern (the matching pattern rule that judged it, if no host rule fits) and verdict."""
    spark = pages.sparkSession
    host, path = parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.select("_id", "_url", host.alias("_host"), path.alias("_path"), ascii_lower(F.coalesce("_url", F.lit(""))).alias("_low"))
    tokens = F.array_distinct(F.regexp_extract_all(F.col("_low"), F.lit(TOKEN), 0))
    rules = list(dict.fromkeys([*host_rules, *pattern_rules]))
    best = None
    if rules:
        filed = rarest_tokens(rows.select(F.explode(tokens).alias("token")), rules)
        # the empty token keeps the URLs that have no token; the row number keeps repeated rows apart
        work = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_token", F.explode(F.concat(F.array(F.lit("")), tokens)))
        for i in range(0, len(rules), MAX_BLOCK):
            block = [(filed[r], r.regex, r.name, r.verdict, r.host is not None, len(r.name)) for r in rules[i : i + MAX_BLOCK]]
            index = spark.createDataFrame(block, "_token string, _regex string, _rule string, _verdict string, _by_host boolean, _len int")
            index = index.groupBy("_token").agg(F.collect_list(F.struct("_regex", "_rule", "_verdict", "_by_host", "_len")).alias(f"_found{i}"))
            work = work.join(F.broadcast(index), "_token", "left")
        found = [F.col(f"_found{i}") for i in range(0, len(rules), MAX_BLOCK)]
        none = F.array().cast("array<struct<_regex:string,_rule:string,_verdict:string,_by_host:boolean,_len:int>>")
        candidates = F.concat(*[F.coalesce(f, none) for f in found])
        judged = F.filter(candidates, lambda r: F.when(r._by_host, F.regexp(F.concat("_host", "_path"), r._regex)).otherwise(F.regexp(F.col("_low"), r._regex)))
        order = F.transform(judged, lambda r: F.struct(r._by_host.alias("by_host"), F.when(r._by_host, r._len).otherwise((r._verdict == "block").cast("int")).alias("rank"), r._rule.alias("rule"), r._verdict.alias("verdict")))
        best = F.array_max(order)
        work = work.withColumn("_best", best)
        rows = work.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("_id", "_url", "_host", "_path")], F.max("_best").alias("_best"))
    else:
        rows = rows.withColumn("_best", F.lit(None).cast("struct<by_host:boolean,rank:int,rule:string,verdict:string>"))
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best.by_host"), F.col("_best.rule")).alias("rule"),
        F.when(~F.col("_best.by_host"), F.col("_best.rule")).alias("pattern"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_PATTERNS = "|".join(f"({r.pattern})" for r in PATTERN_RULES)
_URL = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"

ORACLE_SQL = f"""
WITH r AS (SELECT page_id, {_URL} AS low, {_REST} AS rest FROM pages),
p AS (
  SELECT page_id, low,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), f AS (
  SELECT page_id, host, path, low,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(low, '{_PATTERNS}') THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
