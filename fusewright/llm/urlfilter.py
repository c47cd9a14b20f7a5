"""URL filters, with DataFrame functions only.

A rule is a pattern over host and path. It is filed under the rarest of its literal tokens, by
counts over all URLs. A URL's tokens fetch the rules filed under them, and only those rules'
regular expressions run. A few rules stand in the plan; more of them are a table joined by token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule for a host, its subdomains, and the paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path) or '(?=/|$)'}"

    def tokens(self) -> list[str]:
        """Literal tokens that each matching URL has whole: all but a last one that the path leaves open."""
        found = [x for x in re.split(TOKEN, self.name) if x]
        return found if not self.path or re.search(r"[^A-Za-z0-9]$", self.name) else found[:-1]


#: The rules of the production query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Up to so many rules stand in the plan.
IN_PLAN = 2_000


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def told(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds as a table, by one literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    said = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens; as many rows as there are tokens come to the driver."""
    wanted = told(urls.sparkSession, [(t,) for t in tokens], "token string")
    seen = urls.select(F.explode(F.array_distinct(F.split("place", TOKEN))).alias("token")).join(wanted, "token", "left_semi")
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", in_plan: int = IN_PLAN) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict.

    The longest rule that fits decides (equal ones: the first in name order); with none, rule is
    null and the verdict is default. Null url or one without "://": host and path are empty, so no
    rule fits. Very long urls are read whole. Repeated rows: each is judged. Empty table: empty
    result. Other columns are ignored, whatever their names. Any number of rules.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("place", F.concat("host", "path"))
    wanted = sorted({t for r in rules for t in r.tokens()})
    counts = token_counts(urls, wanted) if wanted else {}
    # a rule without a whole token is filed under "", which every URL has
    filed = [(min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=""), -len(r.name), r.name, r.verdict, r.regex) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    tokens = F.array_union(F.array(F.lit("")), F.array_distinct(F.split("place", TOKEN)))
    if not filed:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if len(filed) <= in_plan:
        best = _best_in_plan(urls, tokens, filed)
    else:
        index = told(pages.sparkSession, filed, "token string, order int, name string, verdict string, regex string")
        fits = urls.select("place").distinct().select("place", F.explode(tokens).alias("token")).join(index, "token").where("regexp_like(place, regex)")
        best = urls.join(fits.groupBy("place").agg(F.min(F.struct("order", "name", "verdict")).alias("best")), "place", "left")
    return best.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def _best_in_plan(urls: DataFrame, tokens: Column, filed: Sequence[tuple[str, int, str, str, str]]) -> DataFrame:
    """urls with best (order, name, verdict): one projection, no join."""
    entries: dict[str, list[Column]] = {}
    for token, *entry in filed:
        entries.setdefault(token, []).append(F.struct(*(F.lit(x).alias(k) for k, x in zip(("order", "name", "verdict", "regex"), entry))))
    none = F.slice(F.array(next(iter(entries.values()))[0]), 1, 0)
    index = F.create_map(*[x for t, rs in entries.items() for x in (F.lit(t), F.array(*rs))])
    fetched = F.flatten(F.transform(tokens, lambda t: F.coalesce(index[t], none)))
    return urls.withColumn("best", F.array_min(F.filter(fetched, lambda r: F.regexp_like(F.col("place"), r["regex"]))))


#: judge() with the production rules over the table pages, for DuckDB.
ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
