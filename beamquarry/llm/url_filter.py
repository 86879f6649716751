"""URL filtering by rules and, where none fits, by a Bloom filter cascade over a list of hosts.

The cascade is built over the corpus's complete key universe (every host and parent domain
that could be listed). Level 1 holds the listed keys of the universe; level 2 the unlisted
keys that level 1 wrongly accepts; level 3 the listed keys that level 2 wrongly accepts; and
so on until no key is wrong. A key's membership is then exact: it is listed if the first
level that rejects it has an even number. Levels are bitmaps built by aggregation; probing is
an expression over binary literals, so judging a URL needs no join.

Defined cases: a null URL or one without `://` has empty host and path and is allowed;
repeated rows are judged alike; an empty table gives an empty result and no level; a URL's
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.bloom import Bloom
from beamquarry.llm.common import bounded_broadcast, stored

#: Fixed values: (verdict, host, path) rules, and the hosts listed as unwanted.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UNWANTED = tuple(f"{name}.example.{top}" for name, top in product(("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org")))
#: Listed keys of one segment: some 16 MB of literals at the lowest rate of the first level.
SEGMENT_KEYS = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], index: int) -> Column:
    """Of the longest rule that fits: its verdict (index 0) or its text (index 1); else null."""
    found = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.lit((verdict, rule_host + rule_path)[index])).otherwise(found)
    return found


def domain_keys(host: Column, labels: int) -> Column:
    """The host's parent domains of up to so many labels, itself included if it is no longer."""
    parts = F.slice(F.reverse(F.split(host, r"\.")), 1, labels)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.reverse(F.slice(parts, F.lit(1), i)), "."))


def _level(number: int, keys: int, rate: float) -> Bloom:
    return Bloom.sized(number, keys, rate)


class Cascade:
    """Exact membership of universe keys in the list, as an expression."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame) -> Cascade:
        """From (key, listed) with distinct keys."""
        listed, every = universe.agg(F.count_if("listed"), F.count(F.lit(1))).first()
        levels: list[Bloom] = []
        wrong, side = listed, True  # keys that the next level must hold, and whether these are the listed ones
        left = universe
        while wrong:
            rate = min(0.5, max(1e-6, math.sqrt(0.5) * listed / max(1, every - listed))) if not levels else 0.5
            level = _level(len(levels) + 1, wrong, rate)
            levels.append(level.build(left.where(F.col("listed") == side)))
            # keys of the other side that this level accepts are wrong; of this side, all stay in question
            left = left.where((F.col("listed") == side) | level.accepts(F.col("key")))
            side = not side
            wrong = left.where(F.col("listed") == side).count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            found = F.when(level.accepts(key), found).otherwise(F.lit(level.number % 2 == 0))
        return found


def cascades(universe: DataFrame, segment_keys: int) -> list[Cascade]:
    """One cascade for each segment of the keys, by hash, with about so many listed keys in each."""
    listed = universe.agg(F.count_if("listed")).first()[0]
    segments = max(1, -(-listed // segment_keys))
    return [Cascade.build(universe.where(segment_of(F.col("key"), segments) == s)) for s in range(segments)]


def segment_of(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(segments))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, unwanted: Sequence[str] | DataFrame = UNWANTED, segment_keys: int = SEGMENT_KEYS
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. `unwanted` lists hosts, in a column `key` if it is a table.

    A cascade's levels are literals of the plan, so keys are cut into segments of at most about `segment_keys` listed
    ones. One segment is judged in place; more are judged one after the other over the distinct hosts.
    """
    spark = pages.sparkSession
    if not isinstance(unwanted, DataFrame):
        names = sorted(set(unwanted))
        unwanted = spark.range(1).select(F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("key"))
    listing = unwanted.select("key").distinct().withColumn("_on", F.lit(True))
    labels = max(1, (listing.agg(F.max(F.length("key") - F.length(F.replace("key", F.lit("."), F.lit(""))))).first()[0] or 0) + 1)
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = split.select("host").distinct()
    keys = hosts.select(F.explode(domain_keys(F.col("host"), labels)).alias("key")).distinct()
    universe = stored(keys.join(listing, "key", "left").select("key", F.coalesce("_on", F.lit(False)).alias("listed")), "url-keys")
    built = cascades(universe, segment_keys)
    host, path = F.col("host"), F.col("path")
    if len(built) == 1:
        blocked = F.exists(domain_keys(host, labels), built[0].holds)
    else:
        of_host = hosts.select("host", F.explode(domain_keys(host, labels)).alias("key"))
        hits = [of_host.where((segment_of(F.col("key"), len(built)) == s) & cascade.holds(F.col("key"))).select("host") for s, cascade in enumerate(built)]
        hits = stored(reduce(DataFrame.unionByName, hits).distinct().withColumn("_hit", F.lit(True)), "url-hits")
        split, blocked = split.join(bounded_broadcast(hits, hits), "host", "left"), F.col("_hit").isNotNull()
    return split.select(
        "page_id",
        "host",
        "path",
        fitting_rule(host, path, rules, 1).alias("rule"),
        F.coalesce(fitting_rule(host, path, rules, 0), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


ORACLE = f"""
WITH r AS (
    SELECT page_id, strpos(url, '://') AS p, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), s AS (
    SELECT page_id,
           CASE WHEN p > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
           CASE WHEN p > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM r
), rules(verdict, rule_host, rule_path) AS (
    VALUES {", ".join(str(r) for r in RULES)}
), best AS (
    SELECT s.page_id, s.host, s.path, max_by(r.verdict, length(rule_host || rule_path)) AS verdict,
           max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule
    FROM s LEFT JOIN rules r
      ON (s.host = rule_host OR ends_with(s.host, '.' || rule_host)) AND starts_with(s.path, rule_path)
    GROUP BY ALL
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.])({"|".join(x.replace(".", "[.]") for x in UNWANTED)})$')
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""
