"""URL filters: host rules, and a blocked Bloom filter before an exact hash join.

A list of canonical URLs is folded into a blocked Bloom filter: a table of blocks of
eight 32-bit lanes, each URL setting one bit in every lane of one block. Pages probe
the block of their canonical URL; only possible hits reach the exact join with the
list, which removes the false positives. The filter is a DataFrame: it is broadcast
while its size, known from the count of the list, is below a limit, and joined by
block number beyond it.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no
rule and is on no list; an empty list blocks nothing; repeated pages are judged one by
one; input columns named like computed ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = [f"_b{i}" for i in range(8)]
#: Bytes of one block as a row, for the size check before a broadcast.
BLOCK_BYTES = 96


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Production rules.
RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: Host labels that put a page's canonical URL on the production list.
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` or a last slash, and the
    query without tracking parameters; neither scheme nor fragment."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.ltrim(F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", ""), F.lit("&"))
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/+)$", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def best_rule(host: Column, path: Column, rules: Sequence[HostRule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 20), F.lit(blocks))


def _lane(key: Column, i: int) -> Column:
    bit = F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 5 * i).bitwiseAND(F.lit(31))
    return F.call_function("shiftleft", F.expr("1L"), bit.cast("int"))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter's blocks: (_block, eight lanes). ``listed`` has one column, ``canon``."""
    keys = listed.select(_block(F.col("canon"), blocks).alias("_block"), *[_lane(F.col("canon"), i).alias(c) for i, c in enumerate(LANES)])
    return keys.groupBy("_block").agg(*[F.bit_or(c).alias(c) for c in LANES])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[HostRule] = RULES,
    keys_per_block: int = 16,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``pages`` (with ``url``) plus host, path, rule, verdict, maybe_listed, listed.

    ``listed`` has a string column ``canon``; nulls, empty strings and repeats in it don't
    matter, and a page without a host is on no list. Beyond the broadcast limit both joins
    shuffle; pages that needn't meet the other side are dealt out evenly then.
    """
    listed = materialize(listed.select("canon").where(F.col("canon") != "").distinct(), "urls-listed")
    n = listed.count()
    blocks = max(1, -(-n // keys_per_block))
    bloom = bloom_blocks(listed, blocks)
    # The page travels as one column, so its names meet no computed ones.
    url = F.col("page.url")
    out = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    spread = F.monotonically_increasing_id() % 4096  # of rows that match nothing, whatever it is
    out = out.select("page", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("_canon"), spread.alias("_spread"))
    out = out.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules))
    # Rules come first: only pages that no rule decides need the list.
    asked = F.col("_best").isNull() & (F.col("host") != "")
    out = out.withColumn("_block", F.when(asked, _block(F.col("_canon"), blocks)).otherwise(-1 - F.col("_spread")))
    if blocks * BLOCK_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    out = out.join(bloom, "_block", "left")
    hit = None
    for i, c in enumerate(LANES):
        lane = _lane(F.col("_canon"), i)
        test = F.col(c).bitwiseAND(lane) == lane
        hit = test if hit is None else hit & test
    out = out.withColumn("maybe_listed", F.coalesce(hit, F.lit(False))).drop("_block", *LANES)
    # Exact hash join for the possible hits; the other pages have keys that the list hasn't.
    exact = listed.select(F.col("canon").alias("_key"), F.lit(-1).cast("long").alias("_spread"), F.lit(True).alias("_listed"))
    exact = F.broadcast(exact) if n * 256 <= broadcast_bytes else exact.hint("shuffle_hash")
    hits = {"_key": F.when(F.col("maybe_listed"), F.col("_canon")).otherwise(""), "_spread": F.when(F.col("maybe_listed"), F.lit(-1)).otherwise(F.col("_spread")).cast("long")}
    out = out.withColumns(hits).join(exact, ["_key", "_spread"], "left")
    found = F.coalesce("_listed", F.lit(False))
    new = {
        "host": F.col("host"), "path": F.col("path"), "maybe_listed": F.col("maybe_listed"), "listed": found, "rule": F.col("_best.rule"),
        "verdict": F.coalesce("_best.verdict", F.when(found, "block").otherwise("allow")),
    }
    kept = [F.col("page").getField(c).alias(c) for c in pages.columns if c not in new]
    return out.select(*kept, *[v.alias(k) for k, v in new.items()])


def listed_urls(pages: DataFrame) -> DataFrame:
    """The production list: canonical URLs of pages on a host with a listed label."""
    labels = "|".join(LISTED_LABELS)
    return pages.where(host_of(F.col("url")).rlike(rf"(^|\.)({labels})\.")).select(canonical(F.col("url")).alias("canon"))


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  ltrim(regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '&') AS q FROM u),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/+)$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canon FROM h),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)\.')),
r AS (SELECT c.*, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
