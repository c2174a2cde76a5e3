"""URL filters: rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks: a URL's hash names one block of eight 32-bit words and one
bit in each. URLs that it passes go to an exact hash join with the list, which removes its
false positives. The filter grows with the list: blocks are counted, and where they are too
many to be broadcast, URLs and blocks meet by a shuffle on the block's number, so the exact
join still gets possible hits only.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule
and has an empty canonical form, which is never listed; URLs of any length are judged whole; null entries of the list are passed
over; equal rule lengths are decided by the rule's text; repeated rows are judged once each;
an empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (host, path start, verdict); the longest that fits wins.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: 256-bit blocks hold so many URLs each: about one false positive in a hundred.
PER_BLOCK = 24
TRACKED = r"[?&](utm_[a-z]+|ref)="
_SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def host_of(url: Column) -> Column:
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without a closing slash or .html; scheme, query and fragment don't count."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), bare))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path start) and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A key's block and its eight words, each with one bit set."""
    h = F.xxhash64(key)
    low = h.bitwiseAND(0x7FFFFFFF)
    bits = [F.shiftright((low * F.lit(s & 0x7FFFFFFF)).bitwiseAND(0x7FFFFFFF), 26).cast("int") for s in _SALTS]  # below 2^62: no overflow
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """listed (key) to (block, w0..w7)."""
    block, words = _place(F.col("key"), blocks)
    return listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def listed_hits(urls: DataFrame, listed: DataFrame, broadcast_blocks: int = common.BROADCAST_ROWS) -> DataFrame:
    """urls (with a column key) and whether the key is listed (listed: key), as column hit."""
    listed = common.settle(listed.where("key is not null and key <> ''").select("key").distinct())
    marked = listed.select(F.col("key").alias("_key"))
    blocks = max(1, -(-listed.count() // PER_BLOCK))
    table = common.settle(bloom_blocks(listed, blocks))
    if blocks <= broadcast_blocks:
        table = F.broadcast(table)
    kept = [F.col(c) for c in urls.columns]
    named = F.coalesce(F.col("key"), F.lit("")) != ""
    block, words = _place(F.col("key"), blocks)
    tagged = urls.where(named).withColumn("_block", block).join(table, F.col("_block") == F.col("block"), "left")
    possible = F.coalesce(reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(w) != 0 for i, w in enumerate(words)]), F.lit(False))
    sure = tagged.where(~possible).select(*kept).unionByName(urls.where(~named)).withColumn("hit", F.lit(False))
    exact = tagged.where(possible).select(*kept).join(marked, F.col("key") == F.col("_key"), "left").select(*kept, F.col("_key").isNotNull().alias("hit"))
    return sure.unionByName(exact)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, broadcast_blocks: int = common.BROADCAST_ROWS) -> DataFrame:
    """For each row: page_id, host, path, rule, listed, verdict. listed has a column key of canonical URLs."""
    parts = split(pages, id_col, url_col)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    hits = listed_hits(parts.withColumn("rule", rule).withColumn("_by_rule", verdict), listed, broadcast_blocks)
    method = F.when(F.col("hit"), "block").otherwise("allow")
    return hits.select("page_id", "host", "path", "rule", F.col("hit").alias("listed"), F.coalesce("_by_rule", method).alias("verdict"))


def split(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, key (canonical URL)."""
    picked = common.take(pages, page_id=id_col, url=url_col)
    parts = picked.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("key", canonical(F.col("host"), F.col("path")))


def tracked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Canonical URLs that a crawl has reached by a tracking parameter (utm_* or ref): a list that grows with the crawl."""
    own = common.take(pages, page_id=id_col, url=url_col).where(F.col("url").rlike(TRACKED))
    return split(own).where("key <> ''").select("key").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return judge(pages, tracked(pages))


_CASES = {k: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if k == 'rule' else v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))) for k in ("rule", "verdict")}
ORACLE_SQL = rf"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') END AS key FROM u),
t AS (SELECT DISTINCT key FROM k JOIN pages p USING (page_id) WHERE key <> '' AND regexp_matches(p.url, '{TRACKED}'))
SELECT page_id, host, path, CASE {_CASES['rule']} END AS rule, key IN (SELECT key FROM t) AS listed,
  coalesce(CASE {_CASES['verdict']} END, CASE WHEN key IN (SELECT key FROM t) THEN 'block' ELSE 'allow' END) AS verdict
FROM k
"""
