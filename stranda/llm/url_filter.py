"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

Listed URLs are brought to a canonical form: host in lower case without ``www.``, ``m.`` or ``blog.``, path without a trailing
slash or a ``.html`` ending, no scheme, query or fragment. A page is looked up by its own canonical URL and by that of its site (other
subdomains are sites of their own). The
filter, of at most FILTER_BYTES whatever the list's length, has blocks of 256 bits: a key sets one bit in each of a block's eight
words. Pages that the filter lets pass are settled; possible hits go on to an exact hash join with the list, which removes false positives.

A rule (host, path) fits its host and all subdomains if the page's path starts with the rule's; the longest rule (host, then path)
wins and decides; without a rule a listed page is blocked and any other allowed.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed; repeated rows count each;
tables without rows give tables without rows; other columns pass through, but for one that has an appended column's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stranda.llm import common

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Whole sites that the query's list holds besides URLs found by their pages' text.
SITES = [f"{site}.example.{end}" for site in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x") for end in ("com", "net", "org")]
JUNK = r"[A-Za-z.,](?:###|\*\*\*|\$\$\$|%%%|&amp;&amp;&amp;)[ \n<]"
#: Keys of a list that may be broadcast for the exact join: some 10 MB.
SMALL_LIST = 100_000
FILTER_BYTES = 64 << 20
BITS_PER_KEY = 12
WORDS = 8
#: Odd multipliers, one for each word of a block: powers of one number.
SALTS = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(WORDS)], dtype=np.uint64)


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url):
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def site(host):
    return F.regexp_replace(host, r"^(?:www\.|m\.|blog\.)+", "")


def canonical(host, path):
    return F.concat(site(host), F.regexp_replace(path, r"(?:\.html)?/*$", ""))


def fitting_rule(host, path, rules=RULES):
    """(verdict, rule) of the longest rule that fits, as a struct, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


class BlockedBloom:
    """A filter over 64-bit hashes."""

    def __init__(self, blocks: int, words: np.ndarray | None = None):
        self.blocks = blocks
        self.words = np.zeros((blocks, WORDS), np.uint32) if words is None else words

    @classmethod
    def sized(cls, keys: int, most_bytes: int = FILTER_BYTES) -> BlockedBloom:
        blocks = max(1, -(-keys * BITS_PER_KEY // (32 * WORDS)))
        return cls(min(blocks, max(1, most_bytes // (4 * WORDS))))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks, and the bit in each word."""
        h = hashes.astype(np.int64).view(np.uint64)
        low = h & np.uint64(0xFFFFFFFF)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        bit = ((low[:, None] * SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        return block.astype(np.int64), (np.uint32(1) << bit.astype(np.uint32)).astype(np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        block, bits = self.places(hashes)
        for k in range(WORDS):
            np.bitwise_or.at(self.words[:, k], block, bits[:, k])

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self.places(hashes)
        return ((self.words[block] & bits) == bits).all(axis=1)


def listed_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    """(key): distinct canonical URLs of a list; nulls and what isn't a URL are left out."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    return urls.filter(F.col(url).contains("://")).select(canonical(host, path).alias("key")).filter("key <> ''").distinct()


def build(keys: DataFrame, n_keys: int, most_bytes: int = FILTER_BYTES) -> BlockedBloom:
    """The filter of distinct keys: set in parts, blocks that parts share are joined by Spark; its size is bounded."""
    made = BlockedBloom.sized(n_keys, most_bytes)

    def run(parts) -> Iterator[list]:
        for (hashes,) in parts:
            block, bits = made.places(hashes.to_numpy(zero_copy_only=False))
            yield [pa.array(block), *(pa.array(bits[:, k].astype(np.int64)) for k in range(WORDS))]

    schema = "block bigint, " + ", ".join(f"w{k} bigint" for k in range(WORDS))
    rows = common.emit(keys.select(F.xxhash64("key").alias("h")), schema, run, ["h"])
    got = rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).toArrow()
    for k in range(WORDS):
        made.words[got["block"].to_numpy(), k] = got[f"w{k}"].to_numpy()
    return made


ADDED = ("host", "path", "rule", "verdict", "listed")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", most_bytes: int = FILTER_BYTES, small: int = SMALL_LIST) -> DataFrame:
    """Rows with host, path, rule, verdict and listed appended (a column with one of these names is replaced); ``listed`` is a table of URLs."""
    keys = common.save(listed_keys(listed), "listed-urls")
    n_keys = keys.count()
    bloom = pages.sparkSession.sparkContext.broadcast(build(keys, n_keys, most_bytes))
    kept = [c for c in pages.columns if c not in ADDED]
    # The rows' own columns travel as one, so no name of theirs can clash.
    rows = pages.select(F.struct(F.lit(0).alias("n"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)] or [F.lit(0).alias("c0")]).alias("c")).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rows = rows.select("row", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("fits"), canonical(F.col("host"), F.col("path")).alias("own"), site(F.col("host")).alias("site"))
    rows = rows.select("*", F.xxhash64("own").alias("h1"), F.xxhash64("site").alias("h2"))

    def maybe(state, *hashes):
        return [pa.array(bloom.value.might_contain(h.to_numpy(zero_copy_only=False))) for h in hashes]

    rows = common.add_columns(rows, [T.StructField("m1", T.BooleanType()), T.StructField("m2", T.BooleanType())], maybe, ["h1", "h2"], keep=["row", "host", "path", "fits", "own", "site"])

    def settled(possible: DataFrame, known: DataFrame) -> DataFrame:
        """With ``listed``, by an exact hash join; what the filter rules out has a null key."""
        for flag, column, out in (("m1", "own", "l1"), ("m2", "site", "l2")):
            possible = possible.join(known.toDF(f"k_{out}", out), F.when(F.col(flag), F.col(column)) == F.col(f"k_{out}"), "left")
        return possible.select("row", "host", "path", "fits", F.coalesce("l1", "l2", F.lit(False)).alias("listed"))

    known = keys.select("key", F.lit(True))
    if n_keys <= small:
        found = settled(rows, F.broadcast(known))
    else:  # only possible hits are moved to a list that can't be broadcast
        passed = rows.filter(~F.col("m1") & ~F.col("m2")).select("row", "host", "path", "fits", F.lit(False).alias("listed"))
        found = settled(rows.filter(F.col("m1") | F.col("m2")), known).unionByName(passed)
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    own = [F.col(f"row.c.c{k}").alias(c) for k, c in enumerate(kept)]
    return found.select(*own, "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "listed")


def junk_urls(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url) of pages whose HTML has words with a run of symbols stuck to them: what the query lists, besides SITES.

    The list holds canonical URLs, so it also stops other addresses of the same pages.
    """
    return pages.filter(F.col(html).rlike(JUNK)).select(url)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages", "page_id", "url", "html")
    listed = junk_urls(pages).unionByName(spark.createDataFrame([(f"http://{site}/",) for site in SITES], "url string"))
    return judge(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
         , html FROM pages),
k AS (SELECT *, regexp_replace(host, '^(?:www\.|m\.|blog\.)+', '') || regexp_replace(path, '(?:\.html)?/*$', '') AS key FROM p),
junk AS (SELECT DISTINCT key FROM k WHERE regexp_matches(html, '[A-Za-z.,](?:###|\*\*\*|\$\$\$|%%%|&amp;&amp;&amp;)[ \n<]')),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM k)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host, '^(www\.|m\.|blog\.)*(spam-farm|cheap-pills|casino-win|free-bets|ads-track|adult-x)\.example\.(com|net|org)$') THEN 'block'
       WHEN key <> '' AND key IN (SELECT key FROM junk) THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""
