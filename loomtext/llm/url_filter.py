"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter is a table of blocks of 512 bits (eight 64-bit words); a URL sets
one bit in each word of one block. Its size is known from the number of listed
URLs before it is built: within ``broadcast_bytes`` it is sent to every
executor, beyond that it is joined by block. Only URLs whose eight bits are set
go on to the exact join with the list, which removes the false positives: other
rows have no key to join by. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, BLOCK_BITS = 8, 512


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without ``.html`` and closing slashes; scheme, query and fragment go. Empty without ``://``."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"/+$", ""), r"\.html?$", "")
    return F.concat(host, path)


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n).cast("long"))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, n_listed: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """The filter as a table (block, w0..w7), and its number of blocks."""
    n = max(1, -(-n_listed * bits_per_key // BLOCK_BITS))
    words = _bits(listed[key])
    keyed = listed.select(_block(listed[key], n).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n


def listed_urls(
    pages: DataFrame, listed: DataFrame, url: str = "url", key: str = "canon",
    bits_per_key: int = 16, broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Every row of ``pages`` with ``listed`` boolean: is its canonical URL in ``listed[key]``?

    ``listed`` may repeat keys; null and empty keys are never listed. Rows keep
    all their columns (an input column ``listed`` is replaced); repeated rows
    stay. Null URLs and URLs without ``://`` are not listed. An empty list
    lists nothing. The Bloom filter alone never decides: a hit goes on to the
    exact join.
    """
    names = [c for c in pages.columns if c != "listed"]
    row = F.struct(*[pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    marked = _listed(pages.select(row.alias("row"), pages[f"`{url}`"].alias("url")), listed.select(F.col(key).alias("key")), bits_per_key, broadcast_bytes)
    return marked.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "listed")


def probe(pages: DataFrame, keys: DataFrame, n_keys: int, bits_per_key: int, broadcast_bytes: int) -> DataFrame:
    """``pages`` (with ``url``) with ``canon`` and ``hit``: does the Bloom filter of ``keys`` know the canonical URL? Listed ones it always knows."""
    blocks, n = bloom_blocks(keys, "key", n_keys, bits_per_key)
    canon = canonical(F.col("url"))
    probed = pages.withColumn("canon", canon)
    if n * (WORDS + 1) * 8 <= broadcast_bytes:
        blocks, at = F.broadcast(blocks), _block(F.col("canon"), n)
    else:  # rows without a URL belong to no block; they are spread over numbers that no block has
        probed = probed.withColumn("other", -1 - F.pmod(F.monotonically_increasing_id(), F.lit(n).cast("long")))
        at = F.when(F.col("canon") != "", _block(F.col("canon"), n)).otherwise(F.col("other"))
    joined = probed.withColumn("at", at).join(blocks, F.col("at") == F.col("block"), "left")
    hit = F.col("canon") != ""
    for i, bit in enumerate(_bits(F.col("canon"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    return joined.select(*pages.columns, "canon", F.coalesce(hit, F.lit(False)).alias("hit"))


def _listed(pages: DataFrame, listed: DataFrame, bits_per_key: int = 16, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``row, url, listed`` from pages (row, url) and the list (key).

    A list within ``broadcast_bytes`` goes to every executor as well, and pages
    are read once and not shuffled. A longer one is joined by key with the hits
    alone, for which the pages are read a second time.
    """
    keys = materialise(listed.where(F.col("key") != "").distinct(), "listed")
    size = keys.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + 32).alias("bytes")).first()
    marked = probe(pages.select("row", "url"), keys, size["n"], bits_per_key, broadcast_bytes)
    if (size["bytes"] or 0) <= broadcast_bytes:
        asked = marked.withColumn("asked", F.when(F.col("hit"), F.col("canon")))
        found = asked.join(F.broadcast(keys), F.col("asked") == F.col("key"), "left")
        return found.select("row", "url", F.col("key").isNotNull().alias("listed"))
    sure = marked.where(~F.col("hit")).select("row", "url", F.lit(False).alias("listed"))
    maybe = marked.where("hit").join(keys, F.col("canon") == F.col("key"), "left")
    return sure.unionByName(maybe.select("row", "url", F.col("key").isNotNull().alias("listed")))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` that fits: its host or a subdomain of it, and a path that starts with the rule's.

    A rule is (text, verdict) where text is host and path together, as
    ``com/en/``. Null if none fits. Rules of equal length: the first in text order.
    """
    found = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "canon", **how) -> DataFrame:
    """Every row with host, path, rule and verdict: the longest rule's, else ``block`` for listed URLs and ``allow`` for others."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    row = F.struct(*[pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)])
    marked = _listed(pages.select(row.alias("row"), pages[f"`{url}`"].alias("url")), listed.select(F.col(key).alias("key")), **how)
    parts = marked.select("row", "listed", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = parts.select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("rule"))
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for text, says in rules:
        verdict = F.when(F.col("rule") == text, says).otherwise(verdict)
    return ruled.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "host", "path", "rule", verdict.alias("verdict"), "listed")
