"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Only DataFrame functions.  The filter is a table of 512-bit blocks, each eight 64-bit words; a URL
sets one bit in every word of one block.  The table has at most ``MOST_BLOCKS`` rows whatever the
list's length, so it can be broadcast; a longer list only lets more URLs through to the exact hash
join, which removes every false positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import ready
from wayfold.session import materialize

MOST_BLOCKS = 1 << 16
BITS_PER_URL, WORDS = 16, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(url: str) -> dict[str, Column]:
    """Host, path and query of a URL; empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    return {"host": F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)}


def _canonical() -> Column:
    """Host without ``www.``, path without closing slashes, query without ``utm_`` parameters; null without a host."""
    q = F.regexp_replace(F.regexp_replace("query", "(^|&)utm_[^&]*", ""), "^&", "")
    whole = F.concat(F.regexp_replace("host", r"^www\.", ""), F.rtrim("path", F.lit("/")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(F.col("host") != "", whole)


def canonical_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct canonical URLs of ``url_col`` as ``canonical``; unparsable ones are left out."""
    d = df.select(F.col(url_col).cast("string").alias("u"))
    return d.select(*[c.alias(k) for k, c in _parts("u").items()]).select(_canonical().alias("canonical")).filter("canonical IS NOT NULL").distinct()


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """Block number and one bit for each of its words."""
    d = df.withColumn("_h", F.xxhash64("canonical", F.lit("bits"))).withColumn("block", F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
    bits = [F.expr(f"shiftleft(1L, cast(shiftright(_h, {6 * i}) & 63 AS int))").alias(f"m{i}") for i in range(WORDS)]
    return d.select("*", *bits).withColumn("block", F.when(F.col("canonical").isNotNull(), F.col("block"))).drop("_h")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    return _hashed(listed, blocks).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]).withColumnRenamed("block", "at")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row.

    ``rules`` are (verdict, host, path); a rule fits its host and all subdomains where the path
    starts with the rule's, and the longest wins.  Other URLs are blocked if their canonical form
    is in ``listed`` (column ``canonical``), else allowed.  Null URLs and those without ``://``
    have an empty host and path, fit no rule and are allowed.  Repeated rows are judged alike.
    """
    ready(pages.sparkSession)
    listed = materialize(listed.select("canonical").filter("canonical IS NOT NULL").distinct())
    blocks = min(MOST_BLOCKS, max(1, listed.count() * BITS_PER_URL // (64 * WORDS)))
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u"))
    p = p.select("id", *[c.alias(k) for k, c in _parts("u").items()])
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, says = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(says)
    p = p.select("id", "host", "path", rule.alias("rule"), says.alias("says"), _canonical().alias("canonical"))
    p = p.withColumn("canonical", F.when(F.col("rule").isNull(), F.col("canonical")))
    f = F.broadcast(bloom_filter(listed, blocks))  # at most MOST_BLOCKS rows of 72 bytes
    cond = F.col("block") == F.col("at")
    for i in range(WORDS):
        cond = cond & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    seen = _hashed(p, blocks).join(f, cond, "left").select("id", "host", "path", "rule", "says", "canonical", F.col("at").isNotNull().alias("possible"))
    out = ["id", "host", "path", "rule", "says"]
    no = seen.filter("NOT possible").select(*out, F.lit(False).alias("listed"))
    exact = listed.select(F.col("canonical").alias("c")).hint("shuffle_hash")
    yes = seen.filter("possible").join(exact, F.col("canonical") == F.col("c"), "left").select(*out, F.col("c").isNotNull().alias("listed"))
    r = no.unionByName(yes)
    return r.select("id", "host", "path", "rule", F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
