"""URL rules and lists behind a blocked Bloom filter and an exact hash join.

A listed entry is a canonical URL prefix ``host/path``; it fits its host, all
subdomains, and paths that start with its path.  A URL therefore has one
candidate key per listed path length and host suffix, of as many labels as a
listed host has at most.  Each key probes the
filter - one block of 256 bits - and only possible hits go on to an exact hash
join with the listed entries, which removes false positives.

Work is done once per distinct (host, path); the filter and the hits are
broadcast only if their stored size is small, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hints import broadcast_if_small
from ..session import materialize

BITS_PER_ENTRY = 16
PROBES = 4
LANES = [f"_w{i}" for i in range(4)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    return [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(PROBES)]


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """(``_block``, four longs) over ``entries.key``."""
    bits = entries.select(_block(F.col("key"), blocks).alias("_block"), F.explode(F.array(*_bits(F.col("key")))).alias("_bit"))
    lane = [F.bit_or(F.when(F.shiftright("_bit", 6) == i, F.expr("shiftleft(1L, _bit & 63)")).otherwise(F.lit(0))).alias(w)
            for i, w in enumerate(LANES)]
    return bits.groupBy("_block").agg(*lane)


def possible_hits(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of ``keys`` (column key) that the filter over ``entries`` lets through."""
    blocks = max(1, entries.count() * BITS_PER_ENTRY // 256)
    bloom = materialize(bloom_filter(entries, blocks), "url_filter")
    x = keys.withColumn("_block", _block(F.col("key"), blocks)).join(broadcast_if_small(bloom), "_block")
    for b in _bits(F.col("key")):
        x = x.filter(F.call_function("bit_get", F.get(F.array(*LANES), F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1)
    return x.drop("_block", *LANES)


def candidate_keys(urls: DataFrame, lengths: list[int], labels: int) -> DataFrame:
    """``urls`` (host, path) with one row per key it may be listed under: host
    suffixes of up to ``labels`` labels, the most a listed host has."""
    # Counted from the end; a host of fewer labels gives its whole self more than once.
    parts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, labels + 1)]))
    path = F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(parts, lambda h: F.transform(sizes, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))
    return urls.select("host", "path", F.explode(keys).alias("key"))


def judge(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed): one row per row of ``pages``.

    ``entries`` has key (canonical prefix with a path), verdict, and is_rule.
    The longest fitting rule decides; without one a URL is blocked if a list
    entry that is no rule fits it, else allowed.  Rules take the path as it
    is; list entries read an empty path as ``/``.  Null urls and urls without
    ``://`` have an empty host and path, fit nothing and are allowed.
    Repeated entries count once (allow before block); repeated rows repeat
    their result; an empty table gives no rows; other columns are ignored.
    """
    url = F.col(f"`{url_col}`").cast("string")
    pages = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    entries = entries.groupBy("key", "is_rule").agg(F.min("verdict").alias("_verdict"))
    entries = materialize(entries, "listed")
    sizes = entries.select(F.length("key") - F.instr("key", "/") + 1)
    lengths = sorted(r[0] for r in sizes.distinct().collect())  # at most the longest listed path
    labels = entries.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\.")))).first()[0] or 0  # a number
    urls = materialize(pages.filter("host <> ''").select("host", "path").distinct(), "urls")
    hits = possible_hits(candidate_keys(urls, lengths, labels), entries.select("key").distinct())
    exact = hits.join(broadcast_if_small(entries), "key").filter("NOT is_rule OR path <> ''")
    longest = F.struct(F.length("key"), F.instr("key", "/"), "key")
    best = exact.groupBy("host", "path").agg(
        F.max_by(F.when(F.col("is_rule"), F.struct("key", "_verdict")), F.when(F.col("is_rule"), longest)).alias("r"),
        F.bool_or(~F.col("is_rule")).alias("on_list"))
    best = materialize(best, "url_verdicts")
    x = pages.join(broadcast_if_small(best), ["host", "path"], "left")
    listed = F.coalesce("on_list", F.lit(False))
    return x.select(F.col("_id").alias(id_col), "host", "path", F.col("r.key").alias("rule"),
                    F.coalesce("r._verdict", F.when(listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    listed.alias("listed"))
