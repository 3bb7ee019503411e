"""URLs judged by host and path rules, and by a list of canonical URLs behind a blocked Bloom filter.

A list entry sets eight bits in one block of 256 bits, so a lookup touches one block. The filter has as
many blocks as the list needs, up to ``MOST_BLOCKS``: only that bounded table is broadcast, and a longer
list only makes more false hits. Possible hits, and no others, go through an exact hash join with the list,
which removes the false ones.

Canonical: the host in lower case without ``www.``, the schemes' own ports and final dots; the path without
a final ``index.html`` and slashes; the parameters in order without those that only track; no fragment.

Defined results: a NULL URL, or one without ``://``, has an empty host and path, fits no rule and is on no
list; repeated rows are each judged; an empty table or list is no special case; columns that are not named
stay unread.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

#: Bits per entry; one in several thousand URLs that are not listed is then a possible hit.
BITS = 16
#: 32 MB of bits, whatever the list's length.
MOST_BLOCKS = 1 << 20
_WORDS = 8
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """NULL where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"(:80|:443)?$", ""), r"\.+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    asked = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    asked = F.array_join(F.array_sort(F.filter(asked, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    made = F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when(F.contains(url, F.lit("://")), made)


def _hashes(key: Column, blocks: int) -> list[Column]:
    """The block of a key and its bit in each of the block's eight words of 32 bits."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(blocks))
    return [block, *[F.pmod(F.hash(key, F.lit(i)), F.lit(32)).cast("int") for i in range(_WORDS)]]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter, a row per block that is not empty: block, w0 .. w7."""
    block, *bits = _hashes(F.col(key), blocks)
    rows = listed.select(block.alias("block"), *[F.expr("1L").alias("one")], *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(F.call_function("shiftleft", F.col("one"), F.col(f"b{i}"))).alias(f"w{i}") for i in range(_WORDS)])


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; the rules are a short, given list."""
    chosen = F.lit(None)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.text).alias("rule"))).otherwise(chosen)
    return chosen


def entries_of(listed: DataFrame, url: str = "url") -> DataFrame:
    """A list of URLs -> ``entry``, their canonical forms."""
    return listed.select(canonical(F.col(url)).alias("entry")).where("entry IS NOT NULL").distinct()


def judge(
    pages: DataFrame, entries: DataFrame, rules: tuple[UrlRule, ...], keep: list[str], url: str = "url", on_list: str = "block",
    off_list: str = "allow",
) -> DataFrame:
    """``keep``, host, path, rule, listed (boolean) and verdict for each row of ``pages``.

    ``entries`` has distinct canonical URLs in ``entry``, as ``entries_of`` makes them.
    """
    entries = settle(entries.select("entry"), "listed")
    blocks = max(1, min(MOST_BLOCKS, -(-entries.count() * BITS // (32 * _WORDS))))
    rows = pages.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(url).cast("string").alias("u"))
    rows = rows.select("*", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), canonical(F.col("u")).alias("key"))
    block, *bits = _hashes(F.col("key"), blocks)
    rows = rows.withColumn("b", block).withColumns({f"b{i}": b for i, b in enumerate(bits)})
    rows = rows.join(F.broadcast(bloom(entries, "entry", blocks)), F.col("b") == F.col("block"), "left")
    hit = F.lit(True)
    for i in range(_WORDS):
        hit = hit & (F.call_function("shiftright", F.col(f"w{i}"), F.col(f"b{i}")).bitwiseAND(F.lit(1)) == 1)
    rows = rows.select(*[f"_keep{i}" for i in range(len(keep))], "host", "path", "key", F.coalesce(hit & F.col("key").isNotNull(), F.lit(False)).alias("hit"))
    missed = rows.where(~F.col("hit")).withColumn("listed", F.lit(False)).drop("hit", "key")
    hits = rows.where("hit").join(entries.hint("shuffle_hash"), F.col("key") == F.col("entry"), "left")
    judged = missed.unionByName(hits.withColumn("listed", F.col("entry").isNotNull()).drop("hit", "key", "entry"))
    judged = judged.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    otherwise = F.when(F.col("listed"), on_list).otherwise(off_list)
    return judged.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("_fit")["rule"].alias("rule"), "listed",
        F.coalesce(F.col("_fit")["verdict"], otherwise).alias("verdict"))
