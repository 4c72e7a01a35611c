"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

Everything is DataFrame expressions.  A page's URL gives its host and path; candidates of rules are looked
up in a map literal, since rules are a short list given by the user.  Where no rule fits, the page is
blocked if its canonical URL is on the list.

The list may be as large as the corpus, so it is not sent to the executors.  Its blocked Bloom filter is: words of
64 bits, one for each ``KEYS_PER_BLOCK`` rows of the list and ``BLOCKS`` at most, built with one aggregation (``bit_or`` of the keys' masks by
block), so its size is bounded whatever the list's, and it can be broadcast.  Only pages that the
filter lets pass go into the shuffle of the exact hash join, which removes false positives; a list too
long for the filter costs more false positives, never a wrong verdict.

Null URLs and URLs without ``://``: empty host and path, no rule, canonical URL null, so allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protomill.llm.common import numbered

#: Words of 64 bits in a filter at most: 8 MB of bits, about six million keys at ten bits a key.
BLOCKS = 1 << 20
#: Rows of the list for each word: ten bits or more a key.
KEYS_PER_BLOCK = 6
#: Bits that a key sets in its word.
KEY_BITS = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and path without ``.html`` or a slash at its end; null without a host."""
    short = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(short, F.regexp_replace(path, r"(\.html|/)$", "")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none does.

    ``rules`` are (verdict, host, path).  A rule fits its host and all subdomains if the path starts with
    the rule's; the longest (host and path together, then as text) wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for what, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def blocks_for(rows: int) -> int:
    """Words of a filter for a list of so many rows."""
    return max(1, min(BLOCKS, -(-rows // KEYS_PER_BLOCK)))


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for i in range(KEY_BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.shiftrightunsigned(h, 6 * KEY_BITS), F.lit(blocks)).cast("int"), mask


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a list as rows (block, bits), ``blocks`` at most."""
    block, mask = _block_and_mask(F.col(key), blocks)
    return (
        listed.where(F.col(key).isNotNull())
        .select(block.alias("__block"), mask.alias("__mask"))
        .groupBy("__block")
        .agg(F.bit_or("__mask").alias("__bits"))
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url_col: str = "url", key: str = "canonical") -> DataFrame:
    """``pages`` with host, path, canonical, rule and verdict.

    ``listed`` has the canonical URLs to block in column ``key`` (repeats and nulls do no harm).  Columns
    of ``pages`` with the new names are replaced.
    """
    plain, names = numbered(pages, [])
    url = F.col(names[pages.columns.index(url_col)])
    out = plain.withColumns({"__host": host_of(url), "__path": path_of(url)})
    rule, verdict = rule_for(F.col("__host"), F.col("__path"), rules)
    out = out.withColumns({"__canonical": canonical_url(F.col("__host"), F.col("__path")), "__rule": rule, "__by_rule": verdict})
    blocks = blocks_for(listed.count())
    block, mask = _block_and_mask(F.col("__canonical"), blocks)
    out = out.withColumns({"__block": block, "__mask": mask})
    bits = F.broadcast(bloom_filter(listed, key, blocks))  # BLOCKS rows at most
    out = out.join(bits, "__block", "left")
    possible = F.col("__by_rule").isNull() & F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    # a page that cannot be listed gets a null key, so the join neither shuffles it by its url nor matches it
    out = out.withColumn("__probe", F.when(possible, F.col("__canonical")))
    exact = listed.where(F.col(key).isNotNull()).select(F.col(key).alias("__probe")).distinct()
    hits = out.where(F.col("__probe").isNotNull()).join(exact.withColumn("__listed", F.lit(True)).hint("shuffle_hash"), "__probe", "left")
    rest = out.where(F.col("__probe").isNull()).withColumn("__listed", F.lit(None).cast("boolean"))
    whole = hits.unionByName(rest)
    method = F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))
    kept = [(n, c) for n, c in zip(names, pages.columns, strict=True) if c not in ("host", "path", "canonical", "rule", "verdict")]
    return whole.select(
        *[F.col(n).alias(c) for n, c in kept],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__canonical").alias("canonical"),
        F.col("__rule").alias("rule"),
        F.coalesce("__by_rule", method).alias("verdict"),
    )
