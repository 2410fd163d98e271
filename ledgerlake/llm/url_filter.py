"""Filtering URLs by rules on host and path, and by a list of unwanted URLs.

Listed URLs and those of pages are compared in a canonical form. A blocked Bloom filter of the list is
given to all tasks: each listed URL sets eight bits of one 512-bit block, so a look-up touches one
block. Tasks combine the bits of their part of the list, and it has at most 2^16 blocks (4 MB)
however long the list is: beyond some million URLs it just lets more pages pass. What it passes is
joined with the list exactly, by the whole canonical URL, so no false hit is left; what it holds back
is listed for certain nowhere.

A URL that very many pages share is no hot key of that join: passing URLs are counted, joined with
the list as distinct ones, and those that hold more than a thousandth of the passing rows, at most
a thousand of them, go back to the pages by broadcast; no other key is large.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import stored

BLOCK, ALLOW = "block", "allow"
#: Bits of a block, bits that a URL sets in it, and bits in the filter for each listed URL.
BLOCK_BITS = 512
HITS = 8
BITS_PER_URL = 16
WORDS = BLOCK_BITS // 64
#: The filter has at most so many blocks: 4 MB.
MOST_BLOCKS = 1 << 16
#: A confirmed URL with more than one in so many passing rows is sent to all tasks.
HOT = 1000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        below = host.endswith("." + self.host)
        return ((host == self.host) | below) & path.startswith(self.path)


RULES = (
    Rule(BLOCK, "net", "/"),
    Rule(ALLOW, "example.net", "/en/"),
    Rule(BLOCK, "example.com", "/de/"),
    Rule(ALLOW, "org", "/fr/"),
)

# Parts of host names that tell what the listed sites are for.
TELLING = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z in lower case; else empty."""
    after = _after_scheme(url)
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; empty if there is no host part."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(rest, F.lit(""))


def canonical(url: Column) -> Column:
    """One form for all spellings of an address; NULL for what has no host.

    The scheme, "www.", a port of 80 or 443 and the fragment do not count, nor do "/", ".html" or
    "/index.html" at the end of the path, nor parameters that only tell where a visitor came from
    (utm_*, ref); the other parameters are ordered.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?\.html?$|/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref)(=|$)"))
    )
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, asked))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as (text, verdict); of equally long ones the first by text."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    told = [
        F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")))
        for r in ordered
    ]
    return F.coalesce(*told, F.lit(None).cast("struct<text:string,verdict:string>"))


# --- the filter ---------------------------------------------------------------------------------


def blocks_for(urls: int) -> int:
    """A power of two of blocks with BITS_PER_URL bits for each URL, or MOST_BLOCKS."""
    wanted = max(1, -(-urls * BITS_PER_URL // BLOCK_BITS))
    return min(MOST_BLOCKS, 1 << (wanted - 1).bit_length())


def bloom_filter(listed: DataFrame) -> np.ndarray:
    """The filter over the 64-bit `hash` of each listed URL, as 64-bit words, block by block.

    Each hash sets HITS bits of its block, from a start by steps of an odd width. Tasks combine the
    bits of their own rows to words before these are shuffled; the driver gets the words of the filter,
    512 thousand at most.
    """
    blocks = blocks_for(listed.count())
    words = (
        listed.select(
            F.col("hash").bitwiseAND(F.lit(blocks - 1)).alias("block"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.lit(HITS - 1)),
                    lambda k: F.shiftrightunsigned("hash", 17).bitwiseAND(F.lit(BLOCK_BITS - 1))
                    + k * F.shiftrightunsigned("hash", 33).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(BLOCK_BITS - 1)),
                )
            ).alias("bit"),
        )
        .groupBy(F.expr(f"block * {WORDS} + (bit % {BLOCK_BITS}) div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))
        .toPandas()
    )
    told = np.zeros(blocks * WORDS, np.uint64)
    told[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return told


def may_hold(told: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set; never false for a listed one."""
    u = np.uint64
    hashes = hashes.view(u)
    first = (hashes & u(len(told) // WORDS - 1)) * u(WORDS)
    start = (hashes >> u(17)) & u(BLOCK_BITS - 1)
    step = ((hashes >> u(33)) | u(1)) & u(BLOCK_BITS - 1)
    held = np.ones(len(hashes), bool)
    for k in range(HITS):
        bit = (start + step * u(k)) % u(BLOCK_BITS)
        held &= (told[(first + bit // u(64)).astype(np.int64)] >> (bit % u(64))) & u(1) == 1
    return held


def _passing(rows: DataFrame, told: np.ndarray) -> DataFrame:
    """Replaces `hash` by `maybe`: whether the filter passes it. A NULL hash is held back."""

    def probe(batches):
        for batch in batches:
            hashes = batch["hash"]
            held = may_hold(told, np.asarray(hashes.fill_null(0), np.int64))
            held &= np.asarray(hashes.is_valid())
            at = batch.schema.get_field_index("hash")
            yield batch.remove_column(at).append_column("maybe", pa.array(held))

    kept = rows.drop("hash")
    schema = kept.withColumn("maybe", F.lit(False)).schema
    return rows.select(*kept.columns, "hash").mapInArrow(probe, schema)


def _confirmed(passing: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds `listed` to rows that the filter passed: whether the list really holds their URL."""
    counted = passing.groupBy("address").agg(F.count(F.lit(1)).alias("rows"))
    real = stored(counted.join(listed.select("address"), "address", "left_semi"), "op13-confirmed")
    total = passing.count()
    hot = real.where(F.col("rows") * HOT > total).select("address", F.lit(True).alias("hot"))
    rest = real.where(F.col("rows") * HOT <= total).select("address", F.lit(True).alias("found"))
    # at most HOT addresses can each hold more than one in HOT rows
    marked = passing.join(F.broadcast(hot), "address", "left")
    others = marked.where("hot IS NULL").join(rest, "address", "left")
    return (
        marked.where("hot")
        .drop("hot")
        .withColumn("listed", F.lit(True))
        .unionByName(others.withColumn("listed", F.col("found").isNotNull()).drop("hot", "found"))
    )


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, address, rule, listed, verdict of every row of (page_id, url).

    `listed` has unwanted URLs in a column url, in any spelling, in any number, also repeated.
    `address` is the canonical form. The verdict is that of the longest rule that fits, else block
    for a listed URL and allow for others. A URL that is NULL or has no "://" has an empty host and
    path, no address, fits no rule and is never listed; one with an empty host has no address either.
    Repeated rows are judged each. Empty tables are no special case: an empty list lists nothing.
    Other columns, whatever their names, are ignored. `rules` are part of the plan, so they are meant
    to be few; the list may be as large as the pages.
    """
    unwanted = stored(
        listed.select(canonical(F.col("url")).alias("address"))
        .where("address IS NOT NULL")
        .distinct()
        .withColumn("hash", F.xxhash64("address")),
        "op13-listed",
    )
    told = bloom_filter(unwanted)
    url = F.col("url").cast("string")
    rows = pages.select(
        F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("address")
    ).withColumn("hash", F.when(F.col("address").isNotNull(), F.xxhash64("address")))
    probed = stored(_passing(rows, told), "op13-probed")
    checked = _confirmed(probed.where("maybe"), unwanted).unionByName(
        probed.where("NOT maybe").withColumn("listed", F.lit(False))
    )
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return checked.withColumn("_rule", rule).select(
        "page_id",
        "host",
        "path",
        "address",
        F.col("_rule.text").alias("rule"),
        "listed",
        F.coalesce("_rule.verdict", F.when(F.col("listed"), BLOCK).otherwise(ALLOW)).alias("verdict"),
    )


def unwanted_pages(pages: DataFrame, telling: Sequence[str] = TELLING) -> DataFrame:
    """URLs of pages on sites whose host name has one of the words, between dots and hyphens."""
    parts = F.split(host_of(F.col("url").cast("string")), r"[.-]")
    return pages.where(F.arrays_overlap(parts, F.array(*(F.lit(t) for t in telling)))).select("url")
