"""URL filter: blocked Bloom filter of listed keys, then an exact hash join.

Listed entries are canonical URLs or (host, path prefix) rules.  Every page probes its canonical URL
and, for the rules, each (host suffix, path prefix) pair whose prefix length occurs in the rule list.
A 256-bit block of the filter is picked by one hash and eight bits in it by another; a probe that finds
all its bits set is a possible hit and goes to the exact join, which removes false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.session import cut_lineage

WORDS = 8
BITS_PER_KEY = 14
#: A filter above this many blocks (64 bytes each as rows) is joined by block number instead of broadcast.
BROADCAST_BLOCKS = 100_000
#: Rules above this many are joined by shuffle instead of broadcast.
BROADCAST_RULES = 20_000

#: Rules of the contract as (verdict, host, path prefix).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Host labels whose pages make up the list of unwanted URLs.
UNWANTED_LABELS = ["casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"]


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without www., m. or blog.; path without a last slash or .html; sorted query without tracking; no fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m|blog)\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    asked = F.array_join(kept, "&")
    return F.coalesce(F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit(""))), F.lit(""))


def _place(key: Column, blocks: int) -> dict[str, Column]:
    h = F.xxhash64(key)
    bits = F.xxhash64(key, F.lit("bits"))
    word = lambda j: F.call_function("shiftleft", F.lit(1), F.shiftright(bits, 5 * j).bitwiseAND(F.lit(31)).cast("int"))
    return {"__block": F.pmod(h, F.lit(blocks))} | {f"__b{j}": word(j) for j in range(WORDS)}


def build_filter(keys: DataFrame, key: str, most: int | None = None) -> tuple[DataFrame, int]:
    """Blocks of the filter over distinct ``keys``: __block and eight 32-bit words; and their number, at most ``most``.

    A filter that would need more blocks passes more false hits, but never loses a key.
    """
    listed = max(1, keys.agg(F.count_distinct(key)).first()[0])
    blocks = max(1, math.ceil(listed * BITS_PER_KEY / (32 * WORDS)))
    blocks = blocks if most is None else min(blocks, most)
    placed = keys.where(F.col(key).isNotNull()).select(*[c.alias(n) for n, c in _place(F.col(key), blocks).items()])
    return placed.groupBy("__block").agg(*[F.bit_or(f"__b{j}").alias(f"__w{j}") for j in range(WORDS)]), blocks


def possible_hits(probes: DataFrame, key: str, blocks_df: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``probes`` whose key the filter may hold; no listed key is lost."""
    side = F.broadcast(blocks_df) if blocks <= BROADCAST_BLOCKS else blocks_df
    found = probes.withColumns(_place(F.col(key), blocks)).join(side, "__block")
    for j in range(WORDS):
        found = found.where(F.col(f"__w{j}").bitwiseAND(F.col(f"__b{j}")) == F.col(f"__b{j}"))
    return found.select(*probes.columns)


def match_listed(probes: DataFrame, key: str, listed: DataFrame, listed_rows: int | None = None) -> DataFrame:
    """Rows of ``probes`` joined exactly with ``listed`` on ``key``, after the filter."""
    blocks_df, blocks = build_filter(listed.select(key), key)
    passed = possible_hits(probes, key, cut_lineage(blocks_df), blocks)
    small = listed_rows is not None and listed_rows <= BROADCAST_RULES
    return passed.join(F.broadcast(listed) if small else listed, key)


def unwanted_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """The list that pages themselves give: canonical URLs on hosts with an unwanted label."""
    labels = F.split(host_of(F.col(url)), r"\.")
    bad = F.arrays_overlap(labels, F.array(*[F.lit(x) for x in UNWANTED_LABELS]))
    return pages.where(bad).select(canonical_url(F.col(url)).alias("canonical")).distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    The longest fitting rule (host, then path) decides; without one a listed canonical URL is blocked and
    any other allowed.  A null URL or one without ``://`` has empty host and path, fits no rule, and is
    allowed unless the list holds the empty URL.  Rows with equal ids and URLs are judged alike and all kept.
    Other columns are dropped.
    """
    spark = pages.sparkSession
    asked = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"))
    asked = asked.withColumns({"host": host_of(F.col("__url")), "path": path_of(F.col("__url")), "canonical": canonical_url(F.col("__url"))}).drop("__url")

    # Rules: verdicts depend on host and path only, so each distinct pair is probed once.
    rows = [(verdict, h, p, f"{h}{p}") for verdict, h, p in rules]
    rule_rows = spark.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string, rule string")
    keyed = rule_rows.select(F.concat_ws("\u0001", "rule_host", "rule_path").alias("key"), "rule", "rule_verdict", F.length("rule").alias("__len"))
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, _, p in rules}) or [0]])
    pairs = asked.where(F.col("host") != "").select("host", "path").distinct()
    parts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    probes = pairs.withColumn("__s", F.explode(suffixes)).withColumn("__p", F.explode(prefixes))
    probes = probes.select("host", "path", F.concat_ws("\u0001", "__s", "__p").alias("key"))
    ruled = match_listed(probes, "key", keyed, len(rows))
    best = ruled.groupBy("host", "path").agg(F.max(F.struct("__len", "rule", "rule_verdict")).alias("__best"))

    # List: distinct canonical URLs probe the filter of listed ones.
    urls = asked.select("canonical").distinct()
    hit = match_listed(urls, "canonical", listed.select("canonical").distinct()).withColumn("__hit", F.lit(True))

    judged = asked.join(best, ["host", "path"], "left").join(hit, "canonical", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.rule_verdict", F.when(F.col("__hit"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("__hit", F.lit(False)).alias("listed"),
    )
