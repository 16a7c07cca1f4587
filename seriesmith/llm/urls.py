"""URL filters: a blocked Bloom filter passes possible hits on to an exact hash join.

A list holds canonical URLs: a host without scheme, port or user, lower-cased, then a path that ends in a slash. An entry
fits a URL if the host is its own or a subdomain of it and the URL's path starts with the entry's; that of an entry which is
no rule also fits the URL that it is without the last slash. For each URL all entries that could fit (each suffix of the
host with each prefix of the path that ends in a slash, no longer than the list's longest by labels and slashes) are tested
against the Bloom filter, once for equal URLs; only possible hits are joined with the list on the entry itself, which
removes false positives. The longest fitting rule gives the verdict; without a rule a URL is blocked if the blocklist has an
entry that fits, and else allowed.

The filter has blocks of 256 bits (four longs), one for every 16 entries; an entry sets one bit in each long of one block. Up
to BROADCAST_BLOCKS blocks (4 MiB) it is broadcast; that of a longer list is joined by block in a shuffle. Hits and verdicts
are joined likewise: broadcast where their files are below VERDICT_BYTES, else in a shuffle.

Defined cases: a null url, or one without ://, has an empty host and path, fits nothing and is allowed; repeated rows and
equal urls get equal answers; an empty list or table works; of two equal entries with different actions, block wins; a URL
of any length is cut once at its dots and slashes, and costs as many candidates as the list's longest entry has labels times
slashes; the columns made here replace columns of the same names. All work is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import boxed, join_small, lower_ascii, materialize, unboxed, without

MADE = ("host", "path", "rule", "verdict")
LANES = 4
ENTRIES_PER_BLOCK = 16
BROADCAST_BLOCKS = 1 << 17
VERDICT_BYTES = 4 << 20


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The entry of a URL; null without a host."""
    return F.when(host != "", F.concat(host, path, F.when(path.endswith("/"), "").otherwise("/")))


def candidates(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """All canonical entries of at most so many labels and slashes that could fit a URL."""
    names, parts = F.split(host, r"\."), F.split(F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/"))), "/")
    hosts = F.transform(
        F.sequence(F.greatest(F.size(names) - labels + 1, F.lit(1)), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), ".")
    )
    paths = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(slashes))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))
    )
    some = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(host != "", some).otherwise(F.array().cast("array<string>"))


def _block(entry: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(n_blocks)).cast("int")


def _bit(entry: Column, lane: int) -> Column:
    """The long with the one bit that the entry sets in a lane: six of 30 well mixed bits of a second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.hash(entry, F.lit(lane)), 7).bitwiseAND(F.lit(63)))


def bloom_filter(entries: DataFrame, n_blocks: int) -> DataFrame:
    """A row for each block that has an entry: block, w0 to w3; n_blocks rows at most."""
    lanes = entries.select(_block(F.col("entry"), n_blocks).alias("block"), *(_bit(F.col("entry"), k).alias(f"w{k}") for k in range(LANES)))
    return lanes.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LANES)))


def possible_hits(entries: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The rows whose column entry the filter can hold. A filter that is broadcast has BROADCAST_BLOCKS rows of 36 bytes at
    most."""
    hit = F.lit(True)
    for k in range(LANES):
        hit = hit & (F.col(f"w{k}").bitwiseAND(_bit(F.col("entry"), k)) != 0)
    blocks = F.broadcast(bloom) if n_blocks <= BROADCAST_BLOCKS else bloom.hint("merge")
    return entries.withColumn("block", _block(F.col("entry"), n_blocks)).join(blocks, "block").filter(hit).select(*entries.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict. listed: entry, action (allow or block), is_rule boolean."""
    listed = materialize(
        listed.groupBy("entry", "is_rule").agg(F.max(F.struct(F.col("action") == "block", F.col("action")))["action"].alias("action")), "listed"
    )
    slashes = F.length(F.regexp_replace("entry", "[^/]", ""))
    n, labels, depth = listed.agg(F.count(F.lit(1)), F.max(F.size(F.split(F.substring_index("entry", "/", 1), r"\."))), F.max(slashes)).first()
    n_blocks = max(1, -(-n // ENTRIES_PER_BLOCK))
    rest = without(pages.columns, MADE)
    where = pages.select(*boxed(rest), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    some = candidates(F.col("host"), F.col("path"), labels or 1, depth or 1)
    entries = where.select("host", "path").distinct().select("host", "path", F.explode(some).alias("entry"))
    hits = possible_hits(entries, bloom_filter(listed, n_blocks), n_blocks)
    best = F.max(F.when(F.col("is_rule"), F.struct(F.length("entry").alias("n"), F.col("entry"), F.col("action"))))
    blocked = F.max((F.col("action") == "block") & ~F.col("is_rule"))
    exact = join_small(hits, listed.withColumnRenamed("entry", "_entry"), F.col("entry") == F.col("_entry"), limit=VERDICT_BYTES)
    exact = exact.filter(~F.col("is_rule") | F.startswith(F.col("path"), F.substr("entry", F.instr("entry", "/"))))
    verdicts = exact.groupBy("host", "path").agg(best.alias("best"), blocked.alias("blocked"))
    verdicts = materialize(
        verdicts.select(
            F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("best.entry").alias("rule"),
            F.coalesce("best.action", F.when(F.col("blocked"), "block")).alias("verdict"),
        ),
        "verdicts",
    )
    judged = join_small(where, verdicts, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left", VERDICT_BYTES)
    return judged.select(*unboxed(rest), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
