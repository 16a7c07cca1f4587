"""Mixing sources to target weights by hash thresholds.

Every document gets a 60-bit hash of its id. A source's documents are taken whole as often as its target holds all of them;
what is left of the target is filled with the documents whose hash lies below a threshold. Thresholds come from nested
histograms: tokens are summed by source and the top 10 bits of the hash, the bucket in which the running sum passes the
budget is found, and only that boundary bucket is summed by the next 10 bits, until it holds one hash. Nothing is sorted
but the at most 1024 buckets of a source, and smaller budgets give smaller thresholds, so mixes nest.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all sizes by weight;
a target stops at ``cap`` times its source's size and the excess is shared again by weight until none is above.

Defined cases: a null text has size 0; documents whose hash is equal (repeated ids, null ids) are taken together, and a
boundary hash is taken if that brings the source nearer to its target; empty tables and sources of size 0 take nothing;
the columns made here replace columns of the same names. The number of sources is that of a mixture's parts: their totals
are ranked in one window. All work is done by DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.llm.common import WORD, boxed, materialize, unboxed, without

WEIGHTS = (5, 2, 1)
BITS, LEVELS = 10, 6
MADE = ("size", "source_size", "target", "taken")


def hash_of(doc_id: Column) -> Column:
    """60 bits that other SQL engines can compute as well."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    With sources ordered by size for their weight, the first k are capped and the others get the same amount for a unit
    of weight; k is the least number for which none of the others is above its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    by_need = Window.orderBy("need", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("need", F.col("source_size").cast("double") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("source_size").over(by_need), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_need), F.lit(0)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("unit", (F.lit(share) * F.col("all") - F.lit(cap) * F.col("before")) / F.col("weight_left"))
        .withColumn("open_unit", F.min(F.when(F.lit(cap) * F.col("need") > F.col("unit"), F.struct("need", "rank", "unit"))).over(everything)["unit"])
    )
    limit = F.lit(cap) * F.col("source_size")
    return filled.select("source", "source_size", F.least(F.coalesce(F.col("open_unit") * F.col("weight"), limit), limit).alias("target"))


def _boundary(rows: DataFrame, level: int) -> DataFrame:
    """For each source of rows (source, hash, size, need: what is still to fill) the bucket of this level in which the running
    sum passes the need: source, prefix, need (what is left for the bucket), hashes (distinct ones in it, about), tokens."""
    bucket = F.shiftright("hash", BITS * (LEVELS - 1 - level))
    cells = rows.groupBy("source", bucket.alias("prefix")).agg(
        F.sum("size").alias("tokens"), F.first("need").alias("need"), F.min("hash").alias("low"), F.max("hash").alias("high")
    )
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("prefix"))
    cells = cells.withColumn("left", F.col("need") - (upto - F.col("tokens")))
    return cells.filter((F.col("left") >= 0) & (F.col("left") < F.col("tokens"))).select(
        "source", "prefix", F.col("left").alias("need"), "tokens", "low", (F.col("low") != F.col("high")).alias("open")
    )


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, times (how often all documents are taken), threshold (those with a lower hash are taken
    once more). sized: source, size, hash."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    times = F.floor(F.col("target") / size)
    plan = materialize(
        targets.withColumn("times", times).withColumn("need", F.col("target") - times * F.col("source_size")), "targets"
    )
    same = lambda other: F.col("source").eqNullSafe(other["_source"])
    state, done = None, []
    for level in range(LEVELS):
        if level == 0:
            need = plan.select(F.col("source").alias("_source"), "need")
            rows = sized.join(need, same(need)).select("source", "hash", "size", "need")
        else:
            need = state.filter("open").select(F.col("source").alias("_source"), F.col("prefix").alias("_prefix"), "need")
            inside = F.shiftright(sized["hash"], BITS * (LEVELS - level)) == F.col("_prefix")
            rows = sized.join(need, same(need) & inside).select("source", "hash", "size", "need")
        state = materialize(_boundary(rows, level), "boundary")
        done.append(state.filter("not open"))
        if level + 1 < LEVELS and state.filter("open").isEmpty():
            break
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    at = last.select(F.col("source").alias("_source"), F.when(2 * F.col("need") >= F.col("tokens"), F.col("low") + 1).otherwise(F.col("low")).alias("threshold"))
    return plan.join(at, same(at), "left").select("source", "source_size", "target", "times", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def _sized(docs: DataFrame, text: str, doc_id: str, source: str, rest: list[str]) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(source).alias("_source_of"), size.alias("_size"), hash_of(F.col(doc_id)).alias("_hash"), *boxed(rest))


def _taken(docs: DataFrame, sized: DataFrame, share: float, cap: float) -> DataFrame:
    """docs joined with their source's thresholds, with _times: how often each is taken."""
    plan = materialize(thresholds(sized, source_targets(sized, share, cap)), "mix").withColumnsRenamed(
        {"source": "_s", "source_size": "_total", "target": "_target", "times": "_whole", "threshold": "_below"}
    )
    times = F.col("_whole") + F.when(F.col("_hash") < F.col("_below"), 1).otherwise(0)
    return docs.join(plan, F.col("_source_of").eqNullSafe(F.col("_s")), "left").withColumn("_times", times)


def mix_sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs without the text, with size, source_size, target and taken (words that the mix takes)."""
    rest = without(docs.columns, [*MADE, text])
    sized = materialize(_sized(docs, text, doc_id, source, rest), "sizes")
    cells = sized.select(F.col("_source_of").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash"))
    mixed = _taken(sized, cells, share, cap)
    return mixed.select(*unboxed(rest), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_times") * F.col("_size")).cast("long").alias("taken"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents of the mix, with their own columns; one that is taken twice comes twice."""
    sized = _sized(docs, text, doc_id, source, [])
    cells = materialize(sized.select(F.col("_source_of").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash")), "sizes")
    narrow = docs.select(*boxed(docs.columns), F.col(source).alias("_source_of"), hash_of(F.col(doc_id)).alias("_hash"))
    mixed = _taken(narrow, cells, share, cap).filter("_times > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))
    return mixed.select("_box", copies.alias("_copy")).select(*unboxed(docs.columns))
