"""Line dedup by winnowing over line hashes.

A document is a sequence of lines with 128-bit hashes and numbers of words; lines without a word have no place in it. Its
windows are the shortest runs of lines with at least ``min_words`` words that start, or that end, at a line. From each
window the line with the smallest hash (the last of equal ones) is selected. Only these minima are kept, as fingerprints;
neighbouring windows mostly share theirs. Two documents that share a run of ``min_words`` words share a window in it, and
so its fingerprint at the same place of the run: no such run is missed.

1. Positions are joined by fingerprint; fingerprints that occur once are dropped. What is left gets its context: the lines
   of all windows that select it.
2. Each position is matched with the first one of its fingerprint, and the match is extended both ways, line by line,
   until the lines differ or the context ends. A match of ``min_words`` words or more is a run that occurred earlier.
3. A position whose context goes on behind its match may share more with others than with the first. All that do differ
   from the first at the same place by the same line. So on each side where the context goes on such positions form a new
   group, of those that share the run of lines up to that one, and 2. is repeated for these groups until none has two
   positions. A group's run is a line longer than that of the group it comes from, and is given up when no window holds it,
   so rounds end with the longest window. No pairs are formed: a group of n positions gives n matches. A group of at most
   GROUP positions goes through all its rounds in one task; only larger ones take a round of joins each.
4. The lines of all matches are deleted. A repeated run is covered by its windows, so it goes as a whole, while its first
   occurrence stays.

Defined cases: a null text stays null; documents are in the order of doc_id, null ids last, and rows with equal ids in the
order in which they were read; lines without a word are kept; a document all of whose lines are deleted stays with an
empty text; repeated rows lose the runs that their first copy has; an empty table gives no rows; texts of any length are
processed whole, one at a time; columns whose names clash with n_lines and n_deleted are replaced in dedup_lines() and
untouched in clean(). Equal hashes count as equal lines: with 10**12 lines two different ones have equal hashes with a
probability below 10**-14.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import SMALL_BATCHES, boxed, in_slices, join_small, materialize, without

MIN_WORDS = 50
#: Positions of a group that one task may hold.
GROUP = 4096
#: Bytes of a line's hash.
HASH = 16
#: For the write of the lines, with the texts: a task that writes or reads a row group holds all of it, which with Parquet's
#: setting of 128 MB is all that a task has.
LINES_SETTINGS = SMALL_BATCHES | {"parquet.block.size": str(8 << 20), "parquet.page.size": str(256 << 10)}
_INTS, _PA_INTS = T.ArrayType(T.IntegerType()), pa.list_(pa.int32())
LINES = T.StructType([T.StructField("at", _INTS), T.StructField("words", _INTS), T.StructField("hashes", T.BinaryType()), T.StructField("place", _INTS), T.StructField("low", _INTS), T.StructField("high", _INTS)])
FURTHER = T.StructType([T.StructField("group", T.BinaryType()), T.StructField("before", T.IntegerType()), T.StructField("behind", T.IntegerType())])
MATCH = T.StructType([T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("words", T.LongType()), T.StructField("more", T.ArrayType(FURTHER))])
_FURTHER = pa.struct([("group", pa.binary()), ("before", pa.int32()), ("behind", pa.int32())])
_MATCH = pa.struct([("left", pa.int32()), ("right", pa.int32()), ("words", pa.int64()), ("more", pa.list_(_FURTHER))])


def line_hash(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=HASH).digest()


def lines_of(text: str | None) -> tuple[list[int], list[int], list[bytes]]:
    """Numbers, words and hashes of the lines that have words."""
    at, words, hashes = [], [], []
    for k, line in enumerate((text or "").split("\n")):
        n = len(line.encode().split())
        if n:
            at.append(k)
            words.append(n)
            hashes.append(line_hash(line))
    return at, words, hashes


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last place) of the shortest runs with min_words words that start, or that end, at a line; in order."""
    upto = np.concatenate(([0], np.cumsum(words)))
    if upto[-1] < min_words:
        return []
    n = len(words)
    last = np.searchsorted(upto, upto[:-1] + min_words) - 1  # of the window that starts at each line
    first = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1  # of the window that ends at each line
    starting = [(i, j) for i, j in enumerate(last.tolist()) if j < n]
    ending = [(i, j) for j, i in enumerate(first.tolist()) if i >= 0]
    return sorted({*starting, *ending})


def winnow(hashes: list[bytes], words: list[int], min_words: int) -> dict[int, tuple[int, int]]:
    """The selected places, each with the first and the last place of the windows that select it."""
    found: dict[int, tuple[int, int]] = {}
    least: deque[int] = deque()  # places from the smallest hash on; of equal hashes the last
    seen = 0
    for i, j in windows(words, min_words):  # both ends only ever grow
        while seen <= j:
            while least and hashes[least[-1]] >= hashes[seen]:
                least.pop()
            least.append(seen)
            seen += 1
        while least[0] < i:
            least.popleft()
        low, _ = found.get(least[0], (i, j))
        found[least[0]] = (low, j)
    return found


def _lines_udf(min_words: int):
    def split(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            at, words, hashes = lines_of(t.as_py())
            found = winnow(hashes, words, min_words)
            rows.append((at, words, b"".join(hashes), list(found), [a for a, _ in found.values()], [b for _, b in found.values()]))
        kinds = (_PA_INTS, _PA_INTS, pa.binary(), _PA_INTS, _PA_INTS, _PA_INTS)
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=LINES.names)

    @F.arrow_udf(LINES)
    def split_lines(texts: pa.Array) -> pa.Array:
        return in_slices(split, texts)

    return split_lines


def extend(mine: bytes, at: int, first: bytes, first_at: int) -> tuple[int, int]:
    """Lines that two contexts share to the left and to the right of a line that both have, at these places."""
    if mine == first and at == first_at:
        return at, len(mine) // HASH - 1 - at
    left = right = 0
    most_left, most_right = min(at, first_at), min(len(mine) // HASH - at, len(first) // HASH - first_at) - 1
    a, b = at * HASH, first_at * HASH
    while left < most_left and mine[a - HASH : a] == first[b - HASH : b]:
        left, a, b = left + 1, a - HASH, b - HASH
    a, b = (at + 1) * HASH, (first_at + 1) * HASH
    while right < most_right and mine[a : a + HASH] == first[b : b + HASH]:
        right, a, b = right + 1, a + HASH, b + HASH
    return left, right


def further(context: bytes, at: int, words: list[int], before: int, behind: int, left: int, right: int, min_words: int) -> list[tuple[bytes, int, int]]:
    """The next groups of a position, (name, lines of the shared run before and behind it): on each side where its context
    goes on behind the match, unless the run is more than a window holds. Their runs are longer than the group's own."""
    out = []
    for a, b in ((left + 1, behind), (before, right + 1)):
        low, high = at - a, at + b
        if a + b > before + behind and low >= 0 and high < len(words) and min(sum(words[low:high]), sum(words[low + 1 : high + 1])) < min_words:
            run = context[low * HASH : high * HASH + HASH]
            out.append((hashlib.blake2b(a.to_bytes(4, "big") + run, digest_size=HASH).digest(), a, b))
    return out


def _match_udf(min_words: int):
    @F.arrow_udf(MATCH)
    def match_first(context: pa.Array, at: pa.Array, words: pa.Array, before: pa.Array, behind: pa.Array, first: pa.Array, first_at: pa.Array) -> pa.Array:
        out = []
        for c, k, w, a, b, f, m in zip(*(x.to_pylist() for x in (context, at, words, before, behind, first, first_at)), strict=True):
            left, right = extend(c, k, f, m)
            more = further(c, k, w, a, b, left, right, min_words)
            out.append((left, right, sum(w[k - left : k + right + 1]), [dict(zip(FURTHER.names, x, strict=True)) for x in more]))
        columns = zip(*out, strict=True) if out else [()] * len(MATCH)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCH, strict=True)], fields=list(_MATCH))

    return match_first


Position = tuple[bytes, int, list[int], int, int]


def all_rounds(group: list[Position], before: int, behind: int, min_words: int) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of the runs that occurred earlier, of a group's positions (context, at, words, row, place) in order."""
    work, done = [(group, before, behind)], set()
    while work:
        members, a, b = work.pop()
        first, first_at = members[0][:2]
        following: dict[tuple[bytes, int, int], list[Position]] = {}
        for k, (context, at, words, row, place) in enumerate(members):
            left, right = extend(context, at, first, first_at)
            if k and sum(words[at - left : at + right + 1]) >= min_words:
                yield row, place - left, place + right
            for name in further(context, at, words, a, b, left, right, min_words):
                following.setdefault(name, []).append(members[k])
        for name, some in following.items():
            if len(some) > 1 and name not in done:  # two ways can lead to a group
                done.add(name)
                work.append((some, *name[1:]))


def _rounds(min_words: int):
    """Positions in the order of group and order as (_row, first, last)."""

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, shared = None, [], (0, 0)
        for batch in batches:
            runs = []
            for g, *position, a, b in zip(*(batch.column(c).to_pylist() for c in ("group", "context", "at", "words", "_row", "place", "before", "behind")), strict=True):
                if g != group:
                    if len(held) > 1:
                        runs += all_rounds(held, *shared, min_words)
                    group, held, shared = g, [], (a, b)
                held.append(tuple(position))
            yield made(runs)
        if len(held) > 1:
            yield made(list(all_rounds(held, *shared, min_words)))

    def made(runs: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*runs, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["_row", "first", "last"])

    return solved


def _without_lines(texts: pa.Array, at: pa.Array, runs: pa.Array) -> pa.Array:
    out = []
    for text, places, gone in zip(texts.to_pylist(), at.to_pylist(), runs.to_pylist(), strict=True):
        if text is not None and gone:
            dropped = {places[k] for r in gone for k in range(r["first"], r["last"] + 1)}
            text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in dropped)
        out.append(text)
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def without_lines(texts: pa.Array, at: pa.Array, runs: pa.Array) -> pa.Array:
    """The texts without the lines in runs of places, which are numbers of lines in at."""
    return in_slices(_without_lines, texts, at, runs)


def _recurring(positions: DataFrame) -> DataFrame:
    """The groups with two positions or more, and how many they have."""
    counted = positions.groupBy(F.col("group").alias("_group")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted.filter("n > 1"), "groups")


def _positions(lined: DataFrame) -> DataFrame:
    """Positions of fingerprints that recur: group, _row, order, place, context, at (the place in it), words,
    before and behind (the lines that the group shares around it), n (the group's positions)."""
    hashes, words = F.col("_lines.hashes"), F.col("_lines.words")

    def of(p: Column) -> Column:
        return F.substring(hashes, p["place"] * HASH + 1, F.lit(HASH)).alias("group")

    def whole(p: Column) -> Column:
        size = p["high"] - p["low"] + 1
        context, own = F.substring(hashes, p["low"] * HASH + 1, size * HASH).alias("context"), F.slice(words, p["low"] + 1, size).alias("words")
        return F.struct(of(p), p["place"].alias("place"), context, (p["place"] - p["low"]).alias("at"), own, p["n"].alias("n"))

    # what is taken from a document's lines is taken before they are exploded, or each row would hold all of them
    ends = F.arrays_zip("_lines.place", "_lines.low", "_lines.high")
    prints = lined.select("_row", F.explode(F.transform(ends, lambda p: F.struct(of(p), p.alias("p")))).alias("q")).select("_row", "q.*")
    hits = prints.join(_recurring(prints).hint("merge"), F.col("group") == F.col("_group")).select("_row", F.struct("p.*", "n").alias("p"))
    hits = materialize(hits.groupBy(F.col("_row").alias("_of")).agg(F.collect_list("p").alias("prints")), "hits")  # fewer than the document's lines
    held = join_small(lined.select("_row", "_id", "_lines"), hits, F.col("_row") == F.col("_of"))
    held = held.select("_row", "_id", F.explode(F.transform("prints", whole)).alias("q")).select("_row", "_id", "q.*")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), "place").alias("order")
    return held.select("group", "_row", "place", order, "context", "at", "words", F.lit(0).alias("before"), F.lit(0).alias("behind"), "n")


def repeated_runs(lined: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_row, runs: array of (first, last) places that occurred earlier. lined: _row, _id and _lines of each document."""
    positions = materialize(_positions(lined), "positions")
    match_first, solved, runs = _match_udf(min_words), _rounds(min_words), []
    while True:
        small = positions.filter(F.col("n") <= GROUP).repartition("group").sortWithinPartitions("group", "order")
        runs.append(materialize(small.mapInArrow(solved, "_row long, first int, last int"), "runs", SMALL_BATCHES))
        large = positions.filter(F.col("n") > GROUP)
        if large.isEmpty():
            break
        lead = F.min_by(F.struct("context", "at", "order"), "order").alias("lead")
        firsts = materialize(large.groupBy(F.col("group").alias("_of")).agg(lead), "firsts")
        met = large.join(firsts.hint("merge"), F.col("group") == F.col("_of"))
        met = met.withColumn("m", match_first("context", "at", "words", "before", "behind", "lead.context", "lead.at"))
        met = met.withColumn("again", (F.col("order") != F.col("lead.order")) & (F.col("m.words") >= min_words))
        matched = materialize(met.filter("again OR size(m.more) > 0").drop("group", "before", "behind", "n", "lead", "_of"), "matched", SMALL_BATCHES)
        runs.append(matched.filter("again").select("_row", (F.col("place") - F.col("m.left")).alias("first"), (F.col("place") + F.col("m.right")).alias("last")))
        rest = matched.select(F.explode("m.more").alias("g"), "_row", "place", "order", "context", "at", "words").select("g.*", "_row", "place", "order", "context", "at", "words")
        rest = rest.join(_recurring(rest.select("group")).hint("merge"), F.col("group") == F.col("_group")).drop("_group")
        positions = materialize(rest.dropDuplicates(["group", "_row", "place"]), "positions")  # two ways can lead to a group
    return reduce(DataFrame.union, runs).groupBy("_row").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _cleaned(docs: DataFrame, text: str, doc_id: str, min_words: int) -> DataFrame:
    """The columns of docs boxed, _lines, runs, and _text: the text cleaned. Texts stay in place where runs are few."""
    others = without(docs.columns, [text])
    split = _lines_udf(min_words)(F.col(text)).alias("_lines")
    lined = docs.select(*boxed(others), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), split, F.monotonically_increasing_id().alias("_row"))
    lined = materialize(lined, "lines", LINES_SETTINGS)
    runs = repeated_runs(lined.select("_row", "_id", "_lines"), min_words).select(F.col("_row").alias("_of"), "runs")
    joined = join_small(lined, materialize(runs, "runs"), F.col("_row") == F.col("_of"), "left")
    some = F.col("runs").isNotNull()  # other texts aren't sent to Python
    cleaned = without_lines(F.when(some, F.col("_text")), F.when(some, F.col("_lines.at")), F.col("runs"))
    return joined.withColumn("_text", F.when(some, cleaned).otherwise(F.col("_text")))


def _columns(columns: list[str], text: str) -> list[Column]:
    return [F.col("_text").alias(c) if c == text else F.col("_box")[c].alias(c) for c in columns]


def clean(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later ones of repeated runs of lines deleted from the text."""
    return _cleaned(docs, text, doc_id, min_words).select(*_columns(docs.columns, text))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """clean(), with n_lines (lines that had words) and n_deleted."""
    rest = without(docs.columns, ["n_lines", "n_deleted"])
    deleted = F.size(F.array_distinct(F.flatten(F.transform(F.col("runs"), lambda r: F.sequence(r["first"], r["last"])))))
    done = _cleaned(docs.select(*rest), text, doc_id, min_words)
    return done.select(*_columns(rest, text), F.size("_lines.at").cast("long").alias("n_lines"), F.when(F.col("runs").isNull(), 0).otherwise(deleted).cast("long").alias("n_deleted"))
