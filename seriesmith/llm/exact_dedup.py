"""Exact dedup with an extendible-hash index on shared files.

1. Each task collapses equal texts (A-Z lower-cased) of its own rows into entries, by comparing bytes, and writes rows and
   entries to a table in the shared folder; the text is written once an entry. A text of which a third of all rows are
   copies so becomes a few entries for each task.
2. A key with more than HOT_ENTRIES entries is merged first: its entries are dealt to as many groups as the root of their
   number, and each group is merged as in 4. So no task has all entries of a text, however many copies there are.
3. The directory of an extendible hash over the leading bits of the entries' keys is built from a histogram: it starts with
   one bucket, overfull buckets split, and the directory doubles where a bucket is as deep as the directory. Buckets are
   numbered in the order of keys.
4. Each owner task has a range of buckets, and so of keys. It reads its entries in the order of keys, chains the entries of
   a key, compares their bytes, and gives the row that stays and the size of the group for every entry. It holds the chain of
   one key only, so the size of a bucket doesn't bound its memory.
5. Rows get their entry's answer.

Defined cases: a null text counts as empty; of equal texts the row with the largest doc_id stays, null ids being smallest,
and of repeated rows with that id just one; an empty table gives no rows; texts of any length are compared whole; a bucket
of one key, however full, isn't split, as its texts are equal or its keys collide; other columns of the input, whatever
their names, are left out.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import SMALL_BATCHES, join_small, materialize, table_bytes

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Bits of the histogram's cells beyond those that number the buckets.
SPARE_BITS = 2
#: Bytes of texts that a task holds while it collapses rows; beyond it starts a new set of entries.
HELD_BYTES = 32 << 20
#: Rows of a batch that a task gives out.
GIVEN_ROWS = 1000
#: Bytes of texts in a bucket, at least, and buckets, at most: with more data a bucket has more bytes, which bounds the
#: directory that the driver builds and each task gets.
BUCKET_BYTES, MAX_BUCKETS = 1 << 20, 1 << 18
#: Entries of a key beyond which they are merged in groups first.
HOT_ENTRIES = 64
ENTRIES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("entry", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("largest", T.BooleanType()),
        T.StructField("n", T.LongType()),
        T.StructField("top", T.LongType()),
        T.StructField("text", T.BinaryType()),
    ]
)
ANSWERS = T.StructType(
    [
        T.StructField("entry", T.LongType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("winner", T.BooleanType()),
    ]
)
MERGED = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("entry", T.LongType()),
        T.StructField("into", T.LongType()),
        T.StructField("best", T.BooleanType()),
        T.StructField("n", T.LongType()),
        T.StructField("top", T.LongType()),
        T.StructField("text", T.BinaryType()),
    ]
)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])


def _rank(doc_id: int | None) -> tuple[bool, int]:
    return (doc_id is not None, doc_id or 0)


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as rows of ENTRIES; the first row of an entry has its text, size and largest id."""
    number = TaskContext.get().partitionId() << 40
    ids: list[int | None] = []
    of: list[int] = []
    texts: dict[bytes, int] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number, held
        best: list[int] = [-1] * len(texts)
        count = [0] * len(texts)
        for row, e in enumerate(of):
            count[e] += 1
            if best[e] < 0 or _rank(ids[row]) > _rank(ids[best[e]]):
                best[e] = row
        digests = [hashlib.sha256(t) for t in texts]
        hexes = [d.hexdigest() for d in digests]
        keys = [int.from_bytes(d.digest()[:8], "big", signed=True) for d in digests]
        every, first = list(texts), [True] * len(texts)
        schema = _arrow(ENTRIES)
        for low in range(0, len(of), GIVEN_ROWS):
            columns: list[list] = [[], [], [], [], [], [], [], []]
            for row in range(low, min(low + GIVEN_ROWS, len(of))):
                e = of[row]
                lead, first[e] = first[e], False
                values = (ids[row], number + e, keys[e], hexes[e], best[e] == row, count[e] if lead else None, ids[best[e]] if lead else None, every[e] if lead else None)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        number += len(texts)
        texts.clear(), ids.clear(), of.clear()
        held = 0

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            text = (text or b"").translate(LOWER)
            e = texts.get(text)
            if e is None:
                e = texts[text] = len(texts)
                held += len(text) + 200
            ids.append(doc_id)
            of.append(e)
            held += 40
            if held > HELD_BYTES:
                yield from flush()
    if ids:
        yield from flush()


class Directory:
    """Extendible hashing over the leading bits of a key: 2**depth slots, each with the number of its bucket."""

    def __init__(self, cells: dict[int, tuple[int, bool]], capacity: int, max_depth: int) -> None:
        """cells: for each value of the leading max_depth bits that occurs (bytes, whether it has but one key)."""
        self.depth = 0
        self.slots = [0]
        self.local = [0]
        self.max_depth = max_depth
        content = [sorted(cells.items())]
        work = [0]
        while work:
            bucket = work.pop()
            inside = content[bucket]
            if sum(size for _, (size, _) in inside) <= capacity or self.local[bucket] == max_depth or (len(inside) == 1 and inside[0][1][1]):
                continue
            if self.local[bucket] == self.depth:
                self.slots = [b for b in self.slots for _ in range(2)]
                self.depth += 1
            self.local[bucket] += 1
            self.local.append(self.local[bucket])
            bit = max_depth - self.local[bucket]
            content[bucket] = [x for x in inside if not x[0] >> bit & 1]
            content.append([x for x in inside if x[0] >> bit & 1])
            new = len(content) - 1
            prefix = (inside[0][0] >> (bit + 1)) << 1 | 1
            width = self.depth - self.local[new]
            for slot in range(prefix << width, (prefix + 1) << width):
                self.slots[slot] = new
            work += [bucket, new]
        number = {b: k for k, b in enumerate(dict.fromkeys(self.slots))}
        self.slots = [number[b] for b in self.slots]
        self.local = [self.local[b] for b in number]


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def build_directory(entries: DataFrame, about: int) -> Directory:
    """From the entries' histogram, which has a few cells for each bucket; about: the bytes of their texts, roughly."""
    depth = min(about // BUCKET_BYTES, MAX_BUCKETS).bit_length() + SPARE_BITS
    size = F.sum(F.length("text") + F.lit(100)).alias("bytes")
    cells = entries.groupBy(_leading(F.col("key"), depth).alias("cell")).agg(size, (F.min("key") == F.max("key")).alias("single"))
    found = {r["cell"]: (r["bytes"], r["single"]) for r in cells.collect()}
    return Directory(found, max(BUCKET_BYTES, sum(b for b, _ in found.values()) // MAX_BUCKETS), depth)


Chain = list[tuple[bytes, list[tuple[int, int, int | None]]]]


def _chained(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[int, Chain] | None]:
    """(key, chain) of the entries (key, entry, n, top, text) that agree in the columns by, in whose order they come; the chain
    has (text, members as (entry, n, top)) for each text. None where a batch ends."""
    group, links, key = None, [], 0
    for batch in batches:
        for *name, k, entry, n, top, text in zip(*(batch.column(c).to_pylist() for c in (*by, "key", "entry", "n", "top", "text")), strict=True):
            if name != group:
                if links:
                    yield key, links
                group, links, key = name, [], k
            for link, members in links:
                if link == text:
                    members.append((entry, n, top))
                    break
            else:
                links.append((text, [(entry, n, top)]))
        yield None
    if links:
        yield key, links
    yield None


def _winner(members: list[tuple[int, int, int | None]]) -> tuple[int, int, int | None]:
    return max(members, key=lambda m: (_rank(m[2]), -m[0]))


def _tables(rows: Iterator[list[tuple] | None], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for some in rows:
        if some is not None:
            held += some
        elif held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of keys as rows of ANSWERS."""

    def answers(found: tuple[int, Chain] | None) -> list[tuple] | None:
        if found is None:
            return None
        out = []
        for _, members in found[1]:
            best = _winner(members)
            size = sum(n for _, n, _ in members)
            out += [(entry, best[2], size, entry == best[0]) for entry, _, _ in members]
        return out

    yield from _tables(map(answers, _chained(batches, ("key",))), _arrow(ANSWERS))


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of keys and groups as rows of MERGED: what each goes into, whether it has the row that would stay,
    and in one row of each merged entry its size, largest id and text."""

    def merged(found: tuple[int, Chain] | None) -> list[tuple] | None:
        if found is None:
            return None
        out = []
        for text, members in found[1]:
            best = _winner(members)
            for k, (entry, _, _) in enumerate(members):
                whole = (sum(n for _, n, _ in members), best[2], text) if k == 0 else (None, None, None)
                out.append((found[0], entry, best[0], entry == best[0], *whole))
        return out

    yield from _tables(map(merged, _chained(batches, ("key", "salt"))), _arrow(MERGED))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs."""
    spark = docs.sparkSession
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(pairs.mapInArrow(collapse, ENTRIES), "entries", SMALL_BATCHES)
    entries = rows.filter("n IS NOT NULL").select("key", "entry", "n", "top", "text")

    crowds = entries.groupBy(F.col("key").alias("_hot")).agg(F.count(F.lit(1)).alias("crowd")).filter(F.col("crowd") > HOT_ENTRIES)
    crowds = materialize(crowds, "hot")
    hot = join_small(entries, crowds, F.col("key") == F.col("_hot"))
    salt = F.pmod(F.xxhash64("entry"), F.ceil(F.sqrt("crowd"))).alias("salt")
    hot = hot.select("key", salt, "entry", "n", "top", "text").repartition("key", "salt").sortWithinPartitions("key", "salt")
    hot = materialize(hot.mapInArrow(merge, MERGED), "merged", SMALL_BATCHES)
    heads = hot.filter("n IS NOT NULL").select("key", F.col("into").alias("entry"), "n", "top", "text")
    entries = join_small(entries, crowds, F.col("key") == F.col("_hot"), "left_anti").unionByName(heads)

    directory = build_directory(entries, 4 * table_bytes(rows))
    n_buckets = len(directory.local)
    owners = min(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = spark.createDataFrame([(s, b, b * owners // n_buckets) for s, b in enumerate(directory.slots)], "slot long, bucket int, owner int")
    slots = materialize(slots.coalesce(1), "directory")  # a few rows for each bucket
    owned = entries.join(F.broadcast(slots), _leading(F.col("key"), directory.depth) == F.col("slot"))
    owned = owned.select("owner", "bucket", "key", "entry", "n", "top", "text").repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "key")
    answers = materialize(owned.mapInArrow(chain, ANSWERS), "answers", SMALL_BATCHES)
    inner = answers.select(F.col("entry").alias("_into"), "keep_id", "group_size", "winner")
    spread = hot.select("entry", "into", "best").join(inner, F.col("into") == F.col("_into"))
    spread = spread.select("entry", "keep_id", "group_size", (F.col("winner") & F.col("best")).alias("winner"))
    alone = answers.join(hot.select("into"), F.col("entry") == F.col("into"), "left_anti")
    judged = rows.select("doc_id", "entry", "text_sha256", "largest").join(alone.unionByName(spread), "entry")
    return judged.select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", (F.col("largest") & F.col("winner")).alias("kept"), "text_sha256")
