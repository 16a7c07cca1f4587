"""Near-dedup by SimHash fingerprints with Golay-code keys, made complete to all pairs of Jaccard similarity 0.8 or more.

A document is its set of 5-word shingle hashes (64 bits); equal sets are one node. Nodes get a SimHash fingerprint of their
set, of 64 bits in three segments, and its keys are the indices of Golay codewords near two of them: all fingerprints within
five bits share one, and many that are further apart. Under each key a fingerprint meets the nearest of at most WINDOW before
it that differs in NEAR_BITS at most; such pairs are candidates, verified by shared shingles. What they join is the start of
the components.

Sets of similarity 0.8 differ in about ten of 64 fingerprint bits, so fingerprints alone can't find them all (the README has
figures). The rest, what WINDOW leaves out too, is found exactly by a prefix filter: of each set the first hashes of one order are keys, so many that two
sets of similarity 0.8 share one, and no such pair is missed. Any order is exact; this one leaves few keys with many nodes, also
where the table grows: hashes go by the number of rows that have them, which is counted over the whole table, and those that
are common in a sample of documents come last, the commonest at the very end, and aren't counted. For the counts the upper
bits of all hashes are dealt by their value as arrays; hashes that no other row has are no keys. Keys are dealt in passes,
so that a pass's shuffle is a part of all keys. Only pairs that aren't in one component yet are looked at: by their sizes,
then by parity sketches with a bit for each hash at least, whose bits differ at no more places than the sets do, so that
both filters drop only pairs below 0.8; what they leave is verified by shared shingles. So that large groups of copies don't
make all their pairs, a crowded key first gives each node's nearest one, then the nearest pair of each two components, and
at last all pairs that are still in different components. A key with more than BLOCK nodes is dealt in blocks: each two of
its blocks meet in a task, so that none holds more than two blocks, however large the group.

Defined cases: words are split and lower-cased as in simhash; fewer words than a shingle give one shingle of them all; texts
without words, null ones too, are equal; texts of any length are processed whole; a group keeps the row with its smallest
doc_id, and of several rows with that id one, so different texts with the same id are judged apart; rows without a doc_id
stay and link nothing; an empty table gives no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import boxed, discard, in_slices, join_small, materialize
from seriesmith.llm.components import components
from seriesmith.llm.simhash import LOWER, SEED, SEGMENTS, fingerprint, wide_keys

SHINGLE = 5
#: Bits of a parity sketch at least, and nodes up to which a key gives all pairs at once.
SKETCH, FEW = 512, 8
#: Bits in which the fingerprints of candidates differ at most, and fingerprints of a key that each one is compared with.
NEAR_BITS, WINDOW = 12, 1024
#: More than any distance.
FAR = 1 << 62
#: Nodes of a key's block.
BLOCK = 8192
#: Parts of the keys that are dealt one after the other.
PASSES = 4
#: Hashes of a part in which they are counted, hashes that a task holds while it deals them, and bits of a row's place in a piece.
PART_HASHES, HELD_HASHES, PLACE = 1 << 19, 1 << 21, 11
#: Documents of which common hashes are learned, the fewest of them that have one, and the most such hashes.
SAMPLE, COMMON, MOST_COMMON = 20_000, 3, 200_000
MET = "key long, a long, b long, n long"
DEALT = "part long, piece long, places binary, marks binary"
COUNTED = "piece long, places binary, marks binary, counts binary"
NODE = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("others", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("wide", T.BinaryType()),
    ]
)
_ARROW = pa.struct([("node", pa.int64()), ("size", pa.int64()), ("others", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("wide", pa.binary())])


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the shingles in order."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    parts = zip(*(words[k:] for k in range(SHINGLE)), strict=False)
    return np.unique(np.array([digest(b" ".join(w), SEED) for w in parts], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def first_keys(n: int | np.ndarray) -> int | np.ndarray:
    """How many hashes of a set of n are keys: one that is similar shares four fifths of it at least, so one of these."""
    return n - (4 * n + 4) // 5 + 1


def known(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are common, and the places of these. common: hashes in order and their ranks."""
    if common is None or not len(common[0]):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
    found = common[0][at] == hashes
    return found, at[found]


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first hashes, common ones after all others, by rank."""
    found, at = known(hashes, common)
    if len(at):
        hashes = np.concatenate([hashes[~found], hashes[found][np.argsort(common[1][at])]])
    return hashes[: first_keys(len(hashes))]


def sketch(hashes: np.ndarray, bits: int = SKETCH) -> bytes:
    """Bit i is the parity of the number of hashes that fall on it; bits is a power of two."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide(hashes: np.ndarray) -> bytes:
    """A sketch with a bit for each hash at least, which tells long sets apart too."""
    return sketch(hashes, max(SKETCH, 1 << max(len(hashes) - 1, 0).bit_length()))


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, of which the longer is folded."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets, as ordered hashes, is 0.8 or more."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 9 * both >= 4 * (len(a) + len(b))


def _node(common: tuple[np.ndarray, np.ndarray]) -> Callable[[Column], Column]:
    """others: hashes that aren't common. Where they are fewer than the keys, all of them are keys, and so are the first common
    ones; else there are none here, see _rare_keys()."""

    def nodes_of(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.cast(pa.binary()).to_pylist():
            h = shingle_set(t or b"")
            others = len(h) - int(known(h, common)[0].sum())
            keys = prefix(h, common) if others < first_keys(len(h)) else h[:0]
            rows.append({"node": node_of(h), "size": len(h), "others": others, "fp": fingerprint(h), "keys": keys.view(np.int64), "wide": wide(h)})
        return pa.array(rows, _ARROW)

    @F.arrow_udf(NODE)
    def node(texts: pa.Array) -> pa.Array:
        return in_slices(nodes_of, texts)

    return node


def _hashes_of(texts: pa.Array) -> pa.Array:
    return pa.array((shingle_set(t or b"").view(np.int64) for t in texts.cast(pa.binary()).to_pylist()), pa.list_(pa.int64()))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _hashes(texts: pa.Array) -> pa.Array:
    return in_slices(_hashes_of, texts)


def _sets_of(texts: pa.Array) -> pa.Array:
    return pa.array((shingle_set(t or b"").tobytes() for t in texts.cast(pa.binary()).to_pylist()), pa.binary())


@F.arrow_udf(T.BinaryType())
def _set(texts: pa.Array) -> pa.Array:
    return in_slices(_sets_of, texts)


def _all_verified(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)), pa.bool_())


@F.arrow_udf(T.BooleanType())
def _verified(a: pa.Array, b: pa.Array) -> pa.Array:
    return in_slices(_all_verified, a, b)


def _all_apart(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((apart(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)), pa.int64())


@F.arrow_udf(T.LongType())
def _apart(a: pa.Array, b: pa.Array) -> pa.Array:
    return in_slices(_all_apart, a, b)


def _starts(batch: pa.RecordBatch | pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before in the named columns."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        new |= np.diff(batch.column(name).to_numpy()) != 0
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def _whole_keys(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("key", "cell")) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of the named columns as tables of whole groups, with the starts of groups and the end."""
    held: list[pa.RecordBatch] = []
    last = None

    def given(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, np.append(_starts(table, names), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        name = tuple(batch.column(c)[-1].as_py() for c in names)
        if name != last:
            cut = int(_starts(batch, names)[-1])
            done = [*held, batch.slice(0, cut)]
            if sum(b.num_rows for b in done):
                yield given(done)
            held, last = [batch.slice(cut)], name
        else:
            held.append(batch)
    if held:
        yield given(held)


def _met(few: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, node, size) in the order of keys to MET: pairs (a, b) of like sizes of a key with few nodes; each node, as a,
    of one with more, whose number is n."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_keys(batches, ("key",)):
            keys, nodes, sizes = (table.column(c).to_numpy() for c in ("key", "node", "size"))
            counts = np.diff(starts)
            counts = np.repeat(counts, counts)
            pairs = np.zeros((0, 2), np.int64)
            for d in range(1, min(few, len(keys))):
                at = np.flatnonzero((keys[d:] == keys[:-d]) & (counts[d:] <= few))
                x, y = sizes[at], sizes[at + d]
                at = at[5 * np.minimum(x, y) >= 4 * np.maximum(x, y)]
                pairs = np.concatenate([pairs, np.sort(np.stack([nodes[at], nodes[at + d]], axis=1), axis=1)])
            pairs = np.unique(pairs, axis=0)
            many = np.flatnonzero(counts > few)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], names=["key", "a", "b", "n"])
            for at in range(0, len(many), 10_000):
                some = many[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(nodes[some]), pa.nulls(len(some), pa.int64()), pa.array(counts[some])], names=["key", "a", "b", "n"])

    return met


def _classes(sketches: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """starts, tables: the sketches of nodes ordered by size as tables of one width each, as words of 64 bits."""
    widths = np.array([len(x) for x in sketches])
    starts = np.append(np.concatenate(([0], np.flatnonzero(np.diff(widths)) + 1)), len(widths))
    return starts, [np.frombuffer(b"".join(sketches[a:b]), np.uint64).reshape(b - a, -1) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing bits of each two rows; the wider ones are folded, as in apart()."""
    while one.shape[1] > two.shape[1]:
        one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
    distance = np.zeros((len(one), len(two)), np.int64)
    for w in range(one.shape[1]):
        distance += np.bitwise_count(one[:, w][:, None] ^ two[:, w][None, :])
    return distance


def group_pairs(sizes: np.ndarray, sketches: list[bytes], labels: np.ndarray, blocks: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a key's nodes, ordered by size, that pass the filters and differ in labels: at step 0 each node's nearest
    one before it, at 1 the nearest pair of two labels, at 2 all. Of two blocks only pairs across them count."""
    two = blocks.min() != blocks.max()
    left, right, far = [], [], []
    block = max(1, (1 << 20) // len(sizes))
    starts, tables = _classes(sketches)
    for k, low in ((k, low) for k in range(len(tables)) for low in range(int(starts[k]), int(starts[k + 1]), block)):
        rows = np.arange(low, min(int(starts[k + 1]), low + block))
        begin = int(np.searchsorted(5 * sizes, 4 * sizes[low]))
        columns = np.arange(begin, rows[-1])
        if not len(columns):
            continue
        mine = tables[k][rows - starts[k]]
        parts = []
        for m in range(k + 1):  # of the narrower ones, only the next can be of like sizes
            a, b = max(begin, int(starts[m])), min(int(rows[-1]), int(starts[m + 1]))
            if a < b:
                parts.append(_distances(mine, tables[m][a - starts[m] : b - starts[m]]))
        distance = np.concatenate(parts, axis=1)
        x, y = sizes[rows][:, None], sizes[columns][None, :]
        passed = (9 * distance <= x + y) & (5 * y >= 4 * x) & (columns[None, :] < rows[:, None]) & (labels[rows][:, None] != labels[columns][None, :])
        if two:
            passed &= blocks[rows][:, None] != blocks[columns][None, :]
        if step == 0:
            distance[~passed] = FAR
            best = distance.argmin(axis=1)
            some = distance[np.arange(len(rows)), best] < FAR
            left.append(rows[some])
            right.append(columns[best[some]])
        else:
            i, j = np.nonzero(passed)
            left.append(rows[i])
            right.append(columns[j])
            far.append(distance[i, j])
            if step == 1:  # one of each two labels is kept, so what is held stays small
                i, j, d = np.concatenate(left), np.concatenate(right), np.concatenate(far)
                ends = np.sort(np.stack([labels[i], labels[j]]), axis=0)
                order = np.lexsort((d, ends[1], ends[0]))
                first = np.ones(len(order), bool)
                first[1:] = (np.diff(ends[:, order], axis=1) != 0).any(axis=0)
                left, right, far = [i[order[first]]], [j[order[first]]], [d[order[first]]]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _crowd_pairs(step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_keys(batches):
            nodes, sizes, labels, blocks = (table.column(c).to_numpy() for c in ("node", "size", "label", "block"))
            bits = table.column("wide")
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if (labels[low:high] == labels[low]).all():
                    continue
                order = low + np.argsort(sizes[low:high], kind="stable")
                i, j = group_pairs(sizes[order], bits.take(pa.array(order)).to_pylist(), labels[order], blocks[order], step)
                a, b = nodes[order[i]], nodes[order[j]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return pairs


def _unlike(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that aren't in one component. roots: node, root of the nodes that have links."""
    for end in "a", "b":
        of = roots.select(F.col("node").alias(f"_{end}"), F.col("root").alias(f"_{end}_root"))
        pairs = join_small(pairs, of, F.col(end) == F.col(f"_{end}"), "left")
    return pairs.filter(F.coalesce("_a_root", "a") != F.coalesce("_b_root", "b")).select("a", "b")


def _checked(pairs: DataFrame, done: DataFrame | None, nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) that haven't been checked, and edges (u, v): those that are similar. Wide sketches are compared first;
    the sets are made again, of one document of each node in a pair which is left. texts: _row, _text."""
    pairs = pairs.distinct()
    if done is not None:
        pairs = pairs.join(done.select(F.col("a").alias("_x"), F.col("b").alias("_y")), (F.col("a") == F.col("_x")) & (F.col("b") == F.col("_y")), "left_anti")
    pairs = materialize(pairs, "pairs")
    one = nodes.select(F.col("node").alias("_a"), F.col("size").alias("n"), F.col("wide").alias("x"))
    two = nodes.select(F.col("node").alias("_b"), F.col("size").alias("m"), F.col("wide").alias("y"))
    both = pairs.join(one.hint("merge"), F.col("a") == F.col("_a")).join(two.hint("merge"), F.col("b") == F.col("_b"))
    close = materialize(both.filter(9 * _apart(F.col("x"), F.col("y")) <= F.col("n") + F.col("m")).select("a", "b"), "close")
    used = close.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    used = materialize(used.join(nodes.hint("merge"), F.col("n") == F.col("node")).select("n", F.col("lead.row").alias("_first")), "used")
    sets = join_small(texts, used, F.col("_row") == F.col("_first")).select("n", _set(F.col("_text")).alias("members"))
    sets = materialize(sets, "sets")
    one = sets.select(F.col("n").alias("_a"), F.col("members").alias("x"))
    two = sets.select(F.col("n").alias("_b"), F.col("members").alias("y"))
    both = close.join(one.hint("merge"), F.col("a") == F.col("_a")).join(two.hint("merge"), F.col("b") == F.col("_b"))
    found = materialize(both.filter(_verified(F.col("x"), F.col("y"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "similar")
    discard(close, used, sets)
    return pairs, found


def _cells(crowded: DataFrame, block: int) -> DataFrame:
    """key, node, block and cell: a row for each two of the key's blocks of which one is the node's."""
    n_blocks = F.ceil(F.col("n") / block)
    mine, other = F.pmod(F.xxhash64("node"), n_blocks), F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))
    dealt = crowded.select("key", "node", mine.cast("long").alias("block"), other.alias("other"))
    cell = F.call_function("shiftleft", F.least("block", "other"), F.lit(31)) + F.greatest("block", "other")
    return dealt.select("key", "node", "block", cell.alias("cell"))


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sample's common shingles in order, and their ranks: the commonest is last."""
    one_in = max(1, rows.count() // SAMPLE)
    some = rows.filter(F.pmod(F.xxhash64("_row"), F.lit(one_in)) == 0).select(F.explode(_hashes(F.col("_text"))).alias("hash"))
    often = materialize(some.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON), "common")
    found = often.orderBy(F.desc("n"), "hash").limit(MOST_COMMON).toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(hashes) - 1 - order


def _dealt(common: tuple[np.ndarray, np.ndarray], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (_row, _text) to DEALT: of the hashes that aren't common, those with the leading bits part, as the next 32 bits and
    the places of their rows in a piece, which is a run of rows."""

    def pieces(rows: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int, bytes, bytes]]:
        hashes, of = np.concatenate(sets), np.repeat(np.array(rows, np.int64), [len(x) for x in sets])
        order = np.lexsort((hashes, of >> PLACE))
        hashes, of = hashes[order], of[order]
        part, piece = (hashes >> np.uint64(64 - bits)).astype(np.int64), of >> PLACE
        places, marks = (of & ((1 << PLACE) - 1)).astype(np.uint16), (hashes >> np.uint64(32 - bits)).astype(np.uint32)
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(piece) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes)], strict=True):
            if a < b:
                yield int(part[a]), int(piece[a]), places[a:b].tobytes(), marks[a:b].tobytes()

    def batch_of(rows: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        columns = list(zip(*pieces(rows, sets), strict=True)) or [[], [], [], []]
        kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "piece", "places", "marks"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("_text").cast(pa.binary()), strict=True):
                h = shingle_set(text.as_py() or b"")
                h = h[~known(h, common)[0]]
                rows.append(row), sets.append(h)
                held += len(h)
                if held > HELD_HASHES:
                    yield batch_of(rows, sets)
                    rows, sets, held = [], [], 0
        if rows:
            yield batch_of(rows, sets)

    return dealt


def _joined_bytes(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a column of bytes as one, and their lengths."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(x) // np.dtype(kind).itemsize for x in parts], np.int64)


def _counted(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """DEALT in the order of parts to COUNTED: the hashes that two rows have at least, without their lowest bits, and their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_keys(batches, ("part",)):
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                some = table.slice(low, high - low)
                marks, lengths = _joined_bytes(some.column("marks"), np.uint32)
                places, _ = _joined_bytes(some.column("places"), np.uint16)
                _, of, counts = np.unique(marks, return_inverse=True, return_counts=True)
                counts = counts[of].astype(np.uint32)
                shared = counts > 1
                top = np.uint64(some.column("part")[0].as_py() << (64 - bits))
                marks = top | (marks.astype(np.uint64) << np.uint64(32 - bits))
                ends = np.cumsum(lengths)
                columns = [[x[a:b][shared[a:b]].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)] for x in (places, marks, counts)]
                yield pa.RecordBatch.from_arrays([some.column("piece").combine_chunks(), *(pa.array(c, pa.binary()) for c in columns)], names=["piece", "places", "marks", "counts"])

    return counted


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTED and rows (piece, place, size, others) in the order of pieces to (row, keys): of each of these rows the hashes
    that are among its first, and that another row has. Hashes that none has come before them."""
    for table, starts in _whole_keys(batches, ("piece",)):
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            some = table.slice(low, high - low)
            heads, some = some.filter(some.column("place").is_valid()), some.filter(some.column("place").is_null())
            left = np.zeros(1 << PLACE, np.int64)
            size, others = heads.column("size").to_numpy(), heads.column("others").to_numpy()
            left[heads.column("place").to_numpy()] = first_keys(size) - others
            asked = np.zeros(1 << PLACE, bool)
            asked[heads.column("place").to_numpy()] = True
            (places, _), (marks, _), (counts, _) = (_joined_bytes(some.column(c), k) for c, k in (("places", np.uint16), ("marks", np.uint64), ("counts", np.uint32)))
            order = np.lexsort((marks, counts, places))
            places, marks = places[order].astype(np.int64), marks[order]
            shared = np.bincount(places, minlength=1 << PLACE)
            nth = np.arange(len(places)) - (np.cumsum(shared) - shared)[places]
            again = np.zeros(len(places), bool)
            again[1:] = (np.diff(places) == 0) & (marks[1:] == marks[:-1])
            taken = np.flatnonzero(asked[places] & (nth < (left + shared)[places]) & ~again)
            row = (some.column("piece")[0].as_py() << PLACE) + places[taken] if len(taken) else places[taken]
            cuts = np.flatnonzero(np.diff(row)) + 1
            keys = np.split(marks[taken].view(np.int64), cuts) if len(taken) else []
            yield pa.RecordBatch.from_arrays([pa.array(row[np.concatenate(([0], cuts))] if len(taken) else row, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "keys"])


def _rare_keys(nodes: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray], hashes: int) -> DataFrame:
    """nodes with their keys. Of all keys the lowest bits are left out, which can only give a key more nodes. hashes: the
    number of all rows' hashes; texts: _row, _text of all rows."""
    bits = min(24, max(1, (hashes // PART_HASHES).bit_length()))
    parts = texts.select("_row", "_text").mapInArrow(_dealt(common, bits), DEALT).repartition("part").sortWithinPartitions("part")
    counted = materialize(parts.mapInArrow(_counted(bits), COUNTED), "counted")
    many = F.col("others") >= F.col("size") - F.floor((4 * F.col("size") + 4) / 5) + 1
    row = F.col("lead.row")
    heads = nodes.filter(many).select(F.shiftright(row, PLACE).alias("piece"), F.pmod(row, F.lit(1 << PLACE)).alias("place"), "size", "others")
    both = counted.unionByName(heads, allowMissingColumns=True).repartition("piece").sortWithinPartitions("piece")
    chosen = materialize(both.mapInArrow(_rarest, "row long, keys array<long>"), "chosen").select("row", F.col("keys").alias("rare"))
    upper = F.transform("keys", lambda k: k.bitwiseAND(F.lit(-1 << (32 - bits))))
    keys = F.coalesce("rare", F.array_distinct(upper)).alias("keys")
    found = nodes.join(chosen.hint("merge"), F.col("lead.row") == F.col("row"), "left").select("node", "lead", "size", "fp", keys, "wide")
    found = materialize(found, "nodes")
    discard(counted, chosen)
    return found


def _golay_keys(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            for at in range(0, len(values), 10_000):
                part = values[at : at + 10_000]
                row, key = wide_keys(part, k)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    return keys


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in order to pairs (u, v): a fingerprint and the nearest before it under the key."""
    for table, _ in _whole_keys(batches, ("key",)):
        keys, fps = table.column("key").to_numpy(), table.column("fp").to_numpy()
        bits = fps.view(np.uint64)
        best, other = np.full(len(fps), NEAR_BITS + 1), np.zeros(len(fps), np.int64)
        for d in range(1, min(WINDOW + 1, len(keys))):
            at = np.flatnonzero(keys[d:] == keys[:-d])
            if not len(at):
                break
            far = np.bitwise_count(bits[at + d] ^ bits[at]).astype(np.int64)
            nearer = far < best[at + d]
            best[at[nearer] + d], other[at[nearer] + d] = far[nearer], at[nearer]
        found = np.flatnonzero(best <= NEAR_BITS)
        pairs = np.unique(np.sort(np.stack([fps[found], fps[other[found]]], axis=1), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _golay_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b): nodes with equal fingerprints, and those whose fingerprints are near by their Golay keys."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    first = lambda end: firsts.select(F.col("fp").alias(f"_{end}"), F.col("first").alias(end))
    pairs = nodes.select("fp", "node").join(first("a"), F.col("fp") == F.col("_a")).select("a", F.col("node").alias("b"))
    for k in range(len(SEGMENTS)):
        keyed = firsts.select("fp").mapInArrow(_golay_keys(k), "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
        near = materialize(keyed.mapInArrow(_nearest, "u long, v long").distinct(), "near")
        pairs = pairs.union(near.join(first("a"), F.col("u") == F.col("_a")).join(first("b"), F.col("v") == F.col("_b")).select("a", "b"))
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _keyed(nodes: DataFrame) -> DataFrame:
    """MET of all keys, dealt in passes."""
    keys = nodes.select(F.explode("keys").alias("key"), "node", "size")
    parts = []
    for k in range(PASSES):
        dealt = keys.filter(F.pmod("key", F.lit(PASSES)) == k).repartition("key").sortWithinPartitions("key")
        parts.append(materialize(dealt.mapInArrow(_met(FEW), MET), "met"))
    met = parts[0]
    for part in parts[1:]:
        met = met.union(part)
    return met


def _joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """The components so far, which stand for the edges that made them as stars, and more edges."""
    if found.isEmpty():
        return roots
    return materialize(components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found)), "roots")


def _grouped(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """prints with stay (doc_id, row): the row that stays of its component. rows: _row, _id (not null), _text."""
    common = _common(rows)
    prints = rows.select("_row", F.col("_id").alias("doc_id"), _node(common)(F.col("_text")).alias("p"))
    prints = materialize(prints.select("_row", "doc_id", "p.*"), "sets-of")
    ids = materialize(prints.select("_row", "doc_id", "node"), "ids")
    leads = materialize(ids.groupBy("node").agg(F.min(F.struct("doc_id", F.col("_row").alias("row"))).alias("lead")).select("lead", F.col("lead.row").alias("_first")), "leads")
    sets = materialize(join_small(prints, leads, F.col("_row") == F.col("_first")).select("node", "lead", "size", "others", "fp", "keys", "wide"), "nodes")
    hashes = prints.agg(F.sum("size")).first()[0] or 0
    discard(prints, leads)
    texts = rows.select("_row", "_text")
    nodes = _rare_keys(sets, texts, common, hashes)
    discard(sets)
    done, found = _checked(_golay_pairs(nodes), None, nodes, texts)
    roots = materialize(components(found), "roots")
    met = _keyed(nodes)
    more, found = _checked(_unlike(met.filter("b IS NOT NULL").select("a", "b"), roots), done, nodes, texts)
    done, roots = done.union(more), _joined(roots, found)
    crowded = _cells(met.filter("b IS NULL").select("key", F.col("a").alias("node"), "n"), block)
    about = nodes.select(F.col("node").alias("_node"), "size", "wide")
    for step in () if crowded.isEmpty() else (0, 1, 2):
        labels = roots.select(F.col("node").alias("_of"), "root")
        known = join_small(about, labels, F.col("_node") == F.col("_of"), "left").select("_node", "size", "wide", F.coalesce("root", "_node").alias("label"))
        joined = crowded.join(known.hint("merge"), F.col("node") == F.col("_node")).select("key", "cell", "block", "node", "size", "wide", "label")
        pairs = joined.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_crowd_pairs(step), "a long, b long")
        more, found = _checked(pairs, done, nodes, texts)
        done, roots = done.union(more), _joined(roots, found)
    discard(met)
    roots = roots.select(F.col("node").alias("_of"), "root")
    rooted = nodes.select("node", "lead").join(roots, F.col("node") == F.col("_of"), "left")
    rooted = materialize(rooted.select("node", "lead", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("lead").alias("stay")).select((F.col("root") + F.lit(0)).alias("_root"), "stay")
    stays = materialize(rooted.join(least, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "stay"), "components")
    discard(nodes, rooted, done)
    return ids.join(stays, F.col("node") == F.col("_node")).select("_row", "doc_id", "stay")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id and component_id for every row of docs that has a doc_id."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    found = _grouped(materialize(rows.filter("_id IS NOT NULL"), "rows"), block)
    return found.select(F.col("doc_id").alias(doc_id), F.col("stay.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: that with its smallest doc_id."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*boxed(others), F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "rows")
    gone = _grouped(rows.filter("_id IS NOT NULL").select("_row", "_id", "_text")).filter(F.col("_row") != F.col("stay.row"))
    gone = materialize(gone.select(F.col("_row").alias("_gone")), "gone")
    kept = join_small(rows, gone, F.col("_row") == F.col("_gone"), "left_anti")
    return kept.select(*(F.col("_text").alias(c) if c == text else F.col("_box")[c].alias(c) for c in docs.columns))
