"""SimHash near-dedup with Golay-code keys.

Fingerprints of 64 bits link where they differ in at most two. A fingerprint is cut into three segments, each filled up to
the 23 bits of the perfect binary Golay code, whose 4096 codewords have spheres of radius 3 that cover every word. Two
words that differ in at most two bits have a codeword within distance 4 of both: that of a word halfway between them. The
indices of all codewords within distance 4, five on average, are therefore keys of which linked words share one. By the
pigeonhole principle one of the three segments of linked fingerprints has no error and the next at most two. So the key
(number and value of a segment, an index of the next segment) brings every linked pair together.

Equal fingerprints are one node. Nodes with equal keys meet in one task, in the order of keys. There they are verified
without forming pairs: two of them link just where the sets of words within distance one of each meet, so each node's 65
words are sorted, and runs of equal ones join nodes; what leaves the task is one edge for each node that has a link. A key
with more than KEY_NODES nodes isn't held: its nodes are linked by the same words in a shuffle of their own, whose groups
have 65 nodes at most. Components follow from the edges.

Defined cases: a null text counts as empty, and texts without words have fingerprint zero; fewer words than a shingle give
one shingle of them all; a component's id is its smallest doc_id, null ids being left out; an empty table gives no rows;
near_dedup() leaves other columns out, whatever their names; ties can't arise, as equal fingerprints are one node; texts
of any length are processed whole. KEY_NODES changes only where links are looked for, not which are found.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import materialize
from seriesmith.llm.components import components

LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
SHINGLE, SEED = 3, 42
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
RADIUS = 4
KEY_NODES = 20_000
EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("crowded", T.BooleanType())])


# fingerprints


def shingle_hashes(text: bytes) -> list[int]:
    words = text.translate(LOWER).split()
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:], strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is set if it is set in over half the hashes; as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array((fingerprint(shingle_hashes(t or b"")) for t in texts.cast(pa.binary()).to_pylist()), pa.int64())


# Golay keys


@cache
def _near_errors() -> tuple[np.ndarray, np.ndarray]:
    """starts, errors: errors[starts[s]:starts[s + 1]] are the error patterns of weight RADIUS at most with syndrome s."""
    errors = np.array([sum(1 << bit for bit in bits) for weight in range(RADIUS + 1) for bits in combinations(range(23), weight)])
    syndromes = _syndrome(errors)
    order = np.argsort(syndromes, kind="stable")
    return np.searchsorted(syndromes[order], np.arange(2049)), errors[order]


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word on division by the generator; zero for codewords."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def _message(codewords: np.ndarray) -> np.ndarray:
    """The index of each codeword: the quotient on division by the generator."""
    rest, quotient = codewords.copy(), np.zeros_like(codewords)
    for bit in range(22, 10, -1):
        top = rest >> bit & 1
        quotient |= top << (bit - 11)
        rest ^= np.where(top, GENERATOR << (bit - 11), 0)
    return quotient


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of the fingerprints."""
    bits = values.view(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    starts, errors = _near_errors()
    rows, keys = [], []
    for k, exact in enumerate(parts):
        other = parts[(k + 1) % 3]
        s = _syndrome(other)
        counts = starts[s + 1] - starts[s]
        row = np.repeat(np.arange(len(values)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[s][row]
        index = _message(other[row] ^ errors[at])
        rows.append(row)
        keys.append(((k << 22 | exact[row]) << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def wide_keys(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the wider radius: pairs of indices of near codewords of segment k and of the next. Of three segments with
    five errors at most two have two each at most, so fingerprints that differ in up to five bits share a key for some k;
    further ones often do, as codewords are shared by many words that differ in more than two bits."""
    bits = values.view(np.uint64)
    starts, errors = _near_errors()
    of = []
    for low, width in (SEGMENTS[k], SEGMENTS[(k + 1) % 3]):
        part = ((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = _syndrome(part)
        of.append((part, starts[s], starts[s + 1] - starts[s]))
    (one, first, n), (two, second, m) = of
    row = np.repeat(np.arange(len(values)), n * m)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    x, y = (_message(part[row] ^ errors[begin[row] + i]) for part, begin, i in ((one, first, at // m[row]), (two, second, at % m[row])))
    return row, (k << 24) | (x << 12) | y


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fp").to_numpy()
        for at in range(0, len(values), 10_000):
            part = values[at : at + 10_000]
            rows, keys = golay_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


# links


def _linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join fingerprints of one key to the smallest they reach by links among themselves."""
    fps = np.unique(fps)
    n = len(fps)
    if n <= 48:
        near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= 2
        a, b = np.nonzero(np.triu(near, 1))
    else:
        flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
        words = (fps.view(np.uint64)[:, None] ^ flips[None, :]).ravel()
        owner = np.repeat(np.arange(n), 65)
        order = np.argsort(words, kind="stable")
        same = words[order][1:] == words[order][:-1]
        a, b = owner[order][:-1][same], owner[order][1:][same]
    root = np.arange(n)
    while True:  # each takes the smallest root across its links, then roots of roots
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in the order of keys as rows of EDGES; nodes of a crowded key come marked, with themselves."""
    held_key, held, crowded = None, [], False

    def made(u: np.ndarray, v: np.ndarray, mark: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), mark))], names=["u", "v", "crowded"])

    def finished() -> Iterator[pa.RecordBatch]:
        if not crowded and held:
            fps = np.concatenate(held)
            if len(fps) > 1:
                yield made(*_linked(fps), False)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        several = np.diff(starts) > 1
        several[[0, -1]] = True  # the first run may go on from the last batch, the last into the next
        u, v = [], []
        for i in np.flatnonzero(several).tolist():
            run = fps[starts[i] : starts[i + 1]]
            key = int(keys[starts[i]])
            if key != held_key:
                yield from finished()
                held_key, held, crowded = key, [], False
            if i == len(starts) - 2 or i == 0:
                held.append(run)
                if crowded or sum(map(len, held)) > KEY_NODES:
                    for part in held:
                        yield made(part, part, True)
                    held, crowded = [], True
            else:
                one, two = _linked(run) if len(run) <= KEY_NODES else (run, run)
                if len(run) > KEY_NODES:
                    yield made(one, two, True)
                else:
                    u.append(one)
                    v.append(two)
        if u and sum(map(len, u)):
            yield made(np.concatenate(u), np.concatenate(v), False)
    yield from finished()


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp) that give their components."""
    keyed = nodes.select("fp").mapInArrow(_keyed, "key long, fp long")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_edges, EDGES), "links")
    crowd = found.filter("crowded").select(F.col("u").alias("fp")).distinct()
    words = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = crowd.select("fp", F.explode(words).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    more = met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u != v")
    return found.filter("NOT crowded").select("u", "v").union(more)


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (the fingerprint as a long) and component_id for every row of docs."""
    prints = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).select((F.col("root") + F.lit(0)).alias("_root"), "component_id")
    ids = materialize(rooted.join(least, F.col("root") == F.col("_root")).select("_fp", "component_id"), "components")
    return prints.join(ids, F.col("fp") == F.col("_fp")).select(F.col("doc_id").alias(doc_id), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
