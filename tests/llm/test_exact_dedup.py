import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seriesmith.llm import exact_dedup as D

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows):
    norm = [(i, (t or "").translate(str.maketrans(UPPER, LOWER))) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def check(rows, got):
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({x[3] for x in brute(rows)}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


ROWS = [(5, "Abc"), (3, "aBC"), (9, "abc"), (1, "Ébc"), (2, "ébc"), (4, None), (6, ""), (9, "abc"), (None, "x"), (None, "X"), (None, None), (7, "abc "), (8, "z" * 300_000), (11, "Z" * 300_000)]


@pytest.mark.parametrize("parts", [1, 3])
def test_brute_force(table, parts):
    check(ROWS, D.dedup(table(ROWS, "doc_id long, text string").repartition(parts)).collect())


def test_hot_group_splits_and_flushes(table, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "HOT text" if i % 3 else f"t{rng.randint(0, 400)}") for i in range(2500)]
    docs = table(rows, "doc_id long, text string").repartition(5)
    check(rows, D.dedup(docs).collect())
    monkeypatch.setattr(D, "HOT_ENTRIES", 1)  # each text that two tasks have is merged in groups
    check(rows, D.dedup(docs).collect())
    check(ROWS, D.dedup(table(ROWS, "doc_id long, text string").repartition(6)).collect())


def test_few_rows_at_once(table, monkeypatch):
    """Batches of texts have a thousand rows at most, to and from Python."""

    def few(made):
        def checked(batches):
            def seen(some):
                for batch in some:
                    assert batch.num_rows <= 1000, batch.num_rows
                    yield batch

            yield from seen(made(seen(batches)))

        return checked

    for name in "collapse", "merge", "chain":
        monkeypatch.setattr(D, name, few(getattr(D, name)))
    rows = [(i, f"Text {i % 2400}") for i in range(2500)]
    check(rows, D.dedup(table(rows, "doc_id long, text string").coalesce(1)).collect())


def test_merge_keeps_texts_apart():
    import pyarrow as pa

    entries = [(7, 0, 1, 2, 10, b"a"), (7, 0, 2, 1, 30, b"b"), (7, 0, 3, 1, 20, b"a"), (7, 1, 4, 1, None, b"a")]
    columns = list(zip(*entries, strict=True))
    names = ["key", "salt", "entry", "n", "top", "text"]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=names)
    out = [r for b in D.merge(iter([batch[:2], batch[2:]])) for r in b.to_pylist()]
    assert {r["entry"]: (r["into"], r["best"], r["n"], r["top"], r["text"]) for r in out} == {
        1: (3, False, 3, 20, b"a"), 3: (3, True, None, None, None), 2: (2, True, 1, 30, b"b"), 4: (4, True, 1, None, b"a"),
    }


def test_collisions_are_chained(spark):
    import pyarrow as pa

    entries = [(7, 1, 2, 10, b"a"), (7, 2, 1, 30, b"b"), (7, 3, 1, 20, b"a"), (8, 4, 1, None, b"a"), (9, 5, 1, 5, b""), (9, 6, 1, 5, b"")]
    columns = list(zip(*entries, strict=True))
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["key", "entry", "n", "top", "text"])
    for cut in range(len(entries) + 1):
        out = [r for b in D.chain(iter([batch[:cut], batch[cut:]])) for r in b.to_pylist()]
        assert {r["entry"]: (r["keep_id"], r["group_size"], r["winner"]) for r in out} == {1: (20, 3, False), 3: (20, 3, True), 2: (30, 1, True), 4: (None, 1, True), 5: (5, 2, True), 6: (5, 2, False)}


def test_directory():
    rng = random.Random(6)
    cells = {c: (rng.randint(1, 50), False) for c in rng.sample(range(1 << 8), 120)}
    cells[3] = (10_000, True)  # one key too large to split
    d = D.Directory(cells, 200, max_depth=8)
    assert len(d.slots) == 1 << d.depth
    load, depth_of = {}, {}
    for c, (size, _) in cells.items():
        b = d.slots[c >> (8 - d.depth)]
        load[b] = load.get(b, 0) + size
        depth_of.setdefault((b, c >> (8 - d.local[b])), []).append(c)
    assert len(depth_of) == len(load), "a bucket is one range of keys"
    assert all(size <= 200 for b, size in load.items() if b != d.slots[3 >> (8 - d.depth)])
    firsts = list(dict.fromkeys(d.slots))
    assert firsts == sorted(firsts) and d.slots == sorted(d.slots), "buckets are ranges of keys in order"
    assert D.Directory({}, 10, 8).slots == [0]


def test_edges(table):
    docs = table(ROWS, "doc_id long, text string")
    assert D.dedup(docs.limit(0)).count() == 0
    clash = docs.withColumn("kept", F.lit("x")).withColumn("entry", F.lit("y")).withColumn("key", F.lit(0))
    check(ROWS, D.dedup(clash).collect())


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in docs.collect()], D.dedup(docs).collect())
