import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesmith.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_same_ids_as_the_library(plain, spark, sf):
    rng = random.Random(1)
    letters = "aAbÉé İſK'sll 've ́ \x85\x1c\x00\n\t12߅１!?Σσς×÷ßĸŉ'd'm're_-ĳǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["x <|endoftext|>y <|startoftext|>", "", " ", "á ́a"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    mine = P.WordTokenizer(PATH)
    assert mine.plain
    for text, ids in zip(texts, mine.encode([t.encode() for t in texts]), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(P, "WORDS_KEPT", 50)
    mine = P.WordTokenizer(PATH)
    texts = [f"w{i} v{i % 7} tail".encode() for i in range(400)]
    first = list(mine.encode(texts))
    assert len(mine.known) <= 60 and len(mine.older) <= 60 and first == list(mine.encode(texts))


def test_best_fit_and_bounds():
    rng = random.Random(2)
    for _ in range(200):
        x = np.array([rng.randint(1, 50) for _ in range(rng.randint(1, 40))])
        bins, places = P.best_fit(x, 50)
        check_bins(x, bins, places, 50)
        assert P.lower_bound(np.bincount(x, minlength=51), 50) <= bins.max() + 1
    six = np.array([26] * 7)
    assert P.lower_bound(np.bincount(six, minlength=51), 50) == 7, "two never fit, which sums don't show"
    thirds = np.array([17] * 9)
    assert P.lower_bound(np.bincount(thirds, minlength=51), 50) == 5


def check_bins(x, bins, places, capacity):
    for b in set(bins):
        inside = sorted(zip(places[bins == b], x[bins == b], strict=True))
        at = 0
        for place, size in inside:
            assert place == at
            at += size
        assert at <= capacity


def brute(plain, rows):
    out = []
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        out += [(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096)) for part in [ids[at : at + 4096]]]
    return sorted(out, key=str)


def check(plain, rows, got):
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == brute(plain, rows)
    x, bins, places = (np.array([r[c] for r in got]) for c in ("length", "sequence_id", "offset"))
    check_bins(x, bins, places, 4096)
    return len(set(bins)), P.lower_bound(np.bincount(x, minlength=4097), 4096)


def test_documents(plain, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, bound = check(plain, [(r["doc_id"], r["text"]) for r in docs.collect()], P.pack(docs.repartition(6), PATH).collect())
    assert used <= bound + 1


def test_exchange_closes_gaps(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "a " * rng.choice([900, 1500, 2500, 40])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = P.pack(docs, PATH, chunk=20).collect()
    x, bins, places = (np.array([r[c] for r in got]) for c in ("length", "sequence_id", "offset"))
    check_bins(x, bins, places, 4096)
    assert len(x) == 240 and len(set(bins)) <= 1.1 * P.lower_bound(np.bincount(x, minlength=4097), 4096)


def test_repack_is_never_worse():
    rng = random.Random(5)
    for _ in range(50):
        x = np.array([rng.randint(1, 4096) for _ in range(40)])
        old, _ = P.best_fit(x[::-1].copy(), 4096)
        old = old[::-1] + 7
        bins, places, certified = P._repack(x, old, 4096)
        check_bins(x, bins, places, 4096)
        assert len(set(bins)) <= len(set(old))
        assert certified == (len(set(bins)) == P.lower_bound(np.bincount(x, minlength=4097), 4096))


def test_only_groups_that_are_not_settled_stay_open():
    import pyarrow as pa

    class Task:
        def partitionId(self):
            return 3

    def packed(lengths):
        batch = pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["length"])
        before, P.TaskContext = P.TaskContext, type("Context", (), {"get": staticmethod(Task)})
        rows = [r for b in P._packer(4096, 10_000, 0, False, True)(iter([batch])) for r in b.to_pylist()]
        P.TaskContext = before
        return rows

    full = packed([4096] * 50)
    assert all(r["certified"] and not r["open"] for r in full)
    few = packed([1000])
    assert few[0]["certified"] and few[0]["open"], "alone no packing is better, but its bin can be shared"
    large = packed([1024] * 4002)
    assert all(r["certified"] and not r["open"] for r in large), "a gap of half a bin in 1001"
    apart = packed([2049] * 30)
    assert all(r["certified"] and r["open"] for r in apart)


def test_edges(plain, table):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "word " * 9000), (4, "né " * 10)]
    docs = table(rows, "doc_id long, text string")
    check(plain, rows, P.pack(docs, PATH).collect())
    assert P.pack(docs.limit(0), PATH).count() == 0
    clash = docs.withColumn("length", F.lit("q")).withColumn("open", F.lit(1)).withColumn("sequence_id", F.lit("q"))
    got = P.pack(clash, PATH)
    assert got.count() == 8 and "open" in got.columns and dict(got.dtypes)["length"] == "bigint"
