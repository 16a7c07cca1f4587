import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seriesmith.llm import mixing as M

SCHEMA = "doc_id long, source string, text string"


def brute_targets(sizes, share=1.5, cap=2.0):
    """Iterative sharing: targets above their cap are set to it, and the excess is shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > cap * sizes[s]}
        if not over:
            return {**out, **{s: unit * weight[s] for s in open_}}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def docs_of(table, n=400):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "d"]), " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    rows += [(1000, "z", "only one here"), (1001, "empty", ""), (1002, "empty", None)]
    return rows, table(rows, SCHEMA)


def test_targets_and_taken(table):
    rows, docs = docs_of(table)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    expected = brute_targets(sizes)
    got = M.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r, (i, s, t) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows, key=lambda r: r[0]), strict=True):
        assert r["doc_id"] == i and r["size"] == words(t) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[s] = by.get(s, 0) + r["taken"]
    for s, taken in by.items():
        assert abs(taken - expected[s]) <= 60, s
    again = {(r["doc_id"], r["taken"]) for r in M.mix_sizes(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    mixed = {r["doc_id"]: r["n"] for r in M.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(mixed.get(r["doc_id"], 0) * r["size"] == r["taken"] for r in got)
    assert M.mix(docs).columns == docs.columns


def test_thresholds_nest(table):
    _, docs = docs_of(table)
    small, large = ({r["doc_id"] for r in M.mix_sizes(docs, share=s, cap=1.0).filter("taken > 0").collect()} for s in (0.3, 0.6))
    assert small < large


def test_hash_is_what_md5_says(table):
    got = table([(7, "", "")], SCHEMA).select(M.hash_of(F.col("doc_id"))).first()[0]
    assert got == int(hashlib.md5(b"7").hexdigest()[:15], 16)


def test_hot_source_and_ties(table):
    rows = [(i, "hot", "w " * 10) for i in range(3000)] + [(10_000 + i, f"s{i % 20}", "w " * 10) for i in range(600)]
    got = M.mix_sizes(table(rows, SCHEMA)).filter("source = 'hot'").agg(F.sum("taken"), F.first("target")).first()
    assert abs(got[0] - got[1]) <= 10
    same = [(1, "a", "w w w")] * 50 + [(None, "a", "w")] * 5 + [(2, "b", "x " * 400)]
    got = M.mix_sizes(table(same, SCHEMA))
    assert got.count() == 56 and got.filter("taken > 2 * size").count() == 0


def test_edges(table):
    _, docs = docs_of(table)
    assert M.mix_sizes(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0
    clash = docs.withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("_hash", F.lit(2)).withColumn("source_of", F.lit(3))
    assert M.mix(clash).columns == clash.columns and dict(M.mix_sizes(clash).dtypes)["size"] == "bigint"
    assert M.mix_sizes(table([(1, "a", None), (2, "a", "")], SCHEMA)).agg(F.sum("taken")).first()[0] == 0
