import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from seriesmith.llm import jaccard as J
from seriesmith.llm import simhash as S
from seriesmith.llm.common import shared_dir


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each component, links between sets of similarity 0.8 or more."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, a) in enumerate(sets):
        for m, (_, b) in enumerate(sets[:k]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[find(k)] = find(m)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] for k, (i, _) in enumerate(sets)}


def documents(groups=8, copies=14):
    """Copies with 0 to 6 words changed, around the bound of 0.8, and a long common sentence."""
    rng = random.Random(4)
    common = " ".join(f"c{k}" for k in range(12))
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([60, 150, 400]))]
        for _ in range(copies):
            edited = list(base)
            for at in rng.sample(range(len(edited)), rng.randint(0, 6)):
                edited[at] = f"E{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(edited) + (" " + common if g % 2 else "")))
    return rows + [(900, ""), (901, None), (902, "One two"), (903, "one TWO"), (904, "one two three"), (905, "long " * 3000)]


@pytest.mark.parametrize(("few", "block"), [(J.FEW, J.BLOCK), (2, J.BLOCK), (2, 5)])
def test_components(table, monkeypatch, few, block):
    """With few nodes to a key most keys are crowded; with small blocks they are dealt to many tasks."""
    rows = documents()
    monkeypatch.setattr(J, "FEW", few)
    got = {r["doc_id"]: r["component_id"] for r in J.near_dedup(table(rows, "doc_id long, text string"), block=block).collect()}
    assert got == brute(rows)
    assert 8 < len(set(got.values())) < 80


def test_repeated_ids_with_different_texts(table):
    """Two unlike texts with the same id are both kept; of equal rows one is."""
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(1, texts["a"]), (1, texts["b"]), (2, texts["a"]), (3, texts["c"]), (3, texts["c"]), (4, texts["b"]), (None, texts["a"])]
    docs = table([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, _row int, _box string")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["_row"]) for r in kept.collect()), key=str) == sorted(((i, texts[k], 7) for i, k in [(1, "a"), (1, "b"), (3, "c"), (None, "a")]), key=str)


def test_filters_keep_similar_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 4, 5, 9, 100, 3000):
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a = np.sort(rng.choice(pool, n, replace=False))
            out = rng.random(n) < rng.uniform(0, 0.25)
            b = np.unique(np.concatenate([a[~out], rng.choice(pool, int(out.sum()))]))
            bits = [np.frombuffer(J.sketch(x), np.uint64) for x in (a, b)]
            distance = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert J.similar(a, b) == (5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)))
            if J.similar(a, b):
                assert len(np.intersect1d(J.prefix(a), J.prefix(b))) and 9 * distance <= len(a) + len(b)
                assert 9 * J.apart(J.wide(a), J.wide(b)) <= len(a) + len(b)


def test_the_stage_drops_copies_with_some_edits(spark, table):
    """One changed word in 50 leaves 41 of 51 shingles: 0.80, far beyond two bits of the 3-word fingerprint."""
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(words), " ".join([*words[:20], "x", *words[21:]]), " ".join([*words[:20], "x", "y", *words[22:]]), None]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0)]
    docs = table(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_stage(spark, docs, "")
    want = sorted({c for c in brute(list(enumerate(texts))).values()})
    assert want == [0, 3] and kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [*want, None]
    assert P.near_stage(spark, docs.limit(0), "").count() == 0


def edited_documents(groups=6):
    """Pairs of 400 words that differ in one."""
    texts = [[f"g{g}w{k}" for k in range(400)] for g in range(groups)]
    return [(2 * g + k, " ".join([*t[:200], f"x{k}", *t[201:]])) for g, t in enumerate(texts) for k in range(2)]


def test_golay_keys_link_without_the_prefix_filter(spark, table, monkeypatch):
    monkeypatch.setattr(J, "_keyed", lambda nodes: spark.createDataFrame([], J.MET))
    rows = edited_documents()
    got = {r["doc_id"]: r["component_id"] for r in J.near_dedup(table(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and set(got.values()) == set(range(0, 12, 2))


def test_wide_keys_meet_within_five_bits():
    rng = np.random.default_rng(2)
    one = rng.integers(-(2**63), 2**63 - 1, 200)
    two = one.copy()
    for i in range(len(two)):
        for bit in rng.choice(64, 5, replace=False):
            two[i] ^= np.array([1 << int(bit)], np.uint64).view(np.int64)[0]
    met = set()
    for k in range(3):
        mine, others = (set(zip(*(x.tolist() for x in S.wide_keys(v, k)), strict=True)) for v in (one, two))
        met |= {row for row, _ in mine & others}
    assert met == set(range(200))


def test_the_nearest_under_a_key():
    """Under key 1 the third is two bits from the first; under 2 the two are too far apart."""
    batches = [pa.record_batch({"key": pa.array([1, 1], pa.int64()), "fp": pa.array([0, 2**40 - 1], pa.int64())}), pa.record_batch({"key": pa.array([1, 2, 2], pa.int64()), "fp": pa.array([3, 5, 2**50 - 1], pa.int64())})]
    assert [tuple(r.values()) for b in J._nearest(iter(batches)) for r in b.to_pylist()] == [(0, 3)]


def test_the_stage_deletes_its_work_tables(spark, table):
    """Only what the result is read from stays on disk: rows, ids, components, and small tables of links."""
    folder = f"{shared_dir(spark).removeprefix('file:')}/seriesmith"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = documents(groups=2)
    kept = P.near_stage(spark, table([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "")
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "rows" in left and not left & {"sets-of", "nodes", "leads", "met", "close", "used", "sets", "pairs"}
    assert {r["doc_id"] for r in kept.collect()} == set(brute(rows).values())


def test_a_common_passage_is_no_key(table):
    """Unlike documents that share a passage share no key, so they make no pairs, however many they are."""
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(100)) + " " + passage) for i in range(40)]
    docs = table(rows, "_row long, _text string")
    common = J._common(docs)
    assert len(common[0]) == 26
    nodes = docs.select(J._node(common)(F.col("_text")).alias("p")).select("p.*")
    assert J._keyed(nodes).count() == 0


def test_any_order_keeps_similar_pairs():
    rng = np.random.default_rng(3)
    for n in (1, 5, 30, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.92], rng.integers(0, 2**63, max(1, n // 12)).astype(np.uint64)]))
            common = np.unique(rng.choice(np.concatenate([a, b]), n))
            common = common, rng.permutation(len(common))
            if len(b) and J.similar(a, b):
                assert len(np.intersect1d(J.prefix(a, common), J.prefix(b, common)))


def test_group_pairs_compare_wide_sketches():
    """All pairs of a key by brute force, among them long unlike sets that 512 bits can't tell apart."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (300, 400, 450, 500, 520, 600, 3000, 3000, 4000, 4090, 4100, 5000)]
    sets += [np.unique(np.concatenate([s[: -len(s) // 20], rng.integers(0, 2**63, 9).astype(np.uint64)])) for s in sets]
    sets.sort(key=len)
    sizes, labels = np.array(list(map(len, sets))), np.arange(len(sets))
    i, j = J.group_pairs(sizes, [J.wide(s) for s in sets], labels, np.zeros(len(sets), np.int64), 2)
    far = lambda a, b: 9 * J.apart(J.wide(a), J.wide(b)) <= len(a) + len(b) and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b))
    want = {(x, y) for x in labels.tolist() for y in range(x) if far(sets[x], sets[y])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) < 20


def test_hashes_that_the_sample_misses_are_no_keys(table, monkeypatch):
    """Unlike documents, twenty to a passage: a sample of about ten of 200 can't know the passages, and each was a crowded key.
    Pairs of near copies among them are found all the same."""
    monkeypatch.setattr(J, "SAMPLE", 10)
    keyed, crowded = J._keyed, []

    def counted(nodes):
        met = keyed(nodes)
        crowded.append(met.filter("b IS NULL").count())
        return met

    monkeypatch.setattr(J, "_keyed", counted)
    words = [[f"d{i}w{k}" for k in range(150)] + [f"p{i % 10}w{k}" for k in range(60)] for i in range(200)]
    words += [[*w[:70], "x", *w[71:]] for w in words[:30]] + [[*w[:9], "y", *w[10:50], "z", "z", *w[52:]] for w in words[20:40]]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    got = {r["doc_id"]: r["component_id"] for r in J.near_dedup(table(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) == 200
    assert crowded == [0]


@pytest.mark.parametrize(("part", "held"), [(J.PART_HASHES, J.HELD_HASHES), (500, 3000)])
def test_rare_keys_are_the_first_by_count(table, monkeypatch, part, held):
    monkeypatch.setattr(J, "PART_HASHES", part)
    monkeypatch.setattr(J, "HELD_HASHES", held)
    texts = [(300 * i, t) for i, (_, t) in enumerate(documents(groups=4))]
    sets = [J.shingle_set((t or "").encode()) for _, t in texts]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    most = every[counts == counts.max()]
    common = (most, np.arange(len(most)))
    rows = table(texts, "_row long, _text string").repartition(3)
    nodes = rows.select(F.struct(F.col("_row").alias("doc_id"), F.col("_row").alias("row")).alias("lead"), J._node(common)(F.col("_text")).alias("p")).select("lead", "p.*")
    got = {r["lead"]["row"]: r["keys"] for r in J._rare_keys(nodes, rows, common, sum(map(len, sets))).collect()}
    bits = max(1, (sum(map(len, sets)) // part).bit_length())
    n = dict(zip(every.tolist(), counts.tolist(), strict=True))
    last = {x: k for k, x in enumerate(most.tolist())}
    for (i, _), h in zip(texts, sets, strict=True):
        first = sorted(h.tolist(), key=lambda x: (last.get(x, -1), n[x], x))[: J.first_keys(len(h))]
        upper = lambda xs: set((np.array(sorted(xs), np.uint64) >> np.uint64(32 - bits) << np.uint64(32 - bits)).view(np.int64).tolist())
        assert upper(x for x in first if n[x] > 1) <= set(got[i]) <= upper(first), i
