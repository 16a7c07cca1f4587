import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmith.llm import components as K
from seriesmith.llm import simhash as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Smallest id of each component, links between prints that differ in two bits at most."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = list(prints)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = {}
    for p, ids in prints.items():
        groups.setdefault(find(p), []).extend(i for i in ids if i is not None)
    return {p: min(groups[find(p)], default=None) for p in prints}


def flip(value, bits):
    for b in bits:
        value ^= 1 << b
    return value


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", None, "one", "one two", "A b C", "a b c d", "É é A a \x1c b", *(" ".join(rng.choice("abcdeXY") for _ in range(rng.randint(3, 60))) for _ in range(50))]:
        assert S.fingerprint(S.shingle_hashes((text or "").encode())) == signed(brute_print(text))


def test_every_word_has_a_near_codeword():
    starts, errors = S._near_errors()
    assert len(starts) == 2049 and (np.diff(starts) >= 1).all() and len(errors) == 1 + 23 + 253 + 1771 + 8855
    words = np.random.default_rng(1).integers(0, 1 << 23, 1000)
    s = S._syndrome(words)
    code = words ^ errors[starts[s]]
    assert (S._syndrome(code) == 0).all() and len(np.unique(S._message(code))) > 400


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_linked_fingerprints_share_a_key(value, bits):
    pair = np.array([signed(value), signed(flip(value, bits))])
    rows, keys = S.golay_keys(pair)
    assert set(keys[rows == 0]) & set(keys[rows == 1])


def clustered(n_groups, size, seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(n_groups):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, size)):
            out.add(at)
            at = flip(at, rng.sample(range(64), rng.randint(1, 3)))
    return sorted(out)


@pytest.mark.parametrize("n", [10, 400])
def test_linking_in_a_group(n):
    prints = clustered(max(1, n // 20), 25, n)
    fps = np.array([signed(p) for p in prints])
    u, v = S._linked(fps)
    expected = brute_components({p: [i] for i, p in enumerate(prints)})
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    got = {}
    for p in fps.tolist():
        got.setdefault(root.get(p, p), set()).add(p)
    want = {}
    for p, c in expected.items():
        want.setdefault(c, set()).add(signed(p))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("limit", [20_000, 3])
def test_links_and_crowded_keys(spark, monkeypatch, limit):
    """With few nodes to a key all work goes through the words in a shuffle."""
    prints = clustered(40, 12, 7)
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    before = S._edges

    def edges(batches):
        S.KEY_NODES = limit  # in the worker
        return before(batches)

    monkeypatch.setattr(S, "_edges", edges)
    roots = {r["node"]: r["root"] for r in K.components(S.links(nodes)).collect()}
    expected = brute_components({p: [i] for i, p in enumerate(prints)})
    for a in prints:
        for b in prints:
            same = roots.get(signed(a), signed(a)) == roots.get(signed(b), signed(b))
            assert same == (expected[a] == expected[b])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000), (7, 3)] + [(-5, 2000), (2000, 2001)]
    got = {r["node"]: r["root"] for r in K.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + k] == 1000 for k in range(50)) and got[2001] == -5
    assert K.components(spark.createDataFrame([], "u long, v long")).count() == 0


def check(rows, got):
    prints = {}
    for i, t in rows:
        prints.setdefault(brute_print(t), []).append(i)
    expected = brute_components(prints)
    want = sorted(((i, f"{brute_print(t):016x}", expected[brute_print(t)]) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["f"], r["component_id"]) for r in got), key=str) == want


def documents():
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(150)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        for _ in range(12):
            edited = list(words)
            for _ in range(rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = f"e{rng.randint(0, 99)}"
            rows.append((len(rows) + 10 * k, " ".join(edited)))
    return rows + [(900, ""), (901, None), (902, " \n"), (None, ""), (903, "one"), (903, "ONE"), (None, "lone words here now"), (904, "long " * 100_000)]


def test_documents(table):
    rows = documents()
    docs = table(rows, "doc_id long, text string")
    got = S.near_dedup(docs).withColumn("f", S.hex_digits(F.col("fp"))).collect()
    check(rows, got)
    assert S.near_dedup(docs.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("x"))).columns == ["doc_id", "fp", "component_id"]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = S.near_dedup(docs).withColumn("f", S.hex_digits(F.col("fp"))).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    assert S.near_dedup(docs.limit(0)).count() == 0
