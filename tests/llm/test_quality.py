import random
import re

import pytest
from pyspark.sql import functions as F

from seriesmith.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measure():
    rng = random.Random(3)
    cases = ["", None, "a b c d e f a b c d e", "x " * 30, "a\n\n\na\n \n b\n b", "\x1c \x85 é　ß", "# $ % & | < > *"]
    cases += ["".join(rng.choice("ab \n\t#é\x1f") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for text in cases:
        assert Q.measure(text) == brute(text), repr(text)


def docs_of(table, bad_host=12):
    rng = random.Random(1)
    good = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))
    rows = [(i, good(), f"good{i % 5}") for i in range(60)] + [(100 + i, "too short", "bad") for i in range(bad_host)] + [(200, good(), "bad"), (201, "one short", "lone"), (202, good(), None), (203, None, None), (204, "", "good1")]
    return table(rows, "doc_id long, text string, source string")


def test_host_verdicts(table):
    got = {r["doc_id"]: r for r in Q.score(docs_of(table)).collect()}
    assert len(got) == 77
    assert all(got[i]["kept"] for i in range(60))
    assert got[200]["base_failed"] is False and got[200]["kept"] is False, "its host fails"
    assert got[201]["host_kept"] in (True, False) and got[201]["kept"] is False
    assert got[203]["n_words"] == 0 and not got[203]["kept"]
    kept = {r["doc_id"] for r in Q.keep(docs_of(table)).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_a_lone_document_does_not_condemn_its_host(table):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) if i % 10 else "short", f"h{i % 7}") for i in range(400)] + [(999, "short", "new")]
    hosts = {r["host"]: r for r in Q.host_verdicts(table(rows, "doc_id long, text string, source string").select("source", Q.measured(F.col("text")).alias("_m")), "source", 0.5).collect()}
    assert hosts["new"]["host_docs"] == 1 and hosts["new"]["rate_few_words"] < 0.5 and hosts["new"]["host_kept"]


def test_prior():
    a, b = Q.prior(0.2, 1000.0, 10.0, 10 * 100.0**2, sum((20.0) ** 2 / 100 for _ in range(10)))
    assert a / (a + b) == pytest.approx(0.2) and a + b == pytest.approx(Q.MAX_STRENGTH, rel=1e-3)
    a, b = Q.prior(0.5, 200.0, 2.0, 2 * 100.0**2, 90.0**2 / 100 + 10.0**2 / 100)
    assert 0 < a + b < 5


def test_edges(table):
    empty = docs_of(table).limit(0)
    assert Q.score(empty).count() == 0 and Q.keep(empty).count() == 0
    clash = docs_of(table).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    assert dict(Q.score(clash).dtypes)["kept"] == "boolean"
    assert Q.keep(clash).columns == clash.columns
    twice = docs_of(table).union(docs_of(table))
    assert Q.score(twice).count() == 154
    long = table([(1, "abc def " * 300_000, "s")], "doc_id long, text string, source string")
    assert Q.score(long).first()["n_words"] == 600_000
