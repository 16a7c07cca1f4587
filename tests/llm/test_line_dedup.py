import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seriesmith.llm import line_dedup as L


def n_words(line):
    return len(line.encode().split())


def brute(rows, least):
    """Texts without the lines of every run of least words that occurred earlier, by comparing all runs."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    lines = {r: [(k, x) for k, x in enumerate((rows[r][1] or "").split("\n")) if n_words(x)] for r in order}
    first, gone = {}, {r: set() for r in order}
    runs = []
    for when, r in enumerate(order):
        for i in range(len(lines[r])):
            total = 0
            for j in range(i, len(lines[r])):
                total += n_words(lines[r][j][1])
                if total >= least:
                    run = tuple(x for _, x in lines[r][i : j + 1])
                    runs.append((r, i, j, run))
                    first.setdefault(run, (when, i))
    at = {r: when for when, r in enumerate(order)}
    for r, i, j, run in runs:
        if first[run] < (at[r], i):
            gone[r].update(lines[r][k][0] for k in range(i, j + 1))
    return [t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r]) for r, (_, t) in enumerate(rows)]


def rows_of(seed, n=30):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.randint(1, 9))) for _ in range(12)]
    out = []
    for i in range(n):
        lines = []
        while rng.random() < 0.85 and len(lines) < 14:
            if rng.random() < 0.4:
                at = rng.randrange(len(pool) - 3)
                lines += pool[at : at + rng.randint(1, 4)]
            else:
                lines.append(rng.choice(["", " ", "x y z", f"own line {rng.randint(0, 10**6)}"]))
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize(("seed", "group"), [(0, L.GROUP), (1, L.GROUP), (2, 1), (3, 4)])
def test_brute_force(table, monkeypatch, seed, group):
    """With small groups all rounds, or some, are joins."""
    monkeypatch.setattr(L, "GROUP", group)
    rows = rows_of(seed)
    rows[3] = (3, None)
    rows[5] = (None, rows[4][1])
    docs = table(rows, "doc_id long, text string").coalesce(1)
    got = L.clean(docs.withColumn("k", F.monotonically_increasing_id()), min_words=10).orderBy("k").collect()
    assert [r["text"] for r in got] == brute(rows, 10)
    assert sum(len(a[1] or "") != len(r["text"] or "") for a, r in zip(rows, got, strict=True)) > 3


def test_selected_minima_cover_runs():
    rng = random.Random(1)
    n_lines = n_selected = 0
    for _ in range(300):
        words = [rng.randint(1, 9) for _ in range(rng.randint(1, 40))]
        hashes = [bytes([rng.randint(0, 5)]) * L.HASH for _ in words]
        got = L.windows(words, 12)
        want = {}
        for i, j in got:
            assert sum(words[i : j + 1]) >= 12 and (sum(words[i:j]) < 12 or sum(words[i + 1 : j + 1]) < 12)
            place = max(k for k in range(i, j + 1) if hashes[k] == min(hashes[i : j + 1]))
            low, high = want.get(place, (i, j))
            want[place] = (min(low, i), max(high, j))
        assert L.winnow(hashes, words, 12) == want
        if sum(words) >= 12:
            assert {k for i, j in got for k in range(i, j + 1)} == set(range(len(words)))
        n_lines, n_selected = n_lines + len(words), n_selected + len(want)
    assert n_selected < 0.8 * n_lines, "only minima are selected"


def test_matches_are_extended_both_ways():
    a, b = (b"".join(bytes([x]) * L.HASH for x in text) for text in (b"abcdefg", b"xbcdez"))
    assert L.extend(a, 3, b, 3) == (2, 1) and L.extend(a, 3, a, 3) == (3, 3)
    assert L.extend(a, 6, a, 0) == (0, 0) and L.extend(a, 0, b, 5) == (0, 0)


@pytest.mark.parametrize(("least", "group"), [(10, L.GROUP), (16, L.GROUP), (10, 20)])
def test_partners_other_than_the_first(table, monkeypatch, least, group):
    """Documents that share a line with all others, but longer runs around it with some only."""
    monkeypatch.setattr(L, "GROUP", group)
    rng = random.Random(least)
    line = lambda k: f"l{k} " + "w " * (k % 4)
    rows = []
    for i in range(120):
        before, behind = ([line(rng.choice([10 * k, 10 * k + 1, 10 * k + 2])) for k in range(side, side + 6)] for side in (10, 50))
        rows.append((i, "\n".join([*before, "common to all", *behind])))
    got = L.clean(table(rows, "doc_id long, text string"), min_words=least).orderBy("doc_id").collect()
    want = brute(rows, least)
    assert [r["text"] for r in got] == want and sum(w != t for w, (_, t) in zip(want, rows, strict=True)) > 20


def test_extension_is_needed(table, monkeypatch):
    rows = rows_of(1)
    docs = table(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(L, "GROUP", 1)  # else tasks import their own
    monkeypatch.setattr(L, "extend", lambda *_: (0, 0))
    assert [r["text"] for r in L.clean(docs, min_words=10).orderBy("doc_id").collect()] != brute(rows, 10)


def test_long_passage_and_counts(table):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"v{rng.randint(0, 10**9)}" for _ in range(n))
    passage = fresh(60)
    two = [fresh(30), fresh(30)]
    rows = [(i, "\n".join([fresh(20), passage, fresh(20)])) for i in range(40)] + [(100 + i, "\n".join([fresh(5), *two, "The end."])) for i in range(3)] + [(200, "The end."), (201, "The end.")]
    got = {r["doc_id"]: r for r in L.dedup_lines(table(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"].count("\n") == 2 and all(passage not in got[i]["text"] and got[i]["n_deleted"] == 1 for i in range(1, 40))
    assert got[101]["n_deleted"] == got[102]["n_deleted"] == 3, "the end belongs to the run"
    assert got[100]["n_deleted"] == 0 and got[201]["text"] == "The end." and got[201]["n_lines"] == 1


def test_edges(table):
    docs = table([(1, "a " * 60), (1, "a " * 60), (2, ""), (3, None), (4, "\n".join(["b " * 60] * 3))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_lines"], r["n_deleted"], r["text"] and len(r["text"])) for r in L.dedup_lines(docs.withColumn("n_lines", F.lit("x"))).collect())
    assert [g[:3] for g in got] == [(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 3, 2)]
    assert L.clean(docs.limit(0)).count() == 0 and L.clean(docs.withColumn("first", F.lit(1))).columns == ["doc_id", "text", "first"]
    clash = docs.withColumns({c: F.lit(1) for c in ("_row", "_id", "_lines", "_text", "runs", "_box")})
    assert L.clean(clash).columns == clash.columns and L.clean(clash).count() == 5


def test_few_texts_are_sent_to_python_at_once(table, monkeypatch):
    """Up to a thousand, whatever Spark's setting is, and at the end only those that lose lines."""
    in_slices = L.in_slices

    def counted(made, texts, *columns):
        assert len(texts) - texts.null_count <= 1000, "too many texts at once"
        return in_slices(made, texts, *columns)

    monkeypatch.setattr(L, "in_slices", counted)
    passage = "again " * 60
    rows = [(i, f"own {i}\n{passage}" if i % 50 == 0 else f"own {i}") for i in range(2500)]
    got = L.dedup_lines(table(rows, "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [rows[0][1]] + [f"own {i}" for i in range(1, 2500)]


def test_row_groups_of_lines_are_small(table, monkeypatch):
    """A task holds a whole row group, so not all of its texts are in one."""
    materialize, sizes = L.materialize, []

    def measured(df, tag, *settings):
        made = materialize(df, tag, *settings)
        if tag == "lines":
            for path in made.inputFiles():
                meta = pq.ParquetFile(path.removeprefix("file://")).metadata
                groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                sizes.extend(sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups)
        return made

    monkeypatch.setattr(L, "materialize", measured)
    rng = random.Random(3)
    rows = [(i, rng.randbytes(15_000).hex()) for i in range(1200)]
    assert L.clean(table(rows, "doc_id long, text string").coalesce(1)).count() == 1200
    assert sum(sizes) > 20 << 20 and max(sizes) < 10 << 20


def test_next_groups_share_more():
    """A run that is no longer than the group's gives no group, or rounds would not end."""
    context, words = b"".join(bytes([x]) * L.HASH for x in b"abcde"), [1] * 5
    assert {g[1:] for g in L.further(context, 2, words, 1, 1, 1, 1, 10)} == {(2, 1), (1, 2)}
    assert L.further(context, 2, words, 1, 1, 0, 0, 10) == []
