"""The pipeline against the stages' brute-force definitions, and the queries over whole tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as P
from seriesmith.llm import line_dedup, packing
from seriesmith.llm.common import materialize, stage_scratch
from tests.llm.test_jaccard import brute as brute_near
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import brute_targets, words
from tests.llm.test_quality import brute as brute_quality


def corpus(spark, path):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"v{rng.randint(0, 10**9)}" for _ in range(n))
    passage = fresh(70)
    rows = [(i, fresh(rng.randint(20, 200)) + ("\n" + passage if i % 5 == 0 else ""), "en", f"s{i % 4}", i) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(10)] + [(200, "short", "en", "s0", 0), (201, "same same " * 30, "en", "s0", 0), (202, None, "en", None, None)]
    rows += [(300, fresh(5000), "en", "s2", 0)]
    near = fresh(90).split()
    rows += [(400 + i, " ".join([*near[: 10 * i], f"x{i}", *near[10 * i + 1 :]]), "en", "s3", 0) for i in range(5)]  # a word apart: similarity 0.9 or less
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return [(r[0], r[1], r[3]) for r in rows]


def test_run(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    got = P.run(spark, str(tmp_path)).collect()

    kept = []
    for i, t, s in rows:
        n, _, _, _, repeats = brute_quality(t)
        if n >= 10 and 100 * repeats <= 20 * n:
            kept.append((i, t, s))
    cleaned = brute_lines([(i, t) for i, t, _ in kept], 50)
    kept = [(i, t, s) for (i, _, s), t in zip(kept, cleaned, strict=True)]
    least = brute_near([(i, t) for i, t, _ in kept])
    kept = [(i, t, s) for i, t, s in kept if least[i] == i]
    sizes = {}
    for _, t, s in kept:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets = brute_targets(sizes)

    copies = {}
    for r in got:
        if r["piece"] == 0:
            copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies) <= {i for i, _, _ in kept} and max(copies.values()) <= 2
    for s, target in targets.items():
        taken = sum(copies.get(i, 0) * words(t) for i, t, x in kept if x == s)
        assert abs(taken - target) <= max(words(t) for _, t, x in kept if x == s)
    tokenizer = packing.WordTokenizer(P.tokenizer_path())
    length = {i: len(next(iter(tokenizer.encode([t.encode()])))) // 4 + 1 for i, t, _ in kept}
    for i, n in copies.items():
        assert sum(r["length"] for r in got if r["doc_id"] == i) == n * length[i]
    x, bins, places = (np.array([r[c] for r in got]) for c in ("length", "sequence_id", "offset"))
    for b in set(bins):
        at = np.sort(places[bins == b])
        order = np.argsort(places[bins == b])
        assert (at == np.concatenate(([0], np.cumsum(x[bins == b][order])[:-1]))).all() and x[bins == b].sum() <= 4096
    assert len(set(bins)) <= packing.lower_bound(np.bincount(x, minlength=4097), 4096) + 1


def test_stages_keep_columns(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]


def test_empty_corpus(spark, tmp_path):
    corpus(spark, tmp_path / "a")
    spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0


def test_queries_agree_with_sql(spark, sf):
    import duckdb

    from seriesmith.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        mine = QUERIES[name](spark, sf)
        found = db.execute(sql)
        columns = sorted(c[0] for c in found.description)
        assert sorted(mine.columns) == columns, name
        at = [[c[0] for c in found.description].index(c) for c in columns]
        rounded = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted(repr(tuple(rounded(r[k]) for k in at)) for r in found.fetchall())
        assert sorted(repr(tuple(map(rounded, r))) for r in mine.select(*columns).collect()) == want, name
    assert set(QUERIES) == {f"op{k}_{n}" for k, n in enumerate(["secret_scans", "quality_rules", "warc_salvage", "source_mixing", "exact_dedup", "best_fit_packing", "url_filters", "simhash_near_dedup", "line_dedup", "chat_formatting"], 1)}


def test_stages_send_few_texts_to_python_at_once(spark):
    @F.arrow_udf(T.IntegerType())
    def rows_at_once(ids: pa.Array) -> pa.Array:
        return pa.array([len(ids)] * len(ids), pa.int32())

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = lambda: materialize(spark.range(0, 5000, 1, 1).select(rows_at_once("id").alias("n")), "n").agg(F.max("n")).first()[0]
    with stage_scratch():
        assert most() <= 1000
    assert spark.conf.get(name) == before and most() == 5000


def test_line_stage_sends_few_texts_at_once(spark, monkeypatch):
    """Whoever writes the stage's rows, under whatever settings, at most a thousand texts are sent to Python at once."""
    in_slices = line_dedup.in_slices

    def counted(made, texts, *columns):
        assert len(texts) - texts.null_count <= 1000, "too many texts at once"
        return in_slices(made, texts, *columns)

    monkeypatch.setattr(line_dedup, "in_slices", counted)
    docs = spark.range(2500).coalesce(1).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.concat(F.lit("own "), "id"), F.when(F.col("id") % 50 == 0, F.lit("again " * 60))).alias("text"))
    got = P.line_stage(spark, docs, "").orderBy("doc_id").collect()
    assert got[0]["text"].endswith("again ") and [r["text"] for r in got[1:]] == [f"own {i}" for i in range(1, 2500)]
