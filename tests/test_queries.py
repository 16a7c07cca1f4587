"""Every engine query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pytest

from seriesmith.operators import frame_codecs
from seriesmith.operators.compress import bound_of
from seriesmith.operators.series import SAMPLE_LEVELS
from seriesmith.plans import queries
from seriesmith.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders", "part")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def comparable(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    mine = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert mine.count() > 0
        return
    found = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(mine.columns) == sorted(names)
    assert comparable(mine.select(*names).collect()) == comparable(found.fetchall())


def agrees(spark, folder, name, rows):
    """A query and its SQL over events of one's own: event_id, ts, event_type, value."""
    c = duckdb.connect()
    c.execute(f"COPY ({rows}) TO '{folder}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert comparable(QUERIES[name](spark, str(folder)).select(*names).collect()) == comparable(found.fetchall())


EVENTS = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_milliseconds(i * 500) AS ts, 'abc'[1 + i % 2] AS event_type, {} AS value FROM range({}) AS r(i)"


@pytest.mark.parametrize("every", [97, 400])
def test_round_trip_of_samples_of_zero(spark, tmp_path, every):
    agrees(spark, tmp_path, "full_roundtrip", EVENTS.format(f"(CASE WHEN i % {every} = 0 THEN 0 ELSE (i * 7919 % 56021) / 100 END)::DOUBLE", 3000))


def test_late_points_at_half_seconds(spark, tmp_path):
    """Halves go to the even second, as in the SQL."""
    agrees(spark, tmp_path, "late_points", EVENTS.format("1.0::DOUBLE", 40).replace("i * 500", "(i * 7 % 40) * 500"))


@pytest.mark.parametrize("name", ["poly_error", "poly_decode"])
def test_splines_of_zeros_and_ties(spark, tmp_path, name):
    """A sample of zero has an infinite error; in frames of 32768 samples keys are 100 apart, so decoded values end in ties."""
    agrees(spark, tmp_path, name, EVENTS.format("(CASE WHEN i = 5011 THEN 0 ELSE (md5_number(i::VARCHAR) % 56021)::INT / 100 END)::DOUBLE", 65536))


def test_inverse_distance_of_zeros(spark, tmp_path):
    """Frames of 256 samples with a zero between keys have an infinite error."""
    agrees(spark, tmp_path, "idw_error", EVENTS.format("(CASE WHEN i IN (200, 1401) THEN 0 ELSE (i * 7919 % 56021) / 100 END)::DOUBLE", 3000))


@pytest.mark.parametrize(("name", "level"), [("codec_choice", 0), ("codec_choice_sampled", 5)])
def test_choice_is_the_smallest_of_all_candidates(spark, name, level):
    """Every frame of every series, each candidate encoded in full."""
    rows = [(r["series_id"], r["frame_no"], r["pos"], r["value"]) for r in queries.framed(queries.events(spark, SF)).collect()]
    frames = {}
    for s, k, _, v in sorted(rows):
        frames.setdefault((s, k), []).append(v)
    got = {(r["series_id"], r["frame_no"]): (r["codec"], r["payload_bytes"]) for r in QUERIES[name](spark, SF).collect()}
    assert set(got) == set(frames)
    bound = bound_of(queries.ERROR)
    for at, values in frames.items():
        x = np.array(values)
        sample = x[: SAMPLE_LEVELS[level]] if level and len(x) >= SAMPLE_LEVELS[level] else x
        tried = [(frame_codecs.encode(sample, c, bound), c) for c in frame_codecs.AUTO]
        size, codec = min(((len(p), c) for (p, e), c in tried if e <= bound), key=lambda t: t[0])
        codec = "constant" if x.min() == x.max() else codec
        assert got[at] == (codec, len(frame_codecs.encode(x, codec, bound)[0]))


def test_whole_frames_against_a_slow_transform():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=200).cumsum() + 50, 2)
    y = frame_codecs.pad(x)
    n = len(y)
    at = np.arange(n)
    slow = np.array([(y.astype(np.float32) * np.exp(-2j * np.pi * k * at / n)).sum() for k in range(n // 2 + 1)])
    payload, error = frame_codecs.fft_encode(x, points=9)
    kept = np.argsort(-np.abs(slow), kind="stable")[:9]
    back = sum((1 if k == 0 or 2 * k == n else 2) * (slow[k] * np.exp(2j * np.pi * k * at / n)).real for k in kept) / n
    before = (n - len(x)) // 2
    np.testing.assert_allclose(frame_codecs.decode(payload, "fft", len(x)), np.clip(back, x.min(), x.max())[before : before + len(x)], atol=2e-4)
    assert error == pytest.approx(np.mean(np.abs((np.clip(back, x.min(), x.max()) - y) / y)), abs=1e-5)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
