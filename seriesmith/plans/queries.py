"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.functions import metrics, scalar, sizes
from seriesmith.operators import compress as engine
from seriesmith.operators import interpolation, runs, series, spectrum, timeindex
from seriesmith.sources import binary, csv, files

FRAME = ["series_id", "frame_no"]
ERROR = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day() -> Column:
    """A long series of events is ranked day by day."""
    return F.date_trunc("DAY", F.col("ts"))


# sources


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, pos, value: events by type in the order of time."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")
    return series.with_positions(series.clean(rows), ["ts", "event_id"], bucket=day()).select("series_id", "pos", "value")


EVENTS = """SELECT event_type AS series_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY event_type) AS n FROM events"""


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, pos, value: quantities of line items by return flag; no key is unique, so all columns give the order."""
    rows = table(spark, sf_dir, "lineitem")
    order = [c for c in rows.columns if c not in ("l_quantity", "l_returnflag")] + ["l_quantity"]
    placed = series.with_positions(rows, order, key="l_returnflag", bucket=F.floor(F.col("l_orderkey") / 4096))
    return placed.select(F.col("l_returnflag").alias("series_id"), "pos", F.col("l_quantity").alias("value"))


_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate, l_quantity"
QUANTITIES = f"""SELECT l_returnflag AS series_id, l_quantity AS value, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_ORDER}) - 1 AS pos,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem"""


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of 0 and 1 in stretches: whether orders above a price are open, orders in the order of their keys."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_totalprice") > 50000).cast("double").alias("value"))
    placed = series.with_positions(rows, ["o_orderkey"], key="o_orderpriority", bucket=F.floor(F.col("o_orderkey") / 4096))
    return placed.select(F.col("o_orderpriority").alias("series_id"), "pos", "value")


STATUSES = """SELECT o_orderpriority AS series_id, (o_totalprice > 50000)::INT::DOUBLE AS value,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders"""


def framed(rows: DataFrame) -> DataFrame:
    return series.with_frames(rows)


def _frames_sql(source: str, name: str = "f") -> str:
    """Common table expressions that give name(series_id, pos, value, frame_no, frame_start, frame_len, x)."""
    return f"""
s AS ({source}),
s1 AS (SELECT *, n // 131072 * 131072 AS done, n - n // 131072 * 131072 AS r, greatest(pos - n // 131072 * 131072, 0) AS o FROM s),
s2 AS (SELECT *, greatest(length(bin(xor(o, r))) - 1, 8) AS bit FROM s1),
s3 AS (SELECT *, (r >> (bit + 1)::BIGINT) AS high FROM s2),
s4 AS (SELECT series_id, pos, value, CASE WHEN pos < done THEN pos // 131072 ELSE done // 131072 + bit_count(high) END::BIGINT AS frame_no,
  CASE WHEN pos < done THEN pos // 131072 * 131072 ELSE done + (high << (bit + 1)::BIGINT) END::BIGINT AS frame_start FROM s3),
{name} AS (SELECT *, (count(*) OVER (PARTITION BY series_id, frame_no))::BIGINT AS frame_len, (pos - frame_start)::BIGINT AS x FROM s4)"""


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """All samples in frames of so many, the last of a series being shorter, with the columns of with_frames()."""
    lengths = rows.groupBy(F.col("series_id").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    start = F.col("pos") - F.col("pos") % size
    made = {"frame_no": F.floor(F.col("pos") / size).cast("long"), "frame_start": start, "frame_len": F.least(F.lit(size).cast("long"), F.col("_n") - start), "pos_in_frame": F.col("pos") % size}
    return rows.join(lengths, F.col("series_id").eqNullSafe(F.col("_key"))).withColumns(made).drop("_key", "_n")


def _blocked_sql(source: str, size: int) -> str:
    """f with the columns of _frames_sql()."""
    return f"""
s AS ({source}), f AS (SELECT series_id, pos, value, (pos // {size})::BIGINT AS frame_no, (pos // {size} * {size})::BIGINT AS frame_start,
  least({size}, n - pos // {size} * {size})::BIGINT AS frame_len, (pos % {size})::BIGINT AS x FROM s)"""


_BITS = """CASE WHEN bool_or(value <> floor(value)) THEN 'F64' WHEN min(value) >= 0 AND max(value) <= 255 THEN 'U8'
  WHEN min(value) >= -32768 AND max(value) <= 32767 THEN 'I16' WHEN min(value) >= -2147483648 AND max(value) <= 2147483647 THEN 'I32' ELSE 'F64' END"""


def _vl(u: str) -> str:
    return f"(CASE WHEN {u} < 251 THEN 1 WHEN {u} < 65536 THEN 3 WHEN {u} < 4294967296 THEN 5 ELSE 9 END)"


def _zz(n: str) -> str:
    return f"(CASE WHEN {n} >= 0 THEN 2 * ({n}) ELSE -2 * ({n}) - 1 END)"


def _width(x: str, depth: str = "bitdepth") -> str:
    return f"(CASE WHEN {depth} = 'U8' THEN 1 WHEN {depth} = 'F64' THEN 8 ELSE {_vl(_zz(f'{x}::BIGINT'))} END)"


def _round(x: str, decimals: int) -> str:
    scaled = f"(({x}) * 1e{decimals}::DOUBLE)"
    return f"(sign({scaled}) * floor(abs({scaled}) + 0.5::DOUBLE) / 1e{decimals}::DOUBLE)"


def rounded(x: str | Column, decimals: int = 6) -> Column:
    return scalar.round_half_away(F.col(x) if isinstance(x, str) else x, decimals)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# cleaning, positions, frames


@query("""
WITH v AS (SELECT event_type AS series_id, ts, event_id, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE
  WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1)::BIGINT AS pos, value FROM v
WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)
""")
def clean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    broken = F.when(e % 7 == 0, float("nan")).when(e % 11 == 0, float("inf")).when(e % 13 == 0, F.lit(None)).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", broken.alias("value"))
    return series.with_positions(series.clean(rows), ["ts", "event_id"], bucket=day()).select("series_id", "pos", "value")


@query(f"WITH {_frames_sql(EVENTS)} SELECT series_id, pos::BIGINT AS pos, frame_no, frame_start, frame_len, x AS pos_in_frame FROM f")
def frame_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(events(spark, sf_dir)).select("series_id", "pos", "frame_no", "frame_start", "frame_len", "pos_in_frame")


@query(f"WITH {_frames_sql(QUANTITIES)} SELECT series_id, frame_no, frame_start, count(*)::BIGINT AS sample_count FROM f GROUP BY ALL")
def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framed(quantities(spark, sf_dir)).groupBy("series_id", "frame_no", "frame_start").agg(F.count(F.lit(1)).alias("sample_count"))


@query(f"WITH s AS ({QUANTITIES}) SELECT series_id, (pos // 2048)::BIGINT AS chunk_no, count(*)::BIGINT AS n, sum(value) AS total, (arg_min(value, pos)) AS first FROM s GROUP BY 1, 2")
def block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("values")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return series.blocks(quantities(spark, sf_dir)).select("series_id", "chunk_no", F.size(v).cast("long").alias("n"), total.alias("total"), F.get(v, F.lit(0)).alias("first"))


@query(f"WITH s AS ({EVENTS}) SELECT series_id, pos::BIGINT AS pos, value FROM s")
def block_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.from_blocks(series.blocks(events(spark, sf_dir)))


def _stats_sql(source: str) -> str:
    return f"""WITH {_frames_sql(source)}
SELECT series_id, frame_no, count(*)::BIGINT AS sample_count, min(value) AS min, max(value) AS max,
  min(x) FILTER (value = low)::BIGINT AS min_loc, min(x) FILTER (value = high)::BIGINT AS max_loc, {_round("avg(value)", 6)} AS mean,
  bool_or(value <> floor(value)) AS fractional, {_BITS} AS bitdepth
FROM (SELECT *, min(value) OVER w AS low, max(value) OVER w AS high FROM f WINDOW w AS (PARTITION BY series_id, frame_no)) GROUP BY 1, 2"""


@query(_stats_sql(EVENTS))
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.frame_stats(framed(events(spark, sf_dir))).withColumn("mean", rounded("mean"))


@query(_stats_sql(QUANTITIES))
def frame_bitdepth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.frame_stats(framed(quantities(spark, sf_dir))).withColumn("mean", rounded("mean"))


# metrics


def _metric_sql(expression: str) -> str:
    return f"WITH e AS (SELECT event_type AS series_id, value AS a, round(value / 10) * 10 AS b FROM events) SELECT series_id, {_round(expression, 6)} AS error FROM e GROUP BY 1"


def _metric(name: str, expression: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("value").alias("a"), (F.round(F.col("value") / 10) * 10).alias("b"))
        return rows.groupBy("series_id").agg(rounded(metrics.METRICS[name](F.col("a"), F.col("b"))).alias("error"))

    run.__name__ = f"err_{name}"
    query(_metric_sql(expression))(run)


_metric("mse", "avg((a - b) * (a - b))")
_metric("nmse", "sum((b - a) * (b - a)) / sum(a * a)")
_metric("mae", "avg(abs(b - a))")
_metric("mape", "avg(abs((b - a) / a))")
_metric("smape", "sum(abs(b - a)) / sum(abs(a) + abs(b)) / count(*)")


# lossless codecs


@query(f"WITH s AS ({EVENTS}) SELECT series_id, pos::BIGINT AS pos, value, {_round('value', 0)}::BIGINT AS stored, {_round('value', 0)} AS decoded FROM s")
def noop_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.noop_decode(runs.noop_encode(events(spark, sf_dir)))


@query(f"""WITH {_frames_sql(EVENTS)} SELECT series_id, frame_no,
  (1 + {_vl("count(*)")} + sum({_vl(_zz(_round("value", 0) + "::BIGINT"))}))::BIGINT AS payload_bytes FROM f GROUP BY 1, 2""")
def noop_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.noop_sizes(framed(events(spark, sf_dir)))


@query(f"""WITH {_frames_sql(STATUSES)}, g AS (SELECT series_id, frame_no, count(*)::BIGINT AS sample_count, min(value) AS constant, {_BITS} AS bitdepth,
  min(value) = max(value) AS is_constant FROM f GROUP BY 1, 2) SELECT *, (2 + {_width("constant")})::BIGINT AS payload_bytes FROM g""")
def constant_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.constant_encode(framed(statuses(spark, sf_dir)))


@query(f"WITH {_frames_sql(STATUSES)} SELECT series_id, frame_no, x AS pos_in_frame, min(value) OVER (PARTITION BY series_id, frame_no) AS decoded FROM f")
def constant_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.constant_decode(runs.constant_encode(framed(statuses(spark, sf_dir))))


_RUNS = """, l AS (SELECT *, lag(value) OVER (PARTITION BY series_id, frame_no ORDER BY x) AS before FROM f),
q AS (SELECT series_id, frame_no, value, x AS start FROM l WHERE before IS NULL OR before <> value)"""


@query(f"WITH {_frames_sql(STATUSES)} {_RUNS} SELECT series_id, frame_no, value, string_agg(start::VARCHAR, ',' ORDER BY start) AS starts FROM q GROUP BY 1, 2, 3")
def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rle_encode(framed(statuses(spark, sf_dir))).withColumn("starts", F.array_join("starts", ","))


@query(f"WITH {_frames_sql(QUANTITIES)} SELECT series_id, frame_no, x AS pos_in_frame, value AS decoded FROM f")
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(quantities(spark, sf_dir))
    counts = rows.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("sample_count"))
    return runs.rle_decode(runs.rle_encode(rows), counts)


_RLE_SIZES = f"""{_RUNS}, d AS (SELECT series_id, frame_no, {_BITS} AS bitdepth FROM f GROUP BY 1, 2),
p AS (SELECT series_id, frame_no, value, count(*) AS k, sum({_vl("start")}) AS starts FROM q GROUP BY 1, 2, 3),
z AS (SELECT series_id, frame_no, count(*)::BIGINT AS n_values, sum(k)::BIGINT AS n_runs, (2 + {_vl("count(*)")} + sum({_width("value")} + {_vl("k")} + starts))::BIGINT AS payload_bytes
  FROM p JOIN d USING (series_id, frame_no) GROUP BY 1, 2)"""


@query(f"WITH {_frames_sql(QUANTITIES)} {_RLE_SIZES} SELECT * FROM z")
def rle_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rle_sizes(framed(quantities(spark, sf_dir)))


# interpolation


_STEPPED = ", t AS (SELECT *, greatest(frame_len // greatest(3, frame_len // 100), 1) AS step FROM f)"
_KEYS = """, k AS (SELECT series_id, frame_no, step, frame_len, (x + step - 1) // step AS key_no, x, value AS v FROM t WHERE x % step = 0 OR x = frame_len - 1)"""


@query(f"WITH {_frames_sql(EVENTS)} {_STEPPED} {_KEYS} SELECT series_id, frame_no, key_no::BIGINT AS key_no, x, v FROM k")
def poly_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.keys(interpolation.with_step(framed(events(spark, sf_dir)))).select(*FRAME, "key_no", "x", "v")


_CUBIC = """v1 * (2 * t * t * t - 3 * t * t + 1) + (v2 - v0) / (x2 - x0) * h * (t * t * t - 2 * t * t + t)
  + v2 * (3 * t * t - 2 * t * t * t) + (v3 - v1) / (x3 - x1) * h * (t * t * t - t * t)"""


def _spline_sql(extra: str = "") -> str:
    """decoded values y(series_id, frame_no, extra, x, value, decoded) from k and t."""
    by = f"series_id, frame_no{extra}"
    return f""", g AS (SELECT {by}, key_no, x::DOUBLE AS x1, v AS v1, lag(x) OVER w AS x0, lag(v) OVER w AS v0, lead(x) OVER w AS x2, lead(v) OVER w AS v2,
  lead(x, 2) OVER w AS x3, lead(v, 2) OVER w AS v3 FROM k WINDOW w AS (PARTITION BY {by} ORDER BY key_no)),
j AS (SELECT t.*, x0, x1, x2, x3, v0, v1, v2, v3, (x2 - x1) AS h, (x - x1) / (x2 - x1) AS t, min(value) OVER (PARTITION BY {by}) AS low, max(value) OVER (PARTITION BY {by}) AS high
  FROM t JOIN g USING ({by}) WHERE g.key_no = CASE WHEN t.x = t.frame_len - 1 THEN (t.x + t.step - 1) // t.step ELSE t.x // t.step END),
c AS (SELECT *, CASE WHEN x2 IS NULL THEN v1 WHEN x0 IS NOT NULL AND x3 IS NOT NULL THEN {_CUBIC} ELSE v1 + (v2 - v1) * t END AS raw FROM j),
y AS (SELECT {by}, x, value, CASE WHEN low = high THEN low ELSE least(greatest({_round("raw", 5)}, low), high) END AS decoded FROM c)"""


@query(f"WITH {_frames_sql(EVENTS)} {_STEPPED} {_KEYS} {_spline_sql()} SELECT series_id, frame_no, x AS pos_in_frame, {_round('decoded', 4)} AS decoded FROM y")
def poly_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = interpolation.spline_decode(interpolation.with_step(framed(events(spark, sf_dir))))
    return decoded.select(*FRAME, "pos_in_frame", rounded("decoded", 4).alias("decoded"))


_ERROR = "avg(abs((decoded - value) / value))"


@query(f"WITH {_frames_sql(EVENTS)} {_STEPPED} {_KEYS} {_spline_sql()} SELECT series_id, frame_no, {_round(_ERROR, 6)} AS error FROM y GROUP BY 1, 2")
def poly_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = interpolation.spline_decode(interpolation.with_step(framed(events(spark, sf_dir))))
    return interpolation.frame_errors(decoded).withColumn("error", rounded("error"))


_IDW = f"""{_STEPPED}, u AS (SELECT * FROM t), k AS (SELECT series_id, frame_no, x AS kx, value AS kv FROM u WHERE x % step = 0 OR x = frame_len - 1),
w AS (SELECT series_id, frame_no, x, value, kv, (x - kx)::DOUBLE * (x - kx) AS d FROM u JOIN k USING (series_id, frame_no)),
m AS (SELECT series_id, frame_no, x, value, coalesce(max(kv) FILTER (d = 0), sum(kv / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)) AS raw FROM w GROUP BY 1, 2, 3, 4),
y AS (SELECT *, least(greatest({_round("raw", 5)}, min(value) OVER (PARTITION BY series_id, frame_no)), max(value) OVER (PARTITION BY series_id, frame_no)) AS decoded FROM m)"""


@query(f"WITH {_blocked_sql(EVENTS, 256)} {_IDW} SELECT series_id, frame_no, x AS pos_in_frame, {_round('decoded', 4)} AS decoded FROM y")
def idw_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = interpolation.idw_decode(interpolation.with_step(blocked(events(spark, sf_dir), 256)))
    return decoded.select(*FRAME, "pos_in_frame", rounded("decoded", 4).alias("decoded"))


@query(f"WITH {_blocked_sql(EVENTS, 256)} {_IDW} SELECT series_id, frame_no, {_round(_ERROR, 6)} AS error FROM y GROUP BY 1, 2")
def idw_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.frame_errors(interpolation.idw_decode(interpolation.with_step(blocked(events(spark, sf_dir), 256)))).withColumn("error", rounded("error"))


@query()
def idw_bounded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames, by arrays."""
    return engine.compress(quantities(spark, sf_dir), codec="idw").drop("payload")


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running number of events by type, in hundreds: positive, growing, and well approximated."""
    return events(spark, sf_dir).withColumn("value", F.round(F.sqrt(F.col("pos") + 10.0) * 100) / 100)


SMOOTH = EVENTS.replace("value,", "round(sqrt(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 + 10.0::DOUBLE) * 100) / 100 AS value,", 1)

_LADDER = f""", n AS (SELECT DISTINCT series_id, frame_no, frame_len FROM f), rung AS (SELECT *, unnest(range(0, 23)) AS up FROM n),
st AS (SELECT DISTINCT series_id, frame_no, greatest(frame_len // (greatest(3, frame_len // 100) + least(up, 17) * greatest(frame_len // 10, 1) + greatest(up - 17, 0) * greatest(frame_len // 100, 1)), 1) AS step FROM rung),
t AS (SELECT f.*, step FROM f JOIN st USING (series_id, frame_no) WHERE step > 1)
{_KEYS} {_spline_sql(", step")}, er AS (SELECT series_id, frame_no, step, {_ERROR} AS error FROM y GROUP BY 1, 2, 3),
ok AS (SELECT * FROM er WHERE {_round("error", 4)} <= {_round("(3 / 100::FLOAT)::FLOAT::DOUBLE", 3)} AND NOT isnan(error) UNION ALL SELECT series_id, frame_no, 1, 0 FROM n),
fit AS (SELECT series_id, frame_no, max(step)::BIGINT AS step, arg_max(error, step) AS error FROM ok GROUP BY 1, 2)"""


@query(f"WITH {_frames_sql(SMOOTH)} {_LADDER} SELECT series_id, frame_no, step, {_round('error', 6)} AS error FROM fit")
def poly_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.fit_ladder(framed(smooth(spark, sf_dir)), scalar.error_bound(ERROR)).withColumn("error", rounded("error"))


# Fourier


def _blocks_of_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked(events(spark, sf_dir), 64)


_DFT = f"""WITH {_blocked_sql(EVENTS, 64)},
d AS (SELECT series_id, frame_no, frame_len, bin, sum(value * cos(-2 * pi() * ((x * bin) % frame_len) / frame_len)) AS re, sum(value * sin(-2 * pi() * ((x * bin) % frame_len) / frame_len)) AS im
  FROM (SELECT *, unnest(range(0, frame_len // 2 + 1)) AS bin FROM f) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, frame_no ORDER BY round(sqrt(re * re + im * im), 9) DESC, bin) AS rank FROM d WHERE re <> 0 OR im <> 0),
o AS (SELECT * FROM r WHERE rank <= 8)"""


@query(f"{_DFT} SELECT series_id, frame_no, bin, {_round('sqrt(re * re + im * im)', 4)} AS norm FROM d")
def dft_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectrum.transform(_blocks_of_64(spark, sf_dir))
    return found.select(*FRAME, "bin", rounded(scalar.norm(F.col("re"), F.col("im")), 4).alias("norm"))


@query(f"{_DFT} SELECT series_id, frame_no, bin, rank::INT AS rank FROM o")
def fft_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.strongest(spectrum.transform(_blocks_of_64(spark, sf_dir)), 8).select(*FRAME, "bin", "rank")


@query(f"""{_DFT}, i AS (SELECT f.series_id, f.frame_no, x, value,
  sum(CASE WHEN bin = 0 OR 2 * bin = f.frame_len THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((x * bin) % f.frame_len) / f.frame_len) - im * sin(2 * pi() * ((x * bin) % f.frame_len) / f.frame_len))) / any_value(f.frame_len) AS raw
  FROM f JOIN o USING (series_id, frame_no) GROUP BY 1, 2, 3, 4),
e AS (SELECT *, min(value) OVER w::FLOAT::DOUBLE AS low, max(value) OVER w::FLOAT::DOUBLE AS high FROM i WINDOW w AS (PARTITION BY series_id, frame_no))
SELECT series_id, frame_no, x AS pos_in_frame, {_round("CASE WHEN low = high THEN high ELSE least(greatest(" + _round("raw", 5) + ", low), high) END", 3)} AS decoded FROM e""")
def fft_decode_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks_of_64(spark, sf_dir)
    decoded = spectrum.inverse(spectrum.strongest(spectrum.transform(rows), 8), rows)
    return decoded.select(*FRAME, "pos_in_frame", rounded("decoded", 3).alias("decoded"))


@query(f"""WITH {_frames_sql(EVENTS)}, z AS (SELECT list((2 ** a * 3 ** b)::BIGINT) AS all_sizes FROM range(0, 21) AS u(a), range(0, 13) AS v(b)),
p AS (SELECT series_id, frame_no, frame_len, any_value(CASE WHEN frame_len >= 128 THEN list_min(list_filter(all_sizes, lambda q: q > frame_len)) ELSE frame_len END) AS size,
  arg_min(value, x) AS first, arg_max(value, x) AS last FROM f, z GROUP BY 1, 2, 3),
g AS (SELECT *, unnest(range(0, size)) AS i, (size - frame_len) // 2 AS before FROM p)
SELECT g.series_id, g.frame_no, i::BIGINT AS pos_in_padded, CASE WHEN i < before THEN first WHEN i >= before + g.frame_len THEN last ELSE f.value END AS value
FROM g LEFT JOIN f ON f.series_id = g.series_id AND f.frame_no = g.frame_no AND f.x = g.i - g.before""")
def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.padded(framed(events(spark, sf_dir)))


@query(f"WITH {_frames_sql(EVENTS)} SELECT series_id, frame_no, frame_len, x AS pos_in_frame, value FROM f")
def trim_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(events(spark, sf_dir))
    return spectrum.trimmed(spectrum.padded(rows), rows)


@query()
def fft_bounded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.compress(quantities(spark, sf_dir), codec="fft").drop("payload")


# selection and whole streams


_CHOICE = f"""{_LADDER} {_RLE_SIZES},
kk AS (SELECT f.series_id, f.frame_no, fit.step, fit.error, f.value FROM f JOIN fit USING (series_id, frame_no) WHERE x % fit.step = 0 OR x = frame_len - 1),
ps AS (SELECT series_id, frame_no, any_value(error) AS error, (2 + {_vl("count(*)")} + sum({_width("kk.value")}) + 17)::BIGINT AS payload_bytes FROM kk JOIN d USING (series_id, frame_no) GROUP BY 1, 2),
cand AS (SELECT series_id, frame_no, 'polynomial' AS codec, 1 AS rank, payload_bytes, error FROM ps UNION ALL SELECT series_id, frame_no, 'rle', 2, payload_bytes, 0 FROM z)"""


def candidates(rows: DataFrame, percent: float) -> DataFrame:
    """FRAME, codec, rank, payload_bytes, error of the native candidates, polynomial and RLE."""
    fit = interpolation.fit_ladder(rows, scalar.error_bound(percent))
    poly = interpolation.keyed_sizes(rows.join(fit.select(*FRAME, "step"), FRAME)).join(fit, FRAME)
    poly = poly.select(*FRAME, F.lit("polynomial").alias("codec"), F.lit(1).alias("rank"), "payload_bytes", "error")
    rle = runs.rle_sizes(rows).select(*FRAME, F.lit("rle").alias("codec"), F.lit(2).alias("rank"), "payload_bytes", F.lit(0.0).alias("error"))
    return poly.unionByName(rle)


def choose(tried: DataFrame, percent: float) -> DataFrame:
    """The smallest candidate within the bound, or the smallest if none is; the first of equal ones."""
    over = ~(F.col("error") <= scalar.error_bound(percent)) | F.isnan("error")
    best = F.min(F.struct(over.alias("over"), "payload_bytes", "rank", "codec", "error"))
    return tried.groupBy(*FRAME).agg(best.alias("b")).select(*FRAME, F.col("b.codec").alias("codec"), F.col("b.payload_bytes").alias("payload_bytes"))


@query(f"WITH {_frames_sql(SMOOTH)} {_CHOICE} SELECT series_id, frame_no, arg_min(codec, payload_bytes * 10 + rank) AS codec, min(payload_bytes) AS payload_bytes FROM cand GROUP BY 1, 2")
def codec_choice_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose(candidates(framed(smooth(spark, sf_dir)), ERROR), ERROR)


def _chosen(rows: DataFrame, level: int) -> DataFrame:
    frames = engine.frame_sizes(engine.compress(rows, error=ERROR, level=level))
    return frames.select(*FRAME, "sample_count", "codec", "error", "payload_bytes")


@query()
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three candidates over all frames; codec_choice_native has the two that SQL can express."""
    return _chosen(events(spark, sf_dir), 0)


@query()
def codec_choice_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec that is best for the first 256 samples of a frame encodes all of it."""
    return _chosen(events(spark, sf_dir), 5)


@query(f"""WITH {_frames_sql(QUANTITIES)} {_RLE_SIZES}, fr AS (SELECT series_id, frame_no, frame_len, payload_bytes, 2 + {_vl("frame_len")} + {_vl("payload_bytes")} + payload_bytes AS bytes
  FROM z JOIN (SELECT DISTINCT series_id, frame_no, frame_len FROM f) USING (series_id, frame_no)),
st AS (SELECT series_id, count(*)::BIGINT AS n_frames, sum(frame_len)::BIGINT AS samples, (9 + {_vl("count(*)")} + sum(bytes))::BIGINT AS stream_bytes FROM fr GROUP BY 1)
SELECT *, {_round("8 * samples / stream_bytes", 6)} AS ratio FROM st""")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = engine.compress(quantities(spark, sf_dir), codec="rle")
    return engine.compression_ratio(frames).withColumn("ratio", rounded("ratio"))


@query(f"""WITH {_frames_sql(QUANTITIES)} {_RLE_SIZES}, fr AS (SELECT series_id, payload_bytes, frame_len FROM z JOIN (SELECT DISTINCT series_id, frame_no, frame_len FROM f) USING (series_id, frame_no))
SELECT series_id, sum(frame_len)::BIGINT AS samples, sum(payload_bytes)::BIGINT AS payload_bytes, (9 + {_vl("count(*)")} + sum(2 + {_vl("frame_len")} + {_vl("payload_bytes")} + payload_bytes))::BIGINT AS stream_bytes FROM fr GROUP BY 1""")
def stream_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(quantities(spark, sf_dir))
    counts = rows.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("sample_count"))
    each = runs.rle_sizes(rows).join(counts, FRAME)
    total = each.groupBy("series_id").agg(
        F.sum("sample_count").alias("samples"), F.sum("payload_bytes").alias("payload_bytes"),
        F.sum(sizes.frame(F.col("sample_count"), F.col("payload_bytes"))).alias("frames"), F.count(F.lit(1)).alias("n"),
    )
    return total.select("series_id", "samples", "payload_bytes", sizes.stream(F.col("n"), F.col("frames")).alias("stream_bytes"))


@query(f"WITH {_frames_sql(EVENTS)} SELECT series_id, frame_no, count(*)::BIGINT AS samples, true AS in_bound, true AS same_length FROM f GROUP BY 1, 2")
def full_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = framed(events(spark, sf_dir))
    back = engine.decompress(engine.compress(rows.select("series_id", "pos", "value"), error=ERROR)).withColumnRenamed("value", "decoded")
    joined = rows.join(back, ["series_id", "pos"], "full")
    # a sample that comes back as it was has no error, also where it is 0
    error = F.avg(F.when(F.col("value") == F.col("decoded"), 0.0).otherwise(metrics.ape(F.col("value"), F.col("decoded"))))
    summed = joined.groupBy(*FRAME).agg(F.count("decoded").alias("samples"), error.alias("error"), F.count("value").alias("n"))
    return summed.select(*FRAME, "samples", (rounded("error", 9) <= scalar.error_bound(ERROR)).alias("in_bound"), (F.col("samples") == F.col("n")).alias("same_length"))


@query("SELECT event_type AS series_id, count(*)::BIGINT AS samples, true AS equal FROM events GROUP BY 1")
def lossless_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    back = engine.decompress(engine.compress(rows, codec="rle")).withColumnRenamed("value", "decoded")
    joined = rows.join(back, ["series_id", "pos"], "full")
    return joined.groupBy("series_id").agg(F.count("value").alias("samples"), F.bool_and(F.coalesce(F.col("value") == F.col("decoded"), F.lit(False))).alias("equal"))


# sources and sinks


@query(f"WITH s AS ({QUANTITIES}) SELECT series_id, pos::BIGINT AS pos, value FROM s")
def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of raw samples and back."""
    return binary.raw_samples(binary.raw_files(quantities(spark, sf_dir)))


@query(f"WITH s AS ({EVENTS}) SELECT series_id, pos::BIGINT AS pos, value FROM s")
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.wav_samples(binary.wav_files(events(spark, sf_dir)))


@query(f"WITH s AS ({STATUSES}) SELECT series_id, pos::BIGINT AS pos, value FROM s")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed streams, each with its header and frames, and back."""
    frames = engine.compress(statuses(spark, sf_dir), codec="rle")
    return engine.decompress(binary.frames_of(binary.stream_files(frames)))


_TIMED = "SELECT event_type AS series_id, (epoch_ns(ts) // 1000000)::BIGINT AS timestamp, value FROM events"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), millis.alias("timestamp"), "value")


@query(f"SELECT timestamp, value FROM ({_TIMED})")
def csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with timestamp and value, written and read back."""
    path = files.shared_path(spark, "csv")
    csv.write_typed(_timed(spark, sf_dir), path)
    return csv.read_typed(spark, path).select("timestamp", "value")


@query(f"SELECT timestamp::VARCHAR AS time, value FROM ({_TIMED})")
def csv_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.shared_path(spark, "csv")
    _timed(spark, sf_dir).select(F.lit("x").alias("other"), F.col("value").alias("v"), F.col("timestamp").alias("t")).write.option("header", True).csv(path)
    return csv.read_with_header(spark, path, "t", "v", keep_time=True).select("time", "value")


@query(f"SELECT value FROM ({_TIMED})")
def csv_without_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.shared_path(spark, "csv")
    _timed(spark, sf_dir).select("value").write.csv(path)
    return csv.read_without_header(spark, path).select("value")


# time index


def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts: one point for each hour in which a type has events, in seconds since the epoch."""
    hours = F.date_trunc("HOUR", F.col("ts"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.unix_timestamp(hours.cast("timestamp")).alias("ts"))
    return rows.distinct()


_SEGMENTS = """WITH RECURSIVE p AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM
  (SELECT DISTINCT event_type AS series_id, epoch(date_trunc('hour', ts))::BIGINT AS ts FROM events)),
st AS (SELECT series_id, i, 0::BIGINT AS seg_no, 0::BIGINT AS m, 0::BIGINT AS x0, ts AS y0, 1::BIGINT AS n FROM p WHERE i = 1
  UNION ALL SELECT st.series_id, p.i, CASE WHEN g THEN seg_no ELSE seg_no + 1 END, CASE WHEN g THEN CASE WHEN n = 1 THEN p.ts - y0 ELSE m END ELSE 0 END,
    CASE WHEN g THEN x0 ELSE x0 + n END, CASE WHEN g THEN y0 ELSE p.ts END, CASE WHEN g THEN n + 1 ELSE 1 END
  FROM st JOIN p ON p.series_id = st.series_id AND p.i = st.i + 1, LATERAL (SELECT CASE WHEN st.n = 1 THEN p.ts > st.y0 ELSE (p.ts - st.y0) // st.m = st.n END AS g)),
sg AS (SELECT series_id, seg_no, max(m) AS m, min(x0) AS x0, min(y0) AS y0, max(n) AS n FROM st GROUP BY 1, 2)"""

_PROBES = """, pr AS (SELECT DISTINCT t.series_id, epoch(date_trunc('minute', e.ts))::BIGINT + (e.event_id % 3) * 1800 AS y FROM events e JOIN (SELECT DISTINCT event_type AS series_id FROM events) t ON t.series_id = e.event_type)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.unix_timestamp(F.date_trunc("MINUTE", F.col("ts")).cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), (minutes + (F.col("event_id") % 3) * 1800).alias("y"))
    return rows.distinct()


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.build_index(seconds(spark, sf_dir))


@query(f"{_SEGMENTS} SELECT series_id, seg_no, m, x0, y0, n FROM sg")
def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir)


@query(f"{_SEGMENTS} SELECT series_id, seg_no, m, x0, y0, n FROM sg")
def index_segments_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.build_index_native(seconds(spark, sf_dir))


@query(f"""{_SEGMENTS} SELECT series_id, min(y0) || chr(10) || max(y0 + m * (n - 1)) || chr(10) || string_agg(concat_ws(',', m, x0, y0, n), chr(10) ORDER BY x0) AS value
FROM sg GROUP BY 1""")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.index_lines(segments(spark, sf_dir))


@query(f"{_SEGMENTS} SELECT series_id, seg_no, m, x0, y0, n FROM sg")
def index_text_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.index_of(binary.index_lines(segments(spark, sf_dir)))


@query(f"{_SEGMENTS} SELECT series_id, min(y0) AS min_ts, max(y0 + m * (n - 1)) AS max_ts, sum(n)::BIGINT AS samples FROM sg GROUP BY 1")
def index_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.bounds(segments(spark, sf_dir))


_AT = "(SELECT min(x0 + (pr.y - y0) // greatest(m, 1)) FROM sg WHERE sg.series_id = pr.series_id AND pr.y BETWEEN y0 AND y0 + m * (n - 1))"


@query(f"{_SEGMENTS} {_PROBES} SELECT series_id, y, {_AT} AS x FROM pr")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.sample_at(probes(spark, sf_dir), segments(spark, sf_dir), span=7 * 86400)


@query(f"{_SEGMENTS}, q AS (SELECT series_id, x0 + unnest(range(0, n, 3)) AS x FROM sg) SELECT series_id, x, (SELECT y0 + m * (q.x - x0) FROM sg WHERE sg.series_id = q.series_id AND q.x BETWEEN x0 AND x0 + n - 1) AS y FROM q")
def index_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    wanted = s.select("series_id", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("n") - 1, F.lit(3).cast("long"))).alias("x"))
    return timeindex.time_at(wanted, s, span=1 << 16)


@query(f"{_SEGMENTS} {_PROBES} SELECT series_id, y, coalesce({_AT}, (SELECT min(x0) FROM sg WHERE sg.series_id = pr.series_id AND y0 >= pr.y)) AS x FROM pr")
def index_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.this_or_next(probes(spark, sf_dir), segments(spark, sf_dir), span=7 * 86400)


@query(f"""{_SEGMENTS} {_PROBES}, b AS (SELECT series_id, max(y0 + m * (n - 1)) AS last, sum(n)::BIGINT AS total FROM sg GROUP BY 1)
SELECT pr.series_id, y, CASE WHEN {_AT} IS NULL AND y >= last THEN total ELSE coalesce({_AT}, (SELECT max(x0 + n - 1) FROM sg WHERE sg.series_id = pr.series_id AND y0 + m * (n - 1) <= pr.y)) END AS x
FROM pr LEFT JOIN b USING (series_id)""")
def index_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.this_or_previous(probes(spark, sf_dir), segments(spark, sf_dir), span=7 * 86400)


@query(f"{_SEGMENTS}, q AS (SELECT series_id, y0 + m * (n - 1) AS after, lead(y0) OVER (PARTITION BY series_id ORDER BY x0) AS before FROM sg) SELECT * FROM q WHERE before > after + 1")
def index_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.gaps(segments(spark, sf_dir))


@query(f"{_SEGMENTS} {_PROBES} SELECT series_id, y AS a, y + 3000 AS b, NOT EXISTS (SELECT 1 FROM sg WHERE sg.series_id = pr.series_id AND pr.y <= y0 + m * (n - 1) AND pr.y + 3000 >= y0) AS is_empty FROM pr")
def index_is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = probes(spark, sf_dir).select("series_id", F.col("y").alias("a"), (F.col("y") + 3000).alias("b"))
    return timeindex.is_empty(ranges, segments(spark, sf_dir))


@query(f"{_SEGMENTS}, q AS (SELECT series_id, x0, y0, m, unnest(range(0, n)) AS i FROM sg) SELECT series_id, x0 + i AS x, y0 + m * i AS y FROM q")
def index_all_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeindex.all_times(segments(spark, sf_dir))


@query(f"{_SEGMENTS}, q AS (SELECT series_id, x0, y0, m, unnest(range(0, n)) AS i FROM sg) SELECT series_id, x0 + i AS pos, (x0 + i)::DOUBLE AS value, y0 + m * i AS ts FROM q")
def samples_with_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    samples = timeindex.all_times(s).select("series_id", F.col("x").alias("pos"), F.col("x").cast("double").alias("value"))
    return timeindex.with_times(samples, s)


_FINITE = """(SELECT series_id, ts, id::DOUBLE AS value FROM (SELECT event_type AS series_id, epoch(date_trunc('hour', ts))::BIGINT AS ts, min(event_id) AS id FROM events GROUP BY 1, 2)
  WHERE id % 7 <> 0 AND id % 11 <> 0 AND id % 13 <> 0)"""


@query(_SEGMENTS.replace("(SELECT DISTINCT event_type AS series_id, epoch(date_trunc('hour', ts))::BIGINT AS ts FROM events)", _FINITE) + f""",
v AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM {_FINITE})
SELECT v.series_id, v.pos::BIGINT AS pos, v.value, y0 + m * (v.pos - x0) AS ts FROM v JOIN sg ON sg.series_id = v.series_id AND v.pos BETWEEN x0 AND x0 + n - 1""")
def times_through_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timed series with NaN, inf and null, compressed and back: each sample that is left has the time it had."""
    hours = F.unix_timestamp(F.date_trunc("HOUR", F.col("ts")).cast("timestamp"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), hours.alias("ts")).agg(F.min("event_id").alias("id"))
    broken = F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 11 == 0, float("inf")).when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("id").cast("double"))
    points = rows.select("series_id", "ts", broken.alias("value"))
    samples = engine.decompress(engine.compress(points, order=["ts"], codec="rle"))
    return timeindex.with_times(samples, timeindex.build_index(points, value="value"))


@query("""SELECT event_type AS series_id, event_id, epoch(ts)::BIGINT AS ts, coalesce(epoch(ts)::BIGINT < max(epoch(ts)::BIGINT) OVER
  (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rejected FROM events""")
def late_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "event_id", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("ts"))
    return timeindex.reject_late(rows, ["event_id"])


# scalar functions


@query("""SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS second_of_day, epoch(date_trunc('day', ts))::BIGINT AS day_start FROM events""")
def day_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", scalar.seconds_of_day(ts).alias("second_of_day"), scalar.start_of_day(ts).alias("day_start"))


@query(f"""WITH z AS (SELECT list((2 ** a * 3 ** b)::BIGINT) AS s FROM range(0, 21) AS u(a), range(0, 13) AS v(b))
SELECT p_partkey, 1::BIGINT << (length(bin(p_size)) - 1)::BIGINT AS below, list_min(list_filter(s, lambda q: q > p_size))::INT AS next_size, list_contains(s, p_size) AS smooth,
  floor(p_retailprice * 1000)::BIGINT AS fixed, {_round("p_retailprice / 7", 3)} AS rounded, least(greatest({_round("p_retailprice / 7", 3)}, 130.0::DOUBLE), 200.0::DOUBLE) AS clamped,
  floor(p_retailprice / 7)::BIGINT AS whole FROM part, z""")
def pow2_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalar.prev_power_of_two(n).alias("below"), scalar.next_size(n).alias("next_size"), scalar.is_decomposable(n).alias("smooth"),
        scalar.to_fixed(price, 3).alias("fixed"), scalar.round_half_away(price / 7, 3).alias("rounded"),
        scalar.round_clamped(price / 7, F.lit(130.0), F.lit(200.0), 3).alias("clamped"), scalar.whole_part(price / 7).alias("whole"),
    )
