"""The time index as a streaming query: segments close as points arrive, late points are marked."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seriesmith.operators.timeindex import resume

OUTPUT = "series_id string, kind string, m long, x0 long, y0 long, n long, rejected_ts long"
STATE = "max_ts long, m long, x0 long, y0 long, n long"


def _advance(timeout_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Closed segments (kind segment), rejected points (kind late) and, when a series times out, its open segment.

    The points of a trigger are taken in the order of time; one that is earlier than a point of an earlier trigger is late.
    """
    (name,) = key
    row = lambda kind, seg=(None,) * 4, late=None: (name, kind, *seg, late)
    if state.hasTimedOut:
        _, *segment = state.get
        state.remove()
        yield pd.DataFrame([row("segment", segment)], columns=_NAMES)
        return
    newest, *segment = state.get if state.exists else (None, 0, 0, 0, 0)
    times = sorted(int(t) for pdf in batches for t in pdf["ts"].dropna())
    late = [t for t in times if newest is not None and t < newest]
    fine = times[len(late) :]
    current = tuple(segment) if segment[3] else None
    found = list(resume(current, fine))
    rows = [row("segment", s) for s in found[:-1]] + [row("late", late=t) for t in late]
    if found:
        state.update((max(fine[-1] if fine else newest, newest or 0), *found[-1]))
    if timeout_ms is not None:
        state.setTimeoutDuration(timeout_ms)
    if rows:
        yield pd.DataFrame(rows, columns=_NAMES)


_NAMES = [field.split()[0] for field in OUTPUT.split(", ")]


def segment_stream(points: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """OUTPUT of a stream of points (series_id, ts in seconds), in append mode; the state is one segment a series.

    With a timeout, a series without points for so long gives its open segment, and its next point starts anew. Such a query
    looks for timeouts all the time and never is idle.
    """
    typed = points.select(F.col("series_id").cast("string"), F.col("ts").cast("long"))
    when = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _advance(timeout_ms, key, batches, state)

    return typed.groupBy("series_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", when)
