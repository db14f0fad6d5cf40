"""Continuous periods and gaps of entities, kept up to date as intervals arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ripplegraph.operators.intervals import IntervalMap

STATE = "starts array<long>, ends array<long>"
OUTPUT = "entity string, kind string, start long, end long, version long, live boolean"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*(list(x) for x in state.get)) if state.exists else IntervalMap()
    of = lambda: {*(("period", *p) for p in m.periods()), *(("gap", *g) for g in m.gaps())}
    before, version = of(), 0
    for b in batches:
        for s, e, v in zip(b["start"], b["end"], b["version"], strict=True):
            version = max(version, int(v))
            if not (pd.isna(s) or pd.isna(e)) and e >= s:
                m.insert(int(s), int(e))
    after = of()
    if after != before:
        state.update((m.starts, m.ends))
        rows = [(key[0], *r, version, True) for r in sorted(after - before)] + [(key[0], *r, version, False) for r in sorted(before - after)]
        yield pd.DataFrame(rows, columns=["entity", "kind", "start", "end", "version", "live"])


def stream_intervals(ranges: DataFrame) -> DataFrame:
    """What a batch changed in the periods and gaps of an entity: new ones ``live``, and those that are no more.

    ``ranges`` is a stream of (entity, start, end, version), version rising over time, in update mode. Null or reversed
    bounds cover nothing. The state of an entity is its disjoint intervals, so it shrinks as holes close, and is written only
    when they change. An entity of very many intervals is given as several, cut by range (a file by blocks of lines); periods
    that touch at a cut are joined by ``merge_intervals`` over the table that the stream feeds.
    """
    return ranges.groupBy("entity").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
