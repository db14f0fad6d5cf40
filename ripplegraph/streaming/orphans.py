"""Orphan references kept up to date as references and parents arrive and go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ripplegraph.operators.orphans import PendingOrphans

STATE = "present boolean, waiting array<string>, since array<long>, attached array<string>"
OUTPUT = "key string, ident string, since long, until long"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = PendingOrphans()
    if state.exists:
        s.present, waiting, since, attached = state.get
        s.waiting, s.attached = dict(zip(waiting, since, strict=True)), set(attached)
    rows = pd.concat(list(batches)).sort_values(["seq", "op"], kind="stable")
    out = [(key[0], *span) for q, op, i in zip(rows["seq"], rows["op"], rows["ident"], strict=True) for span in s.apply(int(q), int(op), i)]
    state.update((s.present, list(s.waiting), list(s.waiting.values()), list(s.attached)))
    if out:
        yield pd.DataFrame(out, columns=["key", "ident", "since", "until"])


def stream_orphans(events: DataFrame) -> DataFrame:
    """Spans (key, ident, since, until) as they end: a reference that had no parent got one, or went.

    ``events`` is a stream of (key, seq, op, ident), the codes of ``ripplegraph.operators.orphans``; within a key batches
    must come in order of seq, within a batch any order will do. The state of a key is all references to it; a key of very
    many is given as several, its references parted by a hash of their ident and its parent's events copied to each, as
    ``orphan_spans`` does.
    """
    return events.groupBy("key").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
