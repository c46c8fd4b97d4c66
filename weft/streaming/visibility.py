"""Horizontal visibility over a stream: edges as events come, with a stack for each series as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "layout long, src long, dst long, weight double, time_gap long"
STATE = "seq long, last double, seqs array<long>, ids array<long>, times array<double>, values array<double>"


def stream_horizontal_visibility(events: DataFrame) -> DataFrame:
    """Append-only edges for a stream of (layout, id, t, v).

    A new event sees the events on the stack from the top until one is as high as it or higher (which it
    still sees); lower ones leave the stack. An event that is older than its series' last one is left
    out, so a series' events must come in order from batch to batch; within a batch they are sorted.
    The stack is as long as the series' longest strictly falling run of events still in sight."""

    def step(key, frames, state: GroupState):
        seq, last, seqs, ids, times, values = state.get if state.exists else (0, float("-inf"), [], [], [], [])
        seqs, ids, times, values = list(seqs), list(ids), list(times), list(values)
        rows = []
        for event in pd.concat(list(frames)).sort_values(["t", "id"], kind="stable").itertuples():
            if event.t < last:
                continue
            while values:
                rows.append((key[0], min(ids[-1], event.id), max(ids[-1], event.id), event.t - times[-1], seq - seqs[-1]))
                if values[-1] > event.v:
                    break
                level = values[-1]
                for own in (seqs, ids, times, values):
                    own.pop()
                if level == event.v:
                    break
            for own, x in ((seqs, seq), (ids, int(event.id)), (times, float(event.t)), (values, float(event.v))):
                own.append(x)
            seq, last = seq + 1, float(event.t)
        state.update((seq, last, seqs, ids, times, values))
        yield pd.DataFrame(rows, columns=["layout", "src", "dst", "weight", "time_gap"])

    return events.select("layout", "id", "t", "v").groupBy("layout").applyInPandasWithState(step, EDGES, STATE, "append", GroupStateTimeout.NoTimeout)
