"""Gaps of requests on a stream: the last timestamps of each object as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from slotwise.operators.requests import GAPS, SENTINEL


def streaming_gaps(requests: DataFrame, gaps: int = GAPS, sentinel: float = SENTINEL) -> DataFrame:
    """seq, object_id, ts, g1..: equal to the batch gaps if each object's requests arrive in order of seq.

    State is one short array an object and is never dropped: a request however late finds its history.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, ts in zip(rows.seq.tolist(), rows.ts.tolist(), strict=True):
            found = [ts - t for t in last][:gaps]
            out.append((seq, key[0], ts, *found, *[sentinel] * (gaps - len(found))))
            last = [ts, *last][:gaps]
        state.update((last,))
        yield pd.DataFrame(out, columns=["seq", "object_id", "ts", *[f"g{i + 1}" for i in range(gaps)]])

    schema = "seq long, object_id string, ts double, " + ", ".join(f"g{i + 1} double" for i in range(gaps))
    return requests.groupBy("object_id").applyInPandasWithState(update, schema, "last array<double>", "append", "NoTimeout")
