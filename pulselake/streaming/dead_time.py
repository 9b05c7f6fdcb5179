"""The dead-time fold on a stream: the same rows as operators.ordered.dead_time_fold, from state kept for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dead_time_stream(df: DataFrame, key: str, time: str, ident: str, block: int) -> DataFrame:
    """Rows that start a dead time, of a stream whose batches hold each key's rows in order of time.

    State is one number for each key: the time of its last start. Rows earlier than the last start are late and dropped.
    """
    schema = df.schema

    def fold(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values([time, ident])
        last = state.get[0] if state.exists else None
        stamps, keep = rows[time].to_numpy(), []
        at = 0 if last is None else int(np.searchsorted(stamps, last + block, "left"))
        while at < len(stamps):
            keep.append(at)
            last = int(stamps[at])
            at = int(np.searchsorted(stamps, last + block, "left"))
        if last is not None:
            state.update((last,))
        yield rows.iloc[keep]

    return df.groupBy(key).applyInPandasWithState(fold, schema, "last long", "append", GroupStateTimeout.NoTimeout)
