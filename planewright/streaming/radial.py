"""The incremental radial filter: a point is passed on if it is far enough from the last one passed on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def radial_stream(points: DataFrame, least: float, key: str = "user_id", reset: str | None = None) -> DataFrame:
    """(key, idx, x, y) of the points passed on; ``points`` is a stream or a table with those columns.

    A key's state is the last point passed on, so its size doesn't grow. Rows of a micro-batch are
    taken in order of ``idx``; rows without coordinates are left out. ``reset`` names a boolean
    column: a row in which it is true begins anew, so that its own point is passed on.
    """
    kind = points.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        kept = []
        for row in pd.concat(list(frames)).dropna(subset=["x", "y"]).sort_values("idx").itertuples(index=False):
            if row.reset:
                last = None
            if last is None or (row.x - last[0]) ** 2 + (row.y - last[1]) ** 2 >= least * least:
                last = (float(row.x), float(row.y))
                kept.append((name[0], int(row.idx), *last))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=[key, "idx", "x", "y"])

    again = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    grouped = points.select(key, "idx", "x", "y", again.alias("reset")).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {kind}, idx long, x double, y double", "x double, y double", "append", GroupStateTimeout.NoTimeout)
