"""Work on many small groups at once. Rows come sorted in Arrow batches, so that a task's groups cost one
call for each batch, not one for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def schema_of(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _starts(rows: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Places at which a group begins."""
    new = np.zeros(max(len(rows) - 1, 0), bool)
    for c in by:
        value, missing = rows[c].to_numpy(), rows[c].isna().to_numpy()
        new |= np.where(missing[1:] | missing[:-1], missing[1:] != missing[:-1], value[1:] != value[:-1]).astype(bool)
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def over_groups(df: DataFrame, by: list[str], order: list, work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of `work`, which gets whole groups, each in its order, one behind the other, and the places
    where they begin, with the number of rows behind the last. A group that goes on in the next batch
    waits for it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in parts:
            if not len(rows):
                continue
            starts = _starts(rows, by)
            if held and len(_starts(pd.concat([held[-1].tail(1), rows.head(1)]), by)) == 1:
                if len(starts) == 1:  # still the same group
                    held.append(rows)
                    continue
                held.append(rows[: starts[1]])
                rows = rows[starts[1] :]
                yield _done(held)
                starts = _starts(rows, by)
            elif held:
                yield _done(held)
            if starts[-1]:
                whole = rows[: starts[-1]].reset_index(drop=True)
                yield work(whole, starts)
            held = [rows[starts[-1] :]]
        if held:
            yield _done(held)

    def _done(held: list[pd.DataFrame]) -> pd.DataFrame:
        one = pd.concat(held, ignore_index=True)
        return work(one, np.array([0, len(one)]))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
