"""Functions that the user brings, over batches of rows; a bad row becomes an error row and loses nobody else."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def map_rows(df: DataFrame, row_id: str, value: str, function: Callable[[object], str | None]) -> DataFrame:
    """(id, ok, result, error) for each row, in Arrow batches of the session's size."""
    kind = dict(df.dtypes)[row_id]

    def run(batches):
        for pdf in batches:
            out = []
            for k, x in zip(pdf[row_id], pdf[value], strict=True):
                try:
                    out.append((k, True, function(x), None))
                except Exception as e:  # the row's own failure is its result
                    out.append((k, False, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=[row_id, "ok", "result", "error"])

    return df.select(row_id, value).mapInPandas(run, f"{row_id} {kind}, ok boolean, result string, error string")
