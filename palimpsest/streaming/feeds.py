"""Change feeds in micro-batches of commit times, and running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.windows import newest

STATE = "time long, value double"


def batches_of(cells: DataFrame, start: int, width: int, pick: str = "latest", tombstones: bool = False) -> DataFrame:
    """(batch, key, time, value): what consecutive batches (start + k width, start + (k + 1) width] would bring.

    ``latest`` gives a key's newest cell in each batch, ``between`` all of them.
    """
    rows = cells.where(F.col("time") > start).withColumn("batch", F.floor((F.col("time") - start - 1) / width).cast("long"))
    rows = newest(rows, "batch", "key") if pick == "latest" else rows
    return (rows if tombstones else rows.where(F.col("value").isNotNull())).select("batch", "key", "time", "value")


def write_latest(stream: DataFrame, path: str, checkpoint: str, tombstones: bool = True) -> StreamingQuery:
    """Appends each micro-batch's newest cell of every key to Parquet, then stops when the source is read up."""

    def put(rows: DataFrame, batch: int) -> None:
        found = newest(rows.select("key", "time", "value"))
        found = found if tombstones else found.where(F.col("value").isNotNull())
        # A batch that is run again replaces what it wrote before.
        found.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latest(stream: DataFrame) -> DataFrame:
    """(key, time, value): a key's newest cell so far, whenever a batch changes it; late, older cells change nothing."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        best = now
        for p in parts:
            row = p.loc[p["time"].idxmax()]
            if best is None or row["time"] > best[0]:
                best = (int(row["time"]), None if pd.isna(row["value"]) else float(row["value"]))
        if best is not None and best != now:
            state.update(best)
            yield pd.DataFrame({"key": [key[0]], "time": [best[0]], "value": pd.Series([best[1]], dtype="float64")})

    return stream.groupBy("key").applyInPandasWithState(update, "key long, " + STATE, STATE, "update", GroupStateTimeout.NoTimeout)
