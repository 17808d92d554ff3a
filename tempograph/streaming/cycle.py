"""Connector sync as a stream: rows and tombstones, with replays absorbed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def applied(state: DataFrame, batch: DataFrame, key: list[str], deleted: str = "deleted") -> DataFrame:
    """The state after a batch of upserts and tombstones: of each key the batch's last row (by seq) counts, and rows that are already there change nothing."""
    last = batch.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("seq")))).where("_rank = 1").drop("_rank")
    newer = last.join(state.select(*key, F.col("seq").alias("_seq")), key, "left").where("_seq is null or seq > _seq").drop("_seq")
    return state.join(newer.select(*key), key, "left_anti").unionByName(newer.where(~F.col(deleted)).select(*state.columns))


def sync(stream: DataFrame, path: str, checkpoint: str, key: list[str], columns: str) -> StreamingQuery:
    """Keeps a table in step with a stream of rows (columns, seq long, deleted boolean) until what is there is read.

    Each batch writes a version of its own and reads the one before, so a batch
    that is run again after a failure gives the same version.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(columns).parquet(f"{path}/v={number - 1}") if number else session.createDataFrame([], columns)
        applied(before, batch, key).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quota_stream(stream: DataFrame, allowed: int, seconds: int) -> DataFrame:
    """As folds.quota for a stream of key string, at timestamp: state is a window's start and count for each key.

    Rows of one key within a micro-batch are put in order of time; rows of a
    later batch count as later.
    """
    window = pd.Timedelta(seconds=seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        start = pd.Timestamp(start, unit="us") if start is not None else None
        times = pd.concat([b["at"] for b in batches]).sort_values()
        fits = []
        for t in times:
            if start is None or t >= start + window:
                start, n = t, 0
            fits.append(n < allowed)
            n += fits[-1]
        state.update((start.value // 1000, int(n)))
        yield pd.DataFrame({"key": key[0], "at": times.to_numpy(), "admitted": fits})

    return stream.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, admitted boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)
