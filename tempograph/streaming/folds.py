"""Rate limits, quotas, breakers, debouncing and queues over timed rows of a key.

What windows can say is said with windows. The quota needs an ordered fold; it
runs over sorted partitions and holds one key's state, never a key's rows, so
a hot key costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_sorted(rows: DataFrame, key: str, order: list[str], step: Callable[[Any, Any], tuple[Any, tuple]], out: str) -> DataFrame:
    """step(state, row) for each row of a key in order gives the next state (None at first) and the columns of ``out``; rows keep their own columns."""
    names = [x.split()[0] for x in out.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, first = None, None, True
        for b in batches:
            made = []
            for r in b.itertuples(index=False):
                k = getattr(r, key)
                if first or k != now:
                    now, state, first = k, None, False
                state, values = step(state, r)
                made.append(values)
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{schema}, {out}")


def quota(rows: DataFrame, key: str, at: str, allowed: int, seconds: int) -> DataFrame:
    """Whether each use is within a quota whose window opens at the first use after the last one has run out."""
    window = pd.Timedelta(seconds=seconds)

    def step(state, row):
        t = getattr(row, at)
        start, n = state if state is not None and t < state[0] + window else (t, 0)
        fits = n < allowed
        return (start, n + fits), (fits, start + window)

    ordered = [at, *[c for c in rows.columns if c not in (key, at)]]
    return fold_sorted(rows, key, ordered, step, "admitted boolean, resets_at timestamp")


def rate_limited(rows: DataFrame, key: str, at: str, tie: str, period: float, burst: int) -> DataFrame:
    """Seconds that each request waits for a cell; one comes free each period, up to burst of them.

    The time when all cells are free again is a running maximum, so no fold is needed.
    """
    order = W.partitionBy(key).orderBy(at, tie)
    t, n = F.unix_micros(F.col(at)) / 1e6, F.row_number().over(order)
    rows = rows.withColumn("_t", t).withColumn("_n", n).withColumn("_m", F.max(F.col("_t") - (F.col("_n") - 1) * period).over(order.rowsBetween(W.unboundedPreceding, 0)))
    before = F.lag("_m").over(order) + (F.col("_n") - 1) * period
    wait = F.greatest(F.coalesce(before, F.col("_t")) - (burst - 1) * period - F.col("_t"), F.lit(0.0))
    return rows.withColumn("wait_s", wait).drop("_t", "_n", "_m")


def failures(rows: DataFrame, key: str, at: str, tie: str, failed: Column, base_s: float, most_s: float, limit: int) -> DataFrame:
    """Failures in a row, the doubling backoff after each, and whether the breaker is open."""
    order = W.partitionBy(key).orderBy(at, tie)
    rows = rows.withColumn("_f", failed).withColumn("_run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(order))
    n = F.sum(F.col("_f").cast("int")).over(W.partitionBy(key, "_run").orderBy(at, tie))
    rows = rows.withColumn("in_a_row", n)
    wait = F.when(F.col("in_a_row") > 0, F.least(base_s * F.pow(F.lit(2.0), F.least(F.col("in_a_row") - 1, F.lit(60))), F.lit(most_s))).otherwise(0.0)
    return rows.withColumn("backoff_s", wait).withColumn("open", F.col("in_a_row") >= limit).drop("_f", "_run")


def debounced(rows: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """The rows that come at least so long after the row of their key before."""
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(W.partitionBy(key).orderBy(at, tie)))
    return rows.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= seconds * 1_000_000)).drop("_gap")


def idle(rows: DataFrame, key: str, at: str, tie: str, activity: Column, seconds: int) -> DataFrame:
    """The other rows at whose time the last activity of their key is at least so long ago, or never was."""
    last = F.max(F.when(activity, F.unix_micros(at))).over(W.partitionBy(key).orderBy(at, tie))
    return rows.withColumn("_last", last).where(~activity & (F.col("_last").isNull() | (F.unix_micros(at) - F.col("_last") >= seconds * 1_000_000))).drop("_last")


def newest(rows: DataFrame, key: str, at: str, tie: str, most: int) -> DataFrame:
    """A ledger with a cap for each key: the oldest rows beyond it go."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))).where(F.col("_rank") <= most).drop("_rank")
