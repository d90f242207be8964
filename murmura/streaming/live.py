"""Streaming forms: folds with checkpointed state, upserts, tables written per micro-batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from murmura.operators.store import replace_by_key
from murmura.streaming.folds import Fold


def run(fold: Fold, stream: DataFrame, key: str, order: str, idle_ms: int | None = None, event_time: str | None = None) -> DataFrame:
    """A fold as a streaming query in append mode: results in the order in which each key's rows arrive.

    Rows of one micro-batch are put in order; across batches the source's order counts. With ``idle_ms`` a key without
    rows for so long is finished (what is open is emitted and the state goes): by the clock, or by ``event_time``, a
    column with a watermark, which replays the same way.
    """
    kinds = dict(stream.dtypes)
    values = [F.col(v) for v in fold.values]
    timed = [F.col(event_time).alias("__time")] if event_time else []
    rows = stream.select(F.col(key).alias("k"), F.col(order).alias("o"), *values, *timed)
    result = f"k {kinds[key]}, {fold.result.format(order=kinds[order])}"
    names = ["k", *[c.split()[0] for c in fold.result.split(", ")]]
    n = 2 + len(values)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else fold.begin()
        out: list[tuple] = []
        if state.hasTimedOut:
            out += fold.finish(k, held)
            state.remove()
        else:
            data = pd.concat(list(batches)).sort_values("o", kind="stable")
            for row in data.astype(object).where(data.notna(), None).itertuples(index=False, name=None):
                out += fold.step(held, row[:n])
            state.update((pickle.dumps(held),))
            if idle_ms is not None:
                if event_time:
                    state.setTimeoutTimestamp(max(int(data["__time"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
                else:
                    state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout
    done = rows.groupBy("k").applyInPandasWithState(update, result, "held binary", "append", timeout)
    return done.withColumnRenamed("k", key).withColumnRenamed("o", order)


def latest(stream: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The latest row of each key, for a query in update mode."""
    others = [c for c in stream.columns if c not in keys and c != seq]
    return stream.groupBy(*keys).agg(F.max(F.struct(seq, *others)).alias("r")).select(*keys, "r.*")


def upsert_into(path: str, keys: list[str], seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the latest row of each key in versioned Parquet below ``path``.

    A batch that is delivered again writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, keys, seq)
        if number > 0:
            old = spark.read.parquet(f"{path}/v{number - 1}")
            fresh = latest(old.unionByName(fresh.select(*old.columns)), keys, seq)
        fresh.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One micro-batch to several sinks, computed once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return write


def retain(path: str, meeting: str = "meeting_id") -> Callable[[DataFrame, int], None]:
    """A sink that adds final rows to the table of a session's retained segments; a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.filter("status = 'Final'").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


__all__ = ["fan_out", "latest", "replace_by_key", "retain", "run", "upsert_into"]
