"""One stateful processor for every per-stream fold: rows of a micro-batch in order, small state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.durable import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"

# (rows in order, state or None) -> (output rows as tuples, state)
Step = Callable[[pd.DataFrame, dict | None], tuple[list[tuple], dict]]


class Fold(StatefulProcessor):
    """Applies ``step`` to each key's rows, sorted by ``order`` inside the micro-batch.

    The state is one small value per key; a step keeps it bounded.  ``due`` (optional) names the
    next event time, in milliseconds, at which ``on_due`` must look at the state again.
    """

    def __init__(self, order: list[str], columns: list[str], step: Step, due=None, on_due=None):
        self.order, self.columns, self.step = order, columns, step
        self.due, self.on_due = due, on_due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", "value string")

    def _load(self) -> dict | None:
        return json.loads(self.value.get()[0]) if self.value.exists() else None

    def _store(self, state: dict) -> None:
        self.value.update((json.dumps(state),))
        if self.due is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            at = self.due(state)
            if at is not None:
                self.handle.registerTimer(at)

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        keyed = [(*key, *row) for row in rows]
        return pd.DataFrame(keyed, columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        out, state = self.step(batch, self._load())
        self._store(state)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Everything up to the watermark is due, not only what the timer was set for.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out, state = self.on_due(self._load(), now)
        self._store(state)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def fold_stream(
    sdf: DataFrame,
    keys: list[str],
    order: list[str],
    schema: str,
    step: Step,
    due=None,
    on_due=None,
) -> DataFrame:
    """``step`` over a stream; ``schema`` lists the output columns after the keys.

    Micro-batches must arrive in order (files of a landing folder do); their size is set with
    ``maxFilesPerTrigger`` and bounds what one task holds for one key.
    """
    spark = sdf.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    key_schema = ", ".join(f"{k} {sdf.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, *[c.strip().split(" ")[0] for c in schema.split(",")]]
    return sdf.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Fold(order, columns, step, due, on_due),
        outputStructType=f"{key_schema}, {schema}",
        outputMode="Append",
        timeMode="EventTime" if due else "None",
    )


def drain(sdf: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available now into a table below the shared folder."""
    spark = sdf.sparkSession
    before = spark.conf.get(PARTITIONS)
    # State stores are opened per shuffle partition: no more of them than the cluster has slots.
    slots = max(8, spark.sparkContext.defaultParallelism)
    spark.conf.set(PARTITIONS, str(min(int(before), slots)))
    path = fresh_path(spark, label)
    try:
        run = (
            sdf.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/table")
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        spark.conf.set(PARTITIONS, before)
    return spark.read.schema(sdf.schema).parquet(f"{path}/table")
