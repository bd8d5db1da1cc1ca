"""Operators whose state lives in a stream's checkpoint: results kept by key, and results taken in by their index.

Both are ``transformWithState`` processors. The state store commits with each
micro-batch, so a start that fails is repeated from the state before it, and the
next start finds what earlier ones left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(spark: SparkSession) -> None:
    """Processors keep values and timers, which Spark's default store cannot; a store that was chosen stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(name, STORE)


class _Cache(StatefulProcessor):
    def __init__(self, evaluate: Callable, result: StructType, order: str, ttl_ms: int | None):
        self.evaluate, self.result, self.order, self.ttl_ms = evaluate, result, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", self.result, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)  # one key's rows of a micro-batch
        hit = self.kept.exists()
        if not hit:
            self.kept.update(tuple(self.evaluate(key[0])))
        found = self.kept.get()
        for name, value in zip(self.result.names, found, strict=True):
            batch[name] = pd.Series([value] * len(batch), dtype=object)
        batch["cache_hit"] = hit
        batch["duplicate"] = [i > 0 and not hit for i in range(len(batch))]
        yield batch

    def close(self) -> None:
        pass


def cached_evaluation(stream: DataFrame, key: str, order: str, evaluate: Callable, result: StructType, ttl_ms: int | None = None) -> DataFrame:
    """``stream`` with the columns of ``result``, cache_hit and duplicate: ``evaluate(key)`` runs once for a key, over all starts.

    It gives a tuple of the result's values, which stays in the state for
    ``ttl_ms`` (for ever by default). ``cache_hit``: the key was known before this
    micro-batch; ``duplicate``: an earlier row by ``order`` of the same micro-batch
    asked for it. A null key is a key like any other.
    """
    _stateful(stream.sparkSession)
    out = StructType([*stream.schema.fields, *result.fields, StructField("cache_hit", BooleanType()), StructField("duplicate", BooleanType())])
    return stream.groupBy(key).transformWithStateInPandas(_Cache(evaluate, result, order, ttl_ms), out, "Append", "ProcessingTime" if ttl_ms else "None")


class _Drain(StatefulProcessor):
    """Holds what came too early by its index; what comes twice counts once."""

    def __init__(self, run: str, index: str, names: list[str], wait_ms: int | None):
        self.run, self.index, self.names, self.wait_ms = run, index, names, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n long")
        self.early = handle.getMapState("early", "i long", "row string")

    def _released(self, rows: list, upto: int) -> Iterator:
        import pandas as pd

        self.next.update((upto,))
        if rows:
            yield pd.DataFrame(rows, columns=[*self.names, "processed", "emitted"])

    def _release(self, fresh: dict) -> tuple[list, int]:
        """Rows that are due, of this batch or kept from earlier ones; the rest of the batch is kept."""
        import pickle

        at, rows, failed = self.next.get()[0], [], self.names.index("error")
        waiting = next(iter(self.early.keys()), None) is not None
        while True:
            if at in fresh:
                row = fresh.pop(at)
            elif waiting and self.early.containsKey((at,)):
                row = pickle.loads(bytes.fromhex(self.early.getValue((at,))[0]))
            else:
                break
            if waiting:
                self.early.removeKey((at,))
            at += 1
            rows.append((*row, at, row[failed] is None))
        for i, row in fresh.items():
            self.early.updateValue((i,), (pickle.dumps(tuple(row)).hex(),))
        return rows, at

    def _watch(self, now: int) -> None:
        """A timer for the gap that holds early rows back."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if next(iter(self.early.keys()), None) is not None:
            self.handle.registerTimer(now + self.wait_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        if not self.next.exists():
            self.next.update((0,))
        at, fresh = self.next.get()[0], {}
        for batch in rows:
            clean = batch.astype(object).where(pd.notna(batch), None)
            for row in clean[self.names].itertuples(index=False, name=None):
                i = int(row[self.names.index(self.index)])
                if i >= at:
                    fresh[i] = row
        found, upto = self._release(fresh)
        yield from self._released(found, upto)
        if self.wait_ms is not None and (found or not list(self.handle.listTimers())):
            self._watch(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        """The row that all wait for has not come: it counts as failed."""
        at, early = self.next.get()[0], [k[0] for k in self.early.keys()]
        if early:
            value = dict.fromkeys(self.names) | {self.index: at, "error": "missing"}
            value[self.run] = key[0]
            lost = [(*[value[n] for n in self.names], at + 1, False)]
            self.next.update((at + 1,))
            found, upto = self._release({})
            yield from self._released(lost + found, upto)
            self._watch(timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def drained_stream(results: DataFrame, run: str, index: str = "sample_index", wait_ms: int | None = None) -> DataFrame:
    """A stream of ``results(run, index, error, ...)``, in any order, as a run takes them in: each run's rows by index from 0, without gaps.

    Adds ``processed``, the counter after the row, and ``emitted``: a failed row
    counts but gives no output. Rows that come before the one that is due wait in
    the state, over starts too; after ``wait_ms`` without progress the row that is
    due counts as missing. A run is one sequence, kept by one task; runs are many.
    """
    _stateful(results.sparkSession)
    names = results.columns
    if "error" not in names or index not in names:
        raise ValueError(f"results need the columns {index} and error")
    out = StructType([*results.schema.fields, StructField("processed", LongType()), StructField("emitted", BooleanType())])
    return results.groupBy(run).transformWithStateInPandas(_Drain(run, index, names, wait_ms), out, "Append", "ProcessingTime" if wait_ms else "None")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> None:
    """One start: what is new goes through ``stream`` into the folder ``sink``. Timers and expiry are looked at when there are new rows."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # with timers there would always be another batch; a query takes its settings when it starts
    try:
        query = stream.writeStream.format(fmt).option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    query.awaitTermination()
