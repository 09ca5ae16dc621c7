"""Unbounded input: the processors of keyloom.plans over streams, one state-store row for each key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloom.plans.batch import NAMES, RESULT, Options, Runner, placed
from keyloom.processor import Processor
from keyloom.streaming.schedules import Cron, Every

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Schedule = float | Every | Cron


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def schedule(found: Schedule | str | None) -> Every | Cron | None:
    """Seconds, an interval, or a cron expression; nothing and 0 are none."""
    if not found:
        return None
    return Cron(found) if isinstance(found, str) else Every(found) if isinstance(found, (int, float)) else found


def due_after(plan: Every | Cron, now: int) -> int:
    """Milliseconds of the next moment after `now`; far off if there is none. Cron fields are in UTC."""
    at = plan.after(datetime.fromtimestamp(now / 1000, timezone.utc).replace(tzinfo=None))
    return int(at.replace(tzinfo=timezone.utc).timestamp() * 1000) if at else 1 << 62


class Keyed(StatefulProcessor):
    """An instance per key, pickled in the state store; timers drive its output passes and eviction checks.

    State outlives restarts with the query's checkpoint, so each message changes it once. output_every and evict_every are
    schedules of processing time, each with a due time of its own; without them nothing is put out or evicted, unless options
    name spans of seq. A key's messages of a micro-batch are held as columns, sorted, and handled one after the other.
    """

    def __init__(self, processor: Processor, options: Options = Options(), output_every: Schedule | None = None, evict_every: Schedule | None = None):
        self.args = (processor, options)
        self.plans = {"output": schedule(output_every), "evict": schedule(evict_every)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runner = Runner(*self.args)
        self.held = handle.getValueState("instance", "instance binary, last long, output_at long, evict_at long")

    def _load(self) -> tuple[Any, int | None, dict[str, int]]:
        held = self.held.get()  # null without a state: one question to the store, not two
        if held is None:
            return None, None, {"output": 0, "evict": 0}
        raw, last, output_at, evict_at = held
        return cloudpickle.loads(raw), last, {"output": output_at, "evict": evict_at}

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        """Rows as a frame, without those of kinds that are not asked for."""
        kinds = self.runner.o.kinds
        return pd.DataFrame(out if kinds is None else [r for r in out if r[0] in kinds], columns=NAMES)

    def _keep(self, own: Any, last: int | None, due: dict[str, int]) -> None:
        if own is None:
            self.held.clear()
        else:
            self.held.update((cloudpickle.dumps(own), last, due["output"], due["evict"]))

    def _arm(self, now: int, due: dict[str, int]) -> None:
        for name, plan in self.plans.items():
            if plan and due[name] <= now:
                due[name] = due_after(plan, now)
                self.handle.registerTimer(due[name])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        own, last, due = self._load()
        out: list[tuple] = []
        frames = [df[["message_type", "payload", "seq", "place"]] for df in rows]
        found = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        seq, where = found["seq"].to_numpy(), found["place"].map(lambda x: bytes(x or b"")).to_numpy(object)
        order = np.argsort(seq, kind="stable") if not any(where) else np.array(sorted(range(len(seq)), key=lambda i: (seq[i], where[i])))
        pile: list = []
        kinds, bodies = found["message_type"].tolist(), found["payload"].tolist()
        for i in order.tolist():
            m = self.runner.read(kinds[i], bodies[i], int(seq[i]), where[i])
            own, pile, last = self.runner.next(own, key[0], pile, last, m, out)
            if len(out) > 20_000:
                yield self._rows(out)
                out = []
        own = self.runner.handle(own, key[0], pile, out)
        if own is not None:
            self._arm(timerValues.getCurrentProcessingTimeInMs(), due)
        self._keep(own, last, due)
        yield self._rows(out + self.runner.timings())

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """An instance for a key of a key source, before its first message; one whose activation fails is made by that message."""
        own = self.runner.get(None, key[0], [], [])
        due = {"output": 0, "evict": 0}
        if own is not None:
            self._arm(timerValues.getCurrentProcessingTimeInMs(), due)
        self._keep(own, None, due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        own, last, due = self._load()
        out: list[tuple] = []
        now = expiredTimerInfo.getExpiryTimeInMs()
        if own is not None:
            if self.plans["output"] and due["output"] <= now:
                self.runner.put_out(own, key[0], now, out)
            if self.plans["evict"] and due["evict"] <= now:
                own = self.runner.check(own, key[0], now, out)
            if own is not None:
                self._arm(now, due)
            self._keep(own, last, due)
        yield self._rows(out + self.runner.timings())

    def close(self) -> None: ...


def keyed(
    messages: DataFrame, processor: Processor, cluster: str = "", bulk: bool = False, output_every: Schedule | str | None = None, evict_every: Schedule | str | None = None,
    output_span: int | None = None, evict_span: int | None = None, keys: DataFrame | None = None, kinds: Iterable[str] | None = None,
) -> DataFrame:
    """Results of a processor over a stream of envelope rows; stages may follow one another in a query.

    output_every, evict_every: processing time. output_span, evict_span: units of seq, as over tables. keys: a table with a column
    `key`, each of which has an instance from the start. kinds: the kinds of rows that are returned, all without it.
    """
    timed = schedule(output_every) or schedule(evict_every)
    own = placed(messages).where(F.col("message_type").isin(*sorted(processor.types)) & F.col("key").isNotNull()).select("message_type", "key", "payload", "seq", "place")
    stage = Keyed(processor, Options(cluster, bulk, output_span=output_span, evict_span=evict_span, kinds=None if kinds is None else frozenset(kinds)), schedule(output_every), schedule(evict_every))
    first = keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct().groupBy("key") if keys is not None else None
    return own.groupBy("key").transformWithStateInPandas(stage, RESULT, "Update", "ProcessingTime" if timed else "None", first)


def collected(df: DataFrame, name: str, mode: str = "update") -> list:
    """All rows of a query that is run over what is available now; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()
