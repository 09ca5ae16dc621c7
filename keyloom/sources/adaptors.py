"""Where messages come from and go to: adaptors, and a registry of them by name."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.model import KeyExtractor, ModelError, TypedMessage, to_json
from keyloom.plans.batch import ENVELOPE, envelope


class Adaptor:
    """A source: read() gives its messages as envelope rows, bounded or not."""

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError


class TableAdaptor(Adaptor):
    """Rows of a table or file as messages of one type. Columns are pruned to those named."""

    def __init__(self, path: str, message_type: str, key: str, seq: str, *payload: str, fmt: str = "parquet", schema: str | None = None, stream: bool = False, **options: str):
        self.args, self.path, self.fmt, self.schema, self.stream, self.options = (message_type, key, seq, *payload), path, fmt, schema, stream, options

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream if self.stream else spark.read
        reader = reader.format(self.fmt).options(**self.options)
        rows = (reader.schema(self.schema) if self.schema else reader).load(self.path)
        return envelope(self.prepared(rows), *self.args)

    def prepared(self, rows: DataFrame) -> DataFrame:
        """For adaptors that derive columns, or make several rows of one, before these become messages."""
        return rows


class Dispatcher:
    """Takes objects or explicit messages one by one or in lists; what comes after stop() is dropped and counted."""

    def __init__(self) -> None:
        self._lock, self._rows, self._keys = threading.Lock(), [], KeyExtractor()
        self.dropped, self._open = 0, True

    def dispatch(self, message: Any) -> None:
        if message is None:
            raise ModelError("nothing to dispatch")
        for one in message if isinstance(message, list) else [message]:
            if not isinstance(one, TypedMessage):
                raise ModelError("dispatch takes explicit messages; dispatch_annotated takes others")
            self._add([one])

    def dispatch_annotated(self, message: Any) -> None:
        self._add(self._keys.extract(message))

    def _add(self, messages: Iterable[TypedMessage]) -> None:
        with self._lock:
            for m in messages:
                if not self._open:
                    self.dropped += 1
                    continue
                for t in m.types:
                    self._rows.append((t, str(m.key), to_json(m.message), len(self._rows)))

    def stop(self) -> None:
        self._open = False


class DispatcherAdaptor(Adaptor, Dispatcher):
    """A dispatcher whose messages are a source; they are what one driver process pushes, not a corpus."""

    def read(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame(list(self._rows), ENVELOPE)


class DummyDispatcher(Dispatcher):
    """Drops all."""

    def _add(self, messages: Iterable[TypedMessage]) -> None:
        self.dropped += len(list(messages))


def null_sink(df: DataFrame) -> None:
    """Runs df and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def table_sink(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    df.write.format(fmt).mode(mode).save(path)


def stream_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger: Any) -> Any:
    """A durable sink of an appending stream; each batch is written once. trigger: as for writeStream, availableNow by default."""
    return df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)


def periodic(df: DataFrame, every: Callable | float | str, run: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """A stream's output on a schedule: run(batch, number) at each trigger; seconds, or text such as '5 minutes'."""
    length = every if isinstance(every, str) else f"{every} seconds"
    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("update").trigger(processingTime=length).start()


class Registry:
    """Implementations by a dotted id; a longer id finds the nearest one above it."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, make: Callable[..., Any]) -> None:
        self._made[name] = make

    def get(self, name: str, *args: Any, **options: Any) -> Any:
        at = name
        while at:
            if at in self._made:
                return self._made[at](*args, **options)
            at = at.rpartition(".")[0]
        raise KeyError(f"nothing is registered as {name!r}")


ADAPTORS = Registry()
ADAPTORS.register("table", TableAdaptor)
ADAPTORS.register("dispatcher", DispatcherAdaptor)
SINKS = Registry()
SINKS.register("null", lambda: null_sink)
SINKS.register("table", lambda: table_sink)
SINKS.register("stream", lambda: stream_sink)


def json_messages(df: DataFrame) -> DataFrame:
    """Envelope rows as one JSON text each, and back by from_json_messages."""
    return df.select(F.to_json(F.struct("message_type", "key", "payload", "seq")).alias("value"))


def from_json_messages(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("value", ENVELOPE).alias("m")).select("m.*")
