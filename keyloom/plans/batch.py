"""Bounded input: processors over tables.

A declarative processor becomes aggregates or window functions, which Catalyst plans. Any other runs as its Python class: rows
are dealt by key, sorted by (key, seq, place) within their partition and streamed through, so a task holds one instance at a time
and no group is ever collected. The same class runs over streams in keyloom.streaming.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.model import KeyedMessage, KeyExtractor, ModelError, TypedMessage, from_json, to_json
from keyloom.processor import Processor
from keyloom.storage import cut, written
from keyloom.topology import Topology, TopologyError

#: Messages travel so: a type id, the key as text, the body as JSON, and their place in the order of arrival. A column `place`
#: may follow, which orders the messages that one message caused; see place().
ENVELOPE = "message_type string, key string, payload string, seq long"
#: What a stage returns: messages it sent, and one row for each event that the counters count.
RESULT = "kind string, message_type string, key string, payload string, seq long, place binary, state binary"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
KINDS = ("message", "created", "dispatched", "processed", "failed", "unkeyed", "unsent", "output_failed", "evicted", "deleted", "timing", "state")
#: Most messages that a bulk handler gets at once, over tables and over streams.
PILE = 1000
#: Deltas of state that a cluster keeps before they become one table.
DELTAS = 8


def envelope(df: DataFrame, message_type: str | Column, key: str | Column, seq: str | Column, *payload: str) -> DataFrame:
    """Rows of df as messages of one type, their body the named columns. Null keys can't be sent and are left out."""
    kind = F.lit(message_type) if isinstance(message_type, str) else message_type
    key = F.col(key) if isinstance(key, str) else key
    seq = F.col(seq) if isinstance(seq, str) else seq
    return df.select(kind.alias("message_type"), key.cast("string").alias("key"), F.to_json(F.struct(*payload)).alias("payload"), seq.cast("long").alias("seq")).where("key IS NOT NULL")


def read_payload(df: DataFrame, schema: str) -> DataFrame:
    """Messages with their bodies as columns."""
    return df.withColumn("m", F.from_json("payload", schema)).select("message_type", "key", "seq", "m.*")


def placed(df: DataFrame) -> DataFrame:
    """Envelope rows with a column `place`, empty where they have none."""
    return df if "place" in df.columns else df.withColumn("place", F.lit(b""))


def place(parent: bytes, nth: int) -> bytes:
    """The place of the nth message that the one at `parent` caused: places sort as bytes, by parent first, then by n."""
    if nth < 240:
        return parent + bytes((nth,))
    raw = nth.to_bytes((nth.bit_length() + 7) // 8, "big")
    return parent + bytes((239 + len(raw),)) + raw


@dataclass
class Message:
    """A message as a runner gets it; body is what JSON says, or the error of reading it."""

    kind: str
    body: Any
    seq: int
    place: bytes
    wrong: str | None = None


@dataclass(frozen=True)
class Options:
    """How a cluster's instances live.

    output_span, evict_span: output passes and eviction checks fall due whenever seq passes a multiple of them; null is never.
    end: where the input ends, for the output passes after an instance's last message. final_output: one more pass at the end.
    stop: passivate what is left. keep: return instances as `state` rows, null ones for those that are gone.
    kinds: the kinds of rows that are returned, all without it. fold: what output passes repeat is one row, with their number.
    """

    cluster: str = ""
    bulk: bool = False
    final_output: bool = False
    stop: bool = False
    keep: bool = False
    output_span: int | None = None
    evict_span: int | None = None
    end: int | None = None
    kinds: frozenset[str] | None = None
    fold: bool = False


class Runner:
    """A processor's instances over rows that come sorted by key, seq and place.

    What goes wrong in a handler, an activation, an output pass, a payload or a key is counted as a row, and the rest goes on.
    """

    def __init__(self, processor: Processor, options: Options = Options()):
        self.processor, self.o = processor, options
        self.keys = KeyExtractor()
        self.spent = {"output": [0, 0.0], "evict": [0, 0.0]}
        self.tells_dispatched, self.tells_processed = (options.kinds is None or k in options.kinds for k in ("dispatched", "processed"))
        processor.begin(options.cluster)

    def read(self, kind: str, body: str, seq: int, at: bytes) -> Message:
        try:
            return Message(kind, from_json(self.processor.types.get(kind), body), seq, at)
        except Exception as wrong:
            return Message(kind, None, seq, at, repr(wrong))

    def send(self, results: list[Any], seq: int, parent: bytes, out: list[tuple], nth: int = 0) -> int:
        """Results as messages, from the nth of their cause on; unkeyed: of a class without a key; unsent: its key failed."""
        for r in results:
            try:
                sent = self.sent(r)
            except ModelError:
                out.append(("unkeyed", type(r).__name__, None, None, seq, parent, None))
                continue
            except Exception as wrong:
                out.append(("unsent", type(r).__name__, None, repr(wrong), seq, parent, None))
                continue
            for t, key, body in sent:
                out.append(("message", t, key, body, seq, place(parent, nth), None))
                nth += 1
        return nth

    def sent(self, r: Any) -> list[tuple[str, str, str]]:
        """(type, key, body) of each message that a result is."""
        if hasattr(type(r), "__dataclass_fields__") and not isinstance(r, TypedMessage):
            found = [(t, getattr(r, method)()) for t, method in self.keys.pairs(type(r))]
            for _, k in found:
                if k is None:
                    raise ModelError("a key may not be null")
            body = to_json(r)
            return [(t, str(k), body) for t, k in found]
        return [(t, str(m.key), to_json(m.message)) for m in self.keys.extract(r) for t in m.types]

    def get(self, own: Any, key: str, group: list[Message], out: list[tuple], state: bytes | None = None) -> Any:
        """The instance, made and activated if there is none; null if that fails, and then its messages are lost and counted."""
        if own is not None:
            return own
        try:
            own = self.processor.instance()
            self.processor.activate(own, key, group[0].body if group else None, state)
        except Exception as wrong:
            out += [("failed", m.kind, key, repr(wrong), m.seq, m.place, None) for m in group]
            return None
        out.append(("created", None, key, None, group[0].seq if group else 0, b"", None))
        return own

    def handle(self, own: Any, key: str, pile: list[Message], out: list[tuple]) -> Any:
        """Handle messages that are at hand, all at once if in bulk; the instance then, or null if it was never made."""
        good = [m for m in pile if not m.wrong]
        if len(good) < len(pile):
            out += [("failed", m.kind, key, m.wrong, m.seq, m.place, None) for m in pile if m.wrong]
            out += [("dispatched", m.kind, key, None, m.seq, m.place, None) for m in pile if m.wrong]
        for group in ([good] if self.o.bulk else [[m] for m in good]) if good else []:
            own = self.get(own, key, group, out)
            if own is None:
                continue
            out += [("dispatched", m.kind, key, None, m.seq, m.place, None) for m in group]
            messages = [KeyedMessage(key, m.body) for m in group]
            try:
                results = self.processor.invoke_bulk(own, messages) if self.o.bulk else self.processor.invoke(own, messages[0])
            except Exception as wrong:  # what the handler changed before it failed stays
                out += [("failed", m.kind, key, repr(wrong), m.seq, m.place, None) for m in group]
                continue
            out += [("processed", m.kind, key, None, m.seq, m.place, None) for m in group]
            self.send(results, group[-1].seq, group[-1].place, out)
        return own

    def handle_one(self, own: Any, key: str, m: Message, out: list[tuple]) -> Any:
        """handle() of one message that is not for a bulk handler."""
        if own is None or m.wrong:
            return self.handle(own, key, [m], out)
        if self.tells_dispatched:
            out.append(("dispatched", m.kind, key, None, m.seq, m.place, None))
        try:
            results = self.processor.invoke(own, KeyedMessage(key, m.body))
        except Exception as wrong:  # what the handler changed before it failed stays
            out.append(("failed", m.kind, key, repr(wrong), m.seq, m.place, None))
            return own
        if self.tells_processed:
            out.append(("processed", m.kind, key, None, m.seq, m.place, None))
        if results:
            self.send(results, m.seq, m.place, out)
        return own

    def put_out(self, own: Any, key: str, seq: int, out: list[tuple]) -> None:
        """One output pass over an instance; its messages come after all others of that seq."""
        began = time.perf_counter()
        try:
            results = self.processor.emit(own)
        except Exception as wrong:
            out.append(("output_failed", None, key, repr(wrong), seq, b"\xff", None))
            return
        finally:
            self._spend("output", began)
        self.send(results, seq, b"\xff", out)

    def check(self, own: Any, key: str, seq: int, out: list[tuple]) -> Any:
        """One eviction check; null if the instance went."""
        if own is None:
            return own
        began = time.perf_counter()
        gone = self.processor.evicts(own)
        self._spend("evict", began)
        if not gone:
            return own
        self.processor.passivate(own)
        out += [("evicted", None, key, None, seq, b"", None), ("deleted", None, key, None, seq, b"", None)]
        return None

    def _spend(self, what: str, began: float) -> None:
        self.spent[what][0] += 1
        self.spent[what][1] += time.perf_counter() - began

    def timings(self) -> list[tuple]:
        """A row for output passes and one for eviction checks since the last call: how many, and their milliseconds."""
        out = [("timing", what, None, json.dumps({"passes": n, "ms": round(s * 1000, 3)}), 0, b"", None) for what, (n, s) in self.spent.items() if n]
        self.spent = {what: [0, 0.0] for what in self.spent}
        return out

    def passed(self, own: Any, key: str, last: int | None, now: int, out: list[tuple]) -> Any:
        """What falls due for an instance from its last seq to `now`: passes in order, the check that ends a span after its pass.

        Two passes in a row that leave the instance as it was and give the same tell what the passes up to `now` give: they are
        repeated and not called, unless a check lets the instance go.
        """
        o = self.o
        if own is None or last is None or now <= last:
            return own
        every, at = o.output_span if self.processor.outputs else None, last
        before, given, asked = None, None, True
        while own is not None:
            put, check = _next(at, now, every), _next(at, now, o.evict_span)
            at = min(put, check)
            if at > now:
                break
            if at == put:
                first = len(out)
                self.put_out(own, key, at, out)
                left = (now - at) // every
                if left > 1 or left and before is not None:
                    state, rows = _frozen(own), [(*r[:4], *r[5:]) for r in out[first:]]
                    same = state is not None and state == before and rows == given
                    before, given, asked = state, rows, same and asked or check > now
                    if same and asked:
                        self.repeat(out[first:], left, out)
                        break
            if at == check:
                own, asked = self.check(own, key, at, out), True
                if not every:
                    break  # without a message or an output an instance stays as it is, so later checks would find the same
        return own

    def repeat(self, rows: list[tuple], times: int, out: list[tuple]) -> None:
        """The rows of a pass once more for each of the passes after it, or with their number where passes are folded."""
        self.spent["output"][0] += times
        step = self.o.output_span
        if self.o.fold:
            out += [(*r[:4], r[4] + step, r[5], times) for r in rows]
        else:
            out += [(*r[:4], r[4] + k * step, *r[5:]) for k in range(1, times + 1) for r in rows]

    def close(self, own: Any, key: str, seq: int, out: list[tuple]) -> None:
        own = self.passed(own, key, seq, self.o.end, out) if self.o.end is not None else own
        if own is not None and self.o.final_output:
            self.put_out(own, key, seq, out)
        if own is not None and self.o.stop:
            self.processor.passivate(own)
            out.append(("deleted", None, key, None, seq, b"", None))
        if self.o.keep:
            out.append(("state", None, key, None, seq, b"", cloudpickle.dumps(own) if own is not None and not self.o.stop else None))

    def _due(self, last: int | None, now: int) -> bool:
        if last is None:
            return False
        a, b = self.o.output_span, self.o.evict_span
        return bool(a and now // a > last // a or b and now // b > last // b)

    def batch(self, out: list[tuple]) -> pa.RecordBatch:
        """Rows as Arrow, without those of kinds that are not asked for."""
        if self.o.kinds is not None:
            out = [r for r in out if r[0] in self.o.kinds]
        columns = list(zip(*out)) or [()] * len(NAMES)
        if not self.o.fold:
            return pa.RecordBatch.from_arrays([pa.array(c, t) if any(c) else _bare(c, t) for c, t in zip(columns, TYPES)], names=NAMES)
        # of a folded row the last field is its number
        times, state = [x if type(x) is int else 1 for x in columns[-1]], [None if type(x) is int else x for x in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns[:-1], state, times], [*TYPES, pa.int64()])], names=[*NAMES, "times"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, last, pile, out = None, None, None, [], []
        for batch in batches:
            for kind, k, body, at, where, state in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if key is not None:
                        self.close(self.handle(own, key, pile, out), key, last or 0, out)
                    key, own, last, pile = k, None, None, []
                if state is not None:
                    own, last = cloudpickle.loads(state), (int(body) if body else None)
                    continue
                if kind == "":  # a key that is to have an instance before its first message
                    own = self.get(own, key, [], out)
                    continue
                m = self.read(kind, body, at, where or b"")
                own, pile, last = self.next(own, key, pile, last, m, out)
                if len(out) > 20_000:
                    yield self.batch(out)
                    out = []
        if key is not None:
            self.close(self.handle(own, key, pile, out), key, last or 0, out)
        yield self.batch(out + self.timings())

    def next(self, own: Any, key: str, pile: list[Message], last: int | None, m: Message, out: list[tuple]) -> tuple[Any, list[Message], int]:
        """One more message: due passes come first, and full piles are handled."""
        if self._due(last, m.seq):
            own, pile = self.handle(own, key, pile, out), []
            own = self.passed(own, key, last, m.seq, out)
        if not self.o.bulk:
            return self.handle_one(own, key, m, out), pile, m.seq
        pile.append(m)
        if len(pile) >= PILE:
            own, pile = self.handle(own, key, pile, out), []
        return own, pile, m.seq


def _bare(column: tuple, kind: pa.DataType) -> pa.Array:
    """A column without a value that counts as true; mostly all of it is null, which is soon made."""
    return pa.nulls(len(column), kind) if column.count(None) == len(column) else pa.array(column, kind)


def _next(last: int, now: int, span: int | None) -> int:
    return (last // span + 1) * span if span else now + 1


def _frozen(own: Any) -> bytes | None:
    """An instance as bytes, by which two states compare; null if it has none."""
    try:
        return cloudpickle.dumps(own)
    except Exception:
        return None


def unfolded(results: DataFrame, span: int | None) -> DataFrame:
    """Results of RESULT's columns; what passes at intervals of span repeat, as a row for each of them."""
    if "times" not in results.columns:
        return results
    each = F.explode(F.when(F.col("times") > 1, F.sequence(F.col("seq"), F.col("seq") + (F.col("times") - 1) * span, F.lit(span).cast("long"))).otherwise(F.array("seq")))
    return results.select("*", each.alias("at")).select(*[F.col("at").alias("seq") if c == "seq" else F.col(c) for c in NAMES])


def imperative(
    messages: DataFrame, processor: Processor, cluster: str = "", bulk: bool = False, final_output: bool = False, stop: bool = False, keep: bool = False,
    state: DataFrame | None = None, keys: DataFrame | None = None, output_span: int | None = None, evict_span: int | None = None, end: int | None = None,
    kinds: Iterable[str] | None = None, fold: bool = False,
) -> DataFrame:
    """Results of a processor over envelope rows; see RESULT and Options. With fold they have a column `times`, see unfolded().

    keep returns each instance as a `state` row; state takes such rows (key, seq, state), so a later run goes on from them. keys:
    a table with a column `key`, each of which gets an instance before its first message. Messages with null keys are left out.
    """
    rows = placed(messages).where(F.col("message_type").isin(*sorted(processor.types)) & F.col("key").isNotNull()).select("message_type", "key", "payload", "seq", "place", F.lit(None).cast("binary").alias("state"))
    first = lambda n: F.lit(n - (1 << 62)).cast("long").alias("seq")
    if state is not None:
        last = F.col("seq").cast("string") if "seq" in state.columns else F.lit("")
        rows = rows.union(state.where("state IS NOT NULL").select(F.lit("").alias("message_type"), "key", last.alias("payload"), first(0), F.lit(b"").alias("place"), "state"))
    if keys is not None:
        rows = rows.union(keys.where("key IS NOT NULL").select(F.lit("").alias("message_type"), F.col("key").cast("string"), F.lit("").alias("payload"), first(1), F.lit(b"").alias("place"), F.lit(None).cast("binary").alias("state")).distinct())
    options = Options(cluster, bulk, final_output, stop, keep, output_span, evict_span, end, None if kinds is None else frozenset(kinds), fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Runner(processor, options)(batches)

    return rows.repartition("key").sortWithinPartitions("key", "seq", "place", "message_type", "payload").mapInArrow(run, f"{RESULT}, times long" if fold else RESULT)


def sent(results: DataFrame) -> DataFrame:
    """The messages among results, as an envelope with their places: those that one message caused keep their order."""
    return results.where("kind = 'message'").select("message_type", "key", "payload", "seq", "place")


@dataclass(frozen=True)
class Declarative:
    """A processor as column expressions: state is {name: aggregate}, emitted after each message or at the end of the input.

    before: the state as it was before the message itself; a count is then zero-based.
    """

    state: dict[str, Column]
    emit: str = "running"
    before: bool = False

    def lower(self, df: DataFrame, key: str | list[str], seq: str | list[str]) -> DataFrame:
        keys, order = ([x] if isinstance(x, str) else list(x) for x in (key, seq))
        if self.emit == "final":
            return df.groupBy(*keys).agg(*[c.alias(n) for n, c in self.state.items()])
        end = -1 if self.before else Window.currentRow
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[c.over(w).alias(n) for n, c in self.state.items()])


class Unfinished(RuntimeError):
    """Rounds ended before the messages did. pending: the messages left; found: the results so far."""

    def __init__(self, pending: DataFrame, found: dict[str, DataFrame]):
        super().__init__("rounds ended with messages pending")
        self.pending, self.found = pending, found


class States:
    """A cluster's instances as deltas, the youngest of a key counting; a round reads and writes those of its keys alone."""

    def __init__(self, first: DataFrame | None = None):
        self.deltas: list[DataFrame] = []
        if first is not None:
            self.add(first)

    def add(self, kept: DataFrame) -> None:
        seq = F.col("seq") if "seq" in kept.columns else F.lit(None).cast("long").alias("seq")
        self.deltas.append(kept.select("key", seq, "state", F.lit(len(self.deltas)).alias("age")))
        if len(self.deltas) > DELTAS:
            whole = cut(self.all())
            self.deltas = []
            self.add(whole)

    def all(self, among: DataFrame | None = None) -> DataFrame | None:
        """(key, seq, state) of the live instances, or of those whose key is among the keys given."""
        if not self.deltas:
            return None
        rows = self.deltas[0]
        for d in self.deltas[1:]:
            rows = rows.union(d)
        if among is not None:
            rows = rows.join(among, "key", "left_semi")
        last = rows.groupBy("key").agg(F.max_by(F.struct("seq", "state"), "age").alias("s"))
        return last.select("key", "s.seq", "s.state").where("state IS NOT NULL")


class Results:
    """Results by round, made one table now and then so that plans stay short."""

    def __init__(self) -> None:
        self.parts: list[DataFrame] = []

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) >= 32:
            self.parts = [cut(self.all())]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for df in self.parts[1:]:
            out = out.union(df)
        return out


def span(every: Any, per_second: float) -> int | None:
    """A schedule in units of seq: seconds, or an interval that knows its seconds."""
    seconds = getattr(every, "seconds", every)
    if seconds is None:
        return None
    if not isinstance(seconds, (int, float)):
        raise TopologyError("tables have no clock; give a schedule as a number of seconds")
    return max(1, round(seconds * per_second))


def run(topology: Topology, messages: DataFrame, rounds: int | None = None, states: dict[str, DataFrame] | None = None, per_second: float = 1.0, kinds: Iterable[str] | None = None, fold: bool = False) -> dict[str, DataFrame]:
    """All clusters over messages until none is left to handle: {cluster: results}.

    Each round gives every cluster what the last one sent to it, its instances going on from the round before; so topologies
    may feed back. Without `rounds` the loop ends when no message is pending, and one that feeds back for ever never does; with it,
    Unfinished is raised if messages are left. A message that a cluster handles under two of its types comes twice.

    Over tables seq is the clock, per_second of its units a second: a cluster's output passes and eviction checks fall due
    whenever seq passes a multiple of their interval, without one never. Passes between a key's last message and the end of the
    input run when nothing is pending; what they send is then handled too. A key source makes its instances in the first round.

    kinds: the kinds of rows that are wanted of the results, all without it; messages may be among them or not. fold: results have a
    column `times`, above 1 for what so many output passes in a row gave, the first of them at seq; without it each has its row.
    """
    pending, kinds = written(placed(messages)), None if kinds is None else tuple(kinds)
    spark = pending.sparkSession
    live = [c for c in topology.clusters if c.processor is not None]
    state = {c.name: States((states or {}).get(c.name)) for c in live}
    found = {c.name: Results() for c in live}
    spans = {c.name: (span(c.output_every, per_second), span(c.evict_every, per_second)) for c in live}
    timed = [c for c in live if any(spans[c.name])]
    end = pending.agg(F.max("seq")).first()[0] if timed else None

    def turn(c: Any, own: DataFrame, keys: DataFrame | None = None, among: DataFrame | None = None, end: int | None = None) -> DataFrame:
        output_span, evict_span = spans[c.name]
        folds = bool(output_span and c.processor.outputs)
        given = None if kinds is None else {"message", "state", *kinds}
        done = written(imperative(own, c.processor, c.name, c.bulk, keep=True, state=state[c.name].all(among), keys=keys, output_span=output_span, evict_span=evict_span, end=end, kinds=given, fold=folds))
        state[c.name].add(done.where("kind = 'state'").select("key", "seq", "state"))
        rest = done.where("kind <> 'state'")
        wanted = rest if kinds is None else rest.where(F.col("kind").isin(*kinds))
        found[c.name].add((wanted if folds else wanted.withColumn("times", F.lit(1).cast("long"))) if fold else unfolded(wanted, output_span))
        return unfolded(rest.where("kind = 'message'"), output_span)

    def all_sent(results: list[DataFrame]) -> DataFrame | None:
        out = None
        for own in results:
            out = sent(own) if out is None else out.union(sent(own))
        return out

    handled = frozenset().union(*(c.handled() for c in live))
    none = placed(messages).limit(0)
    done, closed = 0, not timed or end is None
    while True:
        # types of messages, which the topology bounds
        types = {r[0] for r in pending.where(F.col("message_type").isin(*sorted(handled))).select("message_type").distinct().collect()} if pending is not None else set()
        if not types and done:
            if closed:
                break
            closed, pending = True, all_sent([turn(c, none, end=end) for c in timed])
            continue
        if rounds is not None and done >= rounds:
            raise Unfinished(pending, {n: r.all() for n, r in found.items() if r.parts})
        results = []
        for c in live:
            keys = spark.createDataFrame([(str(k),) for k in c.key_source()], "key string") if c.key_source and not done else None
            if not types & c.handled() and keys is None and done:
                continue
            own = pending.where(F.col("message_type").isin(*sorted(c.handled())))
            results.append(turn(c, own, keys, own.select("key").distinct() if keys is None else None))
        done += 1
        pending = all_sent(results)
    return {n: r.all() for n, r in found.items() if r.parts}
