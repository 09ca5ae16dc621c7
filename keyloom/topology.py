"""Clusters, nodes and the graph that their message types make."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from keyloom.model import ModelError
from keyloom.processor import Processor

#: Settings of a node and their defaults: fixed values of the configuration surface.
SETTINGS: dict[str, Any] = {
    "router.managed.total_shards": 256,
    "router.managed.min_node_count": 1,
    "threading.max_pending": 100_000,
    "threading.cores_factor": 1.0,
    "threading.additional_threads": 1,
    "threading.hard_shutdown": True,
    "threading.blocking": False,
    "threading.deserialization_threads": 2,
    "transport.send_threads": 2,
    "transport.send_max_queued": 1000,
    "transport.tcp_mtu": 1400,
    "container.log_queue_len_message_count": 1024,
}
ROUTERS = ("simple", "managed", "group")
CONTAINERS = ("locking", "altnonlocking", "altnonlockingbulk", "simple")


class TopologyError(ValueError):
    """A node or cluster that cannot be planned."""


@dataclass(frozen=True)
class ClusterId:
    app: str
    cluster: str

    def __post_init__(self) -> None:
        if not self.app or not self.cluster or ":" in self.app + self.cluster:
            raise TopologyError("neither part of a cluster's id may be empty or hold ':'")

    def __str__(self) -> str:
        return f"{self.app}:{self.cluster}"

    @classmethod
    def parse(cls, text: str) -> ClusterId:
        return cls(*text.split(":", 1))


@dataclass
class Cluster:
    """One stage: a processor, or an adaptor that reads messages in."""

    name: str
    processor: Processor | None = None
    adaptor: Any = None
    routing: str | None = None
    key_source: Callable[[], Iterable[Any]] | None = None
    output_every: float | str | None = None
    evict_every: float | None = None
    max_pending: int = -1
    bulk: bool = False

    def handled(self) -> frozenset[str]:
        return frozenset(self.processor.types) if self.processor else frozenset()

    def validate(self) -> None:
        if (self.processor is None) == (self.adaptor is None):
            raise TopologyError(f"{self.name} needs either a processor or an adaptor")
        if self.adaptor is not None and self.key_source is not None:
            raise TopologyError(f"{self.name}: an adaptor has no key source")
        if self.processor is not None and self.routing is None:
            raise TopologyError(f"{self.name} needs a routing strategy")
        if self.routing is not None and self.routing.split(":")[0] not in ROUTERS:
            raise TopologyError(f"{self.name}: no router {self.routing!r}")

    def warnings(self) -> list[str]:
        """Settings that do nothing: outputs without a schedule, a schedule without outputs, eviction without a predicate."""
        out = []
        if self.processor:
            if self.processor.outputs and self.output_every is None:
                out.append(f"{self.name}: outputs are never called without a schedule")
            if self.output_every is not None and not self.processor.outputs:
                out.append(f"{self.name}: the output schedule has no method to call")
            if self.evict_every and not self.processor.evictable:
                out.append(f"{self.name}: eviction is on, but nothing says when")
        return out

    def destinations(self, *ids: Any) -> None:
        raise NotImplementedError("destinations follow from message types; explicit ones aren't supported")


@dataclass
class Node:
    app: str
    clusters: list[Cluster] = field(default_factory=list)
    receiver: Any = None
    routing: str | None = None
    container: str = "altnonlocking"
    settings: dict[str, Any] = field(default_factory=lambda: dict(SETTINGS))

    def validate(self) -> Node:
        if not self.app or "/" in self.app or "\\" in self.app:
            raise TopologyError("an application needs a name without slashes")
        if not self.clusters:
            raise TopologyError("a node needs a cluster at least")
        if any(c is None for c in self.clusters):
            raise TopologyError("a cluster is null")
        names = [c.name for c in self.clusters]
        if len(set(names)) < len(names):
            raise TopologyError("two clusters have one name")
        for c in self.clusters:
            ClusterId(self.app, c.name)
            if c.processor is not None and c.routing is None:
                c.routing = self.routing
            c.validate()
        if self.receiver is None and any(c.processor is not None for c in self.clusters):
            raise TopologyError("a node with processors needs a receiver")
        if self.container not in CONTAINERS:
            raise TopologyError(f"no container {self.container!r}")
        shards = self.settings["router.managed.total_shards"]
        if shards < 1 or shards & (shards - 1):
            raise TopologyError("the number of shards must be a power of two")
        if any(c.max_pending >= 0 for c in self.clusters) and self.container.startswith("altnonlocking"):
            raise TopologyError("a limit per container needs a container without its own queue")
        return self

    @staticmethod
    def builder(app: str) -> NodeBuilder:
        return NodeBuilder(app)


class NodeBuilder:
    """Settings of the last cluster named; before the first one they are an error."""

    def __init__(self, app: str):
        self._node = Node(app)

    def cluster(self, name: str | Cluster) -> NodeBuilder:
        self._node.clusters.append(name if isinstance(name, Cluster) else Cluster(name))
        return self

    def clusters(self, *found: Cluster) -> NodeBuilder:
        self._node.clusters += found
        return self

    def _set(self, **values: Any) -> NodeBuilder:
        if not self._node.clusters:
            raise TopologyError("name a cluster first")
        for k, v in values.items():
            setattr(self._node.clusters[-1], k, v)
        return self

    def mp(self, prototype: Any) -> NodeBuilder:
        try:
            return self._set(processor=Processor.of(prototype))
        except ModelError as wrong:
            raise TopologyError(str(wrong)) from wrong

    def adaptor(self, source: Any) -> NodeBuilder:
        return self._set(adaptor=source)

    def routing(self, strategy: str) -> NodeBuilder:
        return self._set(routing=strategy)

    def key_source(self, keys: Callable[[], Iterable[Any]]) -> NodeBuilder:
        return self._set(key_source=keys)

    def evict_every(self, seconds: float | None) -> NodeBuilder:
        return self._set(evict_every=seconds if seconds and seconds > 0 else None)

    def output_every(self, schedule: float | str) -> NodeBuilder:
        return self._set(output_every=schedule)

    def max_pending(self, most: int) -> NodeBuilder:
        return self._set(max_pending=most)

    def bulk(self) -> NodeBuilder:
        return self._set(bulk=True)

    def default_routing(self, strategy: str) -> NodeBuilder:
        self._node.routing = strategy
        return self

    def receiver(self, found: Any = "local") -> NodeBuilder:
        self._node.receiver = found
        return self

    def container(self, kind: str) -> NodeBuilder:
        self._node.container = kind
        return self

    def conf(self, key: str, value: Any) -> NodeBuilder:
        if key not in SETTINGS:
            raise TopologyError(f"no setting {key!r}")
        self._node.settings[key] = type(SETTINGS[key])(value)
        return self

    def build(self) -> Node:
        return self._node.validate()


class Topology:
    """Who receives what: {type id: clusters that handle it}, found from the processors and never declared."""

    def __init__(self, *nodes: Node):
        self.clusters = [c for n in nodes for c in n.clusters]
        self.receivers: dict[str, list[str]] = {}
        for c in self.clusters:
            for t in sorted(c.handled()):
                self.receivers.setdefault(t, []).append(c.name)

    def __getitem__(self, name: str) -> Cluster:
        return next(c for c in self.clusters if c.name == name)

    def to(self, types: Iterable[str]) -> list[str]:
        """Clusters of a message of these types; one that handles two of them is named twice and handles the message twice."""
        return [c for t in types for c in self.receivers.get(t, [])]

    def order(self, emits: dict[str, Iterable[str]]) -> list[str]:
        """Processors so that each comes after those that feed it; a cycle is an error that names it.

        emits: the type ids that a cluster's handlers and outputs return.
        """
        done: list[str] = []
        path: list[str] = []

        def visit(name: str) -> None:
            if name in done:
                return
            if name in path:
                raise TopologyError("feedback: " + " -> ".join([*path[path.index(name) :], name]))
            path.append(name)
            for follower in dict.fromkeys(self.to(emits.get(name, ()))):
                visit(follower)
            path.pop()
            done.append(name)

        for c in self.clusters:
            visit(c.name)
        return done[::-1]
