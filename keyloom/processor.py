"""Processors: what is kept for a key, and what each message does to it."""

from __future__ import annotations

import copy
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, get_type_hints

from keyloom.model import KeyedMessage, ModelError, TypedMessage, handled_types, own_types, unwind, unwound


def mp(cls: type) -> type:
    """Mark a class as a processor; its instances are shallow copies of one prototype."""
    cls._mp = True
    return cls


def _marker(name: str) -> Callable[[Callable], Callable]:
    def mark(method: Callable) -> Callable:
        setattr(method, name, True)
        return method

    return mark


start = _marker("_start")
activation = _marker("_activation")
passivation = _marker("_passivation")
output = _marker("_output")
evictable = _marker("_evictable")
bulk_message_handler = _marker("_bulk")


def message_handler(found: Any = None) -> Any:
    """Mark a handler of one message, typed by its parameter; a discriminator selects the key that addresses it."""

    def mark(method: Callable) -> Callable:
        method._handler = found if isinstance(found, str) else ""
        return method

    return mark(found) if callable(found) else mark


@dataclass
class Processor:
    """A processor class, checked once: its handlers and its lifecycle methods by name."""

    prototype: Any
    handlers: dict[type, str] = field(default_factory=dict)
    types: dict[str, type] = field(default_factory=dict)
    start: str | None = None
    activation: str | None = None
    passivation: str | None = None
    outputs: list[str] = field(default_factory=list)
    evictable: str | None = None
    bulk: str | None = None

    @classmethod
    def of(cls, prototype: Any) -> Processor:
        """The checks: the mark, a clone method of its own, handlers of keyed message types, one bulk handler, start and predicate."""
        if isinstance(prototype, FunctionProcessor):
            return prototype
        kind = type(prototype)
        if not kind.__dict__.get("_mp"):
            raise ModelError(f"{kind.__name__} is not marked as a processor")
        if not any("__copy__" in k.__dict__ or "clone" in k.__dict__ for k in (kind,)):
            raise ModelError(f"{kind.__name__} declares no clone")
        out = cls(prototype)
        members = [(n, m) for n, m in inspect.getmembers(kind, inspect.isfunction)]
        for name, m in members:
            parameters = [p for p in inspect.signature(m).parameters if p != "self"]
            hints = get_type_hints(m) if hasattr(m, "_handler") else {}
            if hasattr(m, "_handler"):
                if len(parameters) != 1:
                    raise ModelError(f"{name} must take exactly one message")
                taken = hints.get(parameters[0])
                if not isinstance(taken, type):
                    raise ModelError(f"{name} must say which message it takes")
                for t in handled_types(taken, m._handler) if own_types(taken) else _missing(name, taken):
                    out.types[t] = taken
                out.handlers[taken] = name
            if hasattr(m, "_bulk"):
                if out.bulk:
                    raise ModelError("one bulk handler at most")
                if len(parameters) != 1:
                    raise ModelError(f"{name} must take exactly one list")
                out.bulk = name
            for mark in ("start", "activation", "passivation", "evictable"):
                if hasattr(m, f"_{mark}"):
                    if getattr(out, mark):
                        raise ModelError(f"one {mark} method at most")
                    setattr(out, mark, name)
            if hasattr(m, "_passivation") and parameters:
                raise ModelError("passivation takes no parameters")
            if hasattr(m, "_activation") and len(parameters) > 3:
                raise ModelError("activation takes a key, a message and a state at most")
            if hasattr(m, "_start") and len(parameters) > 1:
                raise ModelError("start takes the cluster's id at most")
            if hasattr(m, "_evictable") and inspect.signature(m).return_annotation not in (bool, "bool", inspect.Signature.empty):
                raise ModelError("the eviction predicate returns a bool")
            if hasattr(m, "_output"):
                out.outputs.append(name)
        if not out.handlers:
            raise ModelError(f"{kind.__name__} handles no message")
        return out

    def handler(self, message: Any) -> str | None:
        """By exact class, then the classes above it, then the interfaces it declares."""
        if (own := self.handlers.get(type(message))) is not None:
            return own
        for level in type(message).__mro__:
            if level in self.handlers:
                return self.handlers[level]
        return None

    def begin(self, cluster: str = "") -> None:
        """Once per prototype; what it raises is not passed on."""
        if self.start:
            method = getattr(self.prototype, self.start)
            try:
                method(*([cluster] if inspect.signature(method).parameters else []))
            except Exception:
                pass

    def instance(self) -> Any:
        made = self.prototype.clone() if hasattr(self.prototype, "clone") else copy.copy(self.prototype)
        if made is None:
            raise ModelError("clone made nothing")
        return made

    def activate(self, own: Any, key: Any, message: Any, state: bytes | None = None) -> None:
        if not self.activation:
            return
        method = getattr(own, self.activation)
        values = []
        for p in inspect.signature(method).parameters.values():
            hint = p.annotation
            values.append(state if hint in (bytes, "bytes") else message if hint in (object, "object", Any, "Any") or p.name in ("message", "activating") else key)
        method(*values)

    def invoke(self, own: Any, message: KeyedMessage) -> list[Any]:
        name = self.handler(message.message)
        if name is None:
            raise ModelError(f"no handler for {type(message.message).__name__}")
        return unwound(getattr(own, name)(message.message))

    def invoke_bulk(self, own: Any, messages: list[KeyedMessage]) -> list[Any]:
        """The bulk handler where there is one, else each message in turn."""
        if self.bulk:
            return list(unwind(getattr(own, self.bulk)([m.message for m in messages])))
        return [x for m in messages for x in self.invoke(own, m)]

    def emit(self, own: Any) -> list[Any]:
        return [x for name in self.outputs for x in unwind(getattr(own, name)())]

    def evicts(self, own: Any) -> bool:
        """False without a predicate, and where it raises."""
        if not self.evictable:
            return False
        try:
            return bool(getattr(own, self.evictable)())
        except Exception:
            return False

    def passivate(self, own: Any) -> None:
        """What it raises does not keep the instance."""
        if self.passivation:
            try:
                getattr(own, self.passivation)()
            except Exception:
                pass


def _missing(name: str, taken: type) -> tuple[str, ...]:
    raise ModelError(f"{name} takes {taken.__name__}, which is no message type")


class Mp:
    """The functional form: an object that handles keyed messages and returns explicit ones."""

    def handle(self, message: KeyedMessage) -> list[TypedMessage] | TypedMessage | None:
        raise NotImplementedError

    def handle_bulk(self, messages: list[KeyedMessage]) -> list[TypedMessage]:
        return [x for m in messages for x in unwind(self.handle(m))]

    def output(self) -> list[TypedMessage] | None:
        return None

    def should_be_evicted(self) -> bool:
        return False

    def activate(self, key: Any, first: Any, state: bytes | None) -> None: ...

    def passivate(self) -> bytes | None: ...


class FunctionProcessor(Processor):
    """A supplier of Mp objects and the types they handle."""

    def __init__(self, supplier: Callable[[], Mp], types: dict[str, type | None], evictable: bool = False, outputs: bool = False, start: Callable[[str], None] | None = None):
        if not types:
            raise ModelError("a processor handles one type at least")
        super().__init__(supplier, types=types, outputs=["output"] if outputs else [], evictable="should_be_evicted" if evictable else None)
        self._begin = start

    def begin(self, cluster: str = "") -> None:
        if self._begin:
            try:
                self._begin(cluster)
            except Exception:
                pass

    def instance(self) -> Mp:
        return self.prototype()

    def activate(self, own: Mp, key: Any, message: Any, state: bytes | None = None) -> None:
        own.activate(key, message, state)

    def invoke(self, own: Mp, message: KeyedMessage) -> list[Any]:
        return unwound(own.handle(message))

    def invoke_bulk(self, own: Mp, messages: list[KeyedMessage]) -> list[Any]:
        return list(unwind(own.handle_bulk(messages)))

    def emit(self, own: Mp) -> list[Any]:
        return list(unwind(own.output())) if self.outputs else []

    def passivate(self, own: Mp) -> None:
        try:
            own.passivate()
        except Exception:
            pass


class MpFactory:
    """Makes processors from suppliers."""

    @staticmethod
    def make(supplier: Callable[[], Mp], *types: str, **options: Any) -> FunctionProcessor:
        return FunctionProcessor(supplier, dict.fromkeys(types), **options)
