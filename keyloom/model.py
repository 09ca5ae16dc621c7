"""Message types, their keys, and the keyed messages that an object stands for.

A message class names the types it is known by and the keys it is addressed by:

    @message_type("word")
    @dataclass
    class Word:
        word: str

        @message_key
        def key(self): return self.word

One object becomes one keyed message for each type and key of each level of its class tree (exploded fan-out), so the planner
can turn extraction into projections.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, fields, is_dataclass
from functools import lru_cache
from json.encoder import c_make_encoder, encode_basestring_ascii
from typing import Any


class ModelError(ValueError):
    """A message class or processor that cannot be planned."""


@dataclass(frozen=True)
class KeyedMessage:
    key: Any
    message: Any


@dataclass(frozen=True)
class TypedMessage:
    """An explicit message: its key and the type ids it goes by."""

    key: Any
    message: Any
    types: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.message is None or self.key is None:
            raise ModelError("a message and its key may not be null")


def type_id(cls: type) -> str:
    return f"{cls.__module__}.{cls.__qualname__}"


def message_type(*ids: Any) -> Any:
    """Mark a class as a message; without ids its qualified name is its type id."""
    if len(ids) == 1 and isinstance(ids[0], type):
        ids[0].__dict__.get("_message_types") or setattr(ids[0], "_message_types", (type_id(ids[0]),))
        return ids[0]

    def mark(cls: type) -> type:
        cls._message_types = tuple(ids) or (type_id(cls),)
        return cls

    return mark


def message_key(found: Any = None) -> Any:
    """Mark a method without parameters as a key; a discriminator tells several keys apart."""
    if callable(found):
        found._message_key = ""
        return found

    def mark(method: Callable) -> Callable:
        method._message_key = found or ""
        return method

    return mark


def own_types(cls: type) -> tuple[str, ...]:
    return tuple(cls.__dict__.get("_message_types", ()))


def own_keys(cls: type) -> dict[str, str]:
    """{discriminator: method name} of the keys that this level declares."""
    found: dict[str, str] = {}
    for name, member in cls.__dict__.items():
        mark = getattr(member, "_message_key", None)
        if mark is not None:
            if mark in found:
                raise ModelError(f"{cls.__name__} has two keys named {mark!r}")
            found[mark] = name
    return found


def addressed(cls: type, own_only: bool = False) -> list[tuple[str, str]]:
    """(type id, key method) pairs of a class and, unless own_only, of all levels above it.

    A level with a message type must declare its key itself. Where a level has several keys, all must be discriminated, and each
    makes a type `base(discriminator)`.
    """
    out: list[tuple[str, str]] = []
    for level in (cls,) if own_only else cls.__mro__:
        types, keys = own_types(level), own_keys(level)
        if not types:
            continue
        if not keys:
            raise ModelError(f"{level.__name__} is a message type without a key of its own")
        if len(keys) > 1 and "" in keys:
            raise ModelError(f"{level.__name__} has several keys, and one has no discriminator")
        for base in types:
            out += [(f"{base}({mark})" if mark else base, method) for mark, method in keys.items()]
    return out


def handled_types(cls: type, discriminator: str = "") -> tuple[str, ...]:
    """The type ids that a handler of cls takes, by the key that its discriminator selects."""
    types, keys = own_types(cls), own_keys(cls)
    if not types:
        raise ModelError(f"{cls.__name__} is no message type")
    if not keys:
        raise ModelError(f"{cls.__name__} is a message type without a key of its own")
    if discriminator and discriminator not in keys:
        raise ModelError(f"{cls.__name__} has no key {discriminator!r}")
    if not discriminator and len(keys) > 1:
        raise ModelError(f"{cls.__name__} has several keys; the handler must select one")
    mark = discriminator or next(iter(keys))
    return tuple(f"{t}({mark})" if mark else t for t in types)


def unwind(value: Any) -> Iterator[Any]:
    """A handler's result as single messages: None is none, lists and other iterables are flattened to any depth."""
    if value is None:
        return
    if isinstance(value, Iterable) and not isinstance(value, (str, bytes, dict)) and not is_dataclass(value):
        for x in value:
            yield from unwind(x)
    else:
        yield value


def unwound(value: Any) -> list[Any]:
    """unwind() as a list, soon done for the results that are usual."""
    if value is None:
        return []
    if hasattr(type(value), "__dataclass_fields__"):
        return [value]
    if type(value) is list:
        return [y for x in value for y in unwound(x)]
    return list(unwind(value))


class KeyExtractor:
    """Objects to keyed messages; what a class is addressed by is looked up once."""

    def __init__(self) -> None:
        self._known: dict[type, list[tuple[str, str]]] = {}

    def extract(self, message: Any) -> list[TypedMessage]:
        if message is None:
            raise ModelError("a message may not be null")
        out: list[TypedMessage] = []
        for one in unwind(message):
            if isinstance(one, TypedMessage):
                out.append(one)
                continue
            out += [TypedMessage(getattr(one, method)(), one, (t,)) for t, method in self.pairs(type(one))]
        return out

    def pairs(self, cls: type) -> list[tuple[str, str]]:
        """(type id, key method) pairs of a class; see addressed()."""
        if cls not in self._known:
            pairs = addressed(cls)
            if not pairs:
                raise ModelError(f"{cls.__name__} has no message type")
            self._known[cls] = pairs
        return self._known[cls]

    def has_key(self, cls: type) -> bool:
        """Whether results of cls can be sent on; others are dropped and counted."""
        return cls is TypedMessage or bool(addressed(cls))


# The JSON envelope: how a message travels in a row.

#: Names the class of a message that goes by the type of a class above its own.
CLASS = "__class__"


_encoder, _scan = json.JSONEncoder(default=str, sort_keys=True), json.JSONDecoder().scan_once
_encode = _encoder.encode
#: Values that asdict() gives as they are.
FLAT = {str, int, float, bool, type(None)}
_FIXED = c_make_encoder(None, str, encode_basestring_ascii, None, ": ", ", ", True, False, True) if c_make_encoder else None


def _flat(body: dict[str, Any]) -> str:
    """A dictionary of texts to FLAT values as JSON, by an encoder that is made once and not for each."""
    return "".join(_FIXED(body, 0)) if _FIXED else _encode(body)


@lru_cache(1024)
def _shape(cls: type) -> tuple[tuple[str, ...], str | None]:
    """A dataclass's fields, and the name of the class if it goes by types of a class above its own."""
    return tuple(f.name for f in fields(cls)), type_id(cls) if any(own_types(level) for level in cls.__mro__[1:]) else None


@lru_cache(1024)
def _names(cls: type) -> frozenset[str]:
    return frozenset(_shape(cls)[0])


def to_json(message: Any) -> str:
    if not is_dataclass(message) or isinstance(message, type):
        return _encode(message if isinstance(message, dict) else {"value": message})
    names, named = _shape(type(message))
    body = {n: getattr(message, n) for n in names}
    if named is not None:
        body[CLASS] = named
    if FLAT.issuperset(map(type, body.values())):
        return _flat(body)
    return _encode(asdict(message) | ({} if named is None else {CLASS: named}))


def _below(cls: type) -> Iterator[type]:
    yield cls
    for child in cls.__subclasses__():
        yield from _below(child)


def from_json(cls: type | None, body: str) -> Any:
    """The message of a body: of cls, or of the class below it that the body names, where that is known here."""
    try:
        found, end = _scan(body, 0)
        if end != len(body):
            found = json.loads(body)
    except (StopIteration, TypeError, ValueError):
        found = json.loads(body)  # white space before it, bytes, or an error that says where
    if cls is None:
        return found.get("value", found) if isinstance(found, dict) else found
    named = found.pop(CLASS, None)
    if named is not None:
        cls = next((c for c in _below(cls) if type_id(c) == named), cls)
    if is_dataclass(cls) and not found.keys() <= (names := _names(cls)):
        found = {k: v for k, v in found.items() if k in names}
    return cls(**found)
