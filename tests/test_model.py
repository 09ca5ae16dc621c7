import json
from dataclasses import asdict, dataclass

import pytest

from keyloom.model import KeyExtractor, ModelError, TypedMessage, addressed, from_json, handled_types, message_key, message_type, to_json, unwind


@message_type("word")
@dataclass
class Word:
    word: str

    @message_key
    def key(self):
        return self.word


@message_type("number")
@dataclass
class Number:
    n: int

    @message_key("even")
    def even(self):
        return "yes" if self.n % 2 == 0 else "no"

    @message_key("odd")
    def odd(self):
        return "no" if self.n % 2 == 0 else "yes"


@message_type("a", "b")
@dataclass
class Two:
    x: int

    @message_key
    def key(self):
        return self.x


@message_type("special")
@dataclass
class Special(Two):
    @message_key
    def own(self):
        return -self.x


@message_type
@dataclass
class Keyless(Word):
    pass


def sent(message):
    return [(m.types, m.key) for m in KeyExtractor().extract(message)]


def test_one_key():
    assert sent(Word("w")) == [(("word",), "w")]


def test_several_types_and_keys():
    assert sent(Two(3)) == [(("a",), 3), (("b",), 3)]
    assert sent(Number(4)) == [(("number(even)",), "yes"), (("number(odd)",), "no")]


def test_levels_above_count_with_their_own_keys():
    assert sent(Special(3)) == [(("special",), -3), (("a",), 3), (("b",), 3)]
    assert addressed(Special, own_only=True) == [("special", "own")]


def test_a_level_with_a_type_needs_its_own_key():
    with pytest.raises(ModelError, match="key of its own"):
        KeyExtractor().extract(Keyless("w"))


def test_several_keys_must_all_be_discriminated():
    @message_type("bad")
    class Bad:
        @message_key
        def one(self):
            return 1

        @message_key("two")
        def two(self):
            return 2

    with pytest.raises(ModelError, match="no discriminator"):
        addressed(Bad)


def test_a_handler_selects_the_key():
    assert handled_types(Number, "odd") == ("number(odd)",)
    for wrong in ("", "none"):
        with pytest.raises(ModelError):
            handled_types(Number, wrong)
    with pytest.raises(ModelError, match="no message type"):
        handled_types(int)


def test_nulls_are_refused():
    for wrong in (lambda: KeyExtractor().extract(None), lambda: TypedMessage(None, 1, ("t",)), lambda: TypedMessage(1, None, ("t",))):
        with pytest.raises(ModelError):
            wrong()


def test_results_unwind_to_any_depth():
    assert list(unwind([1, [2, (3, [4])], None, "text"])) == [1, 2, 3, 4, "text"]
    assert list(unwind(None)) == []


def test_explicit_messages_pass():
    m = TypedMessage("k", {"x": 1}, ("t", "u"))
    assert KeyExtractor().extract([m, [m]]) == [m, m]


def test_json_round_trip():
    assert from_json(Two, to_json(Two(5))) == Two(5)
    assert from_json(None, to_json("text")) == "text"


def test_flat_bodies_are_the_same_json():
    @message_type("m")
    @dataclass
    class M:
        b: object
        a: object = None

        @message_key
        def key(self):
            return "k"

    for x in (1, True, 1.5, float("nan"), None, 'é"\\\n😀', [1, {"z": 1, "y": None}], {1, 2}, 10**30):
        assert to_json(M(x)) == json.dumps(asdict(M(x)), default=str, sort_keys=True)
    assert from_json(M, ' {"b": 1, "c": 2} ') == M(1) == from_json(M, '{"b": 1}') == from_json(M, b'{"b": 1}')
    for wrong in ("", "{no json", '{"b": 1} 2'):
        with pytest.raises(ValueError):
            from_json(M, wrong)
