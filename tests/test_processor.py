import pytest

from keyloom.model import KeyedMessage, ModelError, TypedMessage
from keyloom.plans.samples import Count, Counter, Event, FunctionalCounter, Special, counter
from keyloom.processor import Mp, MpFactory, Processor, activation, bulk_message_handler, evictable, message_handler, mp, passivation, start


def made(body, base=(object,), mark=True):
    cls = type("P", base, body)
    return mp(cls) if mark else cls


def handle(self, e: Event):
    return None


OK = {"clone": lambda self: self, "handle": message_handler(handle)}


@pytest.mark.parametrize(
    ("body", "mark", "said"),
    [
        (OK, False, "not marked"),
        ({k: v for k, v in OK.items() if k != "clone"}, True, "no clone"),
        ({"clone": OK["clone"]}, True, "handles no message"),
        (OK | {"more": message_handler(lambda self, a, b: None)}, True, "exactly one"),
        (OK | {"a": bulk_message_handler(lambda self, x: None), "b": bulk_message_handler(lambda self, x: None)}, True, "one bulk"),
        (OK | {"a": evictable(lambda self: True), "b": evictable(lambda self: True)}, True, "one evictable"),
        (OK | {"a": start(lambda self: None), "b": start(lambda self: None)}, True, "one start"),
        (OK | {"a": passivation(lambda self, x: None)}, True, "no parameters"),
        (OK | {"a": activation(lambda self, a, b, c, d: None)}, True, "at most"),
    ],
)
def test_classes_are_checked(body, mark, said):
    with pytest.raises(ModelError, match=said):
        Processor.of(made(dict(body), mark=mark)())


def test_a_handler_takes_a_message_type():
    def wrong(self, n: int): ...

    with pytest.raises(ModelError, match="no message type"):
        Processor.of(made({"clone": OK["clone"], "wrong": message_handler(wrong)})())


def test_running_counts_start_at_0():
    p = counter()
    own = p.instance()
    p.activate(own, "7", Event(1, 7))
    assert [p.invoke(own, KeyedMessage("7", Event(k, 7)))[0].count for k in range(3)] == [0, 1, 2]
    assert p.emit(own)[0].count == 3
    assert p.instance().n == 0


def test_the_nearest_handler_is_taken():
    p = counter()
    assert p.handler(Special(1, 2)) == "count"
    assert p.handler(Count("k", 1)) is None


@pytest.mark.parametrize(
    ("parameters", "want"),
    [("self", ()), ("self, key", ("k",)), ("self, message", ("m",)), ("self, state: bytes", (b"s",)), ("self, state: bytes, message, key", (b"s", "m", "k"))],
)
def test_activation_parameters_in_any_order(parameters, want):
    space = {}
    names = [p.split(":")[0].strip() for p in parameters.split(",")][1:]
    exec(f"def act({parameters}): self.got = ({', '.join(names)}{',' if names else ''})", space)
    p = Processor.of(made(OK | {"act": activation(space["act"]), "clone": lambda self: type(self)()})())
    own = p.instance()
    p.activate(own, "k", "m", b"s")
    assert own.got == want


def test_bulk_falls_back_to_single_calls():
    p = counter()
    own = p.instance()
    assert [c.count for c in p.invoke_bulk(own, [KeyedMessage("7", Event(k, 7)) for k in range(3)])] == [0, 1, 2]


def test_failing_predicates_start_and_passivation():
    def fail(self):
        raise ValueError

    p = Processor.of(made(OK | {"e": evictable(fail), "s": start(lambda self: 1 / 0), "p": passivation(lambda self: 1 / 0)})())
    p.begin("app:c")
    assert p.evicts(p.prototype) is False
    p.passivate(p.prototype)


def test_functional_form():
    p = MpFactory.make(FunctionalCounter, "event")
    own = p.instance()
    assert p.invoke(own, KeyedMessage("k", 1)) == [TypedMessage("k", {"count": 1}, ("counted",))]
    assert p.emit(own) == [] and not p.evicts(own)
    with pytest.raises(ModelError):
        MpFactory.make(Mp)


def test_clones_share_what_the_prototype_holds():
    prototype = Counter()
    prototype.shared = []
    p = Processor.of(prototype)
    p.instance().shared.append(1)
    assert prototype.shared == [1]
