"""Sample messages and processors: counters, in the forms that the catalogue and the tests run."""

from __future__ import annotations

import copy
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.model import KeyedMessage, TypedMessage, message_key, message_type
from keyloom.processor import Mp, MpFactory, Processor, activation, bulk_message_handler, evictable, message_handler, mp, output, passivation, start
from keyloom.sources.adaptors import TableAdaptor


@message_type("event")
@dataclass
class Event:
    event_id: int
    user_id: int
    event_type: str = ""
    value: float = 0.0

    @message_key
    def key(self) -> str:
        return str(self.user_id)


@dataclass
class Special(Event):
    """An event by inheritance alone: it goes by the type and key of the level above it."""


@message_type("count")
@dataclass
class Count:
    key_: str
    count: int
    touched: int = 0

    @message_key
    def key(self) -> str:
        return self.key_


@message_type("total")
@dataclass
class Total:
    key_: str
    count: int

    @message_key
    def key(self) -> str:
        return self.key_


@mp
class Counter:
    """Emits the count before each message: the n-th one gives n - 1."""

    def __init__(self) -> None:
        self.key, self.n = "", 0

    def clone(self) -> Counter:
        return copy.copy(self)

    @activation
    def activate(self, key: str) -> None:
        self.key = key

    @message_handler
    def count(self, event: Event) -> Count:
        self.n += 1
        return Count(self.key, self.n - 1, self.n)

    @output
    def total(self) -> Total:
        return Total(self.key, self.n)


@mp
class BulkCounter(Counter):
    def clone(self) -> BulkCounter:
        return copy.copy(self)

    @bulk_message_handler
    def pile(self, events: list) -> list:
        self.n += len(events)
        return [[Count(self.key, len(events))], None]


@mp
class Failing(Counter):
    """Fails on ids that end in 3, after it has counted them."""

    def clone(self) -> Failing:
        return copy.copy(self)

    @message_handler
    def count(self, event: Event) -> Count:
        self.n += 1
        if event.event_id % 10 == 3:
            raise ValueError("an id that ends in 3")
        return Count(self.key, self.n - 1, self.n)


@mp
class Evicting(Counter):
    """Goes after `most` messages, when a check finds that it has had as many."""

    gone = 0

    def __init__(self, most: int = 10) -> None:
        super().__init__()
        self.most = most

    def clone(self) -> Evicting:
        return copy.copy(self)

    @evictable
    def done(self) -> bool:
        return self.n >= self.most

    @passivation
    def leave(self) -> None:
        self.gone = 1


# Words to counts to ranks to the ten best


@message_type("word")
@dataclass
class Word:
    word: str

    @message_key
    def key(self) -> str:
        return self.word


@message_type("word_count")
@dataclass
class WordCount:
    word: str
    count: int

    @message_key
    def key(self) -> str:
        return self.word


@message_type("rank")
@dataclass
class Rank:
    """Goes to one instance, whatever its word."""

    word: str
    rank: int

    @message_key
    def key(self) -> str:
        return "all"


@message_type("best")
@dataclass
class Best:
    words: list
    ranks: list

    @message_key
    def key(self) -> str:
        return "all"


class WordAdaptor(TableAdaptor):
    """The words of a text column, one message each, in the order of the rows' numbers and of their places."""

    def __init__(self, path: str, order: str, text: str = "text", **options):
        super().__init__(path, "word", "word", "at", "word", **options)
        self.order, self.text = order, text

    def prepared(self, rows: DataFrame) -> DataFrame:
        split = F.split(self.text, "[ \\t\\n\\x0B\\f\\r]+")
        each = rows.select(F.expr(self.order).alias("row"), F.posexplode(split).alias("nth", "word")).where("word <> ''")
        return each.select("word", (F.col("row") * (1 << 24) + F.col("nth")).alias("at"))


@mp
class CountWords:
    """Zero-based counts; a pile gives the last of its counts alone."""

    def __init__(self) -> None:
        self.n = -1

    def clone(self) -> CountWords:
        return copy.copy(self)

    @message_handler
    def count(self, word: Word) -> WordCount:
        self.n += 1
        return WordCount(word.word, self.n)

    @bulk_message_handler
    def pile(self, words: list) -> WordCount:
        self.n += len(words)
        return WordCount(words[-1].word, self.n)


@mp
class KeepMax:
    """Sends the largest count of its word on when it grows."""

    def __init__(self) -> None:
        self.most = -1

    def clone(self) -> KeepMax:
        return copy.copy(self)

    @message_handler
    def keep(self, count: WordCount) -> Rank | None:
        if count.count <= self.most:
            return None
        self.most = count.count
        return Rank(count.word, count.count)


@mp
class TopTen:
    """The ten largest ranks, equal ones by word; ranks only grow, so what falls out may be forgotten."""

    def __init__(self) -> None:
        self.best: dict[str, int] = {}

    def clone(self) -> TopTen:
        return TopTen()

    def _take(self, ranks: list[Rank]) -> Best:
        for r in ranks:
            self.best[r.word] = max(r.rank, self.best.get(r.word, -1))
        self.best = dict(sorted(self.best.items(), key=lambda p: (-p[1], p[0]))[:10])
        return Best(list(self.best), list(self.best.values()))

    @message_handler
    def take(self, rank: Rank) -> Best:
        return self._take([rank])

    @bulk_message_handler
    def pile(self, ranks: list) -> Best:
        return self._take(ranks)


# Several results of one cause, in order


@message_type("part")
@dataclass
class Part:
    key_: str
    nth: int

    @message_key
    def key(self) -> str:
        return self.key_


@message_type("digest")
@dataclass
class Digest:
    key_: str
    parts: int
    md5: str

    @message_key
    def key(self) -> str:
        return self.key_


@mp
class Burst:
    """Twelve results of each message."""

    def clone(self) -> Burst:
        return Burst()

    @message_handler
    def burst(self, event: Event) -> list:
        return [Part(str(event.user_id), k) for k in range(12)]


@mp
class InOrder:
    """A digest of the numbers of all parts as they came. It goes on with each part; only where state is kept it is made anew from its text."""

    def __init__(self) -> None:
        self.n, self.text, self.md5 = 0, bytearray(), hashlib.md5()

    def clone(self) -> InOrder:
        return InOrder()

    def __getstate__(self) -> tuple[int, bytes]:
        return self.n, bytes(self.text)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.n, self.text, self.md5 = state[0], bytearray(state[1]), hashlib.md5(state[1])

    @message_handler
    def take(self, part: Part) -> Digest:
        own = f"{part.nth},".encode()
        self.n += 1
        self.text += own
        self.md5.update(own)
        return Digest(part.key_, self.n, self.md5.hexdigest())


# Feedback


@message_type("hop")
@dataclass
class Hop:
    user_id: int
    hops: int

    @message_key
    def key(self) -> str:
        return str(self.user_id)


@message_type("seen")
@dataclass
class Seen:
    user_id: int
    hops: int

    @message_key
    def key(self) -> str:
        return str(self.user_id)


@mp
class Hopper:
    """Sends a message to itself until it has no hops left, and says which it saw."""

    def clone(self) -> Hopper:
        return Hopper()

    @message_handler
    def hop(self, message: Hop) -> list:
        return [Seen(message.user_id, message.hops), Hop(message.user_id, message.hops - 1) if message.hops > 0 else None]


# Handlers by class


@message_type("interaction")
@dataclass
class Interaction(Event):
    """A kind of event that goes by a type of its own too."""

    @message_key
    def key(self) -> str:
        return str(self.user_id)


@dataclass
class Click(Interaction):
    """Below Interaction, without a type of its own."""


@message_type("purchase")
@dataclass
class Purchase(Event):
    """A kind of event with a handler of its own."""

    @message_key
    def key(self) -> str:
        return str(self.user_id)


@message_type("handled_by")
@dataclass
class HandledBy:
    key_: str
    handler: str

    @message_key
    def key(self) -> str:
        return self.key_


@mp
class ByClass:
    """One handler for purchases, one for interactions and what lies below them, one for all other events."""

    def clone(self) -> ByClass:
        return ByClass()

    @message_handler
    def general(self, event: Event) -> HandledBy:
        return HandledBy(str(event.user_id), "general")

    @message_handler
    def parent(self, event: Interaction) -> HandledBy:
        return HandledBy(str(event.user_id), "parent")

    @message_handler
    def exact(self, event: Purchase) -> HandledBy:
        return HandledBy(str(event.user_id), "exact")


# Keys by discriminator


@message_type("pair")
@dataclass
class Pair:
    """A number under two keys; each makes a message type of its own."""

    number: int

    @message_key("even")
    def even(self) -> str:
        return "yes" if self.number % 2 == 0 else "no"

    @message_key("odd")
    def odd(self) -> str:
        return "yes" if self.number % 2 == 1 else "no"


@mp
class Pairing:
    def clone(self) -> Pairing:
        return Pairing()

    @message_handler
    def pair(self, event: Event) -> Pair:
        return Pair(event.event_id)


@mp
class Evens:
    def clone(self) -> Evens:
        return Evens()

    @message_handler("even")
    def take(self, pair: Pair) -> None: ...


@mp
class Odds:
    def clone(self) -> Odds:
        return Odds()

    @message_handler("odd")
    def take(self, pair: Pair) -> None: ...


# Lifecycles


@message_type("told")
@dataclass
class Told:
    key_: str
    cluster: str
    starts: int
    count: int

    @message_key
    def key(self) -> str:
        return self.key_


@mp
class Started:
    """Clones know what their prototype was told when it started, once, and count each for themselves."""

    def __init__(self) -> None:
        self.cluster, self.starts, self.n = "", 0, 0

    def clone(self) -> Started:
        return copy.copy(self)

    @start
    def begin(self, cluster: str) -> None:
        self.cluster, self.starts = cluster, self.starts + 1

    @message_handler
    def count(self, event: Event) -> Told:
        self.n += 1
        return Told(str(event.user_id), self.cluster, self.starts, self.n)


@mp
class Choosy(Counter):
    """Can't be activated for keys that five divides."""

    def clone(self) -> Choosy:
        return copy.copy(self)

    @activation
    def activate(self, key: str) -> None:
        if int(key) % 5 == 0:
            raise ValueError("a key that five divides")
        self.key = key


@mp
class Outspoken(Counter):
    """Two outputs at each pass."""

    def clone(self) -> Outspoken:
        return copy.copy(self)

    @output
    def again(self) -> list:
        return [Total(self.key, -self.n), None]


@mp
class Clinging(Evicting):
    """Fails when it is passivated; it goes all the same."""

    def clone(self) -> Clinging:
        return copy.copy(self)

    @passivation
    def leave(self) -> None:
        raise ValueError("not yet")


@mp
class Undecided(Counter):
    """Its predicate fails, so it never goes."""

    def clone(self) -> Undecided:
        return copy.copy(self)

    @evictable
    def done(self) -> bool:
        raise ValueError("who knows")


class FunctionalCounter(Mp):
    def __init__(self) -> None:
        self.n = 0

    def handle(self, message: KeyedMessage) -> TypedMessage:
        self.n += 1
        return TypedMessage(message.key, {"count": self.n}, ("counted",))


class Putter(Mp):
    """Keeps the last count of its key."""

    last = None

    def handle(self, message: KeyedMessage) -> None:
        self.last = message.message["count"]


def counter() -> Processor:
    return Processor.of(Counter())


def bulk_counter() -> Processor:
    return Processor.of(BulkCounter())


def failing() -> Processor:
    return Processor.of(Failing())


def evicting(most: int = 10) -> Processor:
    return Processor.of(Evicting(most))


def functional_counter() -> Processor:
    return MpFactory.make(FunctionalCounter, "event")


def putter() -> Processor:
    return MpFactory.make(Putter, "counted")
