"""Personal data in texts: fixed patterns, and candidates judged by aggregated weak labels."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut, free_name
from keyloom.llm.spans import digits, listed, luhn, scan

# The leftmost match of a run starts where the run does, or where the last match ended (\G): without trying every later
# start, long runs take linear time. Possessive groups match the same strings here and don't recurse.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates that the fixed patterns miss.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
LOCAL = r"(?<![0-9A-Za-z+.)-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
NUMBER = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

DIGIT13 = r"[0-9](?:[\x20-]?[0-9]){12}"
KINDS = {
    "email": (EMAIL, lambda t: t.contains("@")),
    "ip": (IP, None),
    "card": (CARD, lambda t: t.rlike(DIGIT13)),
    "phone": (PHONE, lambda t: t.contains("+")),
    "spelled_email": (SPELLED, lambda t: t.contains("at]") | t.contains("at)")),
    "local_phone": (LOCAL, None),
    "id_number": (NUMBER, None),
}
BASE = ("email", "ip", "card", "phone")
FAMILY = {"email": "email", "spelled_email": "email", "ip": "ip", "card": "card", "phone": "phone", "local_phone": "phone", "id_number": "id"}
#: Words beside a span that speak for its family.
CONTEXT = {"email": "mail|contact|write to|address", "ip": r"\bip\b|server|host|login|logged", "card": "card|visa|master|amex|credit|pay", "phone": "phone|tel|call|mobile|fax|dial|contact", "id": r"ssn|social|passport|\bid\b|tax"}
#: Words beside a span that speak against personal data.
OTHER = r"version|\bv[0-9]|isbn|issn|order|invoice|serial|section|figure|table|equation|page|doi|chapter"
#: Gazetteer: mail domains, address blocks and number prefixes that belong to people or to networks.
DOMAINS = r"(?i)(gmail|yahoo|hotmail|outlook|icloud|aol|gmx|web|proton|mail[0-9]*)([.\[( ]|$)"
BLOCKS = r"^(0|127|255)\."
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"

#: EM and classifier settings; fixed numbers of steps over at most 3 ** len(LABELERS) * len(FAMILY) vote patterns.
EM_STEPS = 40
FIT_STEPS = 300
RATE = 0.5
RIDGE = 0.01


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a fixed pattern meets its condition; candidates always do."""
    own = digits(match)
    n = F.char_length(own)
    small = F.forall(F.split(match, "\\."), lambda x: F.char_length(F.regexp_replace(x, "^0+(?=.)", "")).between(1, 3) & (F.coalesce(F.try_to_number(F.right(x, F.lit(3)), F.lit("999")).cast("int"), F.lit(999)) <= 255))
    return F.when(kind == "ip", small).when(kind == "card", n.between(13, 19) & luhn(own)).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def labelers() -> dict[str, Column]:
    """Votes of the labelers on a span: 1 personal, -1 not, 0 no opinion."""
    family = F.element_at(F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair]), F.col("kind"))
    near = F.lower(F.concat_ws(" ", "before", "after"))
    own = digits(F.col("match"))
    spoken = F.lit(False)
    for name, words in CONTEXT.items():
        spoken = F.when(family == name, near.rlike(words)).otherwise(spoken)
    repeated = F.char_length(F.regexp_replace(own, "([0-9])\\1*", "$1")) * 3 <= F.char_length(own)
    return {
        "pattern": vote(F.col("kind").isin(*BASE), F.col("kind").isin("id_number", "local_phone") & repeated),
        "gazetteer": F.when(family == "email", vote(F.lower("match").rlike(DOMAINS), F.lower("match").rlike("noreply|no-reply|postmaster"))).when(family == "ip", vote(~F.col("match").rlike(BLOCKS), F.col("match").rlike(BLOCKS))).when(family == "card", vote(own.rlike(ISSUERS), ~own.rlike(ISSUERS))).when(family == "phone", vote(~own.rlike("^0{3}"), own.rlike("^0{3}"))).otherwise(vote(~own.rlike("^(000|666|9)"), own.rlike("^(000|666|9)"))),
        "context": vote(spoken, F.lit(False)),
        "denial": vote(F.lit(False), near.rlike(OTHER)),
        "edge": vote(F.col("before").rlike(r"(^|[\s:,;(<\"'])$") & F.col("after").rlike(r"^($|[\s:,;.)>\"'!?])"), F.col("before").rlike("[A-Za-z0-9_/=]$") | F.col("after").rlike("^[A-Za-z0-9_/=]")),
    }


NAMES = ("pattern", "gazetteer", "context", "denial", "edge")
Pattern = tuple[int, ...]
#: Features of a span itself, beside its kind and its votes.
SHAPES = {"wide": lambda m: F.char_length(m) > 12, "spaced": lambda m: m.contains(" "), "marked": lambda m: m.rlike(r"[()+\[\]]")}
#: Code points of the blocks in which texts are masked.
BLOCK = 1024


def estimate(counts: dict[Pattern, int], steps: int = EM_STEPS) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]], dict[Pattern, float]]:
    """(prior, reliabilities, posterior of each vote pattern) by expectation-maximisation with votes independent given the class.

    A labeler's reliability is its chance of each vote given the class. It starts from the mean vote and is smoothed by one
    span, so no labeler becomes certain.
    """
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in counts}
    prior, rates = 0.5, []
    for _ in range(steps):
        weight = sum(counts.values())
        good = sum(n * post[p] for p, n in counts.items())
        prior = (good + 1) / (weight + 2)
        rates = []
        for k in range(len(NAMES)):
            yes = {v: 1.0 + 0.5 * (v > 0) for v in (-1, 0, 1)}
            no = {v: 1.0 + 0.5 * (v < 0) for v in (-1, 0, 1)}
            for p, n in counts.items():
                yes[p[k]] += n * post[p]
                no[p[k]] += n * (1 - post[p])
            rates.append(({v: x / sum(yes.values()) for v, x in yes.items()}, {v: x / sum(no.values()) for v, x in no.items()}))
        post = {p: 1 / (1 + math.exp(-max(-30, min(30, math.log(prior / (1 - prior)) + sum(math.log(rates[k][0][v] / rates[k][1][v]) for k, v in enumerate(p)))))) for p in counts}
    return prior, rates, post


def features(kind: str, votes: Pattern, shape: Pattern) -> list[float]:
    """One-hot kind, each labeler's votes for and against, and the span's own features."""
    return [float(kind == k) for k in KINDS] + [float(v > 0) for v in votes] + [float(v < 0) for v in votes] + [float(x) for x in shape]


def fit(rows: Iterable[tuple[str, Pattern, Pattern, int, float]], steps: int = FIT_STEPS) -> list[float]:
    """Weights of a logistic regression on soft labels: rows are (kind, votes, shape, spans, posterior)."""
    data = [(features(k, v, x), n, y) for k, v, x, n, y in rows]
    weights = [0.0] * (len(KINDS) + 2 * len(NAMES) + len(SHAPES))
    whole = sum(math.log1p(n) for _, n, _ in data) or 1
    for _ in range(steps):
        slope = [RIDGE * w for w in weights]
        for x, n, y in data:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(weights, x))))))
            for i, a in enumerate(x):
                slope[i] += math.log1p(n) / whole * (p - y) * a
        weights = [w - RATE * s for w, s in zip(weights, slope)]
    return weights


def learn(counts: dict[tuple[str, Pattern, Pattern], int]) -> list[float]:
    """The classifier's weights from the numbers of spans by kind, votes and shape: EM on the votes, then the fit to its posteriors."""
    merged: dict[Pattern, int] = {}
    for (_, v, _), n in counts.items():
        merged[v] = merged.get(v, 0) + n
    if not merged:
        return [0.0]
    _, _, post = estimate(merged)
    return fit((k, v, x, n, post[v]) for (k, v, x), n in sorted(counts.items()))


def found_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has (row, doc_id) of every row of docs (doc_id, text), spans a row (row, order, start, end, kind) a span.

    Matches of the fixed patterns that meet their conditions always stay. Other candidates stay if the classifier gives them
    one half or more and they don't overlap a fixed match. Labelers vote on every candidate and every fixed match; the votes
    are counted over all of them by kind and shape, and those counts, at most kinds x 3 ** labelers x 2 ** shapes rows however
    large the input, are what EM and the classifier see. Null and empty texts have no spans.
    """
    rows, found = scan(docs, KINDS)
    votes, shapes = labelers(), {k: make(F.col("match")).cast("int") for k, make in SHAPES.items()}
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    judged = cut(found.where(valid(F.col("kind"), F.col("match"))).select("row", "kind", order.alias("order"), "start", "end", *[c.alias(k) for k, c in (votes | shapes).items()]))
    counts = {(r["kind"], tuple(r[k] for k in NAMES), tuple(r[k] for k in SHAPES)): r["count"] for r in judged.groupBy("kind", *NAMES, *SHAPES).count().collect()}
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    names = [yes(F.col("kind") == k) for k in KINDS] + [yes(F.col(k) > 0) for k in NAMES] + [yes(F.col(k) < 0) for k in NAMES] + [yes(F.col(k) > 0) for k in SHAPES]
    score = sum((F.lit(w) * x for w, x in zip(learn(counts), names)), F.lit(0.0))
    fixed = F.col("order") <= len(BASE)
    likely = judged.where(fixed | (score >= 0)).select("row", "order", "start", "end", "kind")
    # running maxima from either side, as each span's nearest fixed matches decide; fixed ones lead at equal starts
    before = Window.partitionBy("row").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy(F.desc("start"), "order").rowsBetween(Window.unboundedPreceding, 0)
    near = likely.withColumn("upto", F.max(F.when(fixed, F.col("end"))).over(before)).withColumn("next", F.min(F.when(fixed, F.col("start"))).over(after))
    covered = F.coalesce(F.col("upto") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return rows, near.where(fixed | ~covered).select("row", "order", "start", "end", "kind")


def find(docs: DataFrame) -> DataFrame:
    """(row, doc_id, spans): every row of docs with its spans (order, start, end, kind), sorted so; see found_spans()."""
    rows, spans = found_spans(docs)
    own = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("order", "start", "end", "kind"))).alias("spans"))
    empty = F.expr("array()").cast("array<struct<order:int,start:bigint,end:bigint,kind:string>>")
    return rows.join(own, "row", "left").select("row", "doc_id", F.coalesce("spans", empty).alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of docs; repeated rows come back repeated.

    A null text is empty: no spans, the hash of the empty string; a null doc_id stays null. Texts of any length are read whole, in
    time that grows with their length and the number of their spans. Columns other than doc_id and text are left out. An empty
    table gives no rows.
    """
    known = F.filter("spans", lambda x: x["order"] <= len(BASE))
    return find(docs).select("doc_id", *map(_count, BASE), F.sha2(listed(known), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def joined(spans: DataFrame) -> DataFrame:
    """(row, start, end, kind): spans that overlap made one, under the kind of the first."""
    w = Window.partitionBy("row").orderBy("start", "end", "kind")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") >= upto, F.lit(True)).cast("long")
    numbered = spans.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind")).drop("nth")


def cuts(spans: DataFrame) -> DataFrame:
    """(row, cuts): for each block of a text, up to its last one with a span, the spans in it as (a, b, tag) within the block.

    A span that goes on from the block before has no tag there.
    """
    block = lambda c: F.floor(c / BLOCK)
    each = spans.select("row", "start", "end", "kind", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))).alias("block"))
    first = F.col("block") * BLOCK
    tag = F.when(F.col("start") >= first, F.concat(F.lit("<"), F.col("kind"), F.lit(">"))).otherwise(F.lit(""))
    own = each.select("row", "block", F.struct(F.greatest(F.col("start") - first, F.lit(0)).cast("int").alias("a"), F.least(F.col("end") - first, F.lit(BLOCK)).cast("int").alias("b"), tag.alias("tag")).alias("cut"))
    last = spans.groupBy("row").agg(block(F.max("end") - 1).alias("last"))
    none = F.lit(None).cast(own.schema["cut"].dataType).alias("cut")
    whole = own.union(last.select("row", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"), none))
    within = whole.groupBy("row", "block").agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    return within.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("block", "cuts"))).alias("c")).select("row", F.transform("c", lambda x: x["cuts"]).alias("cuts"))


def replaced(text: Column, held: Column) -> Column:
    """text with the spans of its blocks' cuts replaced by their tags; work within a block is bounded, so the whole is linear."""

    def block(own: Column, k: Column) -> Column:
        here = F.get(held, k)
        upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(here, i - 1)["b"])
        parts = F.transform(here, lambda c, i: F.concat(F.substring(own, upto(i) + 1, c["a"] - upto(i)), c["tag"]))
        tail = F.substring(own, F.element_at(here, -1)["b"] + 1, F.lit(BLOCK))
        return F.when(F.coalesce(F.size(here), F.lit(0)) <= 0, own).otherwise(F.concat(F.array_join(parts, ""), tail))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), block), "")


def masked(docs: DataFrame) -> DataFrame:
    """docs with all of its columns and rows; each personal span of its texts is replaced by its kind in angle brackets.

    Spans that overlap are masked as one, under the kind of the first. Where docs has n_chars, it is renewed for changed texts.
    Rows meet their spans in a join; the table must keep its partitions between the two reads, as tables do. Null texts stay
    null, an empty table stays empty.
    """
    name, held = free_name(docs, "row_number_"), free_name(docs, "personal_")
    found = cuts(joined(found_spans(docs)[1])).select(F.col("row").alias(name), F.col("cuts").alias(held))
    text = F.col("text").cast("string")
    new = F.when(F.col(held).isNull(), text).otherwise(replaced(text, F.col(held)))
    full = docs.withColumn(name, F.monotonically_increasing_id()).join(found, name, "left")
    columns = [new.alias(c) if c == "text" else F.when(F.col(held).isNull(), F.col(f"`{c}`")).otherwise(F.char_length(new).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return full.select(*columns)
