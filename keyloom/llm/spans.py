"""Spans of regular expressions in a text column by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut

#: Characters kept on either side of a match.
NEAR = 40


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Array of (pos, gap, match, before, after) of the leftmost non-overlapping matches; gap: code points since the last one.

    Splitting at a pattern gives the pieces between the matches, so lengths of pieces and matches give the positions. gate
    must hold for every text with a match; a cheap one saves the two passes over other texts.
    """
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(pair: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("pos"),
            F.char_length(pair["part"]).cast("long").alias("gap"),
            pair["found"].alias("match"),
            F.right(pair["part"], F.lit(NEAR)).alias("before"),
            F.left(pair["after"], F.lit(NEAR)).alias("after"),
        )

    zipped = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("found"), F.slice(parts, 2, F.size(found)).alias("after"))
    spans = F.transform(zipped, one)
    return F.when(F.rlike(text, F.lit(pattern)) if gate is None else gate & F.rlike(text, F.lit(pattern)), spans)


def scan(docs: DataFrame, kinds: dict[str, tuple[str, Column | None]]) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows has (row, doc_id) of every row of docs; found a row for each match of each kind.

    found: row, kind, start, end (code points, end exclusive), match, before, after. The texts are read once; what they hold
    is written to the checkpoint folder, and all later joins are over it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    columns = [matches(F.col("text"), p, gate(F.col("text")) if gate else None).alias(k) for k, (p, gate) in kinds.items()]
    held = cut(plain.select(F.monotonically_increasing_id().alias("row"), "doc_id", *columns))

    def tagged(kind: str) -> Column:
        fields = ("pos", "gap", "match", "before", "after")
        return F.coalesce(F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), *[m[x].alias(x) for x in fields])), F.array())

    each = F.concat(*map(tagged, kinds))
    exploded = held.select("row", F.explode(each).alias("m")).select("row", "m.*")
    size = F.char_length("match")
    upto = F.sum(F.col("gap") + size).over(Window.partitionBy("row", "kind").orderBy("pos"))
    found = exploded.select("row", "kind", (upto - size).alias("start"), upto.alias("end"), "match", "before", "after")
    return held.select("row", "doc_id"), found


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a column of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.char_length(number))
    one = lambda i: F.substring(number, -i, F.lit(1)).cast("int")
    value = F.aggregate(at, F.lit(0), lambda s, i: s + F.when(i % 2 == 1, one(i)).otherwise((one(i) * 2) % 10 + F.floor(one(i) / 5).cast("int")))
    return value % 10 == 0


def listed(spans: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
