"""Secrets in texts: fixed patterns, and weak parts that count only beside complementary ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut
from keyloom.llm.spans import listed, scan

#: Fixed patterns. A run of hex digits of 32 or more, and of an access id of 16 or more, is a whole run of any length that is kept.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts. Each starts where no such run goes on before it, so a long run is read once.
WEAK_ID = r"(?<![A-Za-z0-9])(?=[A-Z]{0,36}[0-9])(?=[0-9]{0,36}[A-Z])[A-Z0-9]{12,36}(?![A-Za-z0-9])"
WEAK_KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,60}+[0-9])(?=[a-z0-9+/_-]{0,60}+[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}"
ENDPOINT = r"(?<![A-Za-z0-9])(?:https?|ftp|s3|jdbc:[a-z]{2,12}|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]++"

KINDS = {
    "assign": (ASSIGN, None),
    "access": (ACCESS, lambda t: t.contains("AKIA")),
    "hex": (HEX, None),
    "id_part": (WEAK_ID, None),
    "key_part": (WEAK_KEY, None),
    "endpoint_part": (ENDPOINT, lambda t: t.contains("://")),
}
BASE = ("assign", "access", "hex")
#: What each kind is a part of.
ROLE = {"assign": "secret", "hex": "secret", "key_part": "secret", "access": "id", "id_part": "id", "endpoint_part": "endpoint"}
#: Most code points between a part and its complement.
SCOPE = 256


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked of every row of docs (doc_id, text).

    Base matches always stay. A weak part (an identifier, a key, or an endpoint) is added if a part of another role lies in the
    same row beside it, with at most `scope` code points between the two; parts that overlap are no such pair. Parts of one role
    link with nothing of their own. A pair meets in an equi-join on row and scope-wide bucket: the end of the first with the start
    of the second, which stands in its own bucket and in the one before; so parts of any length link. Matches of a kind don't
    overlap, so a bucket holds a bounded number of them. The semi-join returns each weak part once at most from either side.

    Null and empty texts, and all rows without a match, have no spans and the hash of the empty string; repeated rows come back
    repeated; a null doc_id stays null; other columns are left out; an empty table gives no rows.
    """
    rows, found = scan(docs, KINDS)
    value = F.regexp_extract("match", ASSIGN, 2)
    found = found.where((F.col("kind") != "assign") | (F.char_length(value) >= 8))
    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), F.col("kind"))
    parts = cut(found.select("row", "kind", "start", "end", role.alias("role")))
    base = parts.where(F.col("kind").isin(*BASE))
    weak = parts.where(~F.col("kind").isin(*BASE))
    # side: whether the complement comes after the part, or before it; in both cases the later start stands in two buckets
    bucket = lambda c: F.floor(c / scope)
    at = lambda side, c: F.struct(F.lit(side).alias("side"), c.alias("bucket"))
    near = parts.select(F.col("row").alias("row2"), F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.explode(F.array(at("after", bucket(F.col("start"))), at("after", bucket(F.col("start")) - 1), at("before", bucket(F.col("end"))))).alias("k")).select("*", "k.*").drop("k")
    asks = weak.select("*", F.explode(F.array(at("after", bucket(F.col("end"))), at("before", bucket(F.col("start"))), at("before", bucket(F.col("start")) - 1))).alias("k")).select("*", "k.*").drop("k")
    gap = F.when(asks.side == "after", near.start2 - asks.end).otherwise(asks.start - near.end2)
    linked = asks.join(near, (asks.row == near.row2) & (asks.side == near.side) & (asks.bucket == near.bucket) & (asks.role != near.role2) & gap.between(0, scope), "left_semi")
    linked = linked.select("row", "kind", "start", "end", "role").distinct()
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = base.union(linked).select("row", F.struct("start", order.alias("order"), "end", "kind").alias("s"))
    own = spans.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s"))
    full = rows.join(own, "row", "left").select("doc_id", F.coalesce("s", F.expr("array()").cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")).alias("s"))
    known = F.filter("s", lambda x: x["order"] <= len(BASE))
    number = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return full.select("doc_id", *[number(k) for k in BASE], F.sha2(listed(known), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"), (F.size("s") - F.size(known)).cast("long").alias("n_linked"))
