"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import by_key, cut, hot_keys

#: A level's target share is its share of tokens to this power, made to sum to 1, unless weights are given.
POWERS = {"source": 0.7, "lang": 0.9, "topic": 0.9}
ROUNDS = 12
#: Most languages and topics whose factors the driver keeps; of more, and of sources in any case, they stay in tables.
LEVELS = 1000
#: Largest share by which a marginal may miss its target after the last round without a warning.
RESIDUAL = 1e-3
#: Most sources whose factors are broadcast; more are joined by a shuffle.
BROADCAST = 20_000

WORD = r"[^\x20\x09-\x0D]+"
#: (topic, text that it holds), the first that fits counts; then long texts, short ones, and the rest.
TOPICS = (("table", " | "), ("symbols", "%%%"), ("licence", "icense"), ("contact", "@"))
LONG, SHORT = 1000, 60


def tokens(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column, n: Column) -> Column:
    named = F.when(text.isNull(), F.lit("short"))
    for name, part in TOPICS:
        named = named.when(text.contains(part), F.lit(name))
    return named.when(n >= LONG, F.lit("long")).when(n < SHORT, F.lit("short")).otherwise(F.lit("prose"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number from 0 to below 1 that an id and a seed fix: 48 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def targets(masses: Mapping[str, float], power: float, given: Mapping[str, float] | None) -> dict[str, float]:
    raw = {k: (given.get(k, 0.0) if given is not None else m**power if m > 0 else 0.0) for k, m in masses.items()}
    whole = sum(raw.values())
    return {k: v / whole if whole else 0.0 for k, v in raw.items()}


def _looked_up(column: Column, values: Mapping[str, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), column), F.lit(0.0)) if values else F.lit(0.0)


def measured(docs: DataFrame) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic and mix_tokens; null sources and languages are the level ''."""
    n = F.col("mix_tokens")
    text = F.col("text").cast("string")
    return docs.withColumns({"mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "mix_tokens": tokens(text)}).withColumn("mix_topic", topic(text, n))


def rake(rows: DataFrame, given: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, float], dict[str, float], float]:
    """(factors of sources, of languages, of topics, rate) over measured rows: rate x product is a row's probability.

    Each round scales sources, then languages, then topics to their target shares. A row per source holds its cells, so
    scaling sources needs no exchange, and what languages and topics need is their common table, which a round aggregates and
    which LEVELS bounds; raked_cells() does without that bound. rate makes the largest probability of any cell 1.
    """
    given = given or {}
    cells = masses_of(rows)
    cells = cells.groupBy("mix_source").agg(F.collect_list(F.struct("mix_lang", "mix_topic", F.col("mass").cast("double").alias("mass"))).alias("cells"), F.sum("mass").cast("double").alias("total"))
    cells = cut(cells)
    power = lambda c: F.pow(c, F.lit(POWERS["source"]))
    want = _looked_up(F.col("mix_source"), given["source"]) if "source" in given else power(F.col("total"))
    sums = cells.agg(F.sum("total"), F.sum(want)).first()
    if not sums[0]:
        return cells.select("mix_source", F.lit(0.0).alias("factor")), {}, {}, 0.0
    pairs = cells.select(F.explode("cells").alias("c")).groupBy("c.mix_lang", "c.mix_topic").agg(F.sum("c.mass").alias("x")).limit(LEVELS * LEVELS + 1).collect()
    masses: dict[str, dict[str, float]] = {"lang": {}, "topic": {}}
    for r in pairs:
        for k in masses:
            masses[k][r[f"mix_{k}"]] = masses[k].get(r[f"mix_{k}"], 0.0) + r["x"]
    if max(map(len, masses.values())) > LEVELS:
        raise TooMany
    goal = {k: targets(m, POWERS[k], given.get(k)) for k, m in masses.items()}
    factor = {k: dict.fromkeys(m, 1.0) for k, m in masses.items()}

    def scaled() -> DataFrame:
        one = lambda c: c["mass"] * _looked_up(c["mix_lang"], factor["lang"]) * _looked_up(c["mix_topic"], factor["topic"])
        sum_ = F.aggregate("cells", F.lit(0.0), lambda s, c: s + one(c))
        return cells.withColumn("factor", F.when(sum_ > 0, want / F.lit(sums[1] or 1.0) / sum_).otherwise(0.0))

    for _ in range(rounds):
        table = scaled().select("factor", F.explode("cells").alias("c")).groupBy("c.mix_lang", "c.mix_topic").agg(F.sum(F.col("factor") * F.col("c.mass")).alias("x")).collect()
        fixed = scaled()
        for k in ("lang", "topic"):
            now: dict[str, float] = {}
            for r in table:
                now[r[f"mix_{k}"]] = now.get(r[f"mix_{k}"], 0.0) + r["x"] * factor["lang"][r["mix_lang"]] * factor["topic"][r["mix_topic"]]
            factor[k] = {v: f * goal[k][v] / now[v] if now[v] else 0.0 for v, f in factor[k].items()}
    # topics fit by construction; sources and languages were fitted before them
    ends = fixed.select("mix_source", "factor", "total", want.alias("want"), F.explode("cells").alias("c")).withColumn("x", F.col("factor") * F.col("c.mass") * _looked_up(F.col("c.mix_lang"), factor["lang"]) * _looked_up(F.col("c.mix_topic"), factor["topic"]))
    missed = ends.groupBy("mix_source").agg(F.sum("x").alias("x"), F.first("want").alias("want")).agg(F.max(F.abs(F.col("x") - F.col("want") / F.lit(sums[1] or 1.0)))).first()[0] or 0.0
    if missed > RESIDUAL:
        warnings.warn(f"after {rounds} rounds a source's share misses its target by {missed:.2g}: the targets may not go together", stacklevel=2)
    best = F.max(F.col("factor") * _looked_up(F.col("c.mix_lang"), factor["lang"]) * _looked_up(F.col("c.mix_topic"), factor["topic"]))
    most = fixed.select("factor", F.explode("cells").alias("c")).agg(best).first()[0]
    return fixed.select("mix_source", "factor"), factor["lang"], factor["topic"], 1.0 / most if most else 0.0


class TooMany(ValueError):
    """More languages or topics than the driver keeps factors of."""


def masses_of(rows: DataFrame) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, mass) of the cells that have tokens."""
    return rows.groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("mass")).where("mass > 0")


def raked_cells(rows: DataFrame, given: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, probability) of every cell, by the same steps as rake(), all of them in tables.

    For any number of levels. A step sums the cells by one column, which combines before it shuffles, and joins the sums back: of
    at most BROADCAST levels, which are counted first, by a broadcast, of more by a shuffle of the cells.
    """
    given = given or {}
    cells = cut(masses_of(rows).select("mix_source", "mix_lang", "mix_topic", F.col("mass").cast("double").alias("mass"), F.col("mass").cast("double").alias("x")))
    columns = cells.columns
    goals, few = {}, {}
    for k in POWERS:
        own = cells.groupBy(f"mix_{k}").agg(F.sum("mass").alias("total"))
        weight = _looked_up(F.col(f"mix_{k}"), given[k]) if k in given else F.pow("total", F.lit(POWERS[k]))
        whole, levels = own.agg(F.sum(weight), F.count("*")).first()
        goals[k], few[k] = cut(own.select(f"mix_{k}", (weight / F.lit(whole or 1.0)).alias("goal"))), levels <= BROADCAST
    for _ in range(rounds):
        for k in POWERS:
            sums = cells.groupBy(f"mix_{k}").agg(F.sum("x").alias("now")).join(F.broadcast(goals[k]) if few[k] else goals[k], f"mix_{k}")
            scaled = cells.join(F.broadcast(sums) if few[k] else sums, f"mix_{k}")
            cells = cut(scaled.withColumn("x", F.when(F.col("now") > 0, F.col("x") * F.col("goal") / F.col("now")).otherwise(0.0)).select(*columns))
    most = cells.agg(F.max(F.col("x") / F.col("mass"))).first()[0]
    return cells.select("mix_source", "mix_lang", "mix_topic", (F.col("x") / F.col("mass") / F.lit(most or 1.0)).alias("raw"))


def weighted(docs: DataFrame, given: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, known: DataFrame | None = None) -> DataFrame:
    """measured(docs) with mix_probability. known: measured rows that give the weights, where docs would be read twice else.

    Rows without tokens have probability 0. Where all tokens are missing, all have.
    """
    rows = measured(docs) if known is None else known
    try:
        sources, langs, topics, rate = rake(rows, given, rounds)
    except TooMany:
        keys = ["mix_source", "mix_lang", "mix_topic"]
        whole = rows.groupBy(*keys).agg(F.count("*").alias("held"))
        cells = raked_cells(rows, given, rounds)
        hot = hot_keys(whole, keys, "held", rows.count())
        found = by_key(rows, cells, keys, hot, "left")
        return found.withColumn("mix_probability", F.when(F.col("mix_tokens") > 0, F.least(F.lit(1.0), F.coalesce("raw", F.lit(0.0)))).otherwise(0.0)).drop("raw")
    if sources.limit(BROADCAST + 1).count() <= BROADCAST:
        sources = F.broadcast(sources)
    joined = rows.join(sources, "mix_source", "left")
    raw = F.lit(rate) * F.coalesce("factor", F.lit(0.0)) * _looked_up(F.col("mix_lang"), langs) * _looked_up(F.col("mix_topic"), topics)
    return joined.withColumn("mix_probability", F.when(F.col("mix_tokens") > 0, F.least(F.lit(1.0), raw)).otherwise(0.0)).drop("factor")


def sample(docs: DataFrame, given: Mapping[str, Mapping[str, float]] | None = None, seed: int = 1) -> DataFrame:
    """The sampled rows of docs (doc_id, text, lang, source), with all of its columns.

    A row stays if the number that its doc_id fixes is below its probability, so equal ids share one draw.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")  # so no column of docs meets one of ours
    kept = weighted(docs.select(whole, "doc_id", "text", "lang", "source"), given).where(uniform(F.col("doc_id"), seed) < F.col("mix_probability"))
    return kept.select("whole.*")


def mixture(docs: DataFrame, given: Mapping[str, Mapping[str, float]] | None = None, seed: int = 1) -> DataFrame:
    """doc_id, topic, n_tokens, probability (6 digits) and kept of every row of docs; repeated rows come back repeated.

    A null or empty text has no tokens, the topic short, and probability 0, so it is not kept; null languages and sources are levels
    of their own. Texts count whole, however long. Rows that share a doc_id, or have none, share its draw. Extra columns are left
    out. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source")
    known = cut(measured(plain).select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens"))
    rows = weighted(plain, given, known=known)
    return rows.select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_probability", 6).alias("probability"), (uniform(F.col("doc_id"), seed) < F.col("mix_probability")).alias("kept"))


def sql(seed: int = 1, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL: one common table for each scaling."""
    named = " ".join(f"WHEN contains(text, '{part}') THEN '{name}'" for name, part in TOPICS)
    parts = [
        r"m AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)",
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, n, CASE {named} WHEN n >= {LONG} THEN 'long' WHEN n < {SHORT} THEN 'short' ELSE 'prose' END AS topic FROM m)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS mass FROM d GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for k, p in POWERS.items():
        parts.append(f"t_{k} AS MATERIALIZED (SELECT {k}, power(sum(mass), {p}) / sum(power(sum(mass), {p})) OVER () AS goal FROM c GROUP BY {k})")
    last = "(SELECT *, mass AS x FROM c)"
    for i in range(rounds):
        for k in POWERS:
            parts.append(f"x{i}_{k} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, mass, x * goal / sum(x) OVER (PARTITION BY a.{k}) AS x FROM {last} a JOIN t_{k} USING ({k}))")
            last = f"x{i}_{k}"
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, x / mass / max(x / mass) OVER () AS p FROM {last})")
    u = f"('0x' || substr(md5('{seed}:' || doc_id::VARCHAR), 1, 12))::BIGINT / {float(1 << 48)}"
    return f"WITH {', '.join(parts)} SELECT doc_id, topic, n AS n_tokens, round(q, 6) AS probability, {u} < q AS kept FROM (SELECT d.*, CASE WHEN n > 0 THEN coalesce(p, 0) ELSE 0 END AS q FROM d LEFT JOIN p USING (source, lang, topic))"
