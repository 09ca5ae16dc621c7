"""What the operators share: table access, lineage cuts, byte-bounded batches, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.storage import cut, remove, scratch, shared_folder

__all__ = ["BATCH_BYTES", "bounded", "by_key", "components", "cut", "forest", "free_name", "hot_keys", "marked", "remove", "scratch", "shared_folder", "shuffled", "squeeze", "table", "text_batches", "unpacked"]

#: Bytes of text that a Python worker handles at once.
BATCH_BYTES = 2 << 20
#: Most keys that are called hot, and fewest rows of one.
HOT = 1000
HOT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """From now on Spark hands a Python worker BATCH_BYTES at once in this session, or one longer row.

    Its own bounds are 10,000 rows and 64 MB, which tasks hold in the worker, as vectors, and again as a message to the worker; the last
    two lie beside the JVM's heap. No result depends on where batches end.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(counts: DataFrame, key: str | list[str], n: str, whole: int) -> DataFrame:
    """The keys of counts, a row each, that have more than a share 1 / HOT of `whole` rows, and so HOT keys at most."""
    return counts.where(F.col(n) > max(HOT_ROWS, whole // HOT)).select(key)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join whose sides grow with the input: both are dealt by key, and none is broadcast, whatever Spark takes its size for.

    Spark reckons that an explode and a Python function give one row for each they get, so it broadcasts what it takes for a few MB
    and is a hundred times that.
    """
    return df.hint("merge")


def by_key(rows: DataFrame, classes: DataFrame, key: str | list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with classes, which have one row a key, so that no key's rows meet in one task.

    hot: the keys of many rows, HOT at most, so their classes are broadcast and their rows stay where they are. The rest is
    dealt by key. rows and classes are read twice; both should be cheap to read. how: inner or left.
    """
    many = F.broadcast(hot.select(key))  # HOT rows at most
    here = rows.join(many, key, "left_semi").join(F.broadcast(classes.join(many, key, "left_semi")), key, how)  # HOT rows at most
    return here.union(rows.join(many, key, "left_anti").join(shuffled(classes), key, how).select(here.columns))


def marked(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows whose number, in the column `name`, is one of wanted's, a table of one column of numbers, repeated or not.

    rows stay where they are: which of them are wanted is told by bits, in broadcast blocks of 4096 numbers that take 800 bytes at most,
    0.2 bytes a row where row numbers follow each other, as those of monotonically_increasing_id() do within a partition.
    """
    own, n, block, words = F.col(wanted.columns[0]), F.col(name), free_name(rows, "block"), free_name(rows, "words")
    bit = lambda n: n.bitwiseAND(63).cast("int")
    word = lambda n: F.shiftright(n, 6).bitwiseAND(63).cast("int")
    each = wanted.groupBy(F.shiftright(own, 12).alias(block), word(own).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(own))).alias("bits"))
    blocks = each.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias(words))
    found = rows.join(F.broadcast(blocks), F.shiftright(n, 12) == F.col(block))  # 0.2 bytes a row
    return found.where(F.getbit(F.try_element_at(words, word(n)), bit(n)) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def text_batches(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text") -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts as UTF-8 bytes) of at most BATCH_BYTES, or one longer text; null texts become empty ones."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(key))
        column = batch.column(batch.schema.get_field_index(text))
        raw = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        sizes = np.nan_to_num(pa.compute.binary_length(raw).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        first, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > BATCH_BYTES:
                yield ids.slice(first, i - first), [x or b"" for x in raw.slice(first, i - first).to_pylist()]
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield ids.slice(first), [x or b"" for x in raw.slice(first).to_pylist()]


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is a text, with the text compressed for a shuffle; see unpacked()."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        done = 0
        for _, texts in text_batches(iter([batch]), batch.schema.names[0]):
            part = batch.slice(done, len(texts))
            done += len(texts)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([pack(t) for t in texts], pa.binary())], names=batch.schema.names)


def unpacked(raw: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw) if raw else b""


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of a bounded block of links, roots left out."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        live = low != high
        a, b, low, high = a[live], b[live], low[live], high[live]
        np.minimum.at(parent, high, low)
        while (parent != (up := parent[parent])).any():
            parent = up
    joined = parent != np.arange(len(nodes))
    return nodes[joined], nodes[parent[joined]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u = v = np.empty(0, np.int64)
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy()])
        v = np.concatenate([v, batch.column(1).to_numpy()])
        u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node of its connected component.

    links has two long columns. Each partition first keeps a spanning forest of its own links; the forests then meet in
    rounds of large-star and small-star, whose group minima combine before the shuffle, until the set of links stays as it is.
    Links with a null end and self links count for nothing; without links the result is empty.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = cut(edges.mapInArrow(_forests, "u long, v long"))
    seen = None
    while True:
        # u > v from here on; a fixed point is a set of stars around the smallest nodes
        both = edges.union(edges.select("v", "u")).toDF("u", "v").distinct()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(shuffled(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small.mapInArrow(_forests, "u long, v long") if seen is None else small)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("root")))
