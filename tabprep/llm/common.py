"""What the text operators share: reading, batches of documents, hash splits, shared-folder tables, components."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabprep.workspace import discard, pin

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}

#: Bytes that separate words: space and \x09-\x0D. ``bytes.split()`` splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"

#: Documents of one batch are worked on in blocks of about this many bytes.
BLOCK_CHARS = 2_000_000

#: Multiplier of rolling hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


#: Rows of an Arrow batch where the session has Spark's default: texts are long, and a batch is held by JVM and worker at once.
_BATCH_SETTING, _DEFAULT_ROWS, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2500"


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it, and keep Arrow batches small.

    On a cluster it is installed on the executors or sent with ``--py-files``.
    """
    if spark.conf.get(_BATCH_SETTING) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH_SETTING, _ROWS)
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def map_batches(df: DataFrame, fields: list[tuple[str, str]], function: Callable[[Iterator[pa.RecordBatch]], Iterable]):
    """``mapInArrow`` with a function from batches to dictionaries of columns."""
    find_package(df.sparkSession)
    schema = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def run(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type, from_pandas=True) for f in schema], schema=schema
            )

    return df.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in fields))


def slices(batch: pa.RecordBatch, texts: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each cut after the row with which the texts of a column reach ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = min(int(np.searchsorted(ends, done + size)) + 1, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def blocks(batches: Iterable[pa.RecordBatch], size: int = BLOCK_CHARS) -> Iterator[list[list]]:
    """Rows of the batches as lists of columns, cut after about ``size`` bytes of the last column."""
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1, size):
            yield [column.to_pylist() for column in part.columns]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array (multiply and shift)."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


#: Longest table of powers that a worker keeps (2 MB each).
_KEPT_POWERS = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= _KEPT_POWERS:
            _powers[base] = known
    return known[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = STEP) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair, the same wherever the span lies."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(int(base), n), dtype=np.uint64, out=sums[1:])
    back = powers(pow(int(base), -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


class Memory(dict):
    """What a function gives for short frequent keys; the older half goes when both halves are full."""

    def __init__(self, function, size: int):
        self.function, self.size, self.old = function, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.function(key)
        if len(key) <= 40:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


def rewrite_texts(
    docs: DataFrame, schema: StructType, change: Callable, *needed: str, size: int = BLOCK_CHARS
) -> DataFrame:
    """The columns of ``schema`` of ``docs`` with new texts, in blocks of about ``size`` bytes of text.

    ``change`` takes lists of the ``needed`` columns and the texts, and gives lists of which rows stay and of new texts.
    """
    find_package(docs.sparkSession)

    def run(batches):
        for whole in batches:
            place = whole.schema.get_field_index("text")
            for batch in slices(whole, place, size):
                kept, texts = change(*[batch.column(name).to_pylist() for name in (*needed, "text")])
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
                yield batch.select(schema.names).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)


class HashArray:
    """Sorted 64-bit hashes with an index of their leading bits: finds many keys at once."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        bits = max(int(4 * len(keys)).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes``, and whether the key is there."""
        if not len(self.hashes):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        wanted, last = mix(keys), len(self.hashes) - 1
        place = np.minimum(self.first[wanted >> self.shift], last)
        there = self.hashes[place]
        behind = np.flatnonzero(there < wanted)
        while len(behind):
            behind = behind[place[behind] < last]
            place[behind] += 1
            behind = behind[self.hashes[place[behind]] < wanted[behind]]
        return place, self.hashes[place] == wanted


_CHANCES = 1 << 40


def hash_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most ``rows`` rows: all of a smaller table, else those with the hash of ``columns`` below a cut that follows from the count.

    The cut lies four standard deviations low, so that the limit behind it takes nothing away but from tables of many equal rows.
    """
    total = df.count()
    if total <= rows:
        return df
    cut = int(max(rows - 4 * math.sqrt(rows), 1) / total * _CHANCES)
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(_CHANCES)) < cut).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, divisor: int, held: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``rows`` labelled training documents, chosen by the hash of the id.

    The ids are at most ``rows`` longs, so they are broadcast; documents are read once and not shuffled.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .where(remainder("doc_id", divisor) != held)
    )
    ids = F.broadcast(hash_sample(ids, rows, "doc_id"))
    return docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "label", "text")


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``node, component`` of an undirected graph given as rows ``a, b``; component is the smallest node.

    Large-star and small-star steps in turn. The smallest neighbour of every node is an aggregate with map-side minimum, written
    before it is joined back to the edges: both sides of the join are then plain tables, so that adaptive execution splits
    the edges of a hot node over tasks. Every round is written to the shared folder and the one before deleted.
    """
    edges = pin(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before = None
    while (now := _fingerprint(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = pin(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = pin(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large"
        )
        least = pin(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        new = pin(small.distinct(), name)
        discard(edges, low, large, least)
        edges = new
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and two sums over their hashes: equal for equal sets of distinct edges."""
    hashed = edges.select(F.xxhash64("u", "v").alias("x"), F.hash("v", "u").cast("long").alias("y"))
    row = hashed.agg(F.count("*"), F.bit_xor("x"), F.sum(F.shiftright("x", 20)), F.sum("y")).first()
    return tuple(row)
