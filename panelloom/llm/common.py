"""Reading, Arrow maps over texts, and state that a Python worker keeps from task to task."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.session import ensure_checkpoint_dir

# Rows and bytes of one Arrow batch: what a task holds of the texts at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

# Bytes that separate words: space and \t\n\v\f\r. ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches small, so that a run of very long texts stays within a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    owner = function.__module__

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states_for(owner)
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(mapped, schema)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def texts_of(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The key columns and the text, NULL texts as empty ones."""
    return df.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))


# Bits of the map that thins rows before a shuffle: at most BITS / 64 rows of two numbers, whatever the data.
BITS = 1 << 24


def thinned(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is no ``wanted_key``, so that a join shuffles less.

    The wanted keys are marked in a bit map of fixed size, a table of 64-bit words that is small enough to broadcast.
    """
    bit = "pmod(xxhash64({}), {})"
    marks = wanted.selectExpr(f"{bit.format(wanted_key, BITS)} AS _bit")
    words = marks.groupBy(F.expr("shiftright(_bit, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_bit & 63 AS INT)))").alias("_bits"))
    tagged = rows.withColumn("_bit", F.expr(bit.format(key, BITS)))
    met = tagged.join(F.broadcast(words), F.expr("shiftright(_bit, 6) = _word"))
    return met.where("(_bits & shiftleft(1L, CAST(_bit & 63 AS INT))) <> 0").drop("_bit", "_word", "_bits")


def words_of(text: str) -> list[bytes]:
    """The words as UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


# States that a worker keeps: those of one query's tasks, but not those of queries before it.
STATES = 2


def states_for(owner: str) -> None:
    """Free the states of other operators than ``owner``: a worker outlives queries and pipeline stages."""
    worker = sys.modules.setdefault("_panelloom_worker", types.ModuleType("_panelloom_worker")).__dict__
    if worker.get("owner") != owner:
        worker["owner"] = owner
        worker.get("states", {}).clear()


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task keeps its states alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_state(key: tuple, make: Callable[[], object], version: str = "") -> object:
    """What ``make`` returns, made once in each Python worker and kept for its later tasks; another version replaces it,
    and the state least lately asked for goes when there are more than ``STATES``.

    Functions travel to the executors by value, so a global of this package would start empty in each task.
    """
    held = sys.modules.setdefault("_panelloom_worker", types.ModuleType("_panelloom_worker")).__dict__.setdefault("states", {})
    known = held.pop(key, None)
    if known is None or known[0] != version:
        # The old state goes before the new one is made.
        known = None
        while len(held) >= STATES:
            del held[next(iter(held))]
        known = (version, make())
    held[key] = known
    return known[1]


class Memo(dict):
    """Results of ``compute`` by key; at most ``most`` are held, and none of a key longer than ``longest``. When the newer
    half is full the older one goes; what is asked for again meanwhile moves to the newer one."""

    def __init__(self, compute: Callable, most: int, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of rows that agree in the whole-number columns ``keys``; the batches come sorted by them."""

    def whole(table: pa.Table, numbers: np.ndarray) -> Iterator[pa.Table]:
        edges = np.flatnonzero(np.append(True, (numbers[:, 1:] != numbers[:, :-1]).any(axis=0))).tolist() + [len(table)]
        for a, b in zip(edges[:-1], edges[1:]):
            yield table.slice(a, b - a)

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and all(rest[-1][k][-1] == batch[k][0] for k in keys) and all(batch[k][0] == batch[k][-1] for k in keys):
            rest.append(batch)
            continue
        table = pa.Table.from_batches([*rest, batch])
        numbers = np.stack([table[k].to_numpy() for k in keys])
        other = np.flatnonzero((numbers != numbers[:, -1:]).any(axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from whole(table.slice(0, cut), numbers[:, :cut])
        rest = table.slice(cut).to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


class Parts:
    """Union of row numbers; the least number of a part is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while True:
            above = self.up[at]
            if np.array_equal(above, at):
                return at
            at = above

    def join(self, rows: np.ndarray) -> None:
        roots = np.unique(self.roots(rows))
        self.up[roots] = roots[0]
