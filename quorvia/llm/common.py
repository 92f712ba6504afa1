"""Helpers shared by the text operators: cached chunk tables, Arrow mapping, shared storage."""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.session import checkpointed, shared_dir, table

__all__ = ["ChunkTable", "checkpointed", "free_name", "id_and_text", "id_ddl", "map_arrow", "mix64", "partitions_for", "passthrough", "quiet_gc", "shared_dir", "table", "texts_of"]

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class ChunkTable(dict):
    """Dictionary that computes a missing entry and keeps two generations of entries.

    Real text repeats its words, so a hit costs one C-level lookup. When the young generation is
    full it becomes the old one, from which entries still in use come back without being computed
    again. Chunks of more than ``longest`` letters, which seldom come again, are computed each time; so
    both the number and the size of the entries are bounded, whatever the corpus holds. Keys that are
    numbers have ``longest`` 0.
    """

    def __init__(self, make: Callable, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, vectorised; the argument is left as it is."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def quiet_gc() -> None:
    """In a worker: look for reference cycles rarely, as large tables make each look slow."""
    gc.set_threshold(200_000, 100, 1000)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch that yields batches; nothing outlives a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under fixed names: other columns may be called anything."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_ddl(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def partitions_for(spark: SparkSession, size: float, target: int = 64 << 20) -> int:
    """Shuffle partitions for so many bytes: the session's number, or more, of ``target`` bytes each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / target))


def passthrough(batch: pa.RecordBatch, keep: list[bool] | np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(np.asarray(keep, dtype=bool)))
