"""Sparse text features and their training by follow-the-regularised-leader updates.

Shared by the quality classifier and the toxicity regression: a text becomes numbers of hashed
tokens, a white-space chunk at a time through a table, so that scoring is a gather and a sum.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import ChunkTable, map_arrow, mix64, quiet_gc

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Stands for a token that repeats its predecessor, whatever the token is.
REPEAT = np.uint64(0x5851F42D4C957F2D)


def _hashes(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode())


def chunk_tokens(chunk: str) -> bytes:
    """64-bit hashes of the words and runs of signs of a chunk."""
    return np.array([_hashes(t) for t in TOKENS.findall(chunk)], dtype="<u8").tobytes()


def chunk_stems(chunk: str) -> bytes:
    """As ``chunk_tokens``, and of the first four to six letters of each longer word."""
    out = []
    for t in TOKENS.findall(chunk):
        out.append(_hashes(t))
        out += [_hashes(f"{t[:n]}~") for n in (4, 5, 6) if len(t) > n]
    return np.array(out, dtype="<u8").tobytes()


@lru_cache(maxsize=4)
def chunk_table(make: Callable[[str], bytes]) -> ChunkTable:
    return ChunkTable(make, 300_000)


def token_hashes(text: str, make: Callable[[str], bytes] = chunk_tokens) -> np.ndarray:
    return np.frombuffer(b"".join(map(chunk_table(make).__getitem__, text.lower().split())), dtype="<u8")


def ngram_slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Slots of all words and word pairs of a text; equal neighbours count as one kind of pair."""
    pairs = mix64(tokens[:-1] ^ (tokens[1:] * np.uint64(0x9E3779B97F4A7C15)))
    pairs[tokens[:-1] == tokens[1:]] = REPEAT
    return (np.concatenate([mix64(tokens), pairs]) >> np.uint64(64 - bits)).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, fold: bool, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled documents, those of smallest hash of their id: the same at every
    run, and spread over the corpus. ``fold``: leave out the rows held out for testing. Repeated
    labels of a document: the largest. The ids are so few that they may be broadcast."""
    rows = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull())
    if fold:
        rows = rows.where(~held_out(F.col(id_col)))
    picked = rows.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(target).alias("grade")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(limit)
    return docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_label_id")).select("doc_id", "text", "grade")


def held_out(doc_id):
    """Whether a row belongs to the test fold; one without an id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(sample: DataFrame, slots_of: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The sample's sparse rows at the driver, in a fixed order: one for each id, the smallest, so that
    repeated rows of an id don't add to what the sample's limit allows."""

    def run(batch: pa.RecordBatch):
        quiet_gc()
        made = [slots_of(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.string()), pa.array([s.astype("<i4").tobytes() for s, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary()), batch.column("grade").cast(pa.int64())],
            ["doc_id", "slots", "values", "grade"],
        )

    made = map_arrow(sample, run, "doc_id string, slots binary, values binary, grade bigint")
    got = made.groupBy("doc_id").agg(F.min(F.struct("slots", "values", "grade")).alias("x")).select("doc_id", "x.*").toArrow()
    rows = zip(*(got.column(c).to_pylist() for c in ("doc_id", "slots", "values", "grade")))
    rows = sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest((r[0] or "").encode()), r[0] or "", r[1], r[3]))
    return [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4").astype(np.float64), g) for _, s, v, g in rows]


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown
