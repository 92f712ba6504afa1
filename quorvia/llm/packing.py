"""Packed token matrices: best-fit-decreasing bins found through a segment tree of capacities.

Texts become token ids (byte-level BPE, through a table of white-space chunks) with an end token. A
text longer than a row of the matrix is split into whole rows and a rest, so nothing is lost. Pieces
are placed longest first into the open row with the least room that suffices; the segment tree over
room sizes finds it in the logarithm of the row length.

A task packs what it reads in shards of about ``shard_tokens`` tokens, so no text moves between
machines and memory is bounded; a shard's rows depend on its own documents alone. Only the last row
or so of a shard has room to spare.

Result rows: ``shard`` and ``row``; ``input_ids``, the row of the matrix, padded, as little-endian
integers of ``width`` bytes; ``n_tokens``; ``cu_seqlens``, the cumulative segment lengths from 0;
``position_ids``, positions that start at 0 in each segment, of two or four bytes like the ids;
``segments``: document, place in its tokens, and length.

Edge cases: a null or empty text is the end token alone; ties in length go by document id, then place;
repeated rows are packed each; a null id is kept as null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quorvia.llm.common import ChunkTable, id_and_text, id_ddl, quiet_gc

LENGTH = 2048
SHARD_TOKENS = 4 << 20
#: White space that chunks can't be cut at as plainly as at single spaces and line ends.
_ODD = re.compile(r"[^\S \n]|\s\s|^\s|\s$|[\x01\x1c-\x1f\x85\xa0]")


class ByteVocabulary:
    """A tiktoken rank file, with the end token after its ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1
        self.width = 2 if self.end < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._chunks = ChunkTable(self._encode, 400_000)
        self._tail = np.array([self.end], self.kind).tobytes()

    def _encode(self, text: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(text), self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text and the end token."""
        if not text:
            raw = b""
        elif _ODD.search(text):
            raw = self._encode(text)
        else:  # a single space belongs to the word after it, a line end stands alone
            raw = b"".join(map(self._chunks.__getitem__, text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")))
        return np.frombuffer(raw + self._tail, self.kind)

    def decode(self, ids: np.ndarray) -> str:
        return self._encoding.decode([int(i) for i in ids if i != self.end])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class CapacityTree:
    """Which rooms 0..size are on offer: the smallest one that suffices, in logarithmic time."""

    def __init__(self, size: int):
        self.base = 1
        while self.base <= size:
            self.base *= 2
        self.offered = [0] * (2 * self.base)

    def change(self, room: int, by: int) -> None:
        at = room + self.base
        while at:
            self.offered[at] += by
            at //= 2

    def least(self, need: int) -> int:
        """The smallest room of at least ``need``, -1 if there is none."""
        at, offered = need + self.base, self.offered
        while not offered[at]:
            while at & 1:  # a right child: nothing further right under its parent
                at //= 2
                if at <= 1:
                    return -1
            at += 1
            if at == 1:
                return -1
        while at < self.base:
            at = 2 * at if offered[2 * at] else 2 * at + 1
        return at - self.base


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; the lengths come in descending order and none is over the capacity."""
    tree = CapacityTree(capacity)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        room = tree.least(n)
        if room < 0:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = open_bins[room].pop()
            tree.change(room, -1)
        bins[b].append(i)
        if room - n > 0:
            open_bins[room - n].append(b)
            tree.change(room - n, 1)
    return bins


def pack(docs: DataFrame, *, path: str | None = None, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of packed matrices; see the module. ``position_ids`` take four bytes each where the ids do,
    or where ``length`` is over 65,536."""
    path, key = path or default_path(), id_ddl(docs, id_col)
    key_type = pa.schema([("k", pa.int64())]).field("k").type if key == "bigint" else None
    names = ["shard", "row", "input_ids", "n_tokens", "cu_seqlens", "position_ids", "segments"]

    def run(batches):
        from pyspark import TaskContext

        quiet_gc()
        v = vocabulary(path)
        places = v.kind if length <= 1 << 16 else "<u4"
        part, shard, held = TaskContext.get().partitionId(), 0, 0
        pieces: list[tuple] = []  # length, id, place, ids
        kind = key_type

        def flush():
            nonlocal shard, held
            order = sorted(pieces, key=lambda p: (-p[0], p[1] is None, p[1] if p[1] is not None else 0, p[2]))
            bins = best_fit_decreasing([p[0] for p in order], length)
            for at in range(0, len(bins), 512):
                cols: list[list] = [[] for _ in names]
                for row, members in enumerate(bins[at : at + 512], at):
                    ids, pos = np.full(length, v.end, v.kind), np.zeros(length, places)
                    cuts, segs, used = [0], [], 0
                    for i in members:
                        n, doc, place, tokens = order[i]
                        ids[used : used + n] = tokens
                        pos[used : used + n] = np.arange(n)
                        used += n
                        cuts.append(used)
                        segs.append({"doc_id": doc, "start": place, "length": n})
                    for c, x in zip(cols, (f"{part}-{shard}", row, ids.tobytes(), used, cuts, pos.tobytes(), segs)):
                        c.append(x)
                seg_type = pa.list_(pa.struct([("doc_id", kind), ("start", pa.int32()), ("length", pa.int32())]))
                types = [pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), seg_type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
            pieces.clear()
            shard, held = shard + 1, 0

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = v.encode(text or "")
                for place in range(0, len(ids), length):
                    piece = ids[place : place + length]
                    pieces.append((len(piece), doc, place, piece))
                held += len(ids)
                if held >= shard_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    schema = f"shard string, row int, input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, segments array<struct<doc_id: {key}, start: int, length: int>>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet, a file for each shard's task."""
    packed.write.mode("overwrite").parquet(path)


def matrix(rows, width: int = 2) -> np.ndarray:
    """Collected rows as one (rows, length) array of ids."""
    return np.stack([np.frombuffer(r["input_ids"], f"<u{width}") for r in rows])
