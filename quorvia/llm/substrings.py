"""Removal of repeated passages by Rabin-Karp hashes of every window of words.

The corpus is cut into batches by ranges of the document id. A batch hashes all its windows once
(a rolling polynomial over 64-bit word hashes), sorts and dedups the hashes and sends them, packed
in about five and a half bytes each, to buckets by the leading bits of the hash. A bucket merges the
sorted lists of all batches and answers each batch with one bit a hash: whether an *earlier* batch
has it too. As ranges follow the order of the ids, that bit, with what the batch knows of its own
documents, tells for every window whether a document with a smaller id starts the same words; the
windows hit merge into maximal intervals of words to remove.

What travels is one packed list per batch and bucket, so a passage that a third of all documents
share costs a bucket one entry per batch, not one per document; the answers are bits. Nothing is
collected at the driver but the bounds of the ranges.

A window is judged by its 64-bit hash: among N windows about N*N/2^65 pairs of different ones share a
hash (0.0005 at 10^8 windows).

Edge cases: null texts have no words; texts shorter than a window lose nothing; rows with the same
``doc_id`` don't count as smaller than one another; a null id is larger than any other; each input
row gives a row; an empty table gives none; ids may be of any type with an order; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorvia.llm.common import ChunkTable, id_and_text, id_ddl, mix64, quiet_gc

WINDOW = 13
#: Text bytes that a batch holds in about.
BATCH_BYTES = 8 << 20
DRAWN = 32  # ids drawn for each cut, where ids aren't numbers
BASE = np.uint64(0x9FB21C651E98DF25)
LOW_BITS = 40
_MASK = np.uint64((1 << LOW_BITS) - 1)

_word_hash = ChunkTable(lambda w: xxhash.xxh3_64_digest(w), 100_000)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode("utf-8").split()


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """Hash of each run of ``window`` words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(_word_hash.__getitem__, words)), dtype=">u8").astype(np.uint64)
    out = h[:n].copy()
    for i in range(1, window):
        out *= BASE
        out += h[i : i + n]
    return mix64(out)


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Ascending distinct hashes: low 40 bits as they are, the rest as gaps in unary."""
    n = len(sorted_hashes)
    if not n:
        return b""
    low = (sorted_hashes & _MASK).view(np.uint8).reshape(n, 8)[:, : LOW_BITS // 8]
    high = (sorted_hashes >> np.uint64(LOW_BITS)).astype(np.int64)
    bits = np.zeros(int(high[-1] - high[0]) + n, np.uint8)
    bits[high - high[0] + np.arange(n)] = 1
    return n.to_bytes(8, "little") + int(high[0]).to_bytes(8, "little") + np.ascontiguousarray(low).tobytes() + np.packbits(bits).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    n, first = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    width = LOW_BITS // 8
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(blob, np.uint8, n * width, 16).reshape(n, width)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=16 + n * width)))[:n]
    return low.view("<u8").ravel().astype(np.uint64) | ((ones - np.arange(n) + first).astype(np.uint64) << np.uint64(LOW_BITS))


def _ordered(table: pa.Table) -> tuple[np.ndarray, list]:
    """Rank of each row's id (equal ids share one; null last), and the rows' texts."""
    ids = table.column("doc_id").to_pylist()
    rank = {v: i for i, v in enumerate(sorted({x for x in ids if x is not None}))}
    return np.array([rank[x] if x is not None else len(rank) for x in ids], np.int64), table.column("text").to_pylist()


def _hashes(texts: list, window: int) -> tuple[np.ndarray, list[int]]:
    parts = [window_hashes(words_of(t), window) for t in texts]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), [len(p) for p in parts]


def _bounds(rows: DataFrame, batch_bytes: int) -> list:
    """Ascending ids that begin the second and later batches; batches hold about as many rows."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // batch_bytes) or 1
    if parts == 1:
        return []
    kind = rows.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):  # other ids: cuts of the ids of smallest hash
        drawn = [r[0] for r in rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(DRAWN * parts).orderBy("doc_id").collect()]
        step = max(1, len(drawn) // parts)
        return sorted(set(drawn[step::step]))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted(set(cuts or []))


def _batched(rows: DataFrame, bounds: list) -> DataFrame:
    """With ``batch``: the number of bounds at or under the id, null ids in the last. A binary search
    in nested conditions, so its depth is the logarithm of the number of bounds."""

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return rows.select(search(0, len(bounds)).cast("int").alias("batch"), "doc_id", "text")


def removals(docs: DataFrame, *, window: int = WINDOW, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans[, kept]``: spans are the maximal word
    intervals [start, end) removed from a document, kept the words left, joined by a space."""
    rows, key = id_and_text(docs, id_col, text_col), id_ddl(docs, id_col)
    bounds = _bounds(rows, batch_bytes)
    buckets = len(bounds) + 1
    cut = _batched(rows, bounds)

    def gather(group: tuple, table: pa.Table) -> pa.Table:
        quiet_gc()
        h = np.unique(_hashes(table.column("text").to_pylist(), window)[0])
        edges = _cuts(h, buckets)
        blobs = [pack(h[s:e]) for s, e in zip(edges, edges[1:])]
        at = [i for i, b in enumerate(blobs) if b]
        return pa.table({"bucket": pa.array(at, pa.int32()), "batch": pa.array([group[0].as_py()] * len(at), pa.int32()), "hashes": pa.array([blobs[i] for i in at], pa.binary())})

    def answer(group: tuple, table: pa.Table) -> pa.Table:
        quiet_gc()
        order = sorted(range(table.num_rows), key=table.column("batch").to_pylist().__getitem__)
        lists = [unpack(table.column("hashes")[i].as_py()) for i in order]
        whole = np.concatenate(lists)
        sort = np.argsort(whole, kind="stable")  # equal hashes stay in the order of their batches
        later = np.zeros(len(whole), np.uint8)
        ranked = whole[sort]
        later[sort[1:]] = ranked[1:] == ranked[:-1]
        cuts = np.cumsum([0, *map(len, lists)])
        bits = [np.packbits(later[s:e]).tobytes() for s, e in zip(cuts, cuts[1:])]
        batches = [table.column("batch")[i].as_py() for i in order]
        return pa.table({"batch": pa.array(batches, pa.int32()), "bucket": pa.array([group[0].as_py()] * len(order), pa.int32()), "earlier": pa.array(bits, pa.binary())})

    def finish(group: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        quiet_gc()
        rank, texts = _ordered(table)
        h, counts = _hashes(texts, window)
        owner = np.repeat(rank, counts)
        sort = np.argsort(h, kind="stable")
        ranked = h[sort]
        head = np.ones(len(h), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(head)
        distinct = ranked[starts]
        earlier = np.zeros(len(distinct), bool)
        edges = _cuts(distinct, buckets)
        for b, bits in zip(*(answers.column(c).to_pylist() for c in ("bucket", "earlier"))) if answers.num_rows else ():
            s, e = edges[b], edges[b + 1]
            earlier[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s)
        if len(h):
            first = np.minimum.reduceat(owner[sort], starts)
            of = np.cumsum(head) - 1
            gone = np.empty(len(h), bool)
            gone[sort] = earlier[of] | (owner[sort] > first[of])
        else:
            gone = np.zeros(0, bool)
        out = {"doc_id": table.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "spans": [], "kept": []}
        at = 0
        for text, n in zip(texts, counts):
            words, hit = words_of(text), gone[at : at + n]
            at += n
            spans: list[tuple[int, int]] = []
            for i in np.flatnonzero(hit).tolist():
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + window)
                else:
                    spans.append((i, i + window))
            kept, last = [], 0
            for s, e in spans:
                kept += words[last:s]
                last = e
            left = b" ".join(kept + words[last:] if spans else words)
            out["n_words"].append(len(words))
            out["n_removed"].append(sum(e - s for s, e in spans))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["spans"].append([{"start": s, "end": e} for s, e in spans])
            out["kept"].append(left.decode() if with_text else None)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": spans_type, "kept": pa.string()}
        made = pa.table({k: v if k == "doc_id" else pa.array(v, types[k]) for k, v in out.items()})
        return made if with_text else made.drop_columns(["kept"])

    sent = cut.groupBy("batch").applyInArrow(gather, "bucket int, batch int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "batch int, bucket int, earlier binary")
    schema = f"doc_id {key}, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start: int, end: int>>" + ", kept string" * with_text
    return cut.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, schema)


def _cuts(ascending: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of the hashes, begins in an ascending array, and its length."""
    starts = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(ascending, starts), len(ascending))


def removal_digests(docs: DataFrame, **options) -> DataFrame:
    return removals(docs, with_text=False, **options).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (h) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
