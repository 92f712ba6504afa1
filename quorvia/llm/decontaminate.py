"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of consecutive benchmark words. The search looks at the last two words (the
block) under the end of a window: a shift table says how far the window may move on without passing
an occurrence, and where the shift is nought a bucket of patterns with that suffix is compared word
by word. Words outside the benchmark's vocabulary share one number, so most of a text is skipped in
steps of seven words.

The benchmark's patterns travel with the tasks in parts of a bounded size (``block_bytes``). A benchmark
beyond it is searched part by part: only one part at a time is at the driver and in a task, its finds
are written down before the next begins, and the finds of a document are merged.

Edge cases: a null or empty text has no words, is reported with noughts and the digest of the empty
string; a benchmark row without words is never found; rows with the same ``item_id`` are one item;
a null ``item_id`` marks hits but is no item to count; each input row gives a row, repeated or not;
an empty benchmark leaves all clean; columns other than the ids and texts are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorvia.llm.common import checkpointed, free_name, id_and_text, id_ddl, map_arrow, quiet_gc, texts_of

WINDOW = 8
#: Most bytes of benchmark text that one pass takes to the tasks.
BLOCK_BYTES = 16 << 20

_KEEP = {*range(48, 58), *range(97, 123), *range(128, 256)}
#: Lower-cases A-Z and turns every other ASCII byte that is no word byte into a space.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32) for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split()


class WuManber:
    """Patterns of one length over word numbers; 0 is any word that no pattern has."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], frozenset[str]]):
        self.m, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[list[int], frozenset[str]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block - 1, length):
                key = words[end] if self.block == 1 else words[end - 1] << 32 | words[end]
                step = length - 1 - end
                if step < self.shift.get(key, self.default):
                    self.shift[key] = step
                if step == 0:
                    self.buckets.setdefault(key, []).append((list(words), items))

    def search(self, ids: list[int], hit: bytearray, found: set[str]) -> None:
        m, n, shift, default, single = self.m, len(ids), self.shift.get, self.default, self.block == 1
        at = m - 1
        while at < n:
            key = ids[at] if single else ids[at - 1] << 32 | ids[at]
            step = shift(key, default)
            if step:
                at += step
                continue
            start = at - m + 1
            under = ids[start : at + 1]
            for words, items in self.buckets[key]:
                if words == under:
                    hit[start : at + 1] = b"\1" * m
                    found |= items
                    break  # patterns are distinct
            at += 1


class Patterns:
    """All windows of some benchmark items, grouped by length."""

    def __init__(self, items: tuple[tuple[str | None, str], ...], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            length = min(window, len(ids))
            if not length:
                continue
            for i in range(len(ids) - length + 1):
                by_length.setdefault(length, {}).setdefault(ids[i : i + length], set()).update(() if item is None else (item,))
        self.searches = [WuManber(n, {w: frozenset(s) for w, s in p.items()}) for n, p in sorted(by_length.items())]

    def scan(self, text: str) -> tuple[bytearray, set[str]]:
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words_of(text)]
        hit, found = bytearray(len(ids)), set()
        for search in self.searches:
            search.search(ids, hit, found)
        return hit, found


@lru_cache(maxsize=1)
def _patterns(items: tuple, window: int) -> Patterns:
    return Patterns(items, window)


def _parts(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Callable[[int], tuple]]:
    """The number of parts of about ``block_bytes`` of the benchmark, and what fetches the (id, text)
    rows of one."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1

    def fetch(part: int) -> tuple:
        found = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        return tuple(sorted(((r.item, r.text) for r in found.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1])))

    return parts, fetch


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` of each document."""
    rows, key = id_and_text(docs, id_col, text_col), id_ddl(docs, id_col)
    parts, fetch = _parts(benchmark, item_col, item_text_col, block_bytes)
    names = ["doc_id", "n_words", "n_hit", "item_ids"]

    def scan(items, with_hits: bool):
        def run(batch: pa.RecordBatch):
            quiet_gc()
            p, n, hits, marks, found_in = _patterns(items, window), [], [], [], []
            for text in texts_of(batch):
                hit, found = p.scan(text)
                n.append(len(hit))
                hits.append(hit.count(1))
                marks.append(bytes(hit) if with_hits and 1 in hit else None)
                found_in.append(sorted(found))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(found_in, pa.list_(pa.string()))]
            if with_hits:
                columns += [batch.column("row"), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names + ["row", "marks"] * with_hits)

        return run

    schema = f"doc_id {key}, n_words bigint, n_hit bigint, item_ids array<string>"
    if parts == 1:
        out = map_arrow(rows, scan(fetch(0), False), schema)
    else:  # the parts of a document meet again by its id and text; equal rows count as often as they stood
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
        rows = rows.withColumn("row", F.sha2(F.concat_ws("\0", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256))
        out = None
        for number in range(parts):
            part = map_arrow(rows, scan(fetch(number), True), schema + ", row string, marks binary")
            # of the later parts only the documents with finds are written
            part = checkpointed(part if number == 0 else part.where("marks is not null"))
            out = part if out is None else out.unionByName(part)
        size = "array_max(transform(marks, m -> length(m)))"
        out = (
            out.groupBy("row")
            .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("marks").alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
            .withColumn("n_hit", F.expr(f"if(size(marks) = 0, 0L, cast(size(filter(sequence(1, {size}), i -> exists(marks, m -> substring(m, i, 1) = X'01'))) as bigint))"))
            .join(rows.select("row", "copies"), "row")
            .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
            .select(*names)
        )
    return out.withColumn("n_items", F.size("item_ids").cast("bigint")).withColumn("contaminated", F.col("n_items") >= min_items)


def contamination_digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The report with the ids found as one digest."""
    found = contamination(docs, benchmark, **options)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = 1, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but those whose text has windows of ``min_items`` items or more:
    by default, any window at all (of an item without an id as well)."""
    parts, fetch = _parts(benchmark, item_col, item_text_col, block_bytes)
    so_far = free_name(docs, "items_found")
    names = docs.columns

    def scan(items: tuple, first: bool, last: bool):
        def run(batch: pa.RecordBatch):
            quiet_gc()
            p, texts = _patterns(items, window), texts_of(batch, text_col)
            before = [[] for _ in texts] if first else batch.column(so_far).to_pylist()
            found = []
            for text, have in zip(texts, before):
                hit, items_in = p.scan(text)
                # a window of an item without an id counts as one unknown item
                found.append(sorted(items_in.union(have)) or ([""] if 1 in hit else []))
            stays = pa.array([len(f) < min_items for f in found])
            if not last:
                batch = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.string()))], [*names, so_far])
            elif not first:
                batch = batch.select(names)
            yield batch.filter(stays)

        return run

    out = docs
    for number in range(parts):
        last = number == parts - 1
        schema = docs.schema if last else T.StructType([*docs.schema.fields, T.StructField(so_far, T.ArrayType(T.StringType()))])
        out = map_arrow(out, scan(fetch(number), number == 0, last), schema)
        if not last:
            out = checkpointed(out)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(8, len(w)) AS m, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, dw.m AS m, item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
