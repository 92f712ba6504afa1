"""Nearest neighbours: lists of coarse centres, exact distances within the lists that a query visits.

Vectors stand in lists of their nearest coarse centre; a query visits the lists nearest to it, as many
as hold ``PROBE_RECALL`` of the neighbours in the sample (few where the vectors form clusters, most where
they don't), and no fewer than hold ``LEAST_ROWS`` vectors: a table of no more is searched whole. Within
a visited list every vector is compared exactly, in double precision: a matrix product, on vectors less
the list's centre, finds who may be among the best, and these are measured by differences, as the score
is. So clusters that are narrow beside the whole, which codes of a few bits can't tell apart, cost no
recall.

A list is split into blocks of about ``BLOCK_ROWS`` vectors (fewer of long ones, for ``BLOCK_BYTES``) and
its queries into blocks of about ``QUERY_ROWS``; a task compares one block with one, so its memory is
bounded by these whatever the table, the list and the number of queries are, and ``k`` rows a query leave
it. Centres are fitted on at most ``SAMPLE`` vectors; every vector is indexed.

``Index`` also has the codes of anisotropic product quantisation (two components at a time to one of
sixteen codewords, where the part of the residual that is parallel to the vector costs ``eta`` times the
rest) and their table scan. ``nearest`` doesn't use them: a product in double precision takes less time
than the look-ups here, and loses nothing.

Edge cases: null and zero vectors, and those with a null or non-finite component, take no part, nor
do vectors of another length than most have (the shorter of equally frequent ones counts); rows with
the query's id are not its candidates; repeated rows of another id are candidates each; of a repeated
query id the least vector asks; ties, copies under many ids among them, go to smaller ids; with fewer
candidates than asked for, all are returned; no vectors, no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.llm.common import checkpointed, map_arrow, quiet_gc

SAMPLE = 20_000
LIST_ROWS, MAX_LISTS = 4_000, 1_024
#: Share of the sample's neighbours that the visited lists must hold.
PROBE_RECALL, PROBE_QUERIES = 0.98, 256
LEAST_ROWS = 1 << 18
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 1 << 18, 1 << 13, 64 << 20
NEAREST = 10
ANGLE = 0.2  # threshold of the score-aware loss


def _dist2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _dist2(x, centres).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
    return centres


class Index:
    """Coarse centres and, if ``coded``, codewords."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11, coded: bool = True):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.dim, self.padded = d, d + d % 2
        self.centres = _kmeans(sample, max(1, min(lists, len(sample))), rng)
        if not coded:
            return
        self.eta = max(1.0, (d - 1) * ANGLE**2 / (1 - ANGLE**2))
        x = self._pad(sample)
        m = self.padded // 2
        words = min(16, len(x))
        self.books = np.zeros((m, 16, 2))
        for j in range(m):
            self.books[j, :words] = _kmeans(x[:, 2 * j : 2 * j + 2], words, rng, 6)
            self.books[j, words:] = self.books[j, 0]
        for _ in range(2):
            self._refit(x, self.encode(sample))

    def _pad(self, x: np.ndarray) -> np.ndarray:
        return x if self.padded == self.dim else np.concatenate([x, np.zeros((len(x), 1))], 1)

    def _units(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def encode(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, pairs), by coordinate descent on the score-aware loss."""
        x = self._pad(vectors)
        u, m = self._units(x), self.padded // 2
        codes = np.zeros((len(x), m), np.uint8)
        parallel = np.zeros((len(x), m))
        rows = np.arange(len(x))
        for sweep in range(sweeps + 1):
            total = parallel.sum(1)
            for j in range(m):
                r = x[:, None, 2 * j : 2 * j + 2] - self.books[j][None]
                p = (r * u[:, None, 2 * j : 2 * j + 2]).sum(2)
                cost = (r * r).sum(2)
                if sweep:
                    cost = cost + (self.eta - 1) * ((total - parallel[:, j])[:, None] + p) ** 2
                best = cost.argmin(1)
                codes[:, j] = best
                total = total - parallel[:, j] + p[rows, best] if sweep else total
                parallel[:, j] = p[rows, best]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Codewords that minimise the loss for given codes, one pair of components after another."""
        u, m = self._units(x), self.padded // 2
        part = lambda j: ((x[:, 2 * j : 2 * j + 2] - self.books[j][codes[:, j]]) * u[:, 2 * j : 2 * j + 2]).sum(1)
        total = sum(part(j) for j in range(m))
        for j in range(m):
            xs, us, rest = x[:, 2 * j : 2 * j + 2], u[:, 2 * j : 2 * j + 2], total - part(j)
            for w in range(16):
                at = codes[:, j] == w
                if not at.any():
                    continue
                ux = us[at]
                lhs = at.sum() * np.eye(2) + (self.eta - 1) * ux.T @ ux
                rhs = xs[at].sum(0) + (self.eta - 1) * (ux * (rest[at] + (ux * xs[at]).sum(1))[:, None]).sum(0)
                self.books[j, w] = np.linalg.solve(lhs, rhs)
            total = rest + part(j)

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        return _dist2(vectors, self.centres).argmin(1)

    def scan(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows) by four-bit table look-ups."""
        q = self._pad(queries)
        out = np.zeros((len(q), len(codes)), np.float32)
        for j in range(self.padded // 2):
            tables = (q[:, 2 * j : 2 * j + 2] @ self.books[j].T).astype(np.float32)
            out += tables[:, codes[:, j]]
        return out

    def lists_to_visit(self, sample: np.ndarray, k: int, recall: float) -> int:
        """How many of the nearest lists hold that share of the neighbours of some of the sample in it."""
        asking = sample[:PROBE_QUERIES]
        far = _dist2(asking, sample)
        far[np.arange(len(asking)), np.arange(len(asking))] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(_dist2(asking, self.centres), axis=1, kind="stable"), axis=1)
        found = np.sort(np.take_along_axis(place, self.lists_of(sample)[near], 1), axis=None)
        return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def packed_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpacked_codes(packed: np.ndarray, pairs: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :pairs]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v array<double>`` of the rows that take part, whatever their length."""
    v = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: int, far: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` rows nearest to one query, ties to smaller ids. ``far``: half the
    squared distances less a constant, each right to ``slack``."""
    far[ids == own] = np.inf
    n = min(len(far), k)
    edge = np.partition(far, n - 1)[n - 1]
    may = np.flatnonzero((far <= edge + 2 * slack) & (far < np.inf))
    if not len(may):
        return may, np.zeros(0)
    step = max(1, BLOCK_BYTES // (16 * len(q)))
    # running sums, as a loop over the components adds
    score = np.sqrt(np.concatenate([np.cumsum((x[may[i : i + step]] - q) ** 2, axis=1)[:, -1] for i in range(0, len(may), step)]))
    order = np.lexsort((ids[may], score))[:k]
    return may[order], score[order]


def nearest(
    rows: DataFrame, *, k: int = NEAREST, queries: str = "vec_id % 100 = 0", sample: int = SAMPLE, list_rows: int = LIST_ROWS, probe_recall: float = PROBE_RECALL, rerank: int = 0,
    least_rows: int = LEAST_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row that ``queries`` picks, the ``k`` nearest found.
    ``rerank`` has no effect since all that is visited is compared exactly."""
    spark = rows.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    valid = valid_vectors(rows, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    lengths = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, total = lengths["d"], lengths["count"]
    # vectors of floats travel as floats, which loses nothing
    stored_as = rows.schema[vector_col].dataType.simpleString()
    stored_as = stored_as if stored_as in ("array<float>", "array<double>") else "array<double>"
    valid = valid.where(F.size("v") == dim)
    picked = _matrix(valid.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(sample).select("v").toArrow().column("v"), dim)
    index = Index(picked, max(1, min(MAX_LISTS, total // list_rows)), coded=False)
    lists, visits = len(index.centres), index.lists_to_visit(picked, k, probe_recall)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * dim)))
    travels = pa.list_(pa.float32() if stored_as == "array<float>" else pa.float64())

    def listed(batch: pa.RecordBatch):
        quiet_gc()
        near = index.lists_of(_matrix(batch.column("v"), dim)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(near), batch.column("vec_id"), batch.column("v")], ["list", "vec_id", "v"])

    stored = checkpointed(map_arrow(valid.select("vec_id", F.col("v").cast(stored_as).alias("v")), listed, f"list int, vec_id bigint, v {stored_as}"))
    counts = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}  # a number for each list
    held = np.array([counts.get(i, 0) for i in range(lists)])
    least = max(k + 1, min(total, max(least_rows, 4 * list_rows)))

    def probes(batch: pa.RecordBatch):
        q = _matrix(batch.column("v"), dim)
        order = np.argsort(_dist2(q, index.centres), axis=1, kind="stable")
        for i in range(len(q)):
            enough = np.searchsorted(np.cumsum(held[order[i]]), least) + 1
            visit = order[i][: max(int(enough), visits)]
            visit = visit[held[visit] > 0]
            row = batch.slice(i, 1).take(pa.array([0] * len(visit), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(visit.astype(np.int32)), row.column("vec_id"), row.column("v").cast(travels)], ["list", "query_id", "q"])

    asking = valid.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = map_arrow(asking, probes, f"list int, query_id bigint, q {stored_as}")
    asked_of = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a number for each list
    if not asked_of:
        return spark.createDataFrame([], schema)
    number = lambda of, size: F.element_at(F.array(*(F.lit(max(1, -(-int(of.get(i, 0)) // size))) for i in range(lists))), F.col("list") + 1)
    cells = stored.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), number(counts, block_rows)).cast("int"))
    cells = cells.withColumn("asks", F.explode(F.sequence(F.lit(0), number(asked_of, query_rows) - 1)))
    asked = asked.withColumn("asks", F.pmod(F.xxhash64("query_id"), number(asked_of, query_rows)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), number(counts, block_rows) - 1)))

    def search(group: tuple, data: pa.Table, ask: pa.Table) -> pa.Table:
        quiet_gc()
        out: list[list[np.ndarray]] = [[], [], []]
        if data.num_rows and ask.num_rows:
            centre = index.centres[group[0].as_py()]
            ids, x = data.column("vec_id").combine_chunks().to_numpy(), _matrix(data.column("v"), dim)
            query_ids, q_all = ask.column("query_id").combine_chunks().to_numpy(), _matrix(ask.column("q"), dim)
            moved, asks = x - centre, q_all - centre
            half = 0.5 * (moved * moved).sum(1)
            longest = np.sqrt(2 * half.max())
            step = max(1, (1 << 22) // len(ids))
            for at in range(0, len(q_all), step):
                far = half[None, :] - asks[at : at + step] @ moved.T
                for i, row in enumerate(far, at):
                    # rounding: of the moved vectors, and of the sums of so many products
                    slack = 4e-16 * (dim + 8) * (longest + np.abs(asks[i]).sum() + np.abs(centre).sum()) ** 2
                    places, score = _best(q_all[i], x, ids, query_ids[i], row, slack, k)
                    for part, found in zip(out, (np.full(len(places), query_ids[i]), ids[places], score)):
                        part.append(found)
        join = lambda part, kind: np.concatenate(part).astype(kind) if part else np.zeros(0, kind)
        return pa.table({c: join(part, kind) for c, part, kind in zip(("query_id", "vec_id", "score"), out, (np.int64, np.int64, np.float64))})

    at = ("list", "block", "asks")
    found = cells.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
