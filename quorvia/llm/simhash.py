"""Near-duplicate classes by SimHash and an LSH forest, verified on word shingles.

Two texts are near-duplicates if the cosine of their sets of five-word shingles, the similarity that a
SimHash stands for, is ``SIMILARITY`` or more (for sets of one size: a Jaccard index of 2/3 or more).

1. Every text becomes its set of hashed five-word shingles and a 256-bit SimHash of that set. Texts
   with the same words are one node from here on, so copies are never compared with each other.
2. The forest: in each tree the bits of the SimHash are permuted, and the nodes sorted by them. A node
   looks at its neighbours in the order, which share the longest prefixes, and climbs to shorter ones
   until the prefix has the length at which the trees together reach ``recall`` for a pair at the
   threshold. That length adapts to the density: where more than ``reach`` nodes share such a prefix,
   the region's nodes descend to a level of longer prefixes and as many more trees as the same recall
   then takes, and so on. A pair is either in no crowded region, and then met with the recall of its
   level, or both its nodes descend; so no level loses a pair.
3. Nodes still crowded at the last level (``MOST_TREES``) are joined on their rarest shingles, which
   misses nothing: in one order of all shingles, two sets at the threshold share one of the first
   ``size - ceil(similarity^2 * size) + 1`` of each. What a hot group has in common stands last there.
4. Pairs whose SimHashes are close enough are verified on the shingle sets themselves. First each node
   is tried with its nearest smaller neighbour only, and what is verified is contracted to components;
   then all candidate pairs between different components are. Big groups thus cost a link a node, not
   one a pair, and no candidate pair that could join two classes is left out.

Regions are counted before they move, so a task holds whole regions of at most ``reach`` nodes; crowded
ones move by ranges of their sorted bits, hot shingles in cells of at most ``2 * CELL`` rows or so, and
a hub's links are verified in salted streams against one set at a time. A group may be of any size.

Edge cases: null and empty texts have no words and are copies of each other; texts of fewer than five
words are one shingle; a document whose id is null belongs to no class and isn't returned (the filter
keeps it); rows with the same id and different texts are judged text by text, and ``classes`` gives the
id the smallest of its classes; ids may be of any type with an order; other columns, whatever their
names, are ignored, and the filter hands them on; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorvia.llm.common import ChunkTable, checkpointed, free_name, id_and_text, id_ddl, map_arrow, mix64, partitions_for, quiet_gc, texts_of
from quorvia.llm.graphs import components

SHINGLE, SIMILARITY = 5, 0.8
BITS, LANES = 256, 4
RECALL = 0.99
LEAF = 256  # nodes that share a shortest prefix, on the average
REACH = 4096  # nodes of a region beyond which they descend
STEP, MOST_TREES = 4, 400  # bits that a level adds; trees beyond which shingles decide
HUB = 256  # links verified in one stream
CELL = 4096  # rows of a hot shingle in a block
COUNTERS = 1 << 18  # of shingles, to tell rare ones
NODE_BYTES = 72  # of a row of the forest
_seeds = mix64(np.arange(1, LANES + 1, dtype=np.uint64) << np.uint64(32))
#: Each byte value with its bits spread over the eight bytes of a word, to be summed side by side.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()
_word_hash = ChunkTable(lambda w: xxhash.xxh3_64_digest(w.encode()), 100_000)


def agreement(similarity: float) -> float:
    """Share of equal SimHash bits to be expected between sets of this cosine."""
    return 1 - math.acos(similarity) / math.pi


def shingles(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``size`` words, ascending; of all words, if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(_word_hash.__getitem__, words)), ">u8").astype(np.uint64)
    n = max(1, len(h) - size + 1)
    out = h[:n].copy()
    for i in range(1, min(size, len(h))):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[i : i + n]
    return np.unique(mix64(out))


def simhash(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), LANES) words: bit i is set where most of the set's hashes have it."""
    out = np.zeros((len(sets), LANES), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    ends = np.cumsum(sizes[filled])
    whole = np.concatenate([sets[i] for i in filled])
    firsts = np.unique(np.concatenate([np.arange(s, e, 255) for s, e in zip(ends - sizes[filled], ends)]))
    block_of = np.searchsorted(firsts, ends - sizes[filled])
    need = sizes[filled][:, None]
    for lane in range(LANES):
        octets = mix64(whole ^ _seeds[lane]).view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(filled), 64), np.uint8)
        for b in range(8):
            sums = np.add.reduceat(_SPREAD[octets[:, b]], firsts).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(sums.astype(np.int64), block_of, axis=0)
            bits[:, 8 * b : 8 * b + 8] = 2 * counts > need
        out[filled, lane] = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").ravel()
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, raw``: a digest of the text as it is written, null as empty."""
    return id_and_text(docs, id_col, text_col).withColumn("raw", F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def signatures(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, raw, digest, s0..s3``: of every row of ``keyed`` with an id."""

    def run(batch: pa.RecordBatch):
        quiet_gc()
        texts = texts_of(batch)
        for at in range(0, len(texts), 200):  # the sums take room by shingles
            words = [t.lower().split() for t in texts[at : at + 200]]
            sig = simhash([shingles(w, shingle) for w in words]).view(np.int64)
            digests = [xxhash.xxh3_128_digest(" ".join(w).encode()) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, 200), batch.column("raw").slice(at, 200), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(sig[:, i])) for i in range(LANES))],
                ["doc_id", "raw", "digest", *LANE_NAMES],
            )

    return map_arrow(rows.where("doc_id is not null"), run, f"doc_id {id_ddl(rows, 'doc_id')}, raw string, digest binary, {LANES_DDL}")


LANE_NAMES = [f"s{i}" for i in range(LANES)]
LANES_DDL = ", ".join(f"{s} bigint" for s in LANE_NAMES)


def trees_for(depth: int, similarity: float, recall: float) -> int:
    """Trees in which a pair at the threshold must share ``depth`` bits once with that probability."""
    met = agreement(similarity) ** depth
    return 1 if met >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-met))


def first_depth(nodes: int) -> int:
    return max(0, min(48, math.ceil(math.log2(max(1, nodes) / LEAF))))


@lru_cache(maxsize=4)
def _orders(level: int, trees: int) -> np.ndarray:
    """The first 64 bits of each tree's permutation; every bit is among the leading ones of some."""
    rng = np.random.default_rng(20_240_229 + level)
    return np.stack([rng.permutation(BITS)[:64] for _ in range(trees)])


def _keys(batch: pa.RecordBatch, level: int, trees: int):
    """The leading 64 permuted bits of all nodes of a batch, tree by tree."""
    lanes = [batch.column(s).to_numpy().view(np.uint64) for s in LANE_NAMES]
    bits = np.unpackbits(np.stack(lanes, 1).astype(">u8").ravel().view(np.uint8).reshape(-1, LANES * 8), axis=1)
    for order in _orders(level, trees):
        yield np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").ravel().astype(np.uint64)


class Level:
    """One level of the forest over some nodes: its shortest prefix, trees and crowded regions."""

    def __init__(self, number: int, nodes: DataFrame, depth: int, similarity: float, recall: float, reach: int):
        self.number, self.depth, self.reach, self.trees = number, depth, reach, trees_for(depth, similarity, recall)
        trees = self.trees

        def count(batch: pa.RecordBatch):
            for tree, key in enumerate(_keys(batch, number, trees)):
                prefix, n = np.unique(key >> np.uint64(64 - depth) if depth else np.zeros_like(key), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), tree, np.int32)), pa.array(prefix.astype(np.int64)), pa.array(n)], ["tree", "prefix", "n"])

        counted = map_arrow(nodes.select(*LANE_NAMES), count, "tree int, prefix bigint, n bigint").groupBy("tree", "prefix").agg(F.sum("n").alias("n"))
        self.dense = checkpointed(counted.where(F.col("n") > reach).select("tree", "prefix"))
        self.any_dense = bool(self.dense.limit(1).count())
        self.last = False

    def forest(self, nodes: DataFrame) -> DataFrame:
        """``tree, prefix, sort, node, label, s0..s3``: a row for each node and tree."""
        number, trees, depth = self.number, self.trees, self.depth

        def run(batch: pa.RecordBatch):
            for tree, key in enumerate(_keys(batch, number, trees)):
                prefix = key >> np.uint64(64 - depth) if depth else np.zeros_like(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), tree, np.int32)), pa.array(prefix.astype(np.int64)), pa.array((key >> np.uint64(1)).astype(np.int64)), batch.column("node"), batch.column("label"), *(batch.column(s) for s in LANE_NAMES)],
                    ["tree", "prefix", "sort", "node", "label", *LANE_NAMES],
                )

        return map_arrow(nodes.select("node", "label", *LANE_NAMES), run, f"tree int, prefix bigint, sort bigint, node bigint, label bigint, {LANES_DDL}")

    def regions(self, nodes: DataFrame, rows: int) -> DataFrame:
        """The forest without crowded regions, whole regions in a task, sorted."""
        made = self.forest(nodes)
        if self.any_dense:
            made = made.join(self.dense, ["tree", "prefix"], "left_anti")
        parts = partitions_for(nodes.sparkSession, rows * self.trees * NODE_BYTES)
        return made.repartition(parts, "tree", "prefix").sortWithinPartitions("tree", "prefix", "sort", "node")

    def crowds(self, nodes: DataFrame, rows: int) -> DataFrame:
        """The crowded regions of the forest, in ranges of the sorted bits: a region may span tasks."""
        made = self.forest(nodes).join(self.dense, ["tree", "prefix"])
        parts = partitions_for(nodes.sparkSession, rows * self.trees * NODE_BYTES)
        return made.repartitionByRange(parts, "tree", "prefix", "sort", "node").sortWithinPartitions("tree", "prefix", "sort", "node").select("tree", "prefix", "sort", "node", "label", *LANE_NAMES)

    def crowded(self, nodes: DataFrame) -> DataFrame:
        """The nodes with a crowded region, as they are."""
        ids = self.forest(nodes.withColumn("label", F.col("node"))).join(self.dense, ["tree", "prefix"]).select("node").distinct()
        return nodes.join(ids, "node", "left_semi")


def levels(nodes: DataFrame, count: int, similarity: float, recall: float, reach: int) -> list[tuple[Level, DataFrame, int]]:
    """The forest's levels with their nodes and how many they are."""
    out, depth = [], first_depth(count)
    while True:
        at = Level(len(out), nodes, depth, similarity, recall, reach)
        out.append((at, nodes, count))
        if not at.any_dense:
            return out
        # so many bits more that the crowd's regions shrink to a leaf, were its bits independent
        depth = min(60, max(depth + STEP, first_depth(count)))
        if trees_for(depth, similarity, recall) > MOST_TREES:
            at.last = True
            return out
        nodes = checkpointed(at.crowded(nodes))
        count = nodes.count()


def _pairs(forest: DataFrame, near: int, reach: int, star: bool) -> DataFrame:
    """Candidate pairs (u < v) of different labels, at most ``near`` bits apart, among ``reach``
    followers in a region and with its first node. ``star``: of each node the nearest smaller one only,
    and the node itself (u null) if it has any candidate."""
    half = near // 2 + 8  # of half of the bits, a cheap first look

    def compare(x: dict, fresh: int):
        """Rows before ``fresh`` were compared among each other already."""
        n = len(x["node"])
        region = np.concatenate([[0], np.cumsum((x["tree"][1:] != x["tree"][:-1]) | (x["prefix"][1:] != x["prefix"][:-1]))])
        sig = np.stack([x[s].view(np.uint64) for s in LANE_NAMES], 1)
        front, back = np.ascontiguousarray(sig[:, :2]), np.ascontiguousarray(sig[:, 2:])
        lo, hi = [], []

        def test(i, j):
            apart = np.bitwise_count(front[i] ^ front[j]).sum(axis=1, dtype=np.int32)
            keep = (apart <= half) & (x["label"][i] != x["label"][j])
            if not keep.any():
                return
            i, j, apart = i[keep], j[keep], apart[keep]
            apart = apart + np.bitwise_count(back[i] ^ back[j]).sum(axis=1, dtype=np.int32)
            close = apart <= near
            if close.any():
                lo.append(np.stack([i[close], apart[close]]))
                hi.append(j[close])

        active = np.arange(n - 1)
        for off in range(1, reach + 1):
            active = active[active + off < n]
            active = active[region[active] == region[active + off]]
            if not len(active):
                break
            new = active[active + off >= fresh]
            test(new, new + off)
        else:
            first = np.searchsorted(region, region)
            far = np.flatnonzero(np.arange(n) - first > reach)
            test(first[far], far)
        if not hi:
            return
        i, apart, j = np.concatenate([p[0] for p in lo]), np.concatenate([p[1] for p in lo]), np.concatenate(hi)
        a, b = x["node"][i], x["node"][j]
        u, v = np.minimum(a, b), np.maximum(a, b)
        if star:
            order = np.lexsort((u, apart, v))
            u, v, apart = u[order], v[order], apart[order]
            best = np.concatenate([[True], v[1:] != v[:-1]])
            u, v, apart = u[best], v[best], apart[best]
            alone = np.setdiff1d(np.unique(np.concatenate([a, b])), v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, alone])), pa.array(np.concatenate([u, alone]), mask=np.concatenate([np.zeros(len(u), bool), np.ones(len(alone), bool)])), pa.array(np.concatenate([apart, np.full(len(alone), BITS)]).astype(np.int32))], ["v", "u", "apart"])
        else:
            got = np.unique(np.stack([v, u, apart], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy()), pa.array(got[:, 2].astype(np.int32))], ["v", "u", "apart"])

    def run(batches):
        quiet_gc()
        have: dict[str, np.ndarray] = {}
        fresh = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            have = {c: np.concatenate([have[c], new[c]]) for c in new} if have else new
            if len(have["node"]) < 8 * reach:
                continue
            yield from compare(have, fresh)
            # the last region may go on: its first row and as many rows as a climb reaches stay
            n = len(have["node"])
            same = (have["tree"] == have["tree"][-1]) & (have["prefix"] == have["prefix"][-1])
            first = int(np.argmax(same))
            keep = np.arange(max(first, n - reach), n)
            if keep[0] > first:
                keep = np.concatenate([[first], keep])
            have, fresh = {c: v[keep] for c, v in have.items()}, len(keep)
        if have and len(have["node"]) > fresh:
            yield from compare(have, fresh)

    return forest.mapInArrow(run, "v bigint, u bigint, apart int")


def _packed(values: np.ndarray) -> bytes:
    """The leading five bytes of each hash; two sets of a thousand differ by chance in 10^-6 of cases."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``node, items``: the shingle sets of the wanted nodes (node, doc_id, raw)."""

    def run(batch: pa.RecordBatch):
        quiet_gc()
        made = [_packed(shingles(t.lower().split(), shingle)) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], ["node", "items"])

    found = map_arrow(rows.join(wanted, ["doc_id", "raw"]).select("node", "text"), run, "node bigint, items binary")
    return found.groupBy("node").agg(F.min("items").alias("items"))  # a row may stand several times


def _rare_pairs(rows: DataFrame, near: int, similarity: float) -> DataFrame:
    """Pairs (u < v) of different labels that may be at that similarity: all that share one of their
    rarest shingles, of fitting sizes and at most ``near`` bits apart. ``rows``: node, label, items,
    s0..s3. The rows of a hot shingle stand in blocks, and meet in a cell for each two blocks."""

    def count(batches):
        quiet_gc()
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for items in batch.column("items").to_pylist():
                np.add.at(seen, _counter(np.unique(_unpacked(items))), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    often = np.zeros(COUNTERS, np.int64)
    for at, n in rows.select("items").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).toLocalIterator():
        often[at] = n
    columns = ["token", "cell", "block", "node", "label", "size", *LANE_NAMES]

    def rare(batch: pa.RecordBatch):
        quiet_gc()
        for row, items in enumerate(batch.column("items").to_pylist()):
            s = np.unique(_unpacked(items))
            n = often[_counter(s)]
            lead = np.lexsort((s, n))[: len(s) - math.ceil(similarity**2 * len(s) - 1e-9) + 1]
            lead = lead[n[lead] > 1]  # no other set has it
            blocks = -(-n[lead] // CELL)
            of = np.repeat(np.arange(len(lead)), blocks)
            other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            mine = (mix64(s[lead] ^ np.uint64(batch.column("node")[row].as_py())) % blocks.astype(np.uint64)).astype(np.int64)[of]
            cell = np.maximum(mine, other) << 32 | np.minimum(mine, other)
            same = [pa.array(np.repeat(batch.column(c)[row].as_py(), len(of)).astype(np.int64)) for c in ("node", "label")]
            lanes = [pa.array(np.repeat(batch.column(c)[row].as_py(), len(of)).astype(np.int64)) for c in LANE_NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(s[lead][of].view(np.int64)), pa.array(cell), pa.array(mine), *same, pa.array(np.full(len(of), len(s), np.int64)), *lanes], columns)

    def compare(x: dict):
        """All pairs of whole cells, each sorted by label; of two blocks only those across."""
        new = (x["token"][1:] != x["token"][:-1]) | (x["cell"][1:] != x["cell"][:-1])
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(x["token"])]])
        several = np.flatnonzero(x["label"][edges[:-1]] != x["label"][edges[1:] - 1])
        sig = np.stack([x[s].view(np.uint64) for s in LANE_NAMES], 1)
        us, vs, held = [], [], 0
        for begin, end in zip(edges[several].tolist(), edges[several + 1].tolist()):
            after = begin + np.searchsorted(x["label"][begin:end], x["label"][begin:end], side="right")
            across = x["cell"][begin] >> 32 != x["cell"][begin] & 0xFFFFFFFF
            for i, j in zip(range(begin, end), after.tolist()):
                if j == end:
                    break
                small, large = np.minimum(x["size"][i], x["size"][j:end]), np.maximum(x["size"][i], x["size"][j:end])
                fit = small >= similarity**2 * large - 1e-9
                if across:
                    fit &= x["block"][i] != x["block"][j:end]
                fits = j + np.flatnonzero(fit)
                fits = fits[np.bitwise_count(sig[i] ^ sig[fits]).sum(axis=1, dtype=np.int32) <= near]
                us.append(np.minimum(x["node"][i], x["node"][fits]))
                vs.append(np.maximum(x["node"][i], x["node"][fits]))
                held += len(fits)
                if held > 100_000:
                    yield np.concatenate(us), np.concatenate(vs)
                    us, vs, held = [], [], 0
        if held:
            yield np.concatenate(us), np.concatenate(vs)

    def run(batches):
        quiet_gc()
        parts: list[dict] = []  # rows of one cell, the last one's, may go on
        last = lambda p, i: (p["token"][i], p["cell"][i])
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            parts.append(new)
            if last(new, -1) == last(parts[0], -1):
                continue
            have = {c: np.concatenate([p[c] for p in parts]) for c in new}
            cut = int(np.argmax((have["token"] == have["token"][-1]) & (have["cell"] == have["cell"][-1])))
            yield from map(_pair_batch, compare({c: a[:cut] for c, a in have.items()}))
            parts = [{c: a[cut:] for c, a in have.items()}]
        if parts:
            yield from map(_pair_batch, compare({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}))

    made = map_arrow(rows.select("node", "label", "items", *LANE_NAMES), rare, f"token bigint, cell bigint, block bigint, node bigint, label bigint, size bigint, {LANES_DDL}")
    size = rows.agg(F.sum(F.octet_length("items"))).first()[0] or 0
    parts_of = partitions_for(rows.sparkSession, size * (1 - similarity**2) / 5 * 80)
    return made.repartition(parts_of, "token", "cell").sortWithinPartitions("token", "cell", "label", "node").mapInArrow(run, "u bigint, v bigint").distinct()


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (mix64(tokens) % np.uint64(COUNTERS)).astype(np.int64)


def _pair_batch(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of at least that cosine; a hub u meets its partners in streams."""
    degree = pairs.groupBy("u").agg(F.ceil(F.count("*") / HUB).alias("streams"))
    links = pairs.join(degree, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("streams")).alias("stream"))
    hubs = links.select("u", "stream").distinct().join(sets, F.col("u") == F.col("node")).select("u", "stream", F.lit(None).cast("bigint").alias("v"), "items")
    tips = links.join(sets, F.col("v") == F.col("node")).select("u", "stream", "v", "items")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hubs.unionByName(tips).repartition(parts, "u", "stream").sortWithinPartitions("u", "stream", F.col("v").asc_nulls_first())

    def run(batches):
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            out_u, out_v = [], []
            for u, v, items in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "items"))):
                if v is None:
                    hub = _unpacked(items)
                    continue
                tip = _unpacked(items)
                if min(len(tip), len(hub)) < similarity**2 * max(len(tip), len(hub)) - 1e-9:
                    continue
                both = len(tip) + len(hub) - len(np.union1d(hub, tip))
                if both >= similarity * math.sqrt(len(tip) * len(hub)) - 1e-9:
                    out_u.append(u)
                    out_v.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return rows.select("u", "v", "items").mapInArrow(run, "u bigint, v bigint")


def _judged(rows: DataFrame, similarity: float, shingle: int, recall: float, reach: int) -> DataFrame:
    """``doc_id, raw, class``: of every row of ``keyed`` with an id; class is a number of no meaning."""
    found = checkpointed(signatures(rows, shingle))
    nodes = found.groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("x"), *(F.first(s).alias(s) for s in LANE_NAMES))
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "x.doc_id", "x.raw", *LANE_NAMES))
    p = agreement(similarity)
    near = math.floor(BITS * (1 - p) + 4 * math.sqrt(BITS * p * (1 - p)))
    steps = levels(nodes.select("node", *LANE_NAMES), nodes.count(), similarity, recall, reach)

    def candidates(of: DataFrame | None, star: bool) -> DataFrame:
        """Over all levels; ``of``: the labels of the nodes that may have partners."""
        out = None
        for at, members, count in steps:
            members = members.withColumn("label", F.col("node")) if of is None else members.join(of, "node")
            made = _pairs(at.regions(members, count), near, reach, star)
            if at.last and star:  # what is so dense is contracted as far as neighbours tell
                made = made.unionByName(_pairs(at.crowds(members, count), near, HUB, star))
            out = made if out is None else out.unionByName(made)
        return out

    best = candidates(None, True).groupBy("v").agg(F.min(F.struct("apart", "u")).alias("x")).select(F.col("v").alias("node"), F.col("x.u").alias("u"))
    crowded = None
    if steps[-1][0].last:
        crowded = checkpointed(steps[-1][0].crowded(steps[-1][1]))
        best = best.join(crowded.select("node"), "node", "full_outer")
    best = checkpointed(best)
    sets = checkpointed(_sets(rows, nodes.select("node", "doc_id", "raw").join(best.select("node"), "node"), shingle))
    links = checkpointed(_verified(best.where("u is not null").select("u", F.col("node").alias("v")), sets, similarity))
    of = checkpointed(best.select("node").join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    cross = candidates(of, False).select("u", "v")
    if crowded is not None:
        cross = cross.union(_rare_pairs(crowded.join(of, "node").join(sets, "node"), near, similarity))
    more = checkpointed(_verified(cross.distinct(), sets, similarity))
    a, b = of.toDF("u", "lu"), of.toDF("v", "lv")
    joins = more.join(a, "u").join(b, "v").where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
    of = of.join(components(joins).toDF("label", "final"), "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    of = nodes.select("digest", "node").join(of, "node", "left").select("digest", F.coalesce("label", "node").alias("class"))
    return found.select("doc_id", "raw", "digest").join(of, "digest").select("doc_id", "raw", "class")


def classes(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id`` of every document: its class's smallest id, its own if it has no copies."""
    judged = checkpointed(_judged(keyed(docs, id_col, text_col), similarity, shingle, recall, reach))
    first = judged.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return judged.join(first, "class").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def keep_representatives(docs: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each class of texts one row, of the smallest id and text
    digest in it; of rows that repeat that id and text, the one of smallest hash. Rows without an id
    stay."""
    judged = _judged(keyed(docs, id_col, text_col), similarity, shingle, recall, reach)
    key, raw, nth = (free_name(docs, n) for n in ("key", "raw", "nth"))
    chosen = judged.groupBy("class").agg(F.min(F.struct("doc_id", "raw")).alias("x")).select(F.col("x.doc_id").alias(key), F.col("x.raw").alias(raw))
    rows = docs.where(F.col(id_col).isNotNull()).withColumns({key: F.col(id_col), raw: F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))})
    plain = [c for c, t in docs.dtypes if "map<" not in t]
    again = W.partitionBy(key, raw).orderBy(F.xxhash64(*plain))
    left = rows.join(chosen, [key, raw], "left_semi").withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1)
    return left.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
