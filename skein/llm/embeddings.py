"""Operator 3, near-duplicate vectors by NN-descent.

Two vectors are linked if their cosine, in double precision, is at least `threshold`. Equal directions are one node with
a weight from the start, so a very common vector costs one row.

    start     several times, nodes are sorted by the signs of random projections and compared in overlapping blocks of
              that order, which has no hot bucket however alike vectors are; each keeps its `LIST` nearest above
              `PROSPECT`. The number of orders grows with the number of nodes, since a pair is seldomer in one block.
    refine    neighbours of a node are compared with one another and with it, and lists merged, until few lists change.
    enlarge   a list that is full of links is saturated: there may be more. Saturated nodes and all that an edge above
              `PROSPECT` joins to them form groups. What links with a saturated node is within 2 * 0.95 ** 2 - 1 = 0.805
              of all that links with that node, so nodes at a group's border, which no full list names, are in it. A
              group is compared block by block, each pair of blocks a row of its own, which returns counts and links
              that span what is linked, not pairs. Work there follows the square of the group's size.
    audit     for a sample of all nodes, links are counted against all vectors, and recall is the mean over those that
              have links. While it is short, the start is repeated with other projections; where it still is after
              `ATTEMPTS`, all nodes are compared block by block as one group, which is exact.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of unlike
dimension do not link; a null identifier is returned without links; rows sharing an identifier count as vectors each;
directions are told apart by 128 bits; among equally near neighbours a list keeps any; an empty table gives no rows; extra
columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, small, sound_key, staged, table
from .components import components
from .neardup import block_pairs, spanning
from .sstable import load_arrays, save_arrays

THRESHOLD, PROSPECT = 0.95, 0.8
LIST, ORDERS, BITS, BLOCK = 16, 8, 48, 256
ROUNDS, AUDIT, RECALL, ATTEMPTS = 4, 2048, 0.995, 3
GROWTH, BASE = 0.2, 1 << 14
GROUP_BLOCK, LARGEST_BLOCK, SALTS = 512, 2048, 32


def units(embeddings: DataFrame) -> DataFrame:
    """vec_id, node and check (two hashes of the direction; null where nothing links), unit (packed doubles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, check, unit = [], [], []
            for vec_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.array([np.nan if c is None else c for c in x or []], np.float64)
                size = np.abs(v).max(initial=0)
                if vec_id is None or not len(v) or not np.isfinite(v).all() or size == 0:
                    for out in (node, check, unit):
                        out.append(None)
                    continue
                v = v / size  # so that the sum of squares neither overflows nor vanishes
                data = (v / np.sqrt(v @ v) + 0.0).tobytes()
                for out, h in zip((node, check), np.frombuffer(xxhash.xxh3_128_digest(data), "<i8").tolist(), strict=True):
                    out.append(h)
                unit.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(unit, pa.binary())], ["vec_id", "node", "check", "unit"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(work, "vec_id long, node long, check long, unit binary")


@lru_cache(maxsize=64)
def planes(dimension: int, order: int) -> np.ndarray:
    return np.random.default_rng(1000 + order).standard_normal((dimension, BITS))


def sorted_blocks(nodes: DataFrame, orders: range) -> DataFrame:
    """a, b, sim: each node's nearest in the blocks of each order."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for b in batches:
            unit = b.column(1).to_pylist()
            sizes = np.array([len(u) for u in unit])
            for order in orders:
                code = np.zeros(len(unit), np.int64)
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    code[own] = (np.frombuffer(b"".join([unit[k] for k in own]), np.float64).reshape(len(own), -1) @ planes(size // 8, order) > 0) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), order, np.int32)), pa.array(sizes.astype(np.int32)), pa.array(code), b.column(0), b.column(1)], ["order", "size", "code", "node", "unit"])

    keyed = nodes.select("node", "unit").mapInArrow(codes, "order int, size int, code long, node long, unit binary")
    keys = ["order", "size", "code", "node"]
    dealt = keyed.repartitionByRange(shuffle_width(nodes.sparkSession), *keys).sortWithinPartitions(*keys)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compared(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for size in {len(u) for _, u in rows}:
                own = [r for r in rows if len(r[1]) == size]
                node = np.array([r[0] for r in own])
                m = np.frombuffer(b"".join([r[1] for r in own]), np.float64).reshape(len(own), -1)
                sim = m @ m.T
                sim[node[:, None] == node[None, :]] = -1
                k = min(LIST, len(own))
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(sim, top, 1)
                i, j = np.nonzero(value >= PROSPECT)
                out.append((node[i], node[top[i, j]], value[i, j]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "sim"])

        for b in batches:
            held += zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            while len(held) >= BLOCK:
                yield compared(held[:BLOCK])
                del held[: BLOCK // 2]
        if held:
            yield compared(held)

    return dealt.mapInArrow(nearest, "a long, b long, sim double")


def measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, sim of the pairs that reach PROSPECT."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.float64) for k in (2, 3))
            starts = np.cumsum([0, *(len(u) // 8 for u in b.column(2).to_pylist())])[:-1]
            sim = np.add.reduceat(x * y, starts) if len(starts) else np.zeros(0)
            near = pa.array(sim >= PROSPECT)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], ["a", "b", "sim"]).filter(near)

    left = nodes.select(F.col("node").alias("a"), F.col("unit").alias("unit_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("unit").alias("unit_b"))
    joined = pairs.join(left, "a").join(right, "b").where(F.length("unit_a") == F.length("unit_b"))
    return joined.select("a", "b", "unit_a", "unit_b").mapInArrow(work, "a long, b long, sim double")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def unordered(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))


def lists(edges: DataFrame) -> DataFrame:
    """node, near: its LIST nearest. A node's rows are thinned by part before they meet, so hubs stay small."""
    best = lambda: F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False), 1, LIST)
    part = F.pmod(F.xxhash64("b"), F.lit(64))
    some = both_ways(edges).groupBy("a", part.alias("part")).agg(best().alias("near")).select("a", F.inline("near"))
    return some.groupBy("a").agg(best().alias("near")).select(F.col("a").alias("node"), "near")


def refined(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """NN-descent from the edges (a < b): local joins of every list until few pairs are new."""
    for _ in range(ROUNDS):
        near = lists(edges).select(F.concat(F.array("node"), F.transform("near", lambda x: x["b"])).alias("group"))
        pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        crossed = F.flatten(F.transform("group", lambda x, i: F.transform(F.slice("group", i + 2, LIST + 1), lambda y: pair(x, y))))
        pairs = near.select(F.inline(crossed)).distinct()  # at most about LIST ** 2 / 2 a node
        new = scratch(measured(pairs.join(edges, ["a", "b"], "left_anti"), nodes), "new")
        found = new.count()
        if not found:
            return edges
        before = edges.count()
        edges = scratch(edges.unionByName(new), "edges")
        if found < 0.002 * before:
            return edges
    return edges


def group_counts(grouped: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """node, other, links: weighted counts of links inside each group by pair of blocks, where other is null; else a link
    (node, other), enough of them to join what is linked. A block is written once, to a file in the shared folder, and a
    pair of blocks is one row. grouped: group, node, unit, weight."""
    folder = scratch.folder(grouped.sparkSession, "blocks")
    block = F.greatest(F.lit(GROUP_BLOCK), F.least(F.lit(LARGEST_BLOCK), F.count("*") / 16))
    sizes = grouped.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # spreads a large group's rows
    rows = grouped.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SALTS)).cast("int")).join(sizes, ["group", "salt"]).select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "unit", "weight")
    listed = F.sort_array(F.collect_list(F.struct(F.length("unit").alias("size"), "node", "weight", "unit")))  # of one block
    packed = rows.groupBy("group", "block").agg(listed.alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1):
            group, block, held = b.column(0)[0].as_py(), b.column(1)[0].as_py(), b.column(2)[0].values
            size, node, weight = (held.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            save_arrays(path := f"{folder}/{group}/{block}", [node, weight, size, np.frombuffer(b"".join(held.field(3).to_pylist()), "<f8")])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([path])], ["group", "block", "path"])

    blocks = scratch(packed.mapInArrow(pack, "group long, block int, path string"), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = "", None
        for p, q in (pair for b in batches for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            if last[0] != p:
                last = p, load_arrays(p, "qqqd")
            same, out, x, y = p == q, [], last[1], load_arrays(q, "qqqd")
            for size in np.intersect1d(x[2], y[2]):
                own = []
                for nodes, weights, sizes_, units_ in (x, y):
                    at, low = np.flatnonzero(sizes_ == size), int(sizes_[sizes_ < size].sum()) // 8  # sorted by size
                    own.append((nodes[at], weights[at], units_[low : low + len(at) * size // 8].reshape(len(at), -1)))
                (left, w, m), (right, v, n) = own
                hit = m @ n.T >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                else:
                    out.append((right, None, w @ hit))
                out.append((left, None, hit @ v))
                joined = np.array(spanning(hit, left, right), np.int64).reshape(-1, 2)
                out.append((joined[:, 0], joined[:, 1], np.zeros(len(joined), np.int64)))
            for node, other, links in out:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(node)), pa.nulls(len(node), pa.int64()) if other is None else pa.array(np.ascontiguousarray(other)), pa.array(links.astype(np.int64))], ["node", "other", "links"])

    return block_pairs(blocks).mapInArrow(compare, "node long, other long, links long")


def summed(compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links) and links (a, b) of what group_counts returned."""
    return compared.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links")), compared.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))


def counted(edges: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, n_links without copies of its own direction) for nodes with links, and the links (a, b)."""
    links = scratch(edges.where(F.col("sim") >= threshold).select("a", "b"), "close")
    full = lists(edges).where((F.size("near") == LIST) & (F.get("near", F.lit(LIST - 1))["sim"] >= threshold)).select("node")
    full = scratch(full, "full")
    near = edges.where(F.col("sim") >= 2 * threshold**2 - 1).select("a", "b")
    touched = near.join(full.select(F.col("node").alias("a")), "a", "left_semi").unionByName(near.join(full.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
    groups = components(touched).select("node", F.col("comp").alias("group"))
    dense, joined = summed(scratch(group_counts(nodes.join(groups, "node").select("group", "node", "unit", "weight"), threshold, scratch), "compared"))
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ways = ways.join(groups.select(F.col("node").alias("a"), F.col("group").alias("g")), "a", "left").join(groups.select(F.col("node").alias("b"), F.col("group").alias("h")), "b", "left").where("g IS NULL OR h IS NULL OR g <> h")
    sparse = ways.join(nodes.select(F.col("node").alias("b"), "weight"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("links"))
    return staged(dense.unionByName(sparse).groupBy("node").agg(F.sum("links").alias("links")), "counts"), links.unionByName(joined)


def audited(counts: DataFrame, nodes: DataFrame, threshold: float) -> float:
    """Mean share of its links that were found, over the nodes with links in a sample of all; the sample meets all vectors."""
    picked = nodes.select("node", "unit").orderBy(F.xxhash64("node", F.lit(1))).limit(AUDIT)
    sample = picked.join(counts, "node", "left").collect()  # at most AUDIT rows
    asked = [(size, [k for k, r in enumerate(sample) if len(r["unit"]) == size]) for size in {len(r["unit"]) for r in sample}]
    asked = [(size, np.array(at), np.array([sample[k]["node"] for k in at]), np.frombuffer(b"".join([sample[k]["unit"] for k in at]), np.float64).reshape(len(at), -1)) for size, at in asked]
    if not asked:
        return 1.0

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(len(at) for _, at, _, _ in asked), np.int64)
        for b in small(batches, 1024):
            node, unit, weight = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            sizes = np.array([len(u) for u in unit])
            for size, at, self_, v in asked:
                own = np.flatnonzero(sizes == size)
                if len(own):
                    m = np.frombuffer(b"".join([unit[k] for k in own]), np.float64).reshape(len(own), -1)
                    total[at] += weight[own] @ ((m @ v.T >= threshold) & (node[own][:, None] != self_))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "links"])

    true = dict(nodes.select("node", "unit", "weight").mapInArrow(brute, "k long, links long").groupBy("k").agg(F.sum("links")).collect())
    shares = [min(r["links"] or 0, true[k]) / true[k] for k, r in enumerate(sample) if true[k]]
    return sum(shares) / len(shares) if shares else 1.0


def orders_for(n: int) -> int:
    """Orders of one attempt. Of pairs at 0.95 in 64 dimensions, one order finds about n ** -0.17 as many."""
    return int(np.ceil(ORDERS * max(1.0, n / BASE) ** GROWTH))


def near_vectors(embeddings: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id, kept."""
    scratch = Scratch()
    rows = staged(units(embeddings), "units")
    rows = rows.withColumn("node", sound_key(rows, "node", "check")).drop("check")
    nodes = staged(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("least")), "nodes")
    edges, width = None, orders_for(nodes.count())
    for attempt in range(ATTEMPTS):
        found = unordered(sorted_blocks(nodes, range(attempt * width, (attempt + 1) * width)))
        found = scratch(found if edges is None else unordered(edges.unionByName(found)), "edges")
        edges = refined(found, nodes, scratch)
        counts, links = counted(edges, nodes, threshold, scratch)
        if audited(counts, nodes, threshold) >= RECALL:
            break
    else:
        compared = scratch(group_counts(nodes.select(F.lit(0).cast("long").alias("group"), "node", "unit", "weight"), threshold, scratch), "compared")
        counts, links = summed(compared)
        counts = staged(counts, "counts")
    comp = components(links)
    scratch.clear()
    of_node = nodes.select("node", "least", "weight").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = of_node.groupBy("comp").agg(F.min("least").alias("component_id"))
    answer = of_node.join(smallest, "comp").join(counts, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    key = F.coalesce("node", F.xxhash64("vec_id"))  # spreads rows without a node
    out = rows.select("vec_id", "node", key.alias("_key")).join(answer.withColumnRenamed("node", "_key"), "_key", "left")
    linked = F.col("node").isNotNull()
    return out.select("vec_id", F.when(linked, F.col("links")).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
