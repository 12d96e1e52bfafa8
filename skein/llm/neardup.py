"""Operator 7, near-duplicate documents by BagMinHash.

A text is the multiset of its five-word shingles (words are runs of letters, digits and underscores, lower-cased; a
text of fewer than five words is one shingle). Two texts are linked if sum(min) / sum(max) over the multisets is at
least `threshold`; classes are the components of links.

Signatures. Every shingle has, for each dyadic interval of weights [0,1), [1,2), [2,4), ..., a Poisson process of
points (time, weight, register), the same for all texts. A text whose shingle weighs w sees the points below w: whole
intervals, and the last one thinned to its part. Each register keeps its earliest point, so two texts agree in a
register with the probability of their weighted Jaccard similarity. Processes unfold in time up to a horizon at which
nearly every text has all registers filled; the few others go on with a longer one.

Candidates. Texts that are equal word by word are one node from the start. Bands of `ROWS` registers name buckets, and each
has a centre, first by one of `CENTRES` orders of nodes, so that buckets which a large group fills in many bands mostly
share them. A node is first checked against two of its buckets' centres, which joins large groups by two pairs a node, and
twice against two more of those it is not joined with yet.
Where a bucket still holds several components, nodes are checked against its centre unless in one component with it; then
against a centre taken anew among those cut off. What is then left is compared across components: pair by pair in buckets
of at most `FEW` nodes; larger buckets that share nodes form a group, compared block by block of `GROUP_BLOCK` nodes as
products of matrices, each pair of blocks a row that returns only links enough to join what it found. So no link between
components is lost to the centres, and no group's pairs are ever rows. Every pair is verified on the texts' exact multisets.

Cases: null, empty and wordless texts link with nothing; a null identifier is returned as a class of its own and takes
part in none; rows sharing an identifier are each classed, and kept or removed, by their own text, which a hash of it
tells apart; nodes are told apart by 128 bits; ties between centres go to the smaller hash, which changes no class; a very
long text is one multiset, held by one task; an empty table gives no rows; extra columns are carried by `first_of_each`
whatever their names.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, carrying, small, sound_key, staged, table
from .components import components
from .sstable import load_arrays, save_arrays
from .tokens import forget

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
CENTRES = 4
FEW, GROUP_BLOCK, GROUP_CHARS = 32, 512, 4 << 20
REGISTERS = BANDS * ROWS
WORD = re.compile(r"\w+")
CACHED_WORDS = 500_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Floats in (0, 1) from 64-bit hashes."""
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


class Shingler:
    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(text.lower()) if text else []

    def hashes(self, rows: list[list[str]]) -> list[np.ndarray]:
        """Each row's shingle hashes, in order, with repeats."""
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in {w for row in rows for w in row if w not in known}:
            known[w] = xxhash.xxh3_64_intdigest(w)
        out = []
        with np.errstate(over="ignore"):
            for row in rows:
                w = np.fromiter(map(known.__getitem__, row), U, len(row))
                n = max(len(w) - SHINGLE + 1, min(1, len(w)))
                h = np.full(n, len(w) if len(w) < SHINGLE else 0, U)
                for k in range(min(SHINGLE, len(w))):
                    h = mix(h * U(0x9E3779B97F4A7C15) + w[k : k + n])
                out.append(h)
        return out


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """docs x registers: the identity of each register's earliest point; 0 for documents without shingles."""
    total = np.bincount(doc, weights=weight, minlength=docs)
    out, open_ = np.zeros((docs, registers), U), total > 0
    extra = 3.0
    # elements by dyadic interval of weights
    parts = []
    top, level = int(weight.max(initial=0)), 0
    while True:
        low = 0 if level == 0 else 1 << (level - 1)
        if low >= max(top, 1):
            break
        own = weight > low
        with np.errstate(over="ignore"):
            parts.append((doc[own], mix(shingle[own] + U((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)), np.full(own.sum(), max(low, 1)), np.minimum(weight[own] - low, max(low, 1))))
        level += 1
    if not parts:
        return out
    doc, seed, length, inside = (np.concatenate(c) for c in zip(*parts, strict=True))
    while open_.any():
        horizon = np.zeros(docs)
        horizon[open_] = (np.log(registers) + extra) / total[open_]
        live = np.flatnonzero(open_[doc])
        time, first = np.zeros(len(live)), np.full(docs * registers, np.inf)
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            with np.errstate(over="ignore"):
                h = mix(seed[live] + U((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(unit(h)) / (registers * length[live])
            go = time < horizon[doc[live]]
            live, time, h = live[go], time[go], h[go]
            more = mix(h ^ U(0xA0761D6478BD642F))
            register = ((more >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            seen = unit(mix(more)) * length[live] < inside[live]
            key = doc[live][seen] * registers + register[seen]
            np.minimum.at(first, key, time[seen])
            points.append((key, time[seen], h[seen]))
            step += 1
        flat = out.reshape(-1)
        full = np.isfinite(first.reshape(docs, registers)).all(1) & open_
        for key, at, h in points:
            win = (first[key] == at) & full[key // registers]
            flat[key[win]] = h[win] | U(1)
        open_ &= ~full
        extra *= 3
    return out


def bags(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, distinct shingle, weight) of all documents."""
    counted = [np.unique(h, return_counts=True) for h in hashes]
    doc = np.repeat(np.arange(len(hashes)), [len(v) for v, _ in counted])
    return doc, np.concatenate([v for v, _ in counted] or [np.zeros(0, U)]), np.concatenate([c for _, c in counted] or [np.zeros(0, np.int64)])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (distinct shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(a[1].sum() + b[1].sum() - both, 1))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest (hash of the text), node and check (two hashes of the words in order; null without words), bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler = Shingler()
        for b in small(batches, 128):
            rows = [shingler.words(t) for t in b.column(1).to_pylist()]
            sign = bag_minhash(*bags(shingler.hashes(rows)), len(rows)).reshape(len(rows), BANDS, ROWS)
            with np.errstate(over="ignore"):
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(rows), BANDS))
                for k in range(ROWS):
                    band = mix(band * U(0x9E3779B97F4A7C15) + sign[:, :, k])
            node = [np.frombuffer(xxhash.xxh3_128_digest(" ".join(w), seed=11), "<i8").tolist() if w else (None, None) for w in rows]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(rows) + 1, BANDS, dtype=np.int32)), pa.array(np.ascontiguousarray(band).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([n[k] for n in node], pa.int64()) for k in (0, 1)), lists], ["doc_id", "digest", "node", "check", "bands"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(work, "doc_id long, digest long, node long, check long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose texts reach the threshold. texts: node, text."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler, recent = Shingler(), OrderedDict()

        def bag(node: int, text: str):
            if node not in recent:
                recent[node] = np.unique(shingler.hashes([shingler.words(text)])[0], return_counts=True)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[node]

        for batch in small(batches, 128):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            hit = [similarity(bag(q, y[k]), bag(p, x[k])) >= threshold for k, (p, q) in enumerate(zip(a, b, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, h in zip(c, hit, strict=True) if h], pa.int64()) for c in (a, b)], ["a", "b"])

    return joined.mapInArrow(work, "a long, b long")


def spanning(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join everything that the hits join, one fewer than nodes at most. hit: left x right."""
    seen_left, seen_right, out = np.zeros(len(left), bool), np.zeros(len(right), bool), []
    for root in np.flatnonzero(hit.any(1)):
        if seen_left[root]:
            continue
        seen_left[root] = True
        front = np.array([root])
        while len(front):
            new = np.flatnonzero(hit[front].any(0) & ~seen_right)
            out += zip(left[front[hit[np.ix_(front, new)].argmax(0)]].tolist(), right[new].tolist(), strict=True)
            seen_right[new] = True
            back = np.flatnonzero(hit[:, new].any(1) & ~seen_left) if len(new) else new
            out += zip(left[back].tolist(), right[new[hit[np.ix_(back, new)].argmax(1)]].tolist(), strict=True) if len(back) else []
            seen_left[back] = True
            front = back
    return out


def block_overlaps(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """sum(min) of every pair of multisets, exactly: the k-th copy of a shingle is an element of its own."""

    def elements(bag: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for h in bag:
            h = np.sort(h)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            copy = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate([first, [len(h)]])))
            with np.errstate(over="ignore"):
                out.append(np.where(copy > 0, mix(h + copy.astype(U) * U(0xE7037ED1A0B428DB)), h))
        return np.repeat(np.arange(len(bag)), [len(e) for e in out]), np.concatenate(out)

    (i, a), (j, b) = elements(x), elements(y)
    both = np.intersect1d(a, b)
    total = np.zeros((len(x), len(y)), np.float32)
    at, bt = np.searchsorted(both, a), np.searchsorted(both, b)
    own_a = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == a) if len(both) else np.zeros(len(a), bool)
    own_b = (bt < len(both)) & (both[np.minimum(bt, len(both) - 1)] == b) if len(both) else np.zeros(len(b), bool)
    for low in range(0, len(both), columns):
        m, n = np.zeros((len(x), columns), np.float32), np.zeros((len(y), columns), np.float32)
        k = own_a & (at >= low) & (at < low + columns)
        m[i[k], at[k] - low] = 1
        k = own_b & (bt >= low) & (bt < low + columns)
        n[j[k], bt[k] - low] = 1
        total += m @ n.T
    return total


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Paths (x, y) of every pair of a group's blocks, a block with itself included, so that those of one x mostly follow one
    another in a task. blocks: group, block, path. What is joined are blocks, never members."""
    i, j = (blocks.select("group", F.col("block").alias(k), F.col("path").alias(p)) for k, p in (("i", "x"), ("j", "y")))
    pairs = i.join(j, "group").where("i <= j")
    return pairs.repartition("group", "i", F.pmod("j", F.lit(16))).sortWithinPartitions("group", "i", "j").select("x", "y")


def group_links(grouped: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what is linked inside each group, compared block by block; a pair of blocks is one row and
    returns fewer links than it has nodes. A block holds about `GROUP_BLOCK` texts, fewer where texts are long, and is
    written once, as its shingles' hashes, to a file in the shared folder. grouped: group, node; texts: node, text, chars."""
    folder = scratch.folder(grouped.sparkSession, "blocks")
    sizes = grouped.join(texts.select("node", "chars"), "node").groupBy("group").agg(F.ceil(F.greatest(F.count("*") / GROUP_BLOCK, F.sum("chars") / GROUP_CHARS)).cast("int").alias("blocks"))
    rows = grouped.join(sizes, "group").select("group", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        forget()
        shingler = Shingler()
        bags_ = [shingler.hashes([shingler.words(t)])[0] for t in part["text"]]  # one text's words at a time
        group, block = int(part["group"].iloc[0]), int(part["block"].iloc[0])
        save_arrays(path := f"{folder}/{group}/{block}", [part["node"].to_numpy(np.int64), np.array([len(h) for h in bags_], np.int64), np.concatenate(bags_)])
        return pd.DataFrame({"group": [group], "block": [block], "path": [path]})

    blocks = scratch(rows.join(texts.select("node", "text"), "node").groupBy("group", "block").applyInPandas(pack, "group long, block int, path string"), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = "", None
        bag = lambda sizes, hashes: np.split(hashes, np.cumsum(sizes)[:-1])
        for x, y in (pair for b in batches for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            if last[0] != x:
                last = x, load_arrays(x, "qqQ")
            (left, n, own), (right, m, other) = last[1], load_arrays(y, "qqQ")
            both = block_overlaps(bag(n, own), bag(m, other)).astype(np.float64)
            hit = both >= threshold * np.maximum(n[:, None] + m[None, :] - both, 1)
            hit &= left[:, None] != right[None, :]
            found = np.array(spanning(hit, left, right), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])

    return block_pairs(blocks).mapInArrow(compare, "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def two_centres(members: DataFrame, order: int) -> DataFrame:
    """Each node with two centres among those of its buckets, least by two orders. Buckets that a large group fills in many
    bands mostly share these, so that a node meets two centres of the group and not one a band. members: node, centre."""
    least = lambda k: F.min(F.struct(F.xxhash64("centre", F.lit(k)), "centre"))["centre"]
    two = members.groupBy("node").agg(F.array(least(order), least(order + 1)).alias("both"))
    return two.select(F.col("node").alias("a"), F.explode("both").alias("b")).where("a <> b")


def classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, digest, node, class_id (smallest doc_id of the class), kept (doc_id = class_id)."""
    bound_batches(docs.sparkSession)
    scratch = Scratch()
    sketched = staged(sketches(docs), "sketches")
    sketched = sketched.withColumn("node", sound_key(sketched, "node", "check")).drop("check")
    known = sketched.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    rows = known.select("node", F.explode("bands").alias("bucket")).distinct()
    turn = F.xxhash64("node", F.pmod("bucket", F.lit(CENTRES)))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(turn.alias("turn"), "node")).alias("centre")).where("n > 1").select("bucket", F.col("centre.node").alias("centre"))
    members = scratch(rows.join(crowded, "bucket"), "members")
    asked = members.select("node").distinct()
    one = known.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("one")).select(F.col("node").alias("own"), "one.*")
    texts = scratch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("digest")).join(one, ["doc_id", "digest"]).select(F.col("own").alias("node"), "text", F.length("text").alias("chars")).dropDuplicates(["node"]), "texts")
    pairs = scratch(ordered(two_centres(members, 1)), "pairs")
    links, tested, large = scratch(verified(pairs, texts, threshold), "found"), pairs, 0
    comp = components(links)
    for turn_no in ("two", "two more", "centre", "anew", "rest"):
        here = members.select("bucket", "node", "centre").join(comp, "node", "left").select("bucket", "node", "centre", F.coalesce("comp", "node").alias("comp"))
        split = here.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        cut = here.join(split, "bucket")
        if turn_no in ("two", "two more", "centre"):
            rest = cut.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
        elif turn_no == "anew":
            anew = cut.where("comp <> low").groupBy("bucket").agg(F.min(F.struct(turn.alias("turn"), "node", "comp")).alias("c")).select("bucket", F.col("c.node").alias("fresh"), F.col("c.comp").alias("own"))
            rest = cut.join(anew, "bucket").where("comp <> own").select(F.col("node").alias("a"), F.col("fresh").alias("b"))
        else:
            crowd = cut.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
            cut = scratch(cut.join(crowd, "bucket"), "cut")
            few = cut.where(F.col("n") <= FEW)
            rest = few.select("bucket", F.col("node").alias("a"), F.col("comp").alias("x")).join(few.select("bucket", F.col("node").alias("b"), F.col("comp").alias("y")), "bucket").where("x < y").select("a", "b")
            hubs = cut.where(F.col("n") > FEW).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
            if large := hubs.limit(1).count():
                groups = components(hubs).select(F.col("comp").alias("group"), "node")
                links = links.unionByName(scratch(group_links(groups, texts, threshold, scratch), "found"))
        if turn_no in ("two", "two more", "centre"):  # only pairs that no component joins yet
            both = rest.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b", "left")
            rest = both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
            if turn_no != "centre":
                rest = two_centres(rest.select(F.col("a").alias("node"), F.col("b").alias("centre")), 3 if turn_no == "two" else 5)
        pairs = scratch(ordered(rest).join(tested, ["a", "b"], "left_anti"), "pairs")
        if some := pairs.limit(1).count():
            links, tested = links.unionByName(scratch(verified(pairs, texts, threshold), "found")), tested.unionByName(pairs)
        if some or large:
            comp = components(links)
    scratch.clear()
    of_node = nodes.join(comp, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    smallest = of_node.groupBy("comp").agg(F.min("least").alias("class_id"))
    answer = of_node.join(smallest, "comp").select("node", "class_id")
    key = F.coalesce("node", F.xxhash64("doc_id"))  # spreads wordless rows, which match nothing
    out = sketched.select("doc_id", "digest", "node").withColumn("_key", key).join(answer.select(F.col("node").alias("_key"), F.col("class_id").alias("found")), "_key", "left")
    return out.select("doc_id", "digest", "node", F.when(F.col("node").isNotNull() & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id")).alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def first_of_each(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that `classes` does not keep. Repeated rows of a kept identifier and text stay."""

    def work(own: DataFrame) -> DataFrame:
        gone = classes(own, threshold=threshold).where("NOT kept").select("doc_id", F.col("digest").alias("_digest")).distinct()
        key = F.xxhash64(F.col("text").cast("string"))
        return own.withColumn("_digest", key).join(gone, ["doc_id", "_digest"], "left_anti").drop("_digest")

    return carrying(docs, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
