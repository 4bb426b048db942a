"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct 5-word shingles. Its signature holds 64
MinHash values of 16 bits. Two signatures that differ in at most T = 31 of the
64 places differ, by the pigeonhole principle, in at most one place in one of
the 16 chunks of four; each chunk therefore gives four index keys, each with one
place left out, and every pair within the distance shares a key. At the
smallest similarity that counts, 0.75, a place differs with probability 1/4, and
more than 31 of 64 differ once in about 10^5 such pairs.

Documents that share a key are neighbours in the index. They are clustered
around the neighbour they share most keys with, clusters are cut into blocks of
bounded size, and a block's members are compared with one another, then with
documents of other blocks that share a key with a member and have a signature
within the distance, unless they are connected already. Signatures choose the pairs; the sets of whole texts
confirm them. Only links that join two components leave a block, so a group of
n near copies yields about n rows and never n * n.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import MARKS, among, bitmap, digest_of, identified, released, without, written
from .components import components, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, PLACES, CHUNK = 5, 64, 4
#: The largest number of places in which signatures may differ: one error in each chunk, and one short of two.
DISTANCE = 2 * (PLACES // CHUNK) - 1
#: Members and shingles of a block at most, unless one member alone has more.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Documents of one key that are compared in one group; documents that ask in one copy of a block.
TILE, ASKERS = 2048, 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: K.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts, with repeats, bounds of each text's)."""
    n = len(offsets) - 1
    _, _, h, first = hasher.words(data, offsets)
    g, text, _ = K.grams(h, first, WORDS)
    count = np.diff(first)
    if len(short := np.flatnonzero((count > 0) & (count < WORDS))):
        whole = [K.mix((h[first[i] : first[i + 1]] * K._splitmix(int(count[i]), 2000 + int(count[i]))).sum(keepdims=True, dtype=np.uint64)) for i in short]
        g, text = np.concatenate([g, *whole]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        g, text = g[order], text[order]
    return g, np.searchsorted(text, np.arange(n + 1))


def fingerprint(unique: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(unique.tobytes()) - (1 << 63)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_shingles, node, sig): digest is of the text, node identifies the set (null for an empty one), sig is its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = K.Hasher("space", lower=True)
        flip, factor = K._splitmix(PLACES, 6), K._splitmix(PLACES, 5)
        for b in batches:
            data, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets):
                g, bounds = shingle_sets(data, offsets[lo : hi + 1], hasher)
                full = np.flatnonzero(np.diff(bounds))
                sig = np.zeros((len(full), PLACES), dtype=np.uint64)
                for k in range(PLACES if len(full) else 0):
                    sig[:, k] = np.minimum.reduceat((g ^ flip[k]) * factor[k], bounds[full])
                sig = (K.mix(sig) >> K.U64(48)).astype(np.uint16)
                n, node, sigs = np.zeros(hi - lo, dtype=np.int64), [None] * (hi - lo), [None] * (hi - lo)
                for j, i in enumerate(full):
                    u = np.unique(g[bounds[i] : bounds[i + 1]])
                    n[i], node[i], sigs[i] = len(u), fingerprint(u), sig[j].tobytes()
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(lo, hi - lo) for k in (0, 2)], pa.array(n), pa.array(node, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "digest", "n_shingles", "node", "sig"])

    return identified(docs).mapInArrow(run, "doc_id long, digest binary, n_shingles long, node long, sig binary")


def index_keys(nodes: DataFrame) -> DataFrame:
    """(key, left_out, node): for each chunk of a signature, the keys with one of its places left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = K.column(b.column(1))
            node = np.asarray(b.column(0))
            for lo in range(0, len(node), 2048):
                part = node[lo : lo + 2048]
                sig = np.frombuffer(data[offsets[lo] : offsets[lo + len(part)]].tobytes(), dtype=np.uint16).reshape(-1, PLACES).astype(np.uint64)
                keys = np.empty((len(part), PLACES), dtype=np.uint64)
                for k in range(PLACES):
                    v = np.full(len(part), k + 1, dtype=np.uint64)
                    for j in range(k // CHUNK * CHUNK, (k // CHUNK + 1) * CHUNK):
                        if j != k:
                            v = K.mix(v * K.U64(0x9E3779B97F4A7C15) + sig[:, j])
                    keys[:, k] = v
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(np.arange(PLACES, dtype=np.int32), len(part))), pa.array(np.repeat(part, PLACES))], ["key", "left_out", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, left_out int, node long")


class _Block:
    """The members of a block, and what joins them."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.sigs: list[np.ndarray] = []
        self.nodes: list[int] = []
        self.groups: list[int] = []
        self.root: dict[int, int] = {}
        self.ready = False

    def find(self, x: int) -> int:
        while (y := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(y, y)
            x = y
        return x

    def add(self, node: int, group: int, unique: np.ndarray, sig: np.ndarray) -> None:
        if node not in self.nodes[-1:]:
            self.nodes.append(node), self.groups.append(group), self.sets.append(unique), self.sigs.append(sig)

    def close(self) -> None:
        self.size = np.array([len(x) for x in self.sets])
        self.start = np.cumsum(self.size) - self.size
        self.words, inverse = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.at = inverse.ravel()
        self.mark = np.zeros(len(self.words) + 1, dtype=np.int32)
        self.sig = np.stack(self.sigs)
        self.group = np.array(self.groups, dtype=np.int64)
        self.ready = True

    def links(self, node: int, group: int, unique: np.ndarray, sig: np.ndarray, least: int, percent: int) -> Iterator[tuple[int, int]]:
        """Links of a document with members from the one numbered least on, one for each component that it joins."""
        own = self.find(group)
        if not self.ready:
            self.close()
        c = np.flatnonzero((self.group[least:] != own)) + least
        n = self.size[c]
        c = c[(100 * np.minimum(n, len(unique)) >= percent * np.maximum(n, len(unique)))]
        c = c[(self.sig[c] != sig).sum(axis=1) <= DISTANCE]
        if not len(c):
            return
        place = np.searchsorted(self.words, unique)
        place[self.words[np.minimum(place, len(self.words) - 1)] != unique] = len(self.words)
        self.mark[place] = 1
        self.mark[-1] = 0
        n = self.size[c]
        both = np.add.reduceat(self.mark[self.at[K.ragged(self.start[c], n)]], np.cumsum(n) - n)
        self.mark[place] = 0
        for i in c[100 * both >= percent * (n + len(unique) - both)]:
            if (other := self.find(int(self.group[i]))) != (own := self.find(group)):
                yield node, self.nodes[i]
                a, b = min(own, other), max(own, other)
                self.root[b] = a
                self.group[self.group == b] = a


def block_links(rows: DataFrame, within: bool, percent: int) -> DataFrame:
    """(u, v) from rows (block, asks, node, grp, sig, text), dealt and sorted by block; members (asks = false) come first.

    within: members ask one another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = K.Hasher("space", lower=True)
        block, number, found = _Block(), None, []

        def inner() -> Iterator[tuple[int, int]]:
            if within and len(block.nodes) > 1:
                for i, x in enumerate(block.nodes):
                    yield from block.links(x, block.groups[i], block.sets[i], block.sigs[i], i + 1, percent)

        for b in batches:
            data, offsets = K.column(b.column("text"))
            sig, at = K.column(b.column("sig"))
            names = [b.column(x).to_pylist() for x in ("block", "asks", "node", "grp")]
            for lo, hi in K.spans(offsets):
                g, bounds = shingle_sets(data, offsets[lo : hi + 1], hasher)
                for i in range(lo, hi):
                    where, asks, node, group = (x[i] for x in names)
                    if where != number:
                        found += inner()
                        block, number = _Block(), where
                    unique = np.unique(g[bounds[i - lo] : bounds[i - lo + 1]])
                    if fingerprint(unique) != node:  # another row with this doc_id
                        continue
                    own = sig[at[i] : at[i + 1]].view(np.uint16)
                    if not asks:
                        block.add(node, group, unique, own)
                    elif block.nodes:
                        found += block.links(node, group, unique, own, 0, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])
                found = []
        found += inner()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return rows.select("block", "asks", "node", "grp", "sig", "text").repartition("block").sortWithinPartitions("block", "asks", "node").mapInArrow(run, "u long, v long")


def neighbours(at: DataFrame) -> DataFrame:
    """(node, block): who has to ask in which later block, from rows (key, left_out, tile, tiles, first, parts, node, block, grp, sig).

    Signatures of documents that share a key and aren't connected are compared
    here, under the first of the keys that they share only. A key with many
    documents is cut into tiles, and tiles meet in pairs, each pair in a group
    of its own; the tiles of one component, numbered from first, don't meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(group: np.ndarray, tile: np.ndarray, cross: np.ndarray, left_out: np.ndarray, node: np.ndarray, block: np.ndarray, grp: np.ndarray, sig: np.ndarray) -> Iterator[np.ndarray]:
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.concatenate([first, [len(group)]]))
            for n in np.unique(size[size > 1]).tolist():
                starts = first[size == n]
                i, j = np.triu_indices(n, 1)
                step = max(1, (1 << 17) // len(i))
                for lo in range(0, len(starts), step):
                    for part in range(0, len(i), 1 << 17):
                        a = (starts[lo : lo + step, None] + i[part : part + (1 << 17)]).ravel()
                        b = (starts[lo : lo + step, None] + j[part : part + (1 << 17)]).ravel()
                        use = (grp[a] != grp[b]) & (block[a] != block[b]) & ((cross[a] == 0) | (tile[a] != tile[b]))
                        a, b = a[use], b[use]
                        same = sig[a] == sig[b]
                        near = (~same).sum(axis=1) <= DISTANCE
                        a, b, same = a[near], b[near], same[near].reshape(-1, PLACES // CHUNK, CHUNK)
                        if not len(a):
                            continue
                        alike = same.sum(axis=2)
                        chunk = (alike >= CHUNK - 1).argmax(axis=1)
                        pick = np.arange(len(a))
                        key = chunk * CHUNK + np.where(alike[pick, chunk] == CHUNK, 0, same[pick, chunk].argmin(axis=1))
                        own = key == left_out[a]
                        a, b = a[own], b[own]
                        a, b = np.where(block[a] < block[b], a, b), np.where(block[a] < block[b], b, a)
                        yield np.unique(np.stack([node[a], block[b]], axis=1), axis=0)

        def told(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if pairs:
                all_ = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(all_[:, 0]), pa.array(all_[:, 1])], ["node", "block"])

        rest = None
        for b in batches:
            raw, offsets = K.column(b.column(7))
            now = [np.asarray(b.column(k)) for k in range(7)] + [raw[offsets[0] : offsets[-1]].view(np.uint8).reshape(-1, 2 * PLACES).copy().view(np.uint16)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if now[0][0] <= now[0][-1] else len(now[0])
            if cut:
                yield from told(list(compared(*[x[:cut] for x in now])))
            rest = [x[cut:] for x in now]
        if rest is not None and len(rest[0]):
            yield from told(list(compared(*rest)))

    rows = at.withColumn("other", F.explode(F.expr("filter(sequence(0L, tiles - 1L), x -> x < first or x >= first + parts)")))
    group = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    rows = rows.select(group.alias("group"), "tile", (F.col("tile") != F.col("other")).cast("int").alias("cross"), "left_out", "node", "block", "grp", "sig")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "node long, block long")


def tiled(rows: DataFrame, several: DataFrame) -> DataFrame:
    """rows (key, node, grp, ...) of the keys in several (key, n) with tile, tiles, first, parts.

    A key of up to TILE documents is one tile. Beyond that a component with TILE
    of a key's documents or more has tiles of its own, parts of them from first
    on, and the rest share tiles in front of those.
    """
    large = rows.join(several.where(F.col("n") > TILE).select("key"), "key", "left_semi").groupBy("key", "grp").agg(F.count("*").alias("n"))
    own = large.withColumn("parts", F.floor(F.col("n") / TILE))
    shared = own.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("parts") == 0, F.col("n")).otherwise(0)) / TILE).alias("mixed"), F.sum("parts").alias("pure"))
    before = F.coalesce(F.sum("parts").over(W.partitionBy("key").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pure = own.where("parts > 0").select("key", "grp", "parts", before.alias("before"))
    out = rows.join(several.select("key"), "key").join(shared, "key", "left").join(pure, ["key", "grp"], "left")
    first = F.coalesce(F.col("mixed") + F.col("before"), F.lit(0))
    out = out.withColumn("tiles", F.coalesce(F.col("mixed") + F.col("pure"), F.lit(1))).withColumn("first", first).withColumn("parts", F.coalesce("parts", F.lit(0)))
    return out.withColumn("tile", F.when(F.col("parts") > 0, F.col("first") + F.expr("pmod(node, parts)")).otherwise(F.expr("pmod(node, coalesce(greatest(mixed, 1), 1))"))).drop("mixed", "pure", "before")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets (the signature distance is made for 75 or more).
    component_id is the least doc_id that links reach. Texts without words
    (null, empty) are linked with nothing. A row whose doc_id is null is
    compared like any other; if no row of its component has a doc_id,
    component_id is null, and such a row is kept. Rows that repeat a doc_id
    share its fate, each for its own text. An empty table gives an empty
    result. Columns of docs beyond those two are not looked at.
    """
    if not 75 <= percent <= 100:
        raise ValueError("the signature distance is made for similarities from 0.75 to 1")
    found = clusters(docs, percent)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def clusters(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of docs: doc_id, digest, n_shingles, node, component (the least node that links reach), least (doc_id of the component); written."""
    with released(docs.sparkSession):
        return written(_clusters(docs, percent), "components", kept=True)


def _clusters(docs: DataFrame, percent: int) -> DataFrame:
    own = written(signatures(docs), "signatures")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    nodes = own.where("node is not null").groupBy("node").agg(F.min(name).alias("name"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")).select("node", "name.doc_id", "name.digest", "sig", "n_shingles")
    keys = index_keys(nodes).repartition("key")  # dealt once, for the counts and for the join
    # the condition on left_out always holds; with it both sides of the join read the same columns, so that the keys are dealt once
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre"), F.min("left_out").alias("any")).where("n > 1 and any >= 0").select("key", "centre")
    members = written(keys.join(shared, "key"), "members")
    votes = members.groupBy("node", "centre").agg(F.count("*").alias("n"))
    cluster = votes.groupBy("node").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("cluster"))
    placed = cluster.join(nodes, "node")
    sizes = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    # only clusters of several blocks are looked up, in a table of known size, so that a large one's members aren't dealt by cluster
    placed = placed.join(written(sizes.where("parts > 1"), "sizes"), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = written(placed.withColumn("block", F.xxhash64("cluster", F.pmod("node", "parts"))).select("node", "doc_id", "digest", "sig", "block"), "placed")
    place = F.pmod(F.xxhash64("digest"), F.lit(MARKS))
    texts = among(identified(docs).withColumn("place", place), "place", bitmap(placed.select(place.alias("place")), MARKS))
    texts = texts.select(F.col("doc_id").alias("t_id"), "text", F.col("digest").alias("t_digest"))
    members_text = written(placed.join(texts, (placed.digest == texts.t_digest) & placed.doc_id.eqNullSafe(texts.t_id)).select("node", "block", "sig", "text"), "texts")

    asks = lambda yes: F.lit(yes).alias("asks")
    inner = block_links(members_text.select("block", asks(False), "node", F.col("node").alias("grp"), "sig", "text"), True, percent)
    inner = written(inner, "links")
    joined = components(inner)
    grouped = written(placed.select("node", "block").join(joined, "node", "left").select("node", "block", F.coalesce("component", "node").alias("grp")), "grouped")
    several = written(members.select("key", "node").join(grouped.select("node", "grp"), "node").groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"), "several")
    at = tiled(members.select("key", "left_out", "node").join(grouped, "node"), several).join(nodes.select("node", "sig"), "node")
    questions = written(neighbours(at.select("key", "left_out", "tile", "tiles", "first", "parts", "node", "block", "grp", "sig")).distinct().join(grouped.select("node", "grp"), "node"), "questions")
    # a block that many ask is copied, so that each copy has ASKERS at most, about
    copies = questions.groupBy("block").agg(F.ceil(F.count("*") / ASKERS).alias("copies"))
    copy_of = lambda number: F.xxhash64("block", number).alias("block")
    asking = questions.join(copies, "block").join(members_text.select("node", "sig", "text"), "node").select(copy_of(F.pmod("node", "copies")), asks(True), "node", "grp", "sig", "text")
    asked = copies.join(members_text.join(grouped.select("node", "grp"), "node"), "block").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1L)"))).select(copy_of("copy"), asks(False), "node", "grp", "sig", "text")
    outer = block_links(asked.union(asking), False, percent)
    all_links = written(inner.union(outer), "links")
    reached = components(all_links)
    named = nodes.select("node", "doc_id").join(reached, "node", "left")
    linked = named.where("component is not null")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_node = spread(linked, "node", least, "component").select(F.col("node").alias("set"), "component", "least")
    of_node = of_node.unionByName(named.where("component is null").select(F.col("node").alias("set"), F.col("node").alias("component"), F.col("doc_id").alias("least")))
    return own.drop("sig").join(of_node, own.node == of_node.set, "left").drop("set")


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, with their columns as they are, one of each group of near duplicates: that with the least doc_id (none counts as the greatest) and, of rows that repeat it, the least digest of the text.

    Rows are told apart by doc_id and text: distinct texts under one doc_id, or
    without one, are documents of their own, and of rows that repeat both any
    one stays. Texts without words (null, empty) are duplicates only of
    rows with the same doc_id and text. An empty table gives an empty result.
    """
    def named(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        others = others.toDF("_of_id", "_of_digest")
        return rows.join(others, rows["doc_id"].cast("long").eqNullSafe(others["_of_id"]) & digest_of().eqNullSafe(others["_of_digest"]), how)

    with released(docs.sparkSession):
        found = clusters(docs, percent)
        name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
        first = found.where("node is not null").groupBy("component").agg(F.min(name).alias("first"))
        gone = spread(found.where("node is not null"), "node", first, "component").where(~name.eqNullSafe(F.col("first"))).select("doc_id", "digest").distinct()
        again = found.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest")
        gone, again = written(gone, "gone", kept=True), written(again, "repeated", kept=True)
    left = without(docs, gone)
    if again.isEmpty():
        return left
    return without(left, again).unionByName(named(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))
