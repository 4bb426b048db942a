"""Benchmark decontamination by a distributed positional inverted index.

A segment of the index holds some megabytes of text as its sorted terms and, for
each, the ascending positions at which it stands. Segments are stored as a
table, so an index that was built once answers for any benchmark.

A search takes the distinct windows of the benchmark, in blocks of bounded size,
to every segment: a window of which some term isn't there goes, the terms of
the others are put in order of their number of postings there, the list of the
rarest gives the places where the window might begin, and the list of each
further term, shifted by the term's offset, is intersected with those. With a
slack, a term may stand that many words from its place: a proximity match. Only
matches leave a segment. Neither the benchmark nor the corpus has a largest size:
a benchmark of several blocks is searched for in as many passes over the index.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import identified, released, without, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SLACK = 13, 1
#: Positions that are left free between documents, more than a window and its slack.
GAP = 64
#: Bytes of text in a segment.
SEGMENT_BYTES = 4 << 20
#: Windows of a block, about: 104 bytes each, which every task holds.
BLOCK = 1 << 16
SEGMENT = "segment long, doc_ids array<long>, digests array<binary>, starts binary, terms binary, counts binary, positions binary"
SPANS = "array<struct<start:long,length:long>>"


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of the documents in docs (doc_id, text); documents without words are in them as well. Their numbers hold once the index is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = K.Hasher("alnum", lower=True), TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets, SEGMENT_BYTES):
                _, _, h, first = hasher.words(data, offsets[lo : hi + 1])
                starts = first + GAP * (1 + np.arange(len(first)))
                position = (np.arange(len(h)) + GAP * (1 + K.text_of_words(first))).astype(np.uint32)
                order = np.argsort(h, kind="stable")
                h = h[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
                counts = np.diff(np.concatenate([new, [len(h)]])).astype(np.uint32)
                ids = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column(k).slice(lo, hi - lo)) for k in (0, 2)]
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (starts, h[new], counts, position[order])]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *ids, *blobs], ["segment", "doc_ids", "digests", "starts", "terms", "counts", "positions"])
                number += 1

    return identified(docs).mapInArrow(run, SEGMENT)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(terms, item): the windows of each item as packed hashes of their words; item is null where item_id is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = K.Hasher("alnum", lower=True)
        for b in batches:
            data, offsets = K.column(b.column(1))
            names = b.column(0).to_pylist()
            for lo, hi in K.spans(offsets, K.SLICE):
                _, _, h, first = hasher.words(data, offsets[lo : hi + 1])
                raw = h.tobytes()
                for i in range(hi - lo):
                    begin, end = int(first[i]), int(first[i + 1])
                    size = min(window, end - begin)
                    own = list({raw[8 * j : 8 * (j + size)] for j in range(begin, end - size + 1)}) if size else []
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([names[lo + i]] * len(own), pa.string())], ["terms", "item"])

    return benchmark.select(F.col("`item_id`").cast("long").cast("string").alias("item"), F.col("`text`").cast("string").alias("text")).mapInArrow(run, "terms binary, item string").distinct()


@dataclass
class Queries:
    """Distinct windows: terms of each (padded with -1), as numbers of vocabulary, and its length."""

    vocabulary: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, packed: list[bytes]) -> Queries:
        rows = [np.frombuffer(x, dtype=np.uint64) for x in packed]
        lengths = np.array([len(x) for x in rows], dtype=np.int64)
        vocabulary, at = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *rows]), return_inverse=True)
        terms = np.full((len(rows), int(lengths.max(initial=1))), -1, dtype=np.int64)
        terms[np.arange(terms.shape[1]) < lengths[:, None]] = at.ravel()
        return cls(vocabulary, terms, lengths)


def occurrences(q: Queries, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position, whether it is exact) for all matches in a segment."""
    none = np.zeros(0, dtype=np.int64)
    if not len(terms) or not len(q.vocabulary):
        return none, none, none.astype(bool)
    rank = np.minimum(np.searchsorted(terms, q.vocabulary), len(terms) - 1)
    n = np.where(terms[rank] == q.vocabulary, counts[rank], 0).astype(np.int64)
    used = q.terms >= 0
    number = np.where(used, n[q.terms], np.iinfo(np.int64).max)
    alive = np.flatnonzero((number > 0).all(axis=1))
    if not len(alive):
        return none, none, none.astype(bool)
    order = np.argsort(number[alive], axis=1, kind="stable")
    keys = (np.repeat(np.arange(len(terms), dtype=np.uint64), counts) << np.uint64(32)) | positions
    begin = np.cumsum(counts.astype(np.int64)) - counts
    rarest = q.terms[alive, order[:, 0]]
    size = n[rarest]
    window = np.repeat(np.arange(len(alive)), size)
    start = positions[K.ragged(begin[rank[rarest]], size)].astype(np.int64) - order[window, 0]
    if slack:
        shifts = np.arange(-slack, slack + 1)
        window, start = np.repeat(window, len(shifts)), (start[:, None] + shifts).ravel()
    exact = np.ones(len(window), dtype=bool)
    for r in range(q.terms.shape[1]):
        if not len(window):
            break
        offset = order[window, r]
        live = np.flatnonzero(offset < q.lengths[alive[window]])
        term = rank[q.terms[alive[window[live]], offset[live]]].astype(np.uint64) << np.uint64(32)
        place = start[live] + offset[live]
        at = np.searchsorted(keys, term | (place - slack).astype(np.uint64))
        value = keys[np.minimum(at, len(keys) - 1)]
        near = (at < len(keys)) & (value <= (term | (place + slack).astype(np.uint64)))
        if slack:
            at = np.searchsorted(keys, term | place.astype(np.uint64))
            exact[live] &= keys[np.minimum(at, len(keys) - 1)] == (term | place.astype(np.uint64))
        keep = np.ones(len(window), dtype=bool)
        keep[live] = near
        window, start, exact = window[keep], start[keep], exact[keep]
    return alive[window], start, exact


def hits(index: DataFrame, block: list[bytes], slack: int) -> DataFrame:
    """(segment, at, terms, exact) for each window and the number of a document in its segment that has it, and (segment, at, spans) with the words that exact matches of the block cover there: (start, length) from the first word, apart and in order."""
    sent = index.sparkSession.sparkContext.broadcast(block)  # a block of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = sent.value
        q = Queries.of(packed)
        for b in batches:
            for i in range(b.num_rows):
                starts, terms, counts, positions = (np.frombuffer(b.column(k)[i].as_buffer(), dtype=t) for k, t in ((1, np.int64), (2, np.uint64), (3, np.uint32), (4, np.uint32)))
                window, start, exact = occurrences(q, terms, counts, positions, slack)
                if not len(window):
                    continue
                # the place of a near match may lie before its document
                doc = np.where(exact, np.searchsorted(starts, start, "right"), np.searchsorted(starts, start + slack, "right")) - 1
                doc = np.minimum(doc, len(starts) - 2)
                pairs = np.unique(np.stack([doc, window, exact]), axis=1)
                n = pairs.shape[1]
                rows = [[int(x) for x in pairs[0]], [packed[w] for w in pairs[1]], pairs[2].astype(bool).tolist(), [None] * n]
                edge = np.zeros(int(starts[-1]) + q.terms.shape[1] + 1, dtype=np.int64)
                np.add.at(edge, start[exact], 1)
                np.add.at(edge, start[exact] + q.lengths[window[exact]], -1)
                inside = np.concatenate([[False], np.cumsum(edge) > 0])
                first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
                of = np.searchsorted(starts, first, "right") - 1
                for d in np.unique(of).tolist():
                    own = of == d
                    rows[0].append(d), rows[1].append(None), rows[2].append(None)
                    rows[3].append([{"start": s - int(starts[d]), "length": k} for s, k in zip(first[own].tolist(), (last[own] - first[own]).tolist(), strict=True)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(rows[0]), pa.int64()), *[pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.binary(), pa.bool_(), kind), strict=True)]], ["segment", "at", "terms", "exact", "spans"])

    return index.select("segment", "starts", "terms", "counts", "positions").mapInArrow(run, f"segment long, at long, terms binary, exact boolean, spans {SPANS}")


def documents(index: DataFrame) -> DataFrame:
    """(segment, at, doc_id, digest, n_words) of every document of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, digests, starts = b.column(1)[i].values, b.column(2)[i].values, np.frombuffer(b.column(3)[i].as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(ids), pa.int64()), pa.array(np.arange(len(ids))), ids, digests, pa.array(np.diff(starts) - GAP)], ["segment", "at", "doc_id", "digest", "n_words"])

    return index.select("segment", "doc_ids", "digests", "starts").mapInArrow(run, "segment long, at long, doc_id long, digest binary, n_words long")


def _covered(ordered: Column) -> Column:
    """How many words the spans, in order of their starts, cover."""

    def step(acc: Column, x: Column) -> Column:
        end = x.start + x.length
        return F.struct((acc.words + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["to"], x.start))).alias("words"), F.greatest(acc["to"], end).alias("to"))

    return F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("words"), F.lit(-1).cast("long").alias("to")), step, lambda acc: acc.words)


def search(index: DataFrame, benchmark: DataFrame, slack: int = SLACK, window: int = WINDOW) -> DataFrame:
    """Per document of a written index: doc_id, digest, n_words, n_hit, items and near_items (sorted as strings), spans (start and length in words of what exact matches cover; matches that different blocks of windows found may overlap)."""
    with released(index.sparkSession):
        named = written(windows(benchmark, window), "windows")
        distinct = written(named.select("terms").distinct(), "distinct-windows")
        blocks = max(1, -(-distinct.count() // BLOCK))
        parts = []
        for i in range(blocks):
            block = [bytes(r.terms) for r in distinct.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == i).collect()]
            parts.append(written(hits(index, block, slack), "hits"))
        found = reduce(DataFrame.unionByName, parts)
        cover = found.where("spans is not null").groupBy("segment", "at").agg(F.collect_list("spans").alias("lists"))
        cover = cover.select("segment", "at", F.array_sort(F.flatten("lists")).alias("spans")).withColumn("n_hit", _covered(F.col("spans")))
        of = found.where("terms is not null").join(named.where("item is not null"), "terms").select("segment", "at", "item", "exact").groupBy("segment", "at", "item").agg(F.bool_or("exact").alias("exact"))
        items = of.groupBy("segment", "at").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.array_sort(F.collect_list("item")).alias("near_items"))
        verdicts = written(cover.join(items, ["segment", "at"], "full"), "verdicts", kept=True)
    out = documents(index).join(verdicts, ["segment", "at"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, digest (of the text), n_words, n_hit, items, near_items, spans, contaminated.

    Texts are lower-cased (A-Z); words are digits, letters and whatever is
    beyond ASCII. A window is WINDOW consecutive words of an item, or all words
    of a shorter one; items without words have none. contaminated: a twentieth
    or more of the words are hit. Null has no words. Repeated rows are judged
    each by itself, as are rows with a null doc_id, and ties among items are
    all named; an item with a null item_id hits words but isn't named; empty
    tables hit nothing. Further columns aren't looked at.
    """
    found = search(written(build_index(docs), "positions"), benchmark, slack)
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns as they are, without those whose text is contaminated.

    Rows are told apart by doc_id and text, so that a clean text stays that has
    a contaminated one's doc_id, or none. Empty tables stay empty, and an empty
    benchmark removes nothing.
    """
    with released(docs.sparkSession):
        bad = contamination(docs, benchmark, slack=0).where("contaminated").select("doc_id", "digest").distinct()
        bad = written(bad, "contaminated", kept=True)
    return without(docs, bad)
