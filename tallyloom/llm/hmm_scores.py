"""Language-model scores from a hidden Markov model over word classes.

Frequent words are a class each; the others fall into classes by hash, and
within its class a word has its add-one share of the class's training count. The
chain emits classes. Its states are trained by Baum-Welch: each task runs
forward and backward over its training texts and returns expected counts, of a
size fixed by states and classes, which are added up over all tasks. The
likelihood of a text is exact, from the scaled forward recursion.

Word counts are those of the whole corpus. Texts are encoded once, a block at a
time, with the block's own numbering of words; the counts of a block's words are
joined to it by word, so that no task ever holds the whole vocabulary.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import MERGERS, added_up, released, typed, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATES, TOP, HASHED = 6, 1500, 250
#: Passes of Baum-Welch at most, each over all training texts, and the gain in log10 a token under which a pass was the last.
PASSES, SETTLED = 20, 1e-3
#: Longest run of tokens in training: a text beyond it is trained in runs that are worked on side by side; the state is carried over their borders.
RUN = 256
#: Bytes of text in a block.
BLOCK = 4 << 20
#: Words of a share, over all blocks.
WORDS_OF_SHARE = 1 << 20
CLASSES = TOP + HASHED + 1


def _learnt(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, lengths, words, counts, tokens): the texts of a block as numbers of its distinct words, which ascend; the ends aren't among the tokens. counts: of the words in training texts of the block, which is one Arrow batch at most. A block's number holds once it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = K.Hasher("space", lower=True), TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets, BLOCK):
                _, _, h, first = hasher.words(data, offsets[lo : hi + 1])
                words, tokens = np.unique(h, return_inverse=True)
                ids = b.column(0).slice(lo, hi - lo)
                learnt = np.array([_learnt(x) for x in ids.to_pylist()], dtype=bool)
                counts = np.bincount(tokens.ravel()[np.repeat(learnt, np.diff(first))], minlength=len(words))
                arrays = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids)]
                arrays += [pa.array([x.tobytes()], pa.binary()) for x in (np.diff(first), words, counts.astype(np.uint32), tokens.ravel().astype(np.uint32))]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "doc_ids", "lengths", "words", "counts", "tokens"])
                number += 1

    return typed(docs, ("doc_id", "long"), ("text", "string")).mapInArrow(run, "block long, doc_ids array<long>, lengths binary, words binary, counts binary, tokens binary")


def dealt(own: DataFrame, bits: int) -> DataFrame:
    """(share, block, words, counts): each block's words by the first bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = np.frombuffer(b.column(1)[i].as_buffer(), dtype=np.uint64)
                counts = np.frombuffer(b.column(2)[i].as_buffer(), dtype=np.uint32)
                share = (words >> K.U64(64 - bits)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]])) if len(share) else np.zeros(0, dtype=np.int64)
                ends = np.append(first[1:], len(words))
                cut = [(int(share[a]), words[a:z].tobytes(), counts[a:z].tobytes()) for a, z in zip(first, ends, strict=True)]
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int64()), pa.array([b.column(0)[i].as_py()] * len(cut), pa.int64()), *[pa.array([c[k] for c in cut], pa.binary()) for k in (1, 2)]], ["share", "block", "words", "counts"])

    return own.select("block", "words", "counts").mapInArrow(run, "share long, block long, words binary, counts binary")


def corpus_counts(shares: DataFrame) -> DataFrame:
    """Rows (share, block, counts) with the corpus counts of a block's words of one share, and rows (share, words, counts) with all words of a share that training texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], None

        def answer() -> pa.RecordBatch:
            words = np.concatenate([w for _, w, _ in held])
            distinct, back = np.unique(words, return_inverse=True)
            total = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(total, back.ravel(), np.concatenate([c for _, _, c in held]))
            ends = np.cumsum([len(w) for _, w, _ in held])
            each = [x.tobytes() for x in np.split(total[back.ravel()], ends[:-1])]
            seen = total > 0
            n = len(held) + 1
            return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array([x for x, _, _ in held] + [None], pa.int64()), pa.array([None] * len(held) + [distinct[seen].tobytes()], pa.binary()), pa.array([*each, total[seen].tobytes()], pa.binary())], ["share", "block", "words", "counts"])

        for b in batches:
            for share, block, words, counts in zip(*[b.column(k) for k in range(4)], strict=True):
                if (share := share.as_py()) != number:
                    if held:
                        yield answer()
                    held, number = [], share
                held.append((block.as_py(), np.frombuffer(words.as_buffer(), dtype=np.uint64), np.frombuffer(counts.as_buffer(), dtype=np.uint32)))
        if held:
            yield answer()

    return shares.repartition("share").sortWithinPartitions("share").mapInArrow(run, "share long, block long, words binary, counts binary")


@dataclass
class Vocabulary:
    """What the scores need of the corpus, besides a word's own count: of bounded size."""

    n: int
    v: int
    ends: int
    top: np.ndarray
    top_counts: np.ndarray
    tail_counts: np.ndarray
    tail_words: np.ndarray

    def classes(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.top, words), max(len(self.top) - 1, 0))
        is_top = self.top[at] == words if len(self.top) else np.zeros(len(words), dtype=bool)
        return np.where(is_top, at, TOP + (words % K.U64(HASHED)).astype(np.int64)).astype(np.uint16)

    def share(self) -> np.ndarray:
        """Shares of the classes in training, none of them 0."""
        counts = np.zeros(CLASSES)
        counts[: len(self.top)] = self.top_counts
        counts[TOP:-1] = self.tail_counts
        counts[-1] = self.ends
        return (counts + 1) / (counts + 1).sum()


def vocabulary(counted: DataFrame, ends: int) -> Vocabulary:
    """From corpus_counts. Each task reduces its words to its most frequent ones and sums by class; a few more tasks do the same to their results."""

    def best(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((words, -counts))[:TOP]
        return words[order], counts[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_counts, sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros((2, HASHED))
        for b in batches:
            for i in range(b.num_rows):
                words, counts = np.frombuffer(b.column(0)[i].as_buffer(), dtype=np.uint64), np.frombuffer(b.column(1)[i].as_buffer(), dtype=np.int64)
                tail = (words % K.U64(HASHED)).astype(np.int64)
                sums += [np.bincount(tail, weights=counts, minlength=HASHED), np.bincount(tail, minlength=HASHED)]
                top, top_counts = best(np.concatenate([top, words]), np.concatenate([top_counts, counts]))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (top, top_counts, sums)], ["top", "n", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_counts, sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros((2, HASHED))
        for b in batches:
            for a, n, s in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                top, top_counts = best(np.concatenate([top, np.frombuffer(a, dtype=np.uint64)]), np.concatenate([top_counts, np.frombuffer(n, dtype=np.int64)]))
                sums = sums + np.frombuffer(s, dtype=float).reshape(2, HASHED)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (top, top_counts, sums)], ["top", "n", "sums"])

    schema = "top binary, n binary, sums binary"
    rows = counted.where("words is not null").select("words", "counts").mapInArrow(run, schema).repartition(MERGERS).mapInArrow(merge, schema).collect()
    top, counts = best(np.concatenate([np.frombuffer(r["top"], dtype=np.uint64) for r in rows] + [np.zeros(0, dtype=np.uint64)]), np.concatenate([np.frombuffer(r["n"], dtype=np.int64) for r in rows] + [np.zeros(0, dtype=np.int64)]))
    sums = sum([np.frombuffer(r["sums"], dtype=float).reshape(2, HASHED) for r in rows], np.zeros((2, HASHED)))
    n, v = (int(x) for x in sums.sum(axis=1))
    tail = (top % K.U64(HASHED)).astype(np.int64)
    sums = sums - [np.bincount(tail, weights=counts, minlength=HASHED), np.bincount(tail, minlength=HASHED)]
    order = np.argsort(top)
    return Vocabulary(n + ends, v + bool(ends), ends, top[order], counts[order], *sums)


def coded(own: DataFrame, counted: DataFrame, known: Vocabulary) -> DataFrame:
    """(doc_ids, lengths, classes, known, base, inside): the texts of each block as classes, each text's end included, and for each text the tokens seen in training, the base score, and the log10 of its words' shares in their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = np.log10
        for b in batches:
            for i in range(b.num_rows):
                lengths, words, tokens = (np.frombuffer(b.column(k)[i].as_buffer(), dtype=t) for k, t in ((1, np.int64), (2, np.uint64), (3, np.uint32)))
                parts = sorted(b.column(4)[i].as_py() or [], key=lambda x: x["share"])
                count = np.frombuffer(b"".join(x["counts"] for x in parts), dtype=np.int64)
                of = known.classes(words)
                tail = of.astype(np.int64) - TOP
                hashed = tail >= 0
                tail = np.maximum(tail, 0)
                inside = np.where(hashed, log(count + 1) - log(known.tail_counts[tail] + known.tail_words[tail] + 1), 0.0)
                base, width = log(count + 1) - log(known.n + known.v + 1), lengths + 1
                ends = np.cumsum(width) - 1
                classes = np.full(int(width.sum()), CLASSES - 1, dtype=np.uint16)
                word_at = np.ones(len(classes), dtype=bool)
                word_at[ends] = False
                classes[word_at] = of[tokens]
                text = np.repeat(np.arange(len(lengths)), lengths)
                add = lambda x: np.bincount(text, weights=x[tokens], minlength=len(lengths))  # noqa: B023, E731
                end = float(log(known.ends + 1) - log(known.n + known.v + 1))
                n_known = add((count > 0).astype(float)).astype(np.int64) + bool(known.ends)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *[pa.array([x.tobytes()], pa.binary()) for x in (width, classes, n_known, add(base) + end, add(inside))]], ["doc_ids", "lengths", "classes", "known", "base", "inside"])

    counts = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("share", "counts")).alias("parts"))
    both = own.select("block", "doc_ids", "lengths", "words", "tokens").join(counts, "block", "left").select("doc_ids", "lengths", "words", "tokens", "parts")
    return both.mapInArrow(run, "doc_ids array<long>, lengths binary, classes binary, known binary, base binary, inside binary")


class Hmm:
    """start (S), move (S, S), emit (S, classes): probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, share: np.ndarray) -> Hmm:
        """Near the classes' shares in training, each state off by its own noise; states tend to last."""
        noise = np.random.default_rng(8).uniform(0.5, 1.5, (STATES, len(share)))
        emit = share * noise
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def from_counts(cls, total: np.ndarray, share: np.ndarray) -> Hmm:
        """Expected counts with a little of the shares added, so that no class is impossible in a state."""
        k, c = STATES, len(share)
        start, move, emit = total[:k] + 0.01, total[k : k + k * k].reshape(k, k) + 0.01, total[k + k * k : k + k * k + k * c].reshape(k, c) + 0.5 * share * np.sqrt(c)
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _padded(classes: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices (step, run) of runs of like length, and the numbers of the runs."""
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        to = at + max(1, min(4096, (1 << 19) // max(1, int(size[order[at]]))))
        pick = order[at:to]
        steps = np.arange(int(size[pick[0]]))[:, None]
        inside = steps < size[pick]
        yield np.where(inside, classes[np.minimum(start[pick] + steps, len(classes) - 1)], -1), pick
        at = to


def _transfer(model: Hmm, classes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(first state, last state, run): the probability of a run's tokens and its last state, given its first; scaled for each run."""
    k = STATES
    out = np.empty((k, k, len(size)))
    for x, pick in _padded(classes, start, size):
        live = (x >= 0).sum(axis=1)
        a = np.eye(k)[:, :, None] * model.emit[:, None, x[0]]  # last state, first state, run
        for t in range(1, len(x)):
            n = live[t]
            step = (model.move.T @ a[:, :, :n].reshape(k, -1)).reshape(k, k, n)
            step *= model.emit[:, None, x[t, :n]]
            if t % 8 == 0:
                step /= step.sum(axis=(0, 1))
            if n == a.shape[2]:
                a = step
            else:
                a[:, :, :n] = step
        out[:, :, pick] = (a / a.sum(axis=(0, 1))).transpose(1, 0, 2)
    return out


def _borders(model: Hmm, classes: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, run) twice: the shares of the states at the end of the run before, given the tokens up to there, and the weights of the states at the run's end, given the tokens after it. place: of the run in its text."""
    before, after = np.ones((STATES, len(size))), np.ones((STATES, len(size)))
    more = np.append(place[1:] > 0, False)
    long = np.flatnonzero(more | (place > 0))
    if len(long):
        m, p = _transfer(model, classes, start[long], size[long]), place[long]
        order = np.argsort(p, kind="stable")
        at = np.searchsorted(p[order], np.arange(int(p.max()) + 2))
        enter = np.repeat(model.start[:, None], len(long), axis=1)
        for j in range(1, len(at) - 1):
            r = order[at[j] : at[j + 1]]
            last = np.einsum("fr,ftr->tr", enter[:, r - 1], m[:, :, r - 1])
            last /= last.sum(axis=0)
            before[:, long[r]], enter[:, r] = last, model.move.T @ last
        for j in range(len(at) - 2, 0, -1):
            r = order[at[j] : at[j + 1]]
            w = model.move @ np.einsum("ftr,tr->fr", m[:, :, r], after[:, long[r]])
            after[:, long[r - 1]] = w / w.sum(axis=0)
    return before, after


def expected(model: Hmm, classes: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Baum-Welch counts of runs of classes, all of one token at least, then their log10 probability and their number of tokens. place: of each run in its text, whose runs follow one another; without it each run is a text."""
    k = STATES
    place = np.zeros(len(size), dtype=np.int64) if place is None else place
    before, after = _borders(model, classes, start, size, place)
    first, move, emit, fit = np.zeros(k), np.zeros((k, k)), np.zeros((k, model.emit.shape[1])), 0.0
    for x, pick in _padded(classes, start, size):
        steps, width = x.shape
        live = (x >= 0).sum(axis=1)
        b = np.take(model.emit, np.maximum(x, 0), axis=1)
        alpha, scale = np.zeros((k, steps, width)), np.ones((steps, width))
        opens = place[pick] == 0
        a = np.where(opens, model.start[:, None], model.move.T @ before[:, pick]) * b[:, 0]
        for t in range(steps):
            n = live[t]  # runs are sorted by length, so those still going come first
            if t:
                a = (model.move.T @ alpha[:, t - 1, :n]) * b[:, t, :n]
            s = a.sum(axis=0)
            scale[t, :n] = s
            alpha[:, t, :n] = a / s
        fit += float(np.log10(scale).sum())
        beta = after[:, pick]
        beta /= (alpha[:, size[pick] - 1, np.arange(width)] * beta).sum(axis=0)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            if t + 1 < steps and (m := live[t + 1]):
                next_ = beta[:, :m] * b[:, t + 1, :m] / scale[t + 1, :m]
                move += model.move * (alpha[:, t, :m] @ next_.T)
                beta[:, :m] = model.move @ next_
            if t == 0:
                next_ = (beta * b[:, 0] / scale[0])[:, ~opens]
                move += model.move * (before[:, pick[~opens]] @ next_.T)
            alpha[:, t, :n] *= beta[:, :n]
        first += alpha[:, 0, opens].sum(axis=1)
        flat = (x + 1).ravel()
        for s in range(k):
            emit[s] += np.bincount(flat, weights=alpha[s].ravel(), minlength=emit.shape[1] + 1)[1:]
    return np.concatenate([first, move.ravel(), emit.ravel(), [fit, size.sum()]])


def likelihood(model: Hmm, classes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log10 probability of each run, by the scaled forward recursion over all of it."""
    out = np.zeros(len(size))
    table = np.ascontiguousarray(model.emit.T)
    order = np.argsort(-size, kind="stable")
    begin, length = start[order], size[order]
    live = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right") if len(length) else []
    a, total, kept = None, np.zeros(len(size)), np.ones(len(size))
    for t, n in enumerate(live):
        b = table[classes[begin[:n] + t]]
        a = model.start * b if a is None else (a[:n] @ model.move) * b
        s = a.sum(axis=1)
        a /= s[:, None]
        kept[:n] *= s
        if t % 8 == 7:
            total[:n] += np.log10(kept[:n])
            kept[:n] = 1
    out[order] = total + np.log10(kept)
    return out


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, places in the text) of runs of RUN tokens at most of texts that lie one after the other, with their ends."""
    first = np.cumsum(lengths) - lengths
    n = -(-lengths // RUN)
    place = K.ragged(np.zeros(len(n), dtype=np.int64), n)
    start = np.repeat(first, n) + place * RUN
    return start, np.minimum(RUN, np.repeat(first + lengths, n) - start), place


def _training(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, starts, sizes, places) of the runs of a block's training texts."""
    width, classes = np.frombuffer(b.column(1)[i].as_buffer(), dtype=np.int64), np.frombuffer(b.column(2)[i].as_buffer(), dtype=np.uint16)
    learnt = np.array([_learnt(x) for x in b.column(0)[i].as_py()], dtype=bool)
    first = np.cumsum(width) - width
    classes = classes[K.ragged(first[learnt], width[learnt])].astype(np.int64)
    return classes, *_runs(width[learnt])


def fit(texts: DataFrame, share: np.ndarray, passes: int = PASSES, settled: float = SETTLED) -> Hmm:
    """A model trained on all training texts, until a pass has gained less than settled a token."""
    rows = texts.select("doc_ids", "lengths", "classes")

    model, before = Hmm.first(share), -np.inf
    for _ in range(passes):

        def expect(batches: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for i in range(b.num_rows):
                    classes, start, size, place = _training(b, i)
                    if len(size):
                        part = expected(model, classes, start, size, place)
                        total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        total = added_up(rows.mapInArrow(expect, "total binary"))
        if total is None:
            break
        model = Hmm.from_counts(total, share)
        now = total[-2] / total[-1]
        if now - before < settled:
            break
        before = now
    return model


def lm_scores(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty: one token, the end. Rows whose crc32(doc_id as
    text) mod 7 is 2 are held out; a null doc_id is held out, too. Rows that
    repeat a doc_id count and are scored each by itself; an empty table gives an
    empty result; further columns aren't looked at. Words of the same count are
    ranked by their hash. How rows are dealt to tasks matters no further than the
    order of sums does.
    """
    with released(docs.sparkSession):
        own = written(blocks(docs), "blocks")
        size = own.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] / 8
        bits = max(4, int(np.ceil(np.log2(size / WORDS_OF_SHARE + 1))))
        counted = written(corpus_counts(dealt(own, bits)), "counts")
        crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
        ends = own.select(F.explode("doc_ids").alias("doc_id")).where(crc != 2).count()
        known = vocabulary(counted, ends)
        texts = written(coded(own, counted, known), "classes", kept=True)
    model = fit(texts, known.share(), passes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                width, classes, n_known, base, inside = (np.frombuffer(b.column(k)[i].as_buffer(), dtype=t) for k, t in enumerate((np.int64, np.uint16, np.int64, float, float), 1))
                score = likelihood(model, classes, np.cumsum(width) - width, width) + inside
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(width), pa.array(n_known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", F.coalesce(crc == 2, F.lit(True)).alias("held_out"), "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), "base_score", "score")
