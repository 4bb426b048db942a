"""Quality rules as a short-circuit cascade.

Each rule is an integer comparison of statistics of one text. What a rule costs
and how many documents it rejects is measured on a bounded sample; the rules
then run in descending order of rejections per second, and a document that one
of them rejects isn't looked at by the rest. The order decides about time only:
a document is kept if no rule rejects it, whatever the order.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import typed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents on which costs and selectivities are measured, about: each is drawn by the hash of its doc_id.
SAMPLE_ROWS = 2000
SYMBOLS = b"[#*$%&|<>]"


class Stats:
    """Statistics of a run of texts, each computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashers: dict[str, K.Hasher]):
        self.data, self.offsets, self.hashers = data, offsets, hashers
        self.base = int(offsets[0])
        self.part = data[self.base : int(offsets[-1])]
        self.have: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.have:
            self.have[name] = getattr(self, name)()
        return self.have[name]

    def of(self, which: np.ndarray) -> Stats:
        """The same for some of the texts. What has been computed is kept; their bytes are put together only if more is asked for."""
        return _Some(self, which) if len(which) < len(self.offsets) - 1 else self

    def count(self, flags: np.ndarray) -> np.ndarray:
        return K.per_text(flags, self.offsets, self.base)

    def words(self) -> tuple:
        return self.hashers["space"].words(self.data, self.offsets)

    def n_words(self) -> np.ndarray:
        return np.diff(self["words"][3])

    def word_chars(self) -> np.ndarray:
        return self.count(self.hashers["space"].word[self.part] & ((self.part & 0xC0) != 0x80))

    def n_symbols(self) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(SYMBOLS[1:-1])] = True
        return self.count(table[self.part])

    def n_upper(self) -> np.ndarray:
        return self.count((self.part >= 0x41) & (self.part <= 0x5A))

    def n_lower(self) -> np.ndarray:
        return self.count((self.part >= 0x61) & (self.part <= 0x7A))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, numbers of the texts) of the lines that have a word."""
        s, e, h, first = self.hashers["line"].words(self.data, self.offsets)
        worded = np.zeros(len(self.part) + 1, dtype=np.int64)
        np.cumsum(self.hashers["space"].word[self.part], out=worded[1:])
        have = worded[e - self.base] > worded[s - self.base]
        return h[have], K.text_of_words(first)[have]

    def n_lines(self) -> np.ndarray:
        return np.bincount(self["lines"][1], minlength=len(self.offsets) - 1)

    def n_dup_lines(self) -> np.ndarray:
        h, text = self["lines"]
        return np.bincount(text[K.earlier(h, text)], minlength=len(self.offsets) - 1)

    def n_repeat_words(self) -> np.ndarray:
        _, _, h, first = self["words"]
        g, text, at = K.grams(h, first, 8)
        at = at[K.repeated(g, text)]
        edge = np.zeros(len(h) + 9, dtype=np.int64)
        edge[at] += 1
        edge[at + 8] -= 1
        inside = np.cumsum(edge)[: len(h)] > 0
        return K.per_text(inside, first)


class _Some(Stats):
    """Statistics of some texts of a run."""

    def __init__(self, whole: Stats, which: np.ndarray):
        self.hashers, self.have = whole.hashers, {k: v[which] for k, v in whole.have.items() if isinstance(v, np.ndarray)}
        self.whole, self.which, self.base = whole, which, 0

    def __getattr__(self, name: str):
        if name not in ("data", "offsets", "part"):
            raise AttributeError(name)
        first, lengths = self.whole.offsets[:-1][self.which], np.diff(self.whole.offsets)[self.which]
        self.data = self.part = self.whole.data[K.ragged(first, lengths)]
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        return self.__dict__[name]

    def of(self, which: np.ndarray) -> Stats:
        if len(which) == len(self.which):
            return self
        out = _Some(self.whole, self.which[which])
        out.have = {k: v[which] for k, v in self.have.items() if isinstance(v, np.ndarray)}
        return out


@dataclass(frozen=True)
class Rule:
    """rejects: from statistics to booleans; sql: the same as a condition on columns."""

    name: str
    rejects: Callable[[Stats], np.ndarray]
    sql: str


BASE_RULES = (
    Rule("few_words", lambda s: s["n_words"] < 20, "n_words < 20"),
    Rule("repeated_words", lambda s: 100 * s["n_repeat_words"] > 30 * s["n_words"], "100 * n_repeat_words > 30 * n_words"),
)
#: Beyond the base rules: marked-up or tabular junk, shouting, copied lines, and words too short or too long for prose.
MORE_RULES = (
    Rule("symbols", lambda s: 100 * s["n_symbols"] > 5 * s["word_chars"], "100 * n_symbols > 5 * word_chars"),
    Rule("shouting", lambda s: s["n_upper"] > s["n_lower"], "n_upper > n_lower"),
    Rule("copied_lines", lambda s: 2 * s["n_dup_lines"] > s["n_lines"], "2 * n_dup_lines > n_lines"),
    Rule("word_length", lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 20 * s["n_words"]), "word_chars < 2 * n_words or word_chars > 20 * n_words"),
)
RULES = BASE_RULES + MORE_RULES
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashers() -> dict[str, K.Hasher]:
    return {"space": K.Hasher("space", lower=False), "line": K.Hasher("line", lower=False, seed=11)}


def measured_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules by rejections per second on about sample_rows documents, measured where they are read; ties and an empty table keep the order given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, cost, out, seen = _hashers(), [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            data, offsets = K.column(b.column(0))
            for lo, hi in K.spans(offsets):
                seen += hi - lo
                for i, rule in enumerate(rules):
                    stats, began = Stats(data, offsets[lo : hi + 1], hashers), time.thread_time()
                    out[i] += int(rule.rejects(stats).sum())
                    cost[i] += time.thread_time() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(out, pa.int64()), pa.array([seen] * len(rules), pa.int64())], ["rule", "cost", "out", "seen"])

    rows = docs.count()
    drawn = F.pmod(F.xxhash64(F.col("`doc_id`").cast("long"), F.lit(41)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(rows, 1)))
    sample = typed(docs.where(drawn), ("text", "string")).mapInArrow(run, "rule int, cost double, out long, seen long")
    total = {i: (out, cost) for i, out, cost in sample.groupBy("rule").agg(F.sum("out"), F.sum("cost")).collect()}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-total.get(i, (0, 1.0))[0] / max(total.get(i, (0, 1.0))[1], 1e-9), i))]


def quality_rules(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, the base statistics, base_failed, kept.

    Null counts as a text without words, which the base rules reject. Words are
    runs of other than white space; lines are split at line feeds. Rows that
    repeat a doc_id are judged each by itself; an empty table gives an empty
    result; further columns aren't looked at. rules: in the order in which they
    run; measured on a sample unless given, rules that tie in the order of RULES.
    """
    order = list(rules) if rules is not None else measured_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        for b in batches:
            data, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets):
                stats = Stats(data, offsets[lo : hi + 1], hashers)
                columns = [stats[x] for x in STATISTICS]
                base = np.zeros(hi - lo, dtype=bool)
                for rule in BASE_RULES:
                    base |= rule.rejects(stats)
                kept, _ = cascade(order, stats)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(x, pa.int64()) for x in columns], pa.array(base), pa.array(kept & ~base)], ["doc_id", *STATISTICS, "base_failed", "kept"])

    return typed(docs, ("doc_id", "long"), ("text", "string")).mapInArrow(run, f"doc_id long, {', '.join(f'{x} long' for x in STATISTICS)}, base_failed boolean, kept boolean")


def cascade(order: Sequence[Rule], stats: Stats) -> tuple[np.ndarray, np.ndarray]:
    """(which texts no rule rejects, how many texts each rule was asked about). A text that a rule rejects is left out of all that follow."""
    alive = np.arange(len(stats.offsets) - 1)
    kept, asked = np.zeros(len(alive), dtype=bool), np.zeros(len(order), dtype=np.int64)
    for i, rule in enumerate(order):
        if not len(alive):
            break
        asked[i] = len(alive)
        good = np.flatnonzero(~rule.rejects(stats))
        alive, stats = alive[good], stats.of(good)
    kept[alive] = True
    return kept, asked


def cascade_report(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(place, rule, asked, rejected): in the order in which rules run, how many documents each was asked about and rejected."""
    order = list(rules) if rules is not None else measured_order(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers()
        for b in batches:
            data, offsets = K.column(b.column(0))
            for lo, hi in K.spans(offsets):
                kept, asked = cascade(order, Stats(data, offsets[lo : hi + 1], hashers))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(order)), pa.int32()), pa.array([r.name for r in order]), pa.array(asked), pa.array(asked - np.append(asked[1:], kept.sum()))], ["place", "rule", "asked", "rejected"])

    found = typed(docs, ("text", "string")).mapInArrow(run, "place int, rule string, asked long, rejected long")
    return found.groupBy("place", "rule").agg(F.sum("asked").alias("asked"), F.sum("rejected").alias("rejected"))
