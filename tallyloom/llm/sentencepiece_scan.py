"""SentencePiece encoding as a max-plus scan, and decoding.

A text's best segmentation into pieces is a longest path: the value of a
position is the best sum of piece scores up to it, as an integer multiple of
1 / UNIT, so that sums are exact and may be grouped at will. Of equal segmentations the one whose last
piece is longest is taken, from the end backwards.

No piece spans certain pairs of characters (letter and blank, say); the path
passes through every such cut, so a text falls into short units, each solved
once per task. A text longer than a chunk is split anywhere. A chunk's states at
a border are the characters by which a piece overhangs it; the chunk yields the
max-plus matrix between the states of its two borders. Products of these
matrices are taken by runs of chunks and then over the runs, which gives the
values at every border; with them each chunk traces back by itself from each
state at its end, and composing these traces from the last chunk on tells which
one holds.

A model file may as well say that its pieces are merged by byte-pair encoding,
which is greedy and has no best path; library_ids gives those ids. Merges don't
span cuts either, so it works on the same units.

Blanks become U+2581 and a first one is put before the text, as the library
does. Characters without a piece go by bytes, and so does U+2581 itself, which
makes decoding exact.
"""

from __future__ import annotations

import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import typed, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a chunk; chunks of a run.
CHUNK, RUN = 1 << 16, 128
REMEMBERED = 2_500_000
#: The blank of pieces; what stands for a U+2581 of the text, which no UTF-8 text has.
SPACE, LITERAL = "\u2581", "\udc00"
NONE = -(1 << 60)
#: Scores are rounded to multiples of 1 / UNIT; one unit lies far below any difference between log probabilities that counts.
UNIT = 1 << 16
#: Characters with a code below this have their cuts in a table.
SMALL = 0x250
NORMAL, USER, BYTE = 1, 4, 6


class Pieces:
    """A SentencePiece vocabulary read as a unigram model."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        usable = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        floor = min((s for _, _, s in usable if s > -1e8), default=0.0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = round((floor - 10) * UNIT)
        self.score: dict[str, int | None] = {}
        self.id = {}
        self.merge = {p: s for _, p, s in usable}
        for i, p, s in usable:
            for k in range(1, len(p)):
                self.score.setdefault(p[:k], None)
        for i, p, s in usable:
            self.score[p], self.id[p] = round(max(s, floor - 10) * UNIT), i
        self.longest = max((len(p) for p in self.id), default=1)
        self.raw = [b""] * len(pieces)
        for p, i in self.id.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        pairs = {(ord(a), ord(b)) for p in self.id for a, b in zip(p, p[1:])}
        self.joined = np.zeros((SMALL, SMALL), dtype=bool)
        self.pairs = np.array(sorted((a << 21) | b for a, b in pairs), dtype=np.int64)
        # blanks have a code beyond the table; they take a free low one there
        for a, b in pairs:
            a, b = (1 if x == ord(SPACE) else x for x in (a, b))
            if a < SMALL and b < SMALL:
                self.joined[a, b] = True

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether no piece spans codes[i] and codes[i + 1]."""
        low = np.where(codes == ord(SPACE), 1, codes)
        a, b = low[:-1], low[1:]
        small = (a < SMALL) & (b < SMALL)
        out = np.empty(len(a), dtype=bool)
        out[small] = ~self.joined[a[small], b[small]]
        if not small.all():
            big = ~small
            out[big] = ~np.isin((codes[:-1][big].astype(np.int64) << 21) | codes[1:][big], self.pairs)
        return out

    def forward(self, text: str, look: str, entry: list[int]) -> tuple[list[int], list[int]]:
        """(values, lengths of the last pieces) at positions 0 .. len(text) + longest; entry: the values at the first positions, of pieces that overhang from before."""
        n, longest, score = len(text), self.longest, self.score
        whole = text + look[: longest - 1]
        value, last = [NONE] * (n + longest + 1), [0] * (n + longest + 1)
        value[: len(entry)] = entry
        last[: len(entry)] = [1 << 30] * len(entry)
        for p in range(n):
            if (v := value[p]) <= NONE:
                continue
            single = False
            for k in range(1, min(longest, len(whole) - p) + 1):
                s = score.get(whole[p : p + k], 1)
                if s is None:
                    continue
                if s == 1 and whole[p : p + k] not in score:
                    break
                single |= k == 1
                if v + s > value[p + k] or v + s == value[p + k] and k > last[p + k]:
                    value[p + k], last[p + k] = v + s, k
            if not single and v + self.unknown > value[p + 1]:
                value[p + 1], last[p + 1] = v + self.unknown, 1
        return value, last

    def ids(self, piece: str) -> list[int]:
        if (i := self.id.get(piece)) is not None:
            return [i]
        return [self.byte[b] for b in piece.replace(LITERAL, SPACE).encode()]

    def trace(self, text: str, look: str, last: list[int], end: int) -> tuple[list[int], int]:
        """(ids of the pieces that begin in text, up to position end; the state at the first border)."""
        whole, out, p = text + look, [], end
        while p > 0 and last[p] < 1 << 30:
            out.append(whole[p - last[p] : p])
            p -= last[p]
        return [i for piece in reversed(out) for i in self.ids(piece)], p

    def best(self, unit: str) -> tuple[int, list[int]]:
        value, last = self.forward(unit, "", [0])
        return value[len(unit)], self.trace(unit, "", last, len(unit))[0]

    def merged(self, unit: str) -> tuple[int, list[int]]:
        """(0, ids) by merging the adjacent pair of the best score, the leftmost of equal ones, as long as there is one."""
        part, n = list(unit), len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := self.merge.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, j, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not part[i] or not part[j] or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return 0, [x for p in part if p for x in self.ids(p)]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:]


def escape(text: str) -> str:
    """Characters as pieces have them."""
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


class Encoder:
    """Ids of whole texts by units, each solved once: by default for the best path."""

    def __init__(self, pieces: Pieces, solver: str = "best"):
        self.pieces, self.solver = pieces, getattr(pieces, solver)
        self.power = K._splitmix(1, 77)[0]
        self.memo = K.Memo(REMEMBERED)

    def units(self, escaped: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the units of all texts, as known; bounds of each text's; their scores)."""
        joined = "".join(escaped)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(x) for x in escaped])
        if not len(codes):
            return np.zeros(0, dtype=np.int64), np.zeros(len(escaped) + 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        cut = np.zeros(len(codes) + 1, dtype=bool)
        cut[1:-1] = self.pieces.cuts(codes)
        cut[ends] = True
        cut[0] = True
        bound = np.flatnonzero(cut)
        start, size = bound[:-1], np.diff(bound)
        # a unit's hash: the sum of its characters' hashes, each with the place in the unit
        place = np.arange(len(codes)) - np.repeat(start, size)
        h = K.mix(codes.astype(np.uint64) * self.power + place.astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))
        h = K.mix(np.add.reduceat(h, start) + size.astype(np.uint64))
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)

        def solve(i: int) -> tuple[bytes, int]:
            j = at[i]
            score, ids = self.solver(joined[start[j] : start[j] + size[j]])
            return array("I", ids).tobytes(), score

        number = self.memo.places(distinct, solve)[back.ravel()]
        return number, np.searchsorted(start, np.concatenate([[0], ends])), np.array(self.memo.scores)[number]

    def encode(self, escaped: list[str]) -> list[np.ndarray]:
        number, first, _ = self.units(escaped)
        ids, size = self.memo.gather(number)
        total = np.concatenate([[0], np.cumsum(size)])
        return np.split(ids, total[first][1:-1])

    def matrix(self, text: str, look: str) -> np.ndarray:
        """From the states at the chunk's first border to those at its last."""
        n = self.pieces.longest
        out = np.full((n, n), NONE, dtype=np.int64)
        codes = np.array([ord(c) for c in text + look[:1]], dtype=np.int64)
        cut = np.flatnonzero(self.pieces.cuts(codes)) + 1 if len(codes) > 1 else np.zeros(0, dtype=np.int64)
        if not len(cut):
            for i in range(min(n, len(text) + n)):
                value, _ = self.pieces.forward(text, look, [NONE] * i + [0])
                out[i] = value[len(text) : len(text) + n]
            return out
        a, b = int(cut[0]), int(cut[-1])
        middle = int(self.units([text[a:b]])[2].sum())
        tail = np.array(self.pieces.forward(text[b:], look, [0])[0][len(text) - b : len(text) - b + n])
        for i in range(min(n, a + 1)):
            head = self.pieces.forward(text[:a], "", [NONE] * i + [0])[0][a]
            if head > NONE:
                out[i] = np.where(tail > NONE, head + middle + tail, NONE)
        return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, which is associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


class Shared:
    """A vocabulary that tasks build for themselves from a broadcast list of pieces."""

    def __init__(self, rows):
        self.rows, self.built = rows, None

    def __getstate__(self):
        return {"rows": self.rows, "built": None}

    @property
    def value(self) -> Pieces:
        if self.built is None:
            self.built = Pieces(self.rows.value)
        return self.built


def read_model(path: str) -> list[tuple[str, float, int]]:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


def _scan(chunks: DataFrame, pieces) -> DataFrame:
    """(row, chunk, entry): the values at each chunk's first border, relative to their best."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces.value)
        for b in batches:
            rows = b.to_pydict()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([encoder.matrix(escape(t), escape(k)).tobytes() for t, k in zip(rows["text"], rows["look"], strict=True)], pa.binary())], ["row", "chunk", "matrix"])

    def grouped(batches: Iterator[pa.RecordBatch], key, fold) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if held is not None and key(r) != held:
                    yield from fold(rows)
                    rows = []
                held = key(r)
                rows.append(r)
        if rows:
            yield from fold(rows)

    n = pieces.value.longest
    square = lambda x: np.frombuffer(x, dtype=np.int64).reshape(n, n)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fold(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            total = None
            for r in rows:
                total = square(r["matrix"]) if total is None else times(total, square(r["matrix"]))
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["row"]], pa.string()), pa.array([rows[0]["run"]], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["row", "run", "matrix"])

        yield from grouped(batches, lambda r: (r["row"], r["run"]), fold)

    def through(rows: list[dict], name: str, entry: np.ndarray) -> pa.RecordBatch:
        out = []
        for r in rows:
            out.append(entry.tobytes())
            entry = (entry[:, None] + square(r["matrix"])).max(axis=0)
            entry = np.maximum(entry - max(int(entry.max()), NONE), NONE)
        return pa.RecordBatch.from_arrays([pa.array([r["row"] for r in rows], pa.string()), pa.array([r[name] for r in rows], pa.int64()), pa.array(out, pa.binary())], ["row", name, "entry"])

    def run_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.full(n, NONE, dtype=np.int64)
        start[0] = 0
        yield from grouped(batches, lambda r: r["row"], lambda rows: iter([through(rows, "run", start)]))

    def chunk_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, lambda r: (r["row"], r["run"]), lambda rows: iter([through(rows, "chunk", np.frombuffer(rows[0]["entry"], dtype=np.int64))]))

    own = written(chunks.select("row", "chunk", "text", "look").mapInArrow(matrices, "row string, chunk long, matrix binary").withColumn("run", F.floor(F.col("chunk") / RUN)), "matrices")
    of_run = own.repartition("row", "run").sortWithinPartitions("row", "run", "chunk").mapInArrow(runs, "row string, run long, matrix binary")
    entries = of_run.repartition("row").sortWithinPartitions("row", "run").mapInArrow(run_entries, "row string, run long, entry binary")
    return own.join(entries, ["row", "run"]).repartition("row", "run").sortWithinPartitions("row", "run", "chunk").mapInArrow(chunk_entries, "row string, chunk long, entry binary")


def _between(encoder: Encoder, text: str, after: str) -> dict:
    """Of a chunk's merges: head, the text before its first cut, ids of what lies between its first and its last cut, and tail, the text after that; without any cut it is all head, and ids are null."""
    codes = np.array([ord(c) for c in text + after[:1]], dtype=np.int64)
    cut = np.flatnonzero(encoder.pieces.cuts(codes)) + 1 if len(codes) > 1 else np.zeros(0, dtype=np.int64)
    if not len(cut):
        return {"head": text, "ids": None, "tail": ""}
    a, b = int(cut[0]), int(cut[-1])
    return {"head": text[:a], "ids": encoder.encode([text[a:b]])[0].astype("<u4").tobytes(), "tail": text[b:]}


def _assembled(encoder: Encoder, parts: list[dict]) -> bytes:
    """The ids of a text from what _between gave for its chunks, in order; what lies across borders is merged here."""
    out, held = b"", ""
    for p in parts:
        held += p["head"]
        if p["ids"] is not None:
            out += encoder.encode([held])[0].astype("<u4").tobytes() + p["ids"]
            held = p["tail"]
    return out + encoder.encode([held])[0].astype("<u4").tobytes()


def _traced(chunks: DataFrame, entries: DataFrame, pieces, merges=None) -> DataFrame:
    """(row, chunk, ids, merged) of every chunk; merged is what _between gives with the encoder that merges() makes, or null."""
    n = pieces.value.longest

    def solved(r: dict) -> tuple[list[int], list[int]]:
        return pieces.value.forward(escape(r["text"]), escape(r["look"]), np.frombuffer(r["entry"], dtype=np.int64).tolist())

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = b.to_pylist(), []
            for r in rows:
                value, last = solved(r)
                size = len(r["text"])
                out.append([pieces.value.trace(escape(r["text"]), escape(r["look"]), last, size + j)[1] if value[size + j] > NONE else -1 for j in range(n)])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(x)) for x in ("row", "chunk")] + [pa.array(out, pa.list_(pa.int32()))], ["row", "chunk", "back"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state = None, 0
        for b in batches:  # the last chunk of a row comes first
            out = []
            for r in b.to_pylist():
                if r["row"] != row:
                    row, state = r["row"], 0
                out.append(state)
                state = r["back"][state]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], ["row", "chunk", "leaves"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = b.to_pylist(), []
            for r in rows:
                ids, _ = pieces.value.trace(escape(r["text"]), escape(r["look"]), solved(r)[1], len(r["text"]) + r["leaves"])
                out.append(np.array(ids, dtype="<u4").tobytes())
            plain = lambda x: x.replace(" ", SPACE)
            merged = [_between(merges(), plain(r["text"]), plain(r["look"])) if merges else None for r in rows]
            kind = pa.struct([("head", pa.string()), ("ids", pa.binary()), ("tail", pa.string())])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(x)) for x in ("row", "chunk")] + [pa.array(out, pa.binary()), pa.array(merged, kind)], ["row", "chunk", "ids", "merged"])

    both = written(chunks.join(entries, ["row", "chunk"]), "entries")
    back = both.mapInArrow(traces, "row string, chunk long, back array<int>")
    leaves = back.repartition("row").sortWithinPartitions("row", F.col("chunk").desc()).select("row", "chunk", "back").mapInArrow(exits, "row string, chunk long, leaves int")
    return both.join(leaves, ["row", "chunk"]).mapInArrow(emit, "row string, chunk long, ids binary, merged struct<head:string,ids:binary,tail:string>")


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, column: str = "text", library: bool = False) -> DataFrame:
    """(doc_id, text, ids, decoded): ids as packed little-endian unsigned 32-bit numbers, decoded from these again; with library also library_ids (see there).

    Null texts count as empty and have no ids. Rows that repeat a doc_id, or
    have none, are encoded each by itself. An empty table gives an empty
    result; further columns aren't looked at.
    """
    spark = docs.sparkSession
    pieces = Shared(spark.sparkContext.broadcast(read_model(model)))  # as large as the vocabulary
    longest, mark = pieces.value.longest, xxhash.xxh3_128_hexdigest(repr(pieces.rows.value).encode())

    names = ["doc_id", "text", "ids", "decoded", *(["library_ids"] if library else [])]
    schema = "doc_id long, text string, ids binary, decoded string" + (", library_ids binary" if library else "")

    def merges() -> Encoder:
        return K.per_worker(("merges", mark), lambda: Encoder(pieces.value, "merged"))

    def merged(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(_library(merges(), texts), pa.binary())] if library else []

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.per_worker(("pieces", mark), lambda: Encoder(pieces.value))
        own = encoder.pieces
        for b in batches:
            _, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets, 2 * K.SLICE):
                texts = [x or "" for x in b.column(1).slice(lo, hi - lo).to_pylist()]
                ids = encoder.encode([escape(" " + x) if x else "" for x in texts])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.string()), *merged(b.column(1).slice(lo, hi - lo))], names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = " " + b.column(1)[i].as_py()
                starts = list(range(0, len(text), chunk))
                for lo in range(0, len(starts), RUN):
                    part = starts[lo : lo + RUN]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(2)[i].as_py()] * len(part), pa.string()), pa.array([s // chunk for s in part], pa.int64()), pa.array([text[s : s + chunk] for s in part], pa.string()), pa.array([text[s + chunk : s + chunk + longest] for s in part], pa.string())], ["row", "chunk", "text", "look"])

    rows = typed(docs, ("doc_id", "long"), (column, "string")).toDF("doc_id", "text")
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(whole, schema)
    giants = written(rows.where(F.length("text") > chunk).withColumn("row", F.expr("uuid()")), "giants")
    if giants.isEmpty():
        return short
    chunks = written(giants.mapInArrow(split, "row string, chunk long, text string, look string").repartition("row", "chunk"), "chunks")
    ids = _traced(chunks, _scan(chunks, pieces), pieces, merges if library else None)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                parts = sorted(r["parts"], key=lambda x: x["chunk"])
                ids = b"".join(x["ids"] for x in parts)
                own = [pa.array([_assembled(merges(), [x["merged"] for x in parts])], pa.binary())] if library else []
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"]], pa.int64()), pa.array([r["text"]], pa.string()), pa.array([ids], pa.binary()), pa.array([pieces.value.decode(np.frombuffer(ids, dtype="<u4"))], pa.string()), *own], names)

    parts = ids.groupBy("row").agg(F.collect_list(F.struct("chunk", "ids", "merged")).alias("parts"))
    return short.union(giants.join(parts, "row").select("doc_id", "text", "parts").mapInArrow(joined, schema))


def library_ids(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """(doc_id, library_ids): the ids that the sentencepiece library gives for a BPE model file with byte fallback and no normalisation but the blank before the text, packed as in encode.

    Null and empty texts have none; rows that repeat a doc_id are encoded each
    by itself, and an empty table gives an empty result.
    """
    pieces = Shared(docs.sparkSession.sparkContext.broadcast(read_model(model)))  # as large as the vocabulary
    mark = xxhash.xxh3_128_hexdigest(repr(pieces.rows.value).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.per_worker(("merges", mark), lambda: Encoder(pieces.value, "merged"))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_library(encoder, b.column(1)), pa.binary())], ["doc_id", "library_ids"])

    return typed(docs, ("doc_id", "long"), (column, "string")).mapInArrow(run, "doc_id long, library_ids binary")


def _library(encoder: Encoder, texts: pa.Array) -> list[bytes]:
    _, offsets = K.column(texts)
    out = []
    for lo, hi in K.spans(offsets, 2 * K.SLICE):
        ids = encoder.encode([(" " + x).replace(" ", SPACE) if x else "" for x in texts.slice(lo, hi - lo).to_pylist()])
        out += [x.astype("<u4").tobytes() for x in ids]
    return out


def sentencepiece_digest(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids_crc32, round_trip (whether decoding gives the text), library_tokens, library_crc32 (of library_ids)."""
    size = lambda c: F.expr(f"cast(octet_length({c}) / 4 as long)")
    found = encode(docs, model, chunk, library=True)
    return found.select("doc_id", size("ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"), size("library_ids").alias("library_tokens"), F.crc32("library_ids").alias("library_crc32"))
