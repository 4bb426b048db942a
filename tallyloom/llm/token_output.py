"""Token ids of all documents as binary shards with Elias-Fano document bounds.

A shard is one blob: a header, the bounds of its documents and their ids, both
Elias-Fano coded, and the token ids one after the other, two bytes each where
the vocabulary allows. Shards follow one another in ascending doc_id; each is
a row of a Parquet table, so that any store Spark writes to will do, and Spark's
commit protocol makes a lost executor harmless. export() writes them as files
of a shared folder.

A token never spans white space, so that each distinct word between white space
is encoded once in a worker, as long as that remembers it, and its ids are
then copied.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import typed, written
from .elias_fano import EliasFano
from .elias_fano import encode as bounds_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END_ID = 2
#: Ids of a shard at most, unless one document alone has more.
SHARD_IDS = 1 << 21
#: Words, and parts of words, whose ids a worker remembers at most; it then starts anew.
REMEMBERED, PARTS = 2_500_000, 300_000
HEAD = "<4sBQQQqQQ"
SHARDS = "part int, before long, n_docs long, n_tokens long, payload binary"


#: The steps of a tokenizer that WordEncoder stands for, as its file has them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class WordEncoder:
    """ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    For a tokenizer whose normaliser lower-cases and whose pre-tokenizer drops
    white space and splits words as in the pattern below; words of characters
    that those steps treat alike everywhere (ASCII and the letters of Latin-1)
    are split here and their parts given to the library's model, all others go
    through the library whole. A file with other steps is refused.
    """

    def __init__(self, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check(blob)
        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.model = self.tokenizer.model
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = regex.compile("[\x21-\x7eÀ-ÿ]+")
        self.parts = regex.compile(SPLIT)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.hasher = K.Hasher("space", lower=False, seed=3)
        self.of_part: dict[str, bytes] = {}
        self.memo = K.Memo(REMEMBERED)

    def word(self, word: str) -> bytes:
        if not self.plain.fullmatch(word) or any(s in word for s in self.specials):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        out = b""
        for part in self.parts.findall(word.lower()):
            if (ids := self.of_part.get(part)) is None:
                shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
                if len(self.of_part) >= PARTS:
                    self.of_part.clear()
                ids = self.of_part[part] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            out += ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        starts, ends, h, first = self.hasher.words(data, offsets)
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        place = self.memo.places(distinct, lambda i: (self.word(data[starts[at[i]] : ends[at[i]]].tobytes().decode()), 0))
        ids, size = self.memo.gather(place[back.ravel()])
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[first])


def check(blob: bytes) -> None:
    """Raises ValueError unless the tokenizer's steps are those that WordEncoder stands for."""
    steps = json.loads(blob)
    if steps["normalizer"] != NORMALIZER or steps["pre_tokenizer"] != PRE_TOKENIZER or steps.get("truncation"):
        raise ValueError("the tokenizer normalises or splits text in other ways than this encoder does")


def pack(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """One shard; doc_ids ascend, nulls first."""
    named = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    least = int(named[0]) if len(named) else 0
    bounds, names = bounds_of(np.cumsum(counts)), bounds_of(named - least)
    return struct.pack(HEAD, b"TLEF", width, len(doc_ids), len(ids), len(doc_ids) - len(named), least, len(bounds), len(names)) + bounds + names + ids.astype(f"<u{width}").tobytes()


class Shard:
    """A shard's documents, read in place."""

    def __init__(self, payload: bytes | memoryview):
        payload = memoryview(payload)
        magic, width, self.n, self.n_tokens, self.nulls, self.least, a, b = struct.unpack_from(HEAD, payload)
        if magic != b"TLEF":
            raise ValueError("not a shard of token ids")
        self.bounds = EliasFano(payload[struct.calcsize(HEAD) :])
        self.names = EliasFano(payload[struct.calcsize(HEAD) + a :])
        self.ids = np.frombuffer(payload, f"<u{width}", self.n_tokens, struct.calcsize(HEAD) + a + b)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.all() + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]


def shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The shards of docs (doc_id, text), dealt by ranges of doc_id: part and before, the ids of the same part that precede, give the order."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())  # a vocabulary
    check(blob.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.per_worker(("words", hash(blob.value)), lambda: WordEncoder(blob.value))
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, before = TaskContext.get().partitionId(), 0
        names, ids, counts, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal names, ids, counts, held, before
            blob = pack(names, np.concatenate(ids), np.concatenate(counts), width)
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (before, pa.int64()), (len(names), pa.int64()), (held, pa.int64()), (blob, pa.binary()))]
            before += held
            names, ids, counts, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["part", "before", "n_docs", "n_tokens", "payload"])

        for b in batches:
            data, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets, SHARD_IDS):
                found, n = encoder.encode(data, offsets[lo : hi + 1])
                ends = np.cumsum(n)
                names += b.column(0).slice(lo, hi - lo).to_pylist()
                ids.append(np.insert(found, ends, end_id))
                counts.append(n + 1)
                held += len(found) + len(n)
                if held >= SHARD_IDS:
                    yield shard()
        if names:
            yield shard()

    # the place in the table splits rows that repeat a doc_id, or have none, over tasks
    rows = typed(docs, ("doc_id", "long"), ("text", "string")).withColumn("place", F.monotonically_increasing_id())
    return rows.repartitionByRange(F.col("doc_id").asc(), F.col("place").asc()).sortWithinPartitions("doc_id", "place").mapInArrow(run, SHARDS)


def read_back(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a table of shards."""
    # one number for each task that wrote shards
    total = dict(sorted((r[0], r[1]) for r in table.groupBy("part").agg(F.sum("n_tokens")).collect()))
    base = dict(zip(total, np.concatenate([[0], np.cumsum(list(total.values()))]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column(2)[i].as_buffer())
                ends = np.array([shard.bounds.select(k) for k in range(shard.n)], dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = memoryview(shard.ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                at = base[b.column(0)[i].as_py()] + b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(), pa.int64()), pa.array(starts + at), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "before", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(table: DataFrame, folder: str) -> DataFrame:
    """(file, part, before, n_docs, n_tokens): each shard as a file of a folder that all executors see, written by the task that reads it; file names sort in the order of the shards.

    A file appears whole or not at all, and a repeated task writes the same one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = b.to_pydict()
            rows["file"] = []
            for part, before, payload in zip(rows["part"], rows["before"], rows.pop("payload"), strict=True):
                rows["file"].append(os.path.join(folder, f"tokens-{part:06d}-{before:015d}.bin"))
                half = f"{rows['file'][-1]}.{os.getpid()}"
                with open(half, "wb") as f:
                    f.write(payload)
                os.replace(half, rows["file"][-1])
            yield pa.RecordBatch.from_pydict({k: rows[k] for k in ("file", "part", "before", "n_docs", "n_tokens")}, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return table.mapInArrow(run, "file string, part int, before long, n_docs long, n_tokens long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs (doc_id, text) as shards in the shared folder and returns what they hold: doc_id, start, n_tokens, ids_crc32.

    Null texts count as empty and hold the end id alone. Rows with a null doc_id
    come first; repeated doc_ids follow one another in any order, each row with
    its own ids. An empty table gives an empty result; further columns aren't
    looked at.
    """
    return read_back(written(shards(docs, tokenizer, end_id), "shards"))
