"""Token ids in directly addressable files.

Each id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, a
continuation bitmap (does this id go on at the next level?) and a rank directory (ones before every 512th bit). Id i
is read by its chunk at level 0; while its bit is set, its place at the next level is the rank of that bit. So any
token is reached without decoding others, by reads of known places alone.

A file holds the ids of a run of documents in ascending doc_id order:

    "DACF" | version, levels, documents, ids, documents without doc_id (the first ones) | place and size of each section |
    starts | doc_ids | level sections

All numbers are little-endian. Names hold the task's attempt; the manifest names the files of finished attempts.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.bpe import LETTERS, NUMBERS, PLAIN, SPACES, byte_letters
from pagefold.llm.common import shuffle_partitions, small_batches, text_partitions, written

MAGIC, END_ID, BLOCK = b"DACF", 0, 512
#: Ids a file holds before the next is begun; a longer document has a file of its own.
FILE_IDS = 4_000_000
CACHE_WORDS = 400_000


class ByteEncoder:
    """The tokenizers library's ids of a byte-level vocabulary file.

    Each distinct word is encoded by the library's model once and kept. Text is split by an equal pattern where it has
    only Latin-1 and Latin Extended-A; any other text goes through the library whole, as do special tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = self.library.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in spec) or "(?!)")
        self.words = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
        letter, model = byte_letters(), self.library.model

        class Known(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                ids = self[word] = tuple([t.id for t in model.tokenize("".join([letter[b] for b in word.encode()]))])
                return ids

        self.known = Known()

    def encode(self, text: str) -> list[int]:
        if not PLAIN.fullmatch(text) or self.special.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return list(chain.from_iterable(map(self.known.__getitem__, self.words.findall(text))))


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


HEAD = struct.Struct("<4sHHQQQ")


def pack(starts: np.ndarray, doc_ids: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """A file: starts (documents + 1 places of ids), doc_ids (the first nulls of them stand for null), and the ids."""
    rest = np.asarray(ids, "<u4")
    sections = [np.asarray(starts, "<i8").tobytes(), np.asarray(doc_ids, "<i8").tobytes()]
    levels = 0
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        sections += [(rest & 255).astype("u1").tobytes(), bits.tobytes(), np.concatenate(([0], np.cumsum(ones)))[: len(ones)].astype("<i8").tobytes()]
        levels += 1
        if not more.any():
            break
        rest = rest[more] >> 8
    size = HEAD.size + 16 * len(sections)
    places, at = [], size
    for s in sections:
        places += [at, len(s)]
        at += len(s)
    return HEAD.pack(MAGIC, 2, levels, len(doc_ids), len(ids), nulls) + struct.pack(f"<{len(places)}Q", *places) + b"".join(sections)


class Reader:
    """Reads single tokens, or runs of them, from a seekable file; never the whole of a level."""

    def __init__(self, src):
        self.src = src
        magic, _, self.levels, self.documents, self.size, self.nulls = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        places = struct.unpack(f"<{2 * (2 + 3 * self.levels)}Q", self._read(HEAD.size, 16 * (2 + 3 * self.levels)))
        self.places = list(zip(places[::2], places[1::2], strict=True))

    def _read(self, at: int, n: int) -> bytes:
        self.src.seek(at)
        return self.src.read(n)

    def _part(self, section: int, at: int, n: int) -> bytes:
        return self._read(self.places[section][0] + at, min(n, self.places[section][1] - at))

    def documents_at(self, first: int, n: int) -> tuple[np.ndarray, pa.Array]:
        """(starts, n + 1 of them; doc_ids) of n documents from first on."""
        names = np.frombuffer(self._part(1, 8 * first, 8 * n), "<i8")
        return np.frombuffer(self._part(0, 8 * first, 8 * (n + 1)), "<i8"), pa.array(names, mask=np.arange(first, first + n) < self.nulls)

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of the level's bitmap."""
        block = i // BLOCK
        base = int.from_bytes(self._part(4 + 3 * level, 8 * block, 8), "little")
        bits = np.unpackbits(np.frombuffer(self._part(3 + 3 * level, block * BLOCK // 8, BLOCK // 8), "u1"), bitorder="little")
        return base + int(bits[: i - block * BLOCK].sum())

    def token(self, i: int) -> int:
        """Id i of the file."""
        out = 0
        for level in range(self.levels):
            out |= self._part(2 + 3 * level, i, 1)[0] << 8 * level
            if not self._part(3 + 3 * level, i // 8, 1)[0] >> i % 8 & 1:
                break
            i = self.rank(level, i)
        return out

    def run(self, first: int, n: int) -> np.ndarray:
        """Ids first .. first + n - 1, as unsigned 32-bit numbers; one read of chunks and of bits at each level."""
        out, at, level = np.zeros(n, "<u4"), np.arange(n), 0
        while n and level < self.levels:
            chunk = np.frombuffer(self._part(2 + 3 * level, first, n), "u1")
            out[at] |= chunk.astype("<u4") << 8 * level
            low = first // 8
            bits = np.unpackbits(np.frombuffer(self._part(3 + 3 * level, low, (first + n + 7) // 8 - low), "u1"), bitorder="little")[first - 8 * low :][:n].astype(bool)
            at = at[bits]
            first, n, level = (self.rank(level, first) if len(at) else 0), len(at), level + 1
        return out


MANIFEST = "pid int, k int, file string, documents long, ids long"


def write_ids(docs: DataFrame, folder: str, path: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes docs (doc_id, text; others are left out) into folder, in ascending doc_id order, END_ID after each.

    Returns the manifest: pid, k, file, documents, ids, first_id (ids in all files before it). Runs jobs.
    Null text is empty: its end id alone. Rows without doc_id come first; rows that repeat a doc_id stand next to each other, by a
    hash of their text, which also lets many of them lie in several partitions. Texts are encoded whole; ids of one document are in
    one file, however many. The number of ids before a partition is summed from one row for each file.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, enc, k, total = TaskContext.get(), byte_encoder(path), 0, 0
        runs: list[np.ndarray] = []
        names: list[int | None] = []

        def flush() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
            name = f"ids-{task.partitionId():05d}-{task.taskAttemptId()}-{k:05d}.dac"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pack(starts, np.array([x or 0 for x in names], np.int64), np.concatenate(runs), names.count(None)))
            row = [[task.partitionId()], [k], [name], [len(names)], [int(starts[-1])]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["pid", "k", "file", "documents", "ids"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                run = np.array([*enc.encode(text.as_py()), END_ID], "<u4")
                if runs and total + len(run) > file_ids:
                    yield flush()
                    runs.clear(), names.clear()
                    k, total = k + 1, 0
                runs.append(run)
                names.append(name)
                total += len(run)
        if runs:
            yield flush()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(text_partitions(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    files = written(dealt.select("doc_id", "text").mapInArrow(put, MANIFEST), "manifest")
    from pyspark.sql import Window as W

    before = files.groupBy("pid").agg(F.sum("ids").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)))
    inside = F.sum("ids").over(W.partitionBy("pid").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    return files.withColumn("inside", inside).join(before.select("pid", "before"), "pid").select(*files.columns, (F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("first_id"))


CHECKED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(manifest: DataFrame, folder: str, step: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files, read back from them."""

    def get(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as src:
                    r = Reader(src)
                    for k in range(0, r.documents, step):
                        starts, names = r.documents_at(k, min(step, r.documents - k))
                        ids = r.run(int(starts[0]), int(starts[-1] - starts[0]))
                        crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts[:-1] - starts[0], starts[1:] - starts[0], strict=True)]
                        yield pa.RecordBatch.from_arrays([names, pa.array(starts[:-1] + first), pa.array(starts[1:] - starts[:-1]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "first_id")
    return files.repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(get, CHECKED)
