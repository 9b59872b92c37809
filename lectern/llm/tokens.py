"""Token ids in files: bit-plane shuffled blocks, zstandard planes and a chunk index.

A table of chunks is written as Parquet into a folder. A chunk holds whole documents in
ascending id order, cut into blocks of a fixed number of ids. A block is transposed into
planes (plane j holds byte j, or bit j, of every id), each plane is compressed on its
own, and the chunk's index lists the byte length of every plane. Spark's own writer
commits the files, so a task that is lost or run twice leaves nothing behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.common import pick, shared_dir

#: Ids of a block.
BLOCK_IDS = 1 << 16
#: A chunk is closed when it holds so many ids.
CHUNK_IDS = 1 << 19
#: A worker forgets the ids of words when it holds so many.
CACHE_WORDS = 1_400_000

CHUNKS = "part int, chunk int, start long, doc_ids array<long>, n_tokens array<long>, block_ids int, planes string, index array<int>, payload binary"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 of bytes, or 32 of bits packed to bytes; the lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, j]).tobytes() for j in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, j], bitorder="little").tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The n ids of to_planes()."""
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(ids: np.ndarray, planes: str = "byte", block: int = BLOCK_IDS) -> tuple[bytes, list[int]]:
    """Payload and index (compressed length of each plane, block after block)."""
    press, out = zstandard.ZstdCompressor(level=3), []
    for at in range(0, len(ids), block):
        out += [press.compress(p) for p in to_planes(ids[at : at + block], planes)]
    return b"".join(out), [len(x) for x in out]


def unpack(payload: bytes, index: list[int], n: int, planes: str, block: int) -> np.ndarray:
    """The n ids of pack()."""
    per, open_, out, at = 4 if planes == "byte" else 32, zstandard.ZstdDecompressor(), [], 0
    for b in range(0, len(index), per):
        held = []
        for size in index[b : b + per]:
            held.append(open_.decompress(payload[at : at + size]))
            at += size
        out.append(from_planes(held, min(block, n - b // per * block), planes))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>")


class KnownWords(dict):
    """Ids of words as bytes, encoded when first asked for.

    Some tokenizers cut between an ASCII letter and a mark that follows, but for
    apostrophes; then a word that ends in marks is what is before them and the marks.
    """

    def __init__(self, tokenizer: Tokenizer, cuts: bool) -> None:
        super().__init__()
        self.tokenizer, self.cuts = tokenizer, cuts

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS) if self.cuts else word
        if len(core) < len(word) and core and core[-1] in _LETTERS:
            found = self[core] + self[word[len(core) :]]
        else:
            found = pack_ids(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        self[word] = found
        return found


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of texts, word by word with a cache.

    That is right for tokenizers that drop white space: a text's ids are then those of
    its pieces between ASCII white space, one after the other. Probes tell whether that
    holds, whether A-Z are lower-cased, and whether marks are cut off letters; a tokenizer
    of another kind gets whole texts.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        words, marks = ("Stone", "river", "x9", "é"), (",", ".", "###", "!?", ")", "-", '"')
        self.by_word = all(ids(a + gap + b) == ids(a) + ids(b) for a in words for b in words for gap in (" ", "\n ", "\t\t"))
        self.lowers = all(ids(a) == ids(a.lower()) for a in ("Stone", "RIVER", "X9"))
        self.known = KnownWords(self.tokenizer, all(ids(a + m) == ids(a) + ids(m) for a in words for m in marks))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        raw = text.encode("utf-8", "replace")
        if self.lowers and not (b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw):
            raw = raw.lower()  # A-Z alone; not with special tokens, nor with marks that may join a letter of one case only
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, raw.split())), "<u4")


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker, so that words learned once serve them all."""
    return WordEncoder(path)


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, planes: str) -> Iterator[pa.RecordBatch]:
    encode, part, chunk, start = encoder(path).encode, TaskContext.get().partitionId(), 0, 0
    doc_ids: list = []
    held: list[np.ndarray] = []
    count = 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate(held)
        payload, index = pack(ids, planes)
        row = [part, chunk, start, list(doc_ids), [len(x) for x in held], BLOCK_IDS, planes, index, payload]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in CHUNKS.split(", ")])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
            doc_ids.append(i), held.append(ids)
            count += len(ids)
            if count >= CHUNK_IDS:
                yield close()
                start, chunk, count = start + count, chunk + 1, 0
                doc_ids.clear(), held.clear()
    if held:
        yield close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte") -> None:
    """Encode every whole text and write the ids, each document closed by `end_id`, in ascending id order.

    Documents are dealt to tasks by ranges of their id and the beginning of their text
    (many rows may share an id) and sorted by id, then text; null ids come first, null and empty texts hold the end id alone, repeated rows are written
    each, an empty table gives a folder without chunks. Other columns are not read.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(lambda b: _write(b, tokenizer, end_id, planes), CHUNKS).write.option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            start, doc_ids, n_tokens, block, planes, index = (batch.column(c)[row].as_py() for c in ("start", "doc_ids", "n_tokens", "block_ids", "planes", "index"))
            sizes = np.array(n_tokens, np.int64)
            ids = unpack(memoryview(batch.column("payload")[row].as_buffer()), index, int(sizes.sum()), planes, block)
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), n_tokens)]
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """What the files hold, per document: doc_id, start (ids before it), n_tokens, ids_crc32."""
    chunks = spark.read.schema(CHUNKS).parquet(folder)
    totals = chunks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, at = [], 0
    for part, n in sorted(totals.collect()):  # a row for each task that wrote
        before.append((part, at))
        at += n
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    moved = chunks.join(offsets, "part").withColumn("start", F.col("before") + F.col("start")).select(*chunks.columns)
    return moved.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte", folder: str | None = None) -> DataFrame:
    """Write token files (into a new folder of the shared folder unless one is named) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/lectern/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, end_id, id_col, text_col, planes)
    return read_tokens(spark, folder)
