"""Token ids in binary shards whose document boundaries are Elias-Fano encoded.

A shard holds the ids of consecutive documents one after another. The place where each
document starts is a rising number; its low bits are packed, its high bits are gaps in unary
code, and every 64th one's position is sampled, so ``start(i)`` costs one short scan and the
boundaries take about 2 + log2(ids / documents) bits each instead of 64.

Shard, little-endian: magic ``PLEF``, version u16, id bytes u16, documents u64, ids u64,
low bits u32, words of low bits u32, words of high bits u32, samples u32, crc32 of all that
follows u32, pad u32; then doc ids i64[n], null flags u8[n] padded to 8, low u64[],
high u64[], samples u32[] padded to 8, ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, small_batches, stash, utf8
from .tokens import encoder, release

MAGIC, HEAD, EVERY = b"PLEF", struct.Struct("<4sHHQQIIIIII"), 64
#: Ids after which a shard ends, and texts in bytes that one range of doc ids aims at.
SHARD_IDS, RANGE_BYTES = 1 << 19, 32 << 20


class EliasFano:
    """Rising numbers v[0] <= v[1] <= ... <= universe."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.zeros((n * bits + 63) // 64, np.uint64)
        if bits and n:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift + np.uint64(bits)) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(ones[-1]) + 64) // 64 * 64) if n else 0, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64) if n else np.zeros(0, np.uint64)
        return cls(n, bits, low, high, ones[::EVERY].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = (shift + np.uint64(self.low_bits)) > np.uint64(64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """v[i], from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        word, value = at >> 6, int(self.high[at >> 6]) >> (at & 63) << (at & 63)
        while (n := value.bit_count()) <= left:
            left, word = left - n, word + 1
            value = int(self.high[word])
        for _ in range(left):
            value &= value - 1
        one = (word << 6) + (value & -value).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        return (((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(np.arange(self.n))).astype(np.int64)


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(doc_ids: list[int | None], arrays: list[np.ndarray]) -> bytes:
    """A shard of these documents."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint16)
    ef = EliasFano.encode(starts, int(sizes.sum()))
    body = (
        np.array([d or 0 for d in doc_ids], "<i8").tobytes() + _pad(bytes(d is None for d in doc_ids))
        + ef.low.tobytes() + ef.high.tobytes() + _pad(ef.samples.tobytes()) + ids.tobytes()
    )
    return HEAD.pack(MAGIC, 1, ids.dtype.itemsize, len(arrays), len(ids), ef.low_bits, len(ef.low), len(ef.high), len(ef.samples), zlib.crc32(body), 0) + body


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, raw: bytes):
        magic, version, width, self.n, self.n_ids, bits, low, high, samples, crc, _ = HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of token ids")
        if zlib.crc32(memoryview(raw)[HEAD.size :]) != crc:
            raise ValueError("a shard is damaged")
        at = HEAD.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, count, at)
            at += -(-out.nbytes // 8) * 8
            return out

        ids, null = take("<i8", self.n), take("u1", self.n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.bounds = EliasFano(self.n, bits, take("<u8", low), take("<u8", high), take("<u4", samples))
        self.ids = take(f"<u{width}", self.n_ids)

    def start(self, i: int) -> int:
        return self.bounds.select(i) if i < self.n else self.n_ids

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document."""
        return self.ids[self.start(i) : self.start(i + 1)]


def _folder(spark: SparkSession) -> str:
    """A new folder among the shared ones, as a URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/patternlens/{spark.sparkContext.applicationId}/token-shards-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _put(fs: pa.fs.FileSystem, folder: str, name: str, raw: bytes) -> None:
    """A whole file or none: a hidden name first, which no reader lists."""
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(raw)
    fs.move(own, f"{folder}/{name}")


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """(range_no, shard_no, n_docs, n_ids, shard) of the files in a folder; the numbers are in their names."""
    part = lambda k, kind: F.regexp_extract("path", r"ids-(\d+)-(\d+)-(\d+)-(\d+)\.plef$", k).cast(kind)
    files = spark.read.format("binaryFile").load(folder)
    return files.select(part(1, "int").alias("range_no"), part(2, "long").alias("shard_no"), part(3, "long").alias("n_docs"), part(4, "long").alias("n_ids"), F.col("content").alias("shard"))


def write_shards(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes every text and writes shards in rising order of doc id; returns the table of shards.

    Texts are dealt out by ranges of doc ids, as many as their bytes ask for, and each task encodes
    the texts of a range in order. Each shard is a file in the shared folder, written by the task that made it under a hidden
    name and then renamed, so a lost executor leaves no half file and a repeated task the same one.
    The table (range_no, shard_no, n_docs, n_ids, shard) reads these files. Null and empty texts have only
    the end id; null doc ids come first; equal doc ids stand in the order of a hash of the text, so that
    a frequent one spreads over several ranges; an
    empty table gives no shard. Other columns are not read. No group of rows is held: a shard is
    closed at ``shard_ids`` ids, and a longer document is a shard of its own.
    """
    folder = _folder(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], words.dtype)
        fs, place = pa.fs.FileSystem.from_uri(folder)
        number, held_ids, held, count = 0, [], [], 0

        def close() -> pa.RecordBatch:
            name = f"ids-{now:05d}-{number:06d}-{len(held)}-{count}.plef"
            _put(fs, place, name, pack(held_ids, held))
            return pa.record_batch([pa.array([name])], names=["name"])

        for batch in batches:
            offsets, data = utf8(batch.column(1))
            names = batch.column(0).to_pylist()
            for lo, hi in slices(offsets, 1 << 19):
                for d, ids in zip(names[lo:hi], words.encode(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]), strict=True):
                    more = len(ids) + len(end)
                    if held and count + more > shard_ids:
                        yield close()
                        number, held_ids, held, count = number + 1, [], [], 0
                    held_ids.append(d)
                    held.append(np.concatenate([ids, end]))
                    count += more
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = max(1, -(-int(rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0) // RANGE_BYTES))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(shards, "name string").agg(F.count("*")).collect()
    return shard_files(docs.sparkSession, folder)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone.

    ``start`` counts the ids of all documents before it, over all shards.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(batch.num_rows):
                r, s, raw = (c[k].as_py() for c in batch.columns)
                shard = Shard(raw)
                edges = np.array([shard.start(i) for i in range(shard.n + 1)], np.int64)
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                n = shard.n
                yield pa.record_batch(
                    [pa.array([r] * n, pa.int32()), pa.array([s] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())],
                    names=["range_no", "shard_no", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    sizes = shards.groupBy("range_no").agg(F.sum("n_ids").alias("n")).withColumn("range_start", F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = (
        shards.select("range_no", "shard_no", "n_ids")
        .withColumn("inner", F.coalesce(F.sum("n_ids").over(Window.partitionBy("range_no").orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(sizes, "range_no")
        .select("range_no", "shard_no", (F.col("range_start") + F.col("inner")).alias("shard_start"))
    )
    with small_batches(shards.sparkSession, rows=16):  # shards are large
        rows = stash(shards.select("range_no", "shard_no", "shard").mapInArrow(read, "range_no int, shard_no long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-documents")
    return rows.join(starts, ["range_no", "shard_no"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export(shards: DataFrame, folder: str) -> list[str]:
    """Writes each shard as a file of its own under a local folder, one at a time."""
    import os

    names = []
    for row in shards.orderBy("range_no", "shard_no").toLocalIterator():
        names.append(os.path.join(folder, f"ids-{row.range_no:05d}-{row.shard_no:06d}.plef"))
        with open(names[-1], "wb") as f:
            f.write(row.shard)
    return names

