"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here; normaliser, metaspace marker, scores or merges, and byte
fallback are rebuilt from it. A worker checks its backend against the sentencepiece library on
fixed texts before it encodes anything, and on a share of the corpus while it encodes.
Pieces are turned back into bytes here, not by the library's byte fallback: that gives up a
whole run of bytes where one of them is wrong, sentencepiece that byte alone.
"""

from __future__ import annotations

import codecs
import heapq
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .common import slices, utf8, word_hashes
from .tokens import ChunkCache, encoder

SPACE = "▁"
#: Kinds of pieces and of models, as numbered in the model's format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PROBES = ("", " ", "Hello world", "  two  spaces   three\n\ttab", "café 日本語 \U0001f600", "a" * 50, "<s> </s> <unk> <0x41>", "x▁y", "1234567890 3.14", "    " * 9 + "end ")
#: One in so many texts, by a hash of its bytes, is encoded by the sentencepiece library as well.
CHECKED = 1_000

codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message; nested messages as bytes, floats as bytes of four."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    unk: int = 0

    @classmethod
    def read(cls, path: str) -> Model:
        out = cls()
        with open(path, "rb") as f:
            raw = f.read()
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                out.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                out.kind, out.unk = trainer.get(3, UNIGRAM), trainer.get(40, 0)
            elif number == 3:
                spec = dict(_fields(value))
                out.charsmap, out.dummy_prefix, out.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if out.kind not in (UNIGRAM, BPE) or any(k == USER for _, _, k in out.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are rebuilt")
        return out


class PieceEncoder:
    """Encodes and decodes like ``SentencePieceProcessor(model_file=path)``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Regex, Tokenizer, models, normalizers

        self.path, self.model, self.peer = path, Model.read(path), None
        pieces = self.model.pieces
        self.normal = {p: (s, i) for i, (p, s, k) in enumerate(pieces) if k in (NORMAL, UNUSED)}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.ids = {p: i for i, (p, _, _) in enumerate(pieces)}
        fallback = len(self.bytes) == 256
        if self.model.kind == BPE:
            merges = []
            for p, (score, i) in self.normal.items():
                merges += [(-score, i, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in self.normal and p[k:] in self.normal]
            core = models.BPE({p: i for p, i in self.ids.items()}, [(a, b) for _, _, a, b in sorted(merges)], unk_token=pieces[self.model.unk][0], fuse_unk=True, byte_fallback=fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in pieces], self.model.unk, fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(self.model.charsmap)] if self.model.charsmap else []
        if self.model.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        self.normalise = normalizers.Sequence(steps) if steps else None
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in self.normal)
        self.dtype = np.uint16 if len(pieces) <= 1 << 16 else np.uint32
        self.raw = [b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.silent = np.array([k == CONTROL for _, _, k in pieces])
        self.marked = np.array([k not in (CONTROL, BYTE, UNKNOWN) and p.startswith(SPACE) for p, _, k in pieces])
        self.cache = ChunkCache(self._encode, self.dtype, 500_000)
        self.verify(PROBES)

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        marked = [c.replace(" ", SPACE) for c in chunks]
        easy = [i for i, c in enumerate(marked) if self.model.kind != BPE or SPACE * 2 not in c]
        out: list = [None] * len(chunks)
        for i, e in zip(easy, self.tokenizer.encode_batch_fast([marked[i] for i in easy], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int64)
        for i, x in enumerate(out):
            if x is None:
                out[i] = np.array(self._by_score(marked[i]), np.int64)
        return out

    def _by_score(self, text: str) -> list[int]:
        """BPE by score, the leftmost of equals first: pieces of spaces share one score, which ranked merges can't say."""
        part = list(text)
        before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        queue: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := self.normal.get(part[a] + part[b])):
                heapq.heappush(queue, (-found[0], a, b, len(part[a]), len(part[b])))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, m, n = heapq.heappop(queue)
            if len(part[a]) != m or len(part[b]) != n or after[a] != b or not part[a] or not part[b]:
                continue
            part[a], part[b] = part[a] + part[b], ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for p in part:
            if p in self.normal:
                out.append(self.normal[p][1])
            elif p:
                out += [self.bytes[x] for x in p.encode()] if self.bytes else [self.model.unk]
        return out

    def _prepared(self, text: str) -> str:
        if self.normalise:
            text = self.normalise.normalize_str(text)
        return " " + text if self.model.dummy_prefix and text else text

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """An array of ids for each text."""
        marked = SPACE.encode() in data.tobytes()  # the marker itself in a text counts as a space
        if self.normalise or self.model.dummy_prefix or marked:
            raw = [self._prepared(data[a:b].tobytes().decode()).replace(SPACE, " ").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
        n = len(offsets) - 1
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        first[len(data)] = False
        start = np.flatnonzero(first[:-1])
        if self.chunked and len(data):
            space = data == 32
            head = first[:-1].copy()
            head[1:] |= space[1:] & ~space[:-1]
            head |= first[:-1]
            start = np.flatnonzero(head)
        end = np.append(start[1:], len(data))[: len(start)]
        row = np.searchsorted(offsets, start, "right") - 1
        ids, sizes = self.cache.ids(word_hashes(data, start, end), lambda i: data[start[i] : end[i]].tobytes().decode())
        edges = np.concatenate([[0], np.cumsum(np.bincount(row, sizes, n))]).astype(np.int64)
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        return self.encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. A control piece is nothing but ends a run of bytes; a first space goes only with a piece's own marker."""
        said = ids[~self.silent[ids]]
        runs = np.split(ids, np.flatnonzero(self.silent[ids])) if len(said) < len(ids) else [ids]
        text = "".join([b"".join([self.raw[i] for i in run.tolist()]).decode(errors="each_byte") for run in runs])
        return text[1:] if self.model.dummy_prefix and len(said) and self.marked[said[0]] else text

    def verify(self, texts) -> None:
        """Raises unless ids and decoded texts equal the sentencepiece library's."""
        for text, ids in zip(texts, self.encode_texts(list(texts)), strict=True):
            self.compare(text, ids)

    def compare(self, text: str, ids: np.ndarray) -> None:
        if self.peer is None:
            import sentencepiece

            self.peer = sentencepiece.SentencePieceProcessor(model_file=self.path)
        want = self.peer.encode(text)
        if ids.tolist() != want or self.decode(ids) != self.peer.decode(want):
            raise ValueError(f"the tokenizers backend differs from sentencepiece on {text[:200]!r}")


def encode_documents(docs: DataFrame, model_path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, checked: int = CHECKED) -> DataFrame:
    """The ``keep`` columns, n_tokens, ids_crc32, round_trip and, if asked for, ids of every row.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers; ``round_trip`` says
    whether decoding gives the text back. Null counts as the empty text, which has no ids. Ties
    and repeated rows are rows of their own; an empty table gives none. A long text is encoded
    whole. Only the named columns are read; a kept column with the name of a result has ``kept_`` before it.
    One in ``checked`` texts (0: none) is compared with the sentencepiece library; a difference is an error.
    """
    ship(docs.sparkSession)
    results = ("n_tokens", "ids_crc32", "round_trip", *["ids"] * with_ids)
    names = [f"kept_{c}" if c in results else c for c in keep]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model_path, PieceEncoder)
        for batch in batches:
            offsets, data = utf8(batch.column(0))
            for lo, hi in slices(offsets, 1 << 20):
                found = pieces.encode(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])
                if checked:
                    for i, x in enumerate(found, lo):
                        raw = data[offsets[i] : offsets[i + 1]].tobytes()
                        if zlib.crc32(raw) % checked == 0:
                            pieces.compare(raw.decode(), x)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
                same = [pieces.decode(x).encode() == data[offsets[i] : offsets[i + 1]].tobytes() for i, x in enumerate(found, lo)]
                columns = [*(batch.column(k).slice(lo, hi - lo) for k in range(1, batch.num_columns)), pa.array([len(x) for x in found], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).astype(np.int32) if found else [], pa.int32())))
                yield pa.record_batch(columns, names=[*names, *results])

    kept = ", ".join(f"`{name}` {docs.schema[c].dataType.simpleString()}" for name, c in zip(names, keep, strict=True))
    return docs.select(F.col(text_col), *keep).mapInArrow(encode, f"{kept}, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def decode_documents(rows: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of ``rows`` but ``ids_col``, and the text of its ids under ``text_col``.

    Null ids are the empty text, a null among them counts as the unknown piece, an id outside the
    model is an error. Bytes that are no UTF-8 come as U+FFFD each. An existing ``text_col`` is
    replaced; an empty table gives none; repeated rows stay rows of their own.
    """
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c not in (ids_col, text_col)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model_path, PieceEncoder)
        for batch in batches:
            texts = []
            for ids in batch.column(0):
                own = np.array([pieces.model.unk if i is None else i for i in ids.as_py() or []], np.int64)
                if len(own) and not 0 <= own.min() <= own.max() < len(pieces.raw):
                    raise ValueError("an id outside the model")
                texts.append(pieces.decode(own))
            yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string())], names=[*keep, text_col])

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(F.col(f"`{ids_col}`"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(decode, f"{kept}`{text_col}` string")
