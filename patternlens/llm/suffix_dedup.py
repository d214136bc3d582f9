"""Removal of strings that occur elsewhere, by bucket-pointer refinement.

A text is a row of elements: its bytes, or its words by 64-bit hash. Which strings of W elements
start in more than one place is what a suffix array cut off at depth W tells: strings that share
a bucket at that depth. Sorting every suffix of a corpus is not needed for it. Each window of W
elements has an anchor, the short string in it whose hash is smallest (the first such); equal
windows have equal anchors at equal places. So suffixes are dealt out by anchor, anchors that
occur once are dropped, and only the surroundings of the others are sorted: buckets of first
grams are refined by sorting on pairs of bucket numbers, a string's own and that of the string h
elements later, to depth 2h and so on up to W. Each round uses the numbers the last one made, and
buckets of one string leave.

An anchor with very many different surroundings, as a passage has that stands in every third
document, is refined without bringing these together: windows are taken in blocks of
neighbouring starts. A row leaves a block if the string common to the block's windows stands in
no other row; the whole block is repeated if the string around all of them does; rows of which
neither is known go on in finer blocks, down to single windows, against each other and one of each
kind of settled rows of their bucket. Strings are counted with map-side combination.

Every window has an anchor and every pair of equal windows meets in its bucket, so nothing is
missed; the comparison is of whole elements, so nothing is found that is not there.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, SPACE, WORD, mix64, settle, slices, small_batches, stash, unstash, utf8, word_hashes, words

#: Surroundings sorted at once, and those of one anchor beyond which they are not brought together.
TOGETHER, CROWD = 384, 1_024
PIECE = 1 << 19
_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """The elements of a text, and how many make a string that counts as repeated, an anchor, a first gram."""

    window: int
    anchor: int  # a power of two
    gram: int
    words: bool = False

    @property
    def dtype(self) -> type:
        return np.uint64 if self.words else np.uint8

    @property
    def size(self) -> int:
        return 8 if self.words else 1

    @property
    def before(self) -> int:
        """Elements that a window may have ahead of its anchor."""
        return self.window - self.anchor

    @property
    def row(self) -> int:
        return self.before + self.window

    @property
    def steps(self) -> list[int]:
        """Starts in a block of windows, round by round."""
        return [s for s in (64, 8) if 2 * s < self.before] + [1]


#: Strings of 400 bytes; passages of over 50 words, whatever stands between the words.
BYTES, PASSAGES = Unit(400, 32, 8), Unit(51, 8, 1, words=True)


def elements(unit: Unit, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, values, start, end): the elements of each text, and the bytes where each starts and ends.

    Words of long buffers are hashed piece by piece, cut after white space.
    """
    if not unit.words:
        return offsets, data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        while hi < len(data):
            blank = np.flatnonzero(SPACE[data[lo:hi]])
            if len(blank):
                hi = lo + int(blank[-1]) + 1
                break
            hi = min(len(data), hi + PIECE)
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        start, end, _ = words(np.concatenate([[0], inner, [hi - lo]]), data[lo:hi])
        values.append(word_hashes(data[lo:hi], start, end))
        starts.append(start + lo)
        ends.append(end + lo)
        lo = hi
    start, end = np.concatenate(starts), np.concatenate(ends)
    return np.searchsorted(start, offsets), np.concatenate(values), start, end


def anchors(unit: Unit, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of the anchors of all windows in the elements; texts end at ``ends``.

    ``first`` and ``last`` are where the windows start that have this anchor.
    """
    n = len(data)
    if n < unit.window:
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    with np.errstate(over="ignore"):
        h, step, factor = data if unit.words else _BYTE[data], 1, 0x9E3779B97F4A7C15
        while step < unit.anchor:
            h = h[:-step] * _U(factor) + h[step:]
            step, factor = 2 * step, factor * factor % (1 << 64)
        h = mix64(h)
    bits = _U(max(1, int(n).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=_U)
    span, step = unit.before + 1, 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    inside = np.zeros(len(low) + 1, np.int32)
    start = np.concatenate([[0], ends[:-1]])
    whole = ends - start >= unit.window
    np.add.at(inside, start[whole], 1)
    np.add.at(inside, ends[whole] - unit.window + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(at):
        return anchors(unit, data[:0], ends[:0])
    place = (low[at] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.concatenate([[True], place[1:] != place[:-1]])  # anchors do not go back as windows go on
    return place[new], h[place[new]], at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]


def text_anchors(offsets: np.ndarray, data: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """(row, place in its text, hash, first, last) by elements; long texts are gone through piece by piece."""
    offsets, data, _, _ = elements(unit, offsets, data)
    found: list[tuple] = []
    for lo, hi in slices(offsets, PIECE):
        a, b = int(offsets[lo]), int(offsets[hi])
        alone = hi - lo == 1 and b - a > PIECE
        for c in range(a, b, PIECE) if alone else [a]:
            stop = min(b, c + PIECE + unit.window - 1) if alone else b
            place, h, first, last = anchors(unit, data[c:stop], np.minimum(offsets[lo + 1 : hi + 1], stop) - c)
            row = np.searchsorted(offsets, place + c, "right") - 1
            found.append((row, *(x + c - offsets[row] for x in (place, first, last)), h))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, _U))
    row, place, first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(row):  # an anchor's windows may lie in two pieces
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])]))
        row, place, h, first, last = row[new], place[new], h[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)
    return row, place, first, last, h


def repeated(group: np.ndarray, before: list[bytes], after: list[bytes], unit: Unit = BYTES) -> np.ndarray:
    """Bool [rows, unit.before + 1]: whether the window that starts there stands in another row of the group.

    A row is the surroundings of one anchor, laid out so that anchors stand below each other;
    only windows at the same distance from the anchor are compared, so a place never meets itself.
    """
    m, width, reach_back, window = len(before), unit.row, unit.before, unit.window
    raw = np.zeros((m, width), unit.dtype)
    first = np.array([reach_back - len(b) // unit.size for b in before])
    last = np.array([reach_back + len(a) // unit.size for a in after])
    for i, (b, a) in enumerate(zip(before, after, strict=True)):
        raw[i, first[i] : last[i]] = np.frombuffer(b + a, unit.dtype)
    starts = np.arange(reach_back + 1)
    whole = (starts >= first[:, None]) & (starts + window <= last[:, None])
    at = np.arange(width)
    live = (at >= first[:, None]) & (at + unit.gram <= last[:, None])
    if unit.words:
        gram = raw
    else:
        gram = np.zeros((m, width), _U)
        gram[:, : width - unit.gram + 1] = np.lib.stride_tricks.sliding_window_view(raw, unit.gram, 1).copy().view(_U)[:, :, 0]
    bucket = np.full((m, width), -1, np.int64)
    place = np.flatnonzero(live)
    _, number = np.unique(gram.ravel()[place], return_inverse=True)
    key = (group[place // width] * width + place % width) * (int(number.max(initial=0)) + 1) + number
    depth = unit.gram
    while True:
        _, number, size = np.unique(key, return_inverse=True, return_counts=True)
        keep = size[number] > 1
        bucket[:] = -1
        bucket.ravel()[place[keep]] = number[keep]
        # a window is open while all strings in it share buckets; strings of no open window leave
        shut = np.zeros((m, width + 1), np.int32)
        np.cumsum(bucket < 0, axis=1, out=shut[:, 1:])
        reach = window - depth + 1
        open_ = whole & (shut[:, reach : reach + reach_back + 1] == shut[:, : reach_back + 1])
        if depth == window:
            return open_
        change = np.zeros((m, width + 1), np.int32)
        change[:, : reach_back + 1] += open_
        change[:, reach : reach + reach_back + 1] -= open_
        bucket[np.cumsum(change, axis=1)[:, :width] == 0] = -1
        step = min(depth, window - depth)
        place = np.flatnonzero(bucket >= 0)
        place = place[place % width + step < width]
        later = bucket.ravel()[place + step]
        place, later = place[later >= 0], later[later >= 0]
        key = bucket.ravel()[place] * (int(later.max(initial=0)) + 1) + later
        depth += step


def runs(flags: np.ndarray, unit: Unit = BYTES) -> list[tuple[int, int]]:
    """The stretches [lo, hi), counted from the anchor, that the flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > unit.window)
    return [(int(a) - unit.before, int(b) - unit.before + unit.window) for a, b in zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])], strict=True)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_SPAN_SQL = "array<struct<lo:int,hi:int>>"


def _base(docs: DataFrame, text_col: str, unit: Unit) -> DataFrame:
    """(text_key, hash, place, first, last): the anchors of each row that is long enough, texts told apart by md5."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in slices(offsets, PIECE):
                row, place, first, last, h = text_anchors(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], unit)
                if len(row):
                    own = [pa.array(x, pa.int32()) for x in (place, first, last)]
                    yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(h.view(np.int64)), *own], names=["text_key", "hash", "place", "first", "last"])

    with small_batches(docs.sparkSession):
        return stash(_long(docs, text_col, unit).mapInArrow(find, "text_key binary, hash long, place int, first int, last int"), "anchors")


def _long(docs: DataFrame, text_col: str, unit: Unit) -> DataFrame:
    """(text_key, text) of the rows that may hold a window; words take a byte each and one between them."""
    least = 2 * unit.window - 1 if unit.words else unit.window
    return docs.where(F.octet_length(text_col) >= least).select(F.unhex(F.md5(text_col)).alias("text_key"), F.col(text_col).alias("text"))


def _surroundings(suspects: DataFrame, unit: Unit) -> DataFrame:
    """(hash, around, text_key, place, before, after) of each anchor: the elements of its windows. They stand with the first of equal surroundings a worker sees."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for a, b in slices(offsets, PIECE):
                at, data, _, _ = elements(unit, offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]])
                lists = batch.column(2).slice(a, b - a)
                flat, cuts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b - a), cuts)
                place, first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2, 3))
                begin = at[row]
                keys, before, after = np.zeros(len(row), np.int64), [], []
                for k, (h, p, lo, hi, n) in enumerate(zip(flat.field(1).to_pylist(), (begin + place).tolist(), (begin + first).tolist(), (begin + last + unit.window).tolist(), (place - first).tolist(), strict=True)):
                    both = data[lo:hi].tobytes()
                    key = int.from_bytes(hashlib.blake2b(both, digest_size=8, salt=n.to_bytes(2, "little")).digest(), "little", signed=True)
                    keys[k] = key
                    if (known := (h, key)) in seen:
                        before.append(None)
                        after.append(None)
                        continue
                    if len(seen) < 200_000:
                        seen.add(known)
                    before.append(both[: (p - lo) * unit.size])
                    after.append(both[(p - lo) * unit.size :])
                yield pa.record_batch([flat.field(1), pa.array(keys), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["hash", "around", "text_key", "place", "before", "after"])

    return suspects.select("text_key", "text", "found").mapInArrow(cut, "hash long, around long, text_key binary, place int, before binary, after binary")


def _sorted(rows: DataFrame, unit: Unit) -> DataFrame:
    """(hash, around, spans) of different surroundings that share an anchor, by refinement within each anchor."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            group = np.unique(np.array([x[0] for x in held]), return_inverse=True)[1]
            found = [runs(f, unit) for f in repeated(group, [x[2] for x in held], [x[3] for x in held], unit)]
            hit = [i for i, s in enumerate(found) if s]
            return pa.record_batch([pa.array([held[i][0] for i in hit], pa.int64()), pa.array([held[i][1] for i in hit], pa.int64()), pa.array([[{"lo": a, "hi": b} for a, b in found[i]] for i in hit], _SPANS)], names=["hash", "around", "spans"])

        now = None
        for batch in batches:
            b_at, b_raw = utf8(batch.column(2))
            a_at, a_raw = utf8(batch.column(3))
            for i, (h, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if h != now and len(held) >= TOGETHER:
                    yield flush()
                    held = []
                now = h
                held.append((h, key, b_raw[b_at[i] : b_at[i + 1]].tobytes(), a_raw[a_at[i] : a_at[i + 1]].tobytes()))
        if held:
            yield flush()

    return rows.repartition("hash").sortWithinPartitions("hash", "around").select("hash", "around", "before", "after").mapInArrow(refine, f"hash long, around long, spans {_SPAN_SQL}")


def _crowded(rows: DataFrame, unit: Unit) -> DataFrame:
    """The same for anchors with a crowd of different surroundings, a round for each size of block.

    A block is ``step`` windows that start from ``at`` to ``at + step - 1`` elements before the anchor.
    """

    def strings(step: int):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            window, size = unit.window, unit.size
            for batch in batches:
                out: tuple = ([], [], [], [], [])
                for h, key, before, after, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    both, left, right = before + after, len(before) // size, len(after) // size
                    low, high = max(0, window - right), left  # the windows that this row has
                    if blocks is None:
                        todo = range(0, unit.before + 1, step)
                    else:
                        todo = (a for x in blocks for a in range(x["at"], min(x["at"] + x["step"], unit.before + 1), step))
                    for at in todo:
                        end = min(at + step - 1, unit.before)
                        if end < low or at > high:
                            continue
                        salt = struct.pack("<qhh", h, at, step)
                        inner = hashlib.blake2b(both[(left - at) * size : (left + window - end) * size], digest_size=16, key=salt).digest()
                        outer = None
                        if step > 1 and end <= left and window - at <= right:
                            outer = hashlib.blake2b(both[(left - end) * size : (left + window - at) * size], digest_size=16, key=salt).digest()
                        for column, value in zip(out, (h, key, at, inner, outer), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["hash", "around", "at", "inner", "outer"])

        return cut

    rows = stash(rows.select("hash", "around", "before", "after"), "crowds")
    todo, done = rows.withColumn("blocks", F.lit(None).cast("array<struct<at:int,step:int>>")), []
    for step in unit.steps:
        each = stash(todo.mapInArrow(strings(step), "hash long, around long, at int, inner binary, outer binary"), "crowd-strings")
        inner, outer = (stash(each.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").select(c), "crowd-repeats") for c in ("inner", "outer"))
        found = each.join(inner, "inner", "left_semi")
        found = found.join(outer.withColumn("whole", F.lit(True)), "outer", "left") if step > 1 else found.withColumn("whole", F.lit(True))
        found = stash(found.select("hash", "around", "at", "inner", "outer", F.coalesce("whole", F.lit(False)).alias("whole")), "crowd-blocks")
        unstash(each)
        end = F.least(F.col("at") + (step - 1), F.lit(unit.before))
        done.append(found.where("whole").select("hash", "around", F.array(F.struct((-end).cast("int").alias("lo"), (unit.window - F.col("at")).cast("int").alias("hi"))).alias("spans")))
        if step > 1:
            # what is settled has partners among rows alike around the whole block; one of these stays for the others' sake
            open_ = found.where("not whole").select("hash", "around", "at", "inner")
            buckets = stash(open_.select("inner").distinct(), "crowd-open")
            alike = found.where("whole").groupBy("outer").agg(F.min(F.struct("hash", "around", "at", "inner")).alias("one")).select("one.*")
            rest = open_.unionByName(alike.join(buckets, "inner", "left_semi"))
            todo = rows.join(rest.groupBy("hash", "around").agg(F.collect_list(F.struct("at", F.lit(step).alias("step"))).alias("blocks")), ["hash", "around"])
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(docs: DataFrame, *, text_col: str = "text", unit: Unit = BYTES, crowd: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(text_key, copies) of the texts that occur more than once, and (text_key, text, spans) of those with repeated elements.

    Both tables are written ones, and so are the sides of every join on an anchor or its
    surroundings, so that Spark can split the rows of a frequent one.
    """
    crowd = CROWD if crowd is None else crowd
    spark = docs.sparkSession
    base = _base(docs, text_col, unit)
    where = F.xxhash64("text_key", "place")
    often = stash(base.groupBy("hash").agg(F.min(where).alias("x"), F.max(where).alias("y")).where("x <> y").select("hash"), "frequent-anchors")
    found = base.join(often, "hash", "left_semi").groupBy("text_key").agg(F.collect_set(F.struct("place", "hash", "first", "last")).alias("found"))
    texts = _long(docs, text_col, unit).groupBy("text_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    copies = _long(docs, text_col, unit).groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1")
    with small_batches(spark):
        suspects = stash(texts.select("text_key", "text").join(found, "text_key"), "suspects")
        unstash(base)
        around = stash(_surroundings(suspects, unit), "surroundings")
        kinds = around.groupBy("hash", "around").agg(F.count("*").alias("n"), F.first("before", True).alias("before"), F.first("after", True).alias("after"))
        kinds = stash(kinds, "kinds")
        slim = stash(around.select("hash", "around", "text_key", "place"), "anchored")
        unstash(around)
        settle(spark)
        crowds = stash(kinds.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchor-crowds")
        parts = _sorted(kinds.join(crowds.where(F.col("kinds") <= crowd), "hash", "left_semi"), unit)
        if crowds.where(F.col("kinds") > crowd).limit(1).count():
            parts = parts.unionByName(_crowded(kinds.join(crowds.where(F.col("kinds") > crowd), "hash", "left_semi"), unit))
        length = lambda c: (F.octet_length(c) / unit.size).cast("int")
        same = kinds.where("n > 1").select("hash", "around", F.array(F.struct((-length("before")).alias("lo"), length("after").alias("hi"))).alias("spans")).where(f"spans[0].hi - spans[0].lo >= {unit.window}")
        spans = stash(parts.unionByName(same), "spans")
        unstash(kinds)
    placed = slim.join(spans, ["hash", "around"]).select("text_key", F.explode(F.transform("spans", lambda s: F.struct((F.col("place") + s.lo).alias("lo"), (F.col("place") + s.hi).alias("hi")))).alias("span"))
    by_text = placed.groupBy("text_key").agg(F.collect_set("span").alias("spans"))
    return copies, suspects.select("text_key", "text").join(by_text, "text_key")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the characters that lie in them wholly."""
    out = []
    for lo, hi in spans:
        while lo < hi and lo < len(text) and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


#: A text of at least as many words as a passage has.
_PASSAGE = rf"^[\x20\x09-\x0D]*+(?:{WORD}+[\x20\x09-\x0D]++){{{PASSAGES.window - 1}}}{WORD}"


def _core(text: Column) -> Column:
    """Bytes from the first word to the last."""
    blanks = F.lit(" \t\n\v\f\r")
    return F.octet_length(F.ltrim(F.reverse(F.ltrim(text, blanks)), blanks)).cast("long")


def _cuts(docs: DataFrame, text_col: str, unit: Unit, crowd: int | None, with_text: bool) -> DataFrame:
    """(text_key, copies, removed, spans, sha, kept) of the texts that occur more than once or hold repeated elements, as a written table."""
    copies, cut = repeated_spans(docs, text_col=text_col, unit=unit, crowd=crowd)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = utf8(batch.column(1))
            removed, count, sha, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]].tobytes()
                spans = merge([(s["lo"], s["hi"]) for s in batch.column(2)[i].as_py()])
                if unit.words:
                    start, end = elements(unit, at[i : i + 2] - at[i], data[at[i] : at[i + 1]])[2:]
                    spans = [(int(start[lo]), int(end[hi - 1])) for lo, hi in spans]
                removed.append(sum(hi - lo for lo, hi in spans))
                count.append(len(spans))
                sha.append(hashlib.sha256(_cut(text, spans)).hexdigest())
                kept.append(_cut(text, whole_characters(text, spans)).decode() if with_text else None)
            yield pa.record_batch([batch.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], names=["text_key", "removed", "spans", "sha", "kept"])

    with small_batches(docs.sparkSession):
        measured = cut.select("text_key", "text", "spans").mapInArrow(measure, "text_key binary, removed long, spans long, sha string, kept string")
        known = stash(copies.join(measured, "text_key", "full"), "cut-texts")
    unstash(cut)
    return known


def dedup_report(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: Unit = BYTES, crowd: int | None = None, with_text: bool = False, carry: tuple[str, ...] = (), passages: bool = False
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row, plus ``kept_text`` if asked for, and ``carried``: a struct of the ``carry`` columns.

    An element of ``unit`` goes if a string of ``unit.window`` elements that also starts elsewhere,
    in the same row or another, covers it; a run of words goes with what stands between them, and
    what stands before the first and after the last one stays. Null and empty texts, and texts
    shorter than a window, lose nothing; repeated rows count as places of their own, so long ones
    lose all they hold; ids may be null or repeat; an empty table gives none. Other columns are
    not read. ``kept_text`` leaves characters whole: one that is removed in part stays.

    With ``passages``, ``n_passage_bytes`` and ``n_passages`` follow: how many bytes runs of over 50
    words take that also start elsewhere, and how many such runs there are. They are only counted;
    a short one may be less than a string of ``unit``, so that nothing of it goes.
    """
    if passages:
        others = _cuts(docs, text_col, PASSAGES, crowd, False).select("text_key", F.col("copies").alias("others"), F.col("removed").alias("passage_bytes"), F.col("spans").alias("passages"))
        settle(docs.sparkSession)
    known = _cuts(docs, text_col, unit, crowd, with_text)
    if passages:
        known = stash(known.join(others, "text_key", "full"), "cuts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = with_text or unit.words
    rows = docs.select(F.col(id_col), F.unhex(F.md5(text)).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"), *([F.col(text_col).alias("text")] if whole else []), *([F.struct(*carry).alias("carried")] if carry else []), *([text.rlike(_PASSAGE).alias("worded"), _core(text).alias("core")] if passages else []))
    out = rows.join(known, "text_key", "left")
    # what a text keeps that occurs more than once: nothing, or the white space around its words
    all_gone, rest = F.coalesce(F.col("copies") > 1, F.lit(False)), F.lit("")
    if unit.words:
        all_gone = F.when(all_gone, F.regexp_count("text", F.lit(WORD)) >= unit.window).otherwise(F.lit(False))
        rest = F.concat(F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0), F.regexp_extract("text", r"[\x20\x09-\x0D]*\z", 0))
    zero = F.lit(0).cast("long")
    all_passage = F.coalesce(F.col("others") > 1, F.lit(False)) & F.col("worded") if passages else None
    return out.select(
        F.col(id_col),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes") - F.octet_length(rest)).otherwise(F.coalesce("removed", zero)).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(all_gone, F.sha2(rest.cast("binary"), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        *([F.when(all_gone, rest).otherwise(F.coalesce("kept", "text")).alias("kept_text")] if with_text else []),
        *(["carried"] if carry else []),
        *([F.when(all_passage, F.col("core")).otherwise(F.coalesce("passage_bytes", zero)).alias("n_passage_bytes"), F.when(all_passage, F.lit(1).cast("long")).otherwise(F.coalesce("passages", zero)).alias("n_passages")] if passages else []),
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: Unit = BYTES) -> DataFrame:
    """The rows of ``docs`` without their repeated bytes or, with PASSAGES, repeated runs of words.

    Same columns and as many rows, null texts still null; ``n_chars`` is counted anew where there
    is one. All else is as :func:`dedup_report` says; columns of any other name are carried along.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    out = dedup_report(docs, id_col=id_col, text_col=text_col, unit=unit, with_text=True, carry=others)
    text = F.col("kept_text")
    columns = {id_col: F.col(id_col), text_col: text} | {c: F.col("carried").getField(c) for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(columns[c].alias(c) for c in docs.columns))
