"""Exact substring dedup by a depth-limited radix sort of suffixes.

Two suffixes belong together when their first `width` bytes are equal, and the sort stops at that depth. It goes by most
significant digits; at each digit the groups of one member drop out before anything deeper of them is made.

* First digit: ANCHOR bytes. Of the ANCHOR-byte strings within a window of `width` bytes, the one with the least hash (the anchor) is
  the window's first digit; its place in the window depends on the window's bytes alone. Neighbouring windows share their
  anchor, so the suffixes of a text are kept as runs: an anchor, and the windows that own it. Anchors that occur once drop out,
  and with them most suffixes.
* Whole runs. Runs with equal bytes are equal to the last digit; they need no more passes, and one of them stands for all.
* Further digits. The windows of a run are told apart by their offset from the anchor. A pass cuts the offsets
  of a run into ranges a quarter as long as before. All windows of a range share its core, the bytes that lie in each of them, and
  the core grows from pass to pass: with the standard sizes 73, 169, 193, 199, then all 200 bytes. A range whose core nothing else has
  drops out; one that equals another as a whole is settled as repeated; what is left goes to the next digit. At
  the last digit a range is a single window, so the groups of two and more are exactly the repeated windows.

So a border between repeated and other text costs a few rows a pass, not a row a window. The first digit's hash only
sorts out; equality is decided by 128-bit BLAKE2 digests of the bytes themselves, for which no two different strings with
one digest are known.

Cases: a null or empty text, or one shorter than the window, loses nothing; equal rows repeat each other, so all of their windows go;
ties between equal anchors of a window go to the last; a very long text is sorted in overlapping parts of CHUNK_BYTES, which gives the same
result; an empty table gives an empty result; rows that repeat a doc_id, or have none, are documents of their own; extra columns
are ignored by the operator and handed on by the pipeline stage, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.common import discard, map_arrow, materialise, packed, text_chunks, unpacked, with_rows
from tessella.llm.hashing import prefix, windows

WIDTH = 200
ANCHOR = 73


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value in each run of w values; the rightmost of equal ones."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(h) // w)
    filled = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    filled[: len(h)] = h
    filled = filled.reshape(blocks, w)
    place = np.arange(blocks * w, dtype=np.int64).reshape(blocks, w)
    low = np.minimum.accumulate(filled, axis=1)
    front = np.maximum.accumulate(np.where(filled == low, place, -1), axis=1).ravel()
    back = filled[:, ::-1]
    low = np.minimum.accumulate(back, axis=1)
    fresh = np.ones(back.shape, bool)
    fresh[:, 1:] = back[:, 1:] < low[:, :-1]
    # from the right: a place counts only where it is less than all to its right
    step = np.maximum.accumulate(np.where(fresh, np.arange(w), 0), axis=1)
    rear = np.ascontiguousarray((place[:, :1] + w - 1 - step)[:, ::-1]).ravel()
    a, b = rear[:n], front[w - 1 : w - 1 + n]
    return np.where(h[b] <= h[a], b, a)


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit digests of byte spans, as two signed 64-bit columns."""
    view = memoryview(np.ascontiguousarray(data))
    made = [hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), stop.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def _parts(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, number of the first text, place of the bytes in it); long texts come in parts that overlap by width - 1."""
    for first, end, data, offsets in text_chunks(texts):
        size = common.CHUNK_BYTES
        if end - first > 1 or len(data) < 2 * size:
            yield data, offsets, first, 0
            continue
        for at in range(0, len(data) - width + 1, size):
            part = data[at : at + size + width - 1]
            yield part, np.array([0, len(part)]), first, at


def _runs(batches: Iterator[pa.RecordBatch], width: int, k: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The runs of each text: h, the hash of the anchor; with `whole` also _row, lo, hi (first and last window), a (place of the anchor) and d1, d2, the digest of the run's bytes."""
    for batch in batches:
        rows = batch.column("_row").to_numpy()
        for data, offsets, number, base in _parts(batch.column("text"), width):
            n = np.diff(offsets) - width + 1
            full = np.flatnonzero(n > 0)
            if not len(full):
                continue
            h = windows(prefix(data), k)
            at = least_in_window(h, width - k + 1)
            n, begin = n[full], offsets[full]
            s = np.arange(n.sum()) + np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            owner = at[s]
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (s[1:] != s[:-1] + 1))))
            lo, hi, a = s[new], s[np.concatenate((new[1:], [len(s)])) - 1], owner[new]
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(h[a].view(np.int64))], names=["h"])
                continue
            doc = np.searchsorted(offsets, lo, "right") - 1
            shift = base - offsets[doc]
            d = digests(data, lo, hi + width)
            columns = h[a].view(np.int64), rows[number + doc], lo + shift, hi + shift, a + shift, d[:, 0], d[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["h", "_row", "lo", "hi", "a", "d1", "d2"])


def _with_bytes(batch: pa.RecordBatch, width: int) -> pa.Table:
    """The runs listed with each text, one a row, with their bytes."""
    out: list[dict] = []
    for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
        data = text.as_py().encode()
        out += [x | {"bytes": data[x["lo"] : x["hi"] + width]} for x in runs]
    return pa.Table.from_pylist(out, schema=pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("_row", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("a", pa.int64()), ("done", pa.bool_()), ("bytes", pa.binary())]))


def _ranges(batch: pa.RecordBatch, width: int, k: int, size: int, times: int) -> pa.Table:
    """Ranges of `size` offsets of runs: which (m), their first and last offset within the run, and digests of the core (c1, c2) and of all their bytes (g1, g2).

    A run comes with the ranges, `times` as long, that are left of it (null: all), and whether these are settled.
    """
    top = width - k
    keep, m, o1, o2, settled, core, own = [], [], [], [], [], [], []
    lo, hi, a, done = (batch.column(c).to_pylist() for c in ("lo", "hi", "a", "done"))
    for i, (data, left) in enumerate(zip(batch.column("bytes"), batch.column("left").to_pylist(), strict=True)):
        view, wanted = memoryview(data.as_py()), None if left is None else {x["m"]: x["done"] for x in left}
        least, most = a[i] - hi[i], a[i] - lo[i]  # the run's offsets; its anchor lies at `most` in its bytes
        for r in range(least // size, most // size + 1):
            if wanted is not None and r // times not in wanted:
                continue
            first, last = r * size, min(r * size + size - 1, top)
            x, y = max(first, least), min(last, most)
            keep.append(i), m.append(r), o1.append(x), o2.append(y), settled.append(done[i] if wanted is None else wanted[r // times])
            core.append(hashlib.blake2b(view[most - first : most - last + width], digest_size=16, key=b"%d" % r).digest())
            own.append(hashlib.blake2b(view[most - y : most - x + width], digest_size=16, key=b"%d" % r).digest())
    named = {c: batch.column(c).take(pa.array(keep, pa.int64())) for c in ("d1", "d2", "_row", "a")}
    named |= {"done": pa.array(settled, pa.bool_()), "m": pa.array(m, pa.int32()), "o1": pa.array(o1, pa.int32()), "o2": pa.array(o2, pa.int32())}
    for name, x in (("c", core), ("g", own)):
        columns = np.frombuffer(b"".join(x), np.int64).reshape(-1, 2)
        named |= {f"{name}{j + 1}": pa.array(np.ascontiguousarray(columns[:, j])) for j in (0, 1)}
    return pa.table(named)


def sizes(width: int, k: int) -> list[int]:
    """Lengths of the ranges of the digit passes: quarters of a power of two that holds all offsets, down to one."""
    out, s = [], 1 << (width - k).bit_length()
    while s > 1:
        s = max(1, s // 4)
        out.append(s)
    return out or [1]


def repeated_spans(rows: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """Byte intervals (_row, lo, hi; hi exclusive) of a table with _row and text that repeated windows cover; they may overlap."""
    texts = rows.select("_row", "text")
    anchors = texts.mapInArrow(lambda b: _runs(b, width, k, False), "h long")
    twice = materialise(anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "anchors")
    runs = texts.mapInArrow(lambda b: _runs(b, width, k, True), "h long, _row long, lo long, hi long, a long, d1 long, d2 long")
    runs = materialise(runs.join(twice, "h", "left_semi"), "runs")
    discard(twice)
    firsts = [F.first(c).alias(c) for c in ("_row", "lo", "hi", "a")]  # any of equal runs will do
    kinds = materialise(runs.groupBy("h", "d1", "d2").agg(F.count("*").alias("n"), *firsts), "kinds")
    out = [runs.join(kinds.where("n > 1").select("d1", "d2"), ["d1", "d2"], "left_semi").select("_row", "lo", (F.col("hi") + width).alias("hi"))]

    # anchors with runs of different bytes, of which at least one isn't settled
    mixed = kinds.groupBy("h").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 AND least = 1").select("h")
    one = F.struct("d1", "d2", "_row", "lo", "hi", "a", (F.col("n") > 1).alias("done"))
    listed = kinds.join(mixed, "h", "left_semi").groupBy("_row").agg(F.collect_list(one).alias("runs"))
    held = map_arrow(texts.join(listed, "_row").select("text", "runs"), lambda b: _with_bytes(b, width), "d1 long, d2 long, _row long, lo long, hi long, a long, done boolean, bytes binary")
    held = materialise(held, "mixed")
    left, before = None, 0
    for size in sizes(width, k):
        asked = held.withColumn("left", F.lit(None).cast("array<struct<m:int,done:boolean>>")) if left is None else held.join(left, ["d1", "d2"])
        made = map_arrow(asked, lambda b, size=size, times=before // size: _ranges(b, width, k, size, times), "d1 long, d2 long, _row long, a long, done boolean, m int, o1 int, o2 int, c1 long, c2 long, g1 long, g2 long")
        before = size
        made = materialise(made, "ranges")
        equal = made.groupBy("c1", "c2", "g1", "g2").agg(F.count("*").alias("n"), F.min("d1").alias("rep"), F.count_if(~F.col("done")).alias("live"))
        cores = equal.groupBy("c1", "c2").agg(F.sum("n").alias("nc"), F.sum("live").alias("alive")).where("nc > 1 AND alive > 0")
        equal = materialise(equal.join(cores, ["c1", "c2"]).select("c1", "c2", "g1", "g2", "n", "rep", "nc"), "equal")
        judged = made.join(equal, ["c1", "c2", "g1", "g2"])
        out.append(judged.where("n > 1 AND NOT done").select("_row", (F.col("a") - F.col("o2")).alias("lo"), (F.col("a") - F.col("o1") + width).alias("hi")))
        if size == 1:
            break
        # what equals nothing as a whole goes on; so does one of those that equal each other, settled, if others share the core
        on = judged.where("n = 1 OR d1 = rep AND nc > n").select("d1", "d2", F.struct("m", (F.col("done") | (F.col("n") > 1)).alias("done")).alias("x"))
        left = materialise(on.groupBy("d1", "d2").agg(F.collect_list("x").alias("left")), "left")
    spans = out[0]
    for more in out[1:]:
        spans = spans.union(more)
    return materialise(spans, "spans")


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint intervals with the same bytes; touching ones become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in gone:
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]])


def _intervals(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    return [merged([(x["lo"], x["hi"]) for x in s or ()]) for s in batch.column("spans").to_pylist()]


def with_spans(rows: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """The table with _row, and the spans that go: an array of (lo, hi), null where nothing goes."""
    spans_of = repeated_spans(rows, width, k).groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return rows.join(spans_of, "_row", "left")


def op4_suffix_array_dedup(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def f(batch: pa.RecordBatch) -> pa.Table:
        rows = []
        for text, gone in zip(batch.column("text"), _intervals(batch), strict=True):
            data = (text.as_py() or "").encode()
            rows.append((len(data), sum(hi - lo for lo, hi in gone), len(gone), hashlib.sha256(_cut(data, gone)).hexdigest()))
        cols = list(zip(*rows, strict=True))
        return pa.table({"doc_id": batch.column("doc_id"), **{c: pa.array(x, t) for c, x, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)}})

    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return map_arrow(with_spans(rows, width, k).select("doc_id", "text", "spans"), f, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pipeline stage: the texts without the bytes that repeated windows cover, n_chars counted anew where something goes.

    Bytes of a letter that a cut leaves incomplete go too. A document of which nothing but blanks is left goes.
    """
    held = with_spans(packed(docs), width).select("text", "spans", "_rest")
    schema = held.drop("spans").schema.add("_cut", "boolean")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cut = [], _intervals(batch)
        for text, gone in zip(batch.column("text"), cut, strict=True):
            whole = text.as_py()
            texts.append(whole if not gone else _cut(whole.encode(), gone).decode("utf-8", "ignore"))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("_rest"), pa.array([bool(g) for g in cut])], names=["text", "_rest", "_cut"])

    out = map_arrow(held, f, schema).where("NOT _cut OR trim(text) <> ''")
    return unpacked(out, docs.columns, n_chars=F.when(F.col("_cut"), F.char_length("text").cast("long")).otherwise(F.col("_rest.n_chars")))
