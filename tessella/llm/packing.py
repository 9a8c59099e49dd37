"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each document is its token ids and an end id. A document longer than a sequence is cut into full pieces; only its first
piece may be shorter. Pieces are dealt at random into groups of bounded size; a group places its pieces best-fit,
longest first, and then improves the bins by local search: one-for-one and two-for-one exchanges and moves between underfull
bins, each of which raises the sum of squared fills, until no free bin is left to win or nothing raises it. The bins that a group leaves
emptier than LEFT are packed anew with those of other groups, until one group is left. The number of groups grows with the
data, the size of a group doesn't, so a skewed source or one huge document changes nothing.

Cases: a null or empty text is a document of the end id alone; repeated rows, and rows that repeat a doc_id or have none, are packed as often
as they occur; ties go to the smaller doc_id and piece; a very long text is many full pieces; an empty table gives an empty result; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs together.
GROUP_PIECES = 4096
#: Bins emptier than this are packed again with those of other groups.
LEFT = 0.9
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000
#: White space beside a space, and rarer kinds of white space: such texts are encoded whole.
_SPACE_RUNS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class WordEncoder:
    """Ids of a byte-level BPE, word by word.

    A single space between two characters that aren't white space always begins a new word of this tokenizer's pattern, so the
    text between two such spaces is encoded once and remembered. Texts with the end-of-text string, which the tokenizer
    reads as one token, go to the tokenizer whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: str = "<|endoftext|>"):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = Tokenizer.from_file(json_path)
        self.ordinary = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = special
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.special in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _OTHER_SPACE.search(text) or any(x in text for x in _SPACE_RUNS) or text[:1].isspace() or text[-1:].isspace():
            return self._ids(text)
        words = text.split(" ")
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        first = self._ids(words[0])
        try:
            return first + b"".join([known[w] for w in words[1:]])
        except KeyError:
            out = [first]
            for w in words[1:]:
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = self._ids(" " + w)
                out.append(ids)
            return b"".join(out)


@lru_cache(maxsize=1)
def public_encoder() -> WordEncoder:
    """The 50k byte-level BPE of the public tokenizer files, once a worker."""
    import public_tokenizers as p

    return WordEncoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, encoder=public_encoder) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; the ids themselves aren't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder().encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    stop = start + ((n - start) % capacity or capacity) if not start else start + capacity
                    out.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, k = stop, k + 1
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = defaultdict(list)  # by free space, the bins that have it
    sizes: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(sizes, lengths[i])
        if at == len(sizes):
            bins.append([i])
            left, b = capacity - lengths[i], len(bins) - 1
        else:
            free = sizes[at]
            b = room[free].pop()
            if not room[free]:
                del sizes[at]
            bins[b].append(i)
            left = free - lengths[i]
        if left:
            if not room[left]:
                insort(sizes, left)
            room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Exchanges items between underfull bins while the sum of squared fills rises; bins that run empty go.

    From a donor an item moves into a bin with room for it; or one item of the donor is
    exchanged for a smaller one of a fuller bin; or for two smaller ones whose sum is less. All make the fuller bin fuller.
    The emptiest quarter of the bins are donors at first, and more of them as soon as these find nothing.
    """
    bins = [b[:] for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    share = 4
    while share:
        under = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: (fill[k], k))
        if len(under) < 2 or sum(capacity - fill[k] for k in under) < capacity:
            break  # the free space is less than a bin: none can run empty
        changed = False
        for d in under[: max(1, len(under) // share)]:
            for t in reversed(under):
                free = capacity - fill[t]
                if t == d or not free or not bins[t] or fill[t] < fill[d]:
                    continue
                gain, give, take = 0, -1, ()
                own = sorted(bins[t], key=lambda i: lengths[i])
                for i in bins[d]:
                    x = lengths[i]
                    if gain < x <= free:
                        gain, give, take = x, i, ()
                    for j in own:
                        y = lengths[j]
                        if y >= x:
                            break
                        if gain < x - y <= free:
                            gain, give, take = x - y, i, (j,)
                    lo, hi = 0, len(own) - 1
                    while lo < hi:  # two pointers: pairs of the target with the least sum that still fits
                        y = lengths[own[lo]] + lengths[own[hi]]
                        if x - free <= y < x:
                            if x - y > gain:
                                gain, give, take = x - y, i, (own[lo], own[hi])
                            hi -= 1
                        elif y >= x:
                            hi -= 1
                        else:
                            lo += 1
                if give >= 0:
                    bins[d].remove(give)
                    bins[t].append(give)
                    for j in take:
                        bins[t].remove(j)
                        bins[d].append(j)
                    fill[t] += gain
                    fill[d] -= gain
                    changed = True
                if not bins[d]:
                    break
        if not changed:
            share //= 2
    return [b for b in bins if b]


def _pack(group: pd.DataFrame, capacity: int, turn: int) -> pd.DataFrame:
    """Places the pieces of a group: sequence_id, offset, fill of the sequence."""
    group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = group["length"].to_numpy()
    full = int(np.searchsorted(-lengths, -capacity, "right"))
    sequence, offset, fill = np.arange(len(group), dtype=np.int64), np.zeros(len(group), np.int64), np.full(len(group), capacity)
    rest = lengths[full:].tolist()
    for k, b in enumerate(local_search(best_fit(rest, capacity), rest, capacity)):
        at = 0
        for i in b:
            sequence[full + i], offset[full + i] = full + k, at
            at += rest[i]
        fill[[full + i for i in b]] = at
    group["sequence_id"] = (turn << 56) + (group["grp"].to_numpy() << 24) + sequence
    group["offset"], group["fill"] = offset, fill
    return group


def _packer(names: list[str], capacity: int, turn: int):
    return lambda group: _pack(group, capacity, turn)[names]


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start, length (at most capacity) and ids_crc32."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    left, done, before = piece_rows.select(*columns), [], None
    for turn in range(64):
        n = left.count()
        groups = max(1, -(-n // group_pieces))
        dealt = left.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        schema = dealt.select("*").schema.add("sequence_id", "long").add("offset", "long").add("fill", "long")
        made = dealt.groupBy("grp").applyInPandas(_packer(schema.names, capacity, turn), schema)
        if groups == 1 or groups == before:  # one group, or nothing won by the last turn
            done.append(made.select(*columns, "sequence_id", "offset"))
            break
        made, before = materialise(made, "packed"), groups
        again = F.col("fill") < int(LEFT * capacity)
        done.append(made.where(~again).select(*columns, "sequence_id", "offset"))
        left = made.where(again).select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def op3_best_fit_packing(docs: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(materialise(pieces(docs), "pieces"))
