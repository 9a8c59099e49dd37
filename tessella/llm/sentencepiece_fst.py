"""SentencePiece encoding and decoding by weighted finite-state transducers over the tropical semiring.

A model file is compiled into three machines. The normaliser writes U+2581 for a space, and one before the text; other characters it
copies. The piece machine reads characters along a trie; where a piece ends it writes the piece's id, at a weight of 1, and goes to the state
that remembers this piece. Byte fallback reads a character that no piece has, and writes the ids of its UTF-8 bytes, at a weight of 1 each.

The encoding of a byte-pair model isn't a sum of piece weights; it is the one path on which each two neighbouring pieces
are stable: merging their own text by the model's rules gives those two pieces again. So from a state that remembers a piece, only the
arcs of stable neighbours are compiled, when they are first asked for. The input, an acceptor of its characters, is composed with the machines place
by place; a state of the composition is a place and a remembered piece. As all arcs lead to later places, one pass in their
order relaxes each arc once (weights add along a path, the least is kept), and the path back from the last place is the
encoding. No piece has U+2581 after another character, so the paths of different words are independent, and a worker remembers those of words.

Only models whose normaliser is the identity but for spaces are compiled; others are refused with a ValueError.

Cases: null text encodes to no ids and decodes to null; empty text to no ids; bytes that aren't valid on decoding become
U+FFFD; equal rows encode alike; ties between paths go to the one found first; a very long text is composed word by word, a very long
word in time linear in its length; an empty table gives an empty result; rows may repeat a doc_id or have none; extra columns are handed on by encode
and decode, unless they have the name of what is added, and ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_arrow

SPACE = "▁"
CACHE_WORDS = 400_000
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceMachine:
    """The machines of one model, compiled."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.out.append(b"")
            elif model.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.rank[piece] = i, model.get_score(i)
                self.out.append(piece.replace(SPACE, " ").encode())
        probe = "ﬁ  Ａ"
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("only models with the identity normaliser are supported")
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (piece, i)
        #: By piece, whether others can be its next neighbours.
        self.after: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.words: dict[str, bytes] = {}

    def holds(self, a: str, b: str) -> bool:
        """Whether merging the text of two pieces by the model's rule gives the two again.

        The rule: of all neighbours whose join is a piece, the best-scored, leftmost ones are joined, until none is left. A join
        across the border of the two decides it at once.
        """
        parts, left, rank = [*a, *b], len(a), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                return parts == ([a, b] if a else [b])
            if a and at == left - 1:
                return False
            left -= at < left
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, a: str, b: str) -> bool:
        """Whether two pieces can be neighbours; a first piece has "" before it. Compiled when first asked for."""
        if self.n_pairs > 2 * CACHE_WORDS:
            self.after.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.after.setdefault(a, {})[b] = self.holds(a, b)
        return known

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through the composition of a normalised text with the machines.

        reached[place] has, for each remembered piece ("" after byte fallback, and at the start), the least weight and the arc
        that gave it: place and piece before, ids written.
        """
        n, trie = len(text), self.trie
        reached: list[dict[str, tuple]] = [{} for _ in range(n + 1)]
        reached[0][""] = (0, 0, "", ())
        for at in range(n):
            here = reached[at]
            if not here:
                continue
            if text[at] not in self.ids:  # byte fallback; such a character is no neighbour that could be merged
                written = tuple(self.byte_ids[b] for b in text[at].encode("utf-8", "surrogatepass"))
                last = min(here, key=lambda x: here[x][0])
                reached[at + 1][""] = (here[last][0] + len(written), at, last, written)
                continue
            for last, way in here.items():
                sum_, node, known = way[0] + 1, trie, self.after.get(last, {})
                for j in range(at, n):
                    node = node.get(text[j])
                    if node is None:
                        break
                    if "" in node:
                        piece, i = node[""]
                        fits = known.get(piece)
                        if fits or (fits is None and self.stable(last, piece)):
                            old = reached[j + 1].get(piece)
                            if old is None or sum_ < old[0]:
                                reached[j + 1][piece] = (sum_, at, last, (i,))
        if not reached[n]:
            raise ValueError("no path through the machines")
        at, piece, out = n, min(reached[n], key=lambda x: reached[n][x][0]), []
        while at:
            _, at, piece, written = reached[at][piece]
            out.append(written)
        return [i for written in reversed(out) for i in written]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join([self._segment(w) for w in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))])
        known, words = self.words, text.split(" ")
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known.get(w) or self._word(w) for w in words])

    def _segment(self, segment: str) -> bytes:
        if segment[0] == SPACE and SPACE not in segment[1:]:
            return self.words.get(segment[1:]) or self._word(segment[1:])
        return np.array(self.shortest(segment), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        made = np.array(self.shortest(SPACE + word), "<u4").tobytes()
        if len(word) < 64:
            self.words[word] = made
        return made

    def decode(self, ids: bytes) -> str:
        """The inverse machine: text of the ids, without the space that the normaliser puts first."""
        table = self.out
        data = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return data.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=1)
def public_machine() -> PieceMachine:
    """The 32k byte-pair model of the public tokenizer files, compiled once a worker."""
    import public_tokenizers as p

    return PieceMachine(p.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, machine=public_machine, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of a text column as array<int>."""
    columns = [c for c in docs.columns if c != ids]
    schema = docs.select(*columns).schema.add(ids, "array<int>")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = machine()
        made = [None if x is None else np.frombuffer(m.encode(x), "<u4").astype(np.int32) for x in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(made, pa.list_(pa.int32()))], names=[*columns, ids])

    return map_arrow(docs, f, schema)


def decode(encoded: DataFrame, machine=public_machine, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids."""
    columns = [c for c in encoded.columns if c != text]
    schema = encoded.select(*columns).schema.add(text, "string")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = machine()
        made = [None if x is None else m.decode(np.array(x, "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(made, pa.string())], names=[*columns, text])

    return map_arrow(encoded, f, schema)


def op2_sentencepiece(docs: DataFrame, machine=public_machine) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the little-endian 32-bit ids), decoded_sha256, round_trip of every document."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, rows = machine(), []
        for x in batch.column("text"):
            text = x.as_py()
            ids = m.encode(text or "")
            back = None if text is None else m.decode(ids)
            rows.append((len(ids) // 4, zlib.crc32(ids), None if back is None else hashlib.sha256(back.encode()).hexdigest(), back == text))
        made = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in made]], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
