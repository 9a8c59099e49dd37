"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes when an earlier line, by (row, line number), is equal to it or within so many edits as the shorter of the two allows:
one for each CHARS_PER_EDIT code points of it, and EDITS at most. So short lines are judged by equality alone. Blank lines are layout and stay.

1. Equal lines, by two independent 64-bit hashes: only the first occurrence of each line goes on, under a number of its own.
2. Segment index: a line that allows e edits is cut into e + 1 segments, of which an edit each can spoil only e. A line within e
   edits of it therefore holds one segment unchanged, at a place that the length difference and the segment's number bound.
   Indexed segments and probed substrings are keyed by (length, segment number, substring) hashes and joined on the key.
   Where more than CROWD lines hold the same segment, as long near copies of each other do, the join also compares the
   parities of the lines' characters and of their neighbouring pairs, of which an edit changes two and four at most; pairs that differ
   by whole words end there.
3. Verification: a banded bit-parallel edit distance. Of the 2 * EDITS + 1 diagonals around the main one, an integer for each
   number of edits has the bits of those that are reachable; a character of one line moves all diagonals at once.

Cases: null text stays null; an empty text and blank lines stay; the first of equal lines stays, also within a document; of lines
that are within the edits of several the earliest decides nothing more than any other; rows that repeat a doc_id, or have none, are documents of
their own, in the order of their numbers; very long texts and lines are split and compared in time linear in their length; an empty table gives
an empty result; extra columns are ignored by the operator and handed on by the pipeline stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialise, packed, unpacked, with_rows

EDITS = 2
#: A line allows an edit for each so many code points.
CHARS_PER_EDIT = 12
#: A key under which more lines than this, of which there are two at least, are indexed is crowded.
CROWD = 2


def _without_prefix(pair: Column) -> Column:
    """A struct of two strings (a, b), turned round, without what both begin with (up to 4,095 code points of it)."""
    a, b = pair["a"], pair["b"]
    shorter = F.least(F.char_length(a), F.char_length(b))

    def longer(p: Column, s: Column) -> Column:
        same = F.substring(a, p + 1, s) == F.substring(b, p + 1, s)
        return F.when((p + s <= shorter) & same, p + s).otherwise(p)

    common = F.aggregate(F.array(*[F.lit(1 << k) for k in range(11, -1, -1)]), F.lit(0), longer)
    rest = lambda c: lambda p: F.reverse(F.substring(c, p + 1, F.char_length(c)))
    cut = F.transform(F.array(common), lambda p: F.struct(rest(a)(p).alias("a"), rest(b)(p).alias("b")))
    return F.element_at(cut, 1)


def allowed(length: Column, edits: int = EDITS) -> Column:
    """Edits that a line of this length allows."""
    return F.least(F.lit(edits), F.floor(length / CHARS_PER_EDIT).cast("int"))


def let(value: Column, f) -> Column:
    """f of a column that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def within_edits(a: Column, b: Column, most: Column | None = None, edits: int = EDITS) -> Column:
    """Whether two strings are within `most` edits (at most, and by default, `edits`), by bits over the diagonals of the band, once their common ends are cut off."""
    most = F.lit(edits) if most is None else most
    mask = (1 << (2 * edits + 1)) - 1
    names = [f"r{k}" for k in range(edits + 1)]
    begin, bits = [], 1 << edits
    for name in names:
        begin.append(F.lit(bits).alias(name))
        bits = (bits | bits << 1) & mask

    def run(p: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            ch = F.get(p["y"], i)
            same = [F.when(F.get(p["x"], i + (d - edits)) == ch, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(2 * edits + 1)]
            m = same[0]
            for s in same[1:]:
                m = m.bitwiseOR(s)
            packed = F.struct(m.alias("m"))
            moved = F.element_at(F.transform(F.array(packed), lambda q: _advance(state, q["m"], names, mask)), 1)
            return F.when(state[names[-1]] == 0, state).otherwise(moved)  # no diagonal is left: nothing can become reachable

        n, k = F.size(p["x"]), F.size(p["y"])
        end = F.aggregate(F.sequence(F.lit(0), k - 1), F.struct(*begin), step)
        bit = n - k + edits
        last = lambda e: F.element_at(F.array(*[e[name] for name in names]), p["most"] + 1)
        reached = let(end, lambda e: F.call_function("shiftright", last(e), bit).bitwiseAND(1) == 1)
        return F.when((bit >= 0) & (bit <= 2 * edits), reached).otherwise(False)

    def judge(q: Column) -> Column:
        lengths = F.char_length(q["a"]), F.char_length(q["b"])
        lines = F.struct(F.split(q["a"], "").alias("x"), F.split(q["b"], "").alias("y"), most.alias("most"))
        return F.when(F.least(*lengths) == 0, F.greatest(*lengths) <= most).otherwise(let(lines, run))

    cut = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), _without_prefix)
    return F.element_at(F.transform(F.transform(cut, _without_prefix), judge), 1)


def _advance(state: Column, m: Column, names: list[str], mask: int) -> Column:
    """The reachable diagonals after one more character; m has the diagonals on which it matches."""
    out = [state[names[0]].bitwiseAND(m)]
    for k in range(1, len(names)):
        fewer = state[names[k - 1]]
        now = state[names[k]].bitwiseAND(m).bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1))
        out.append(now.bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(mask))
    return F.struct(*[c.alias(n) for c, n in zip(out, names, strict=True)])


def _key(line: Column, length: Column, e: Column, k: Column, shift: Column | int, own: Column) -> Column:
    """Key of the substring that lies where segment k, of e + 1, of a line of that length would, moved by shift; null if it leaves the line.

    All segments but the last `length % (e + 1)` have the same length, those one more.
    """
    parts = e + 1
    base, short = F.floor(length / parts).cast("int"), parts - length % parts
    start = base * k + F.greatest(F.lit(0), k - short) + shift
    size = base + F.when(k >= short, 1).otherwise(0)
    return F.when((start >= 0) & (start + size <= own), F.xxhash64(length, k, F.substring(line, start + 1, size)))


def segment_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Index of lines (id, line, n): id, key, one row for each segment of those that allow edits."""
    e = allowed(F.col("n"), edits)
    each = lines.where(e > 0).select("id", "line", "n", e.alias("e"), F.explode(F.sequence(F.lit(0), e)).alias("k"))
    return each.select("id", _key(F.col("line"), F.col("n"), F.col("e"), F.col("k"), 0, F.col("n")).alias("key"))


def probe_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """Probes of lines (id, line, n): probe, key, under which lines of at most this length that are within their edits are found.

    The probe is 2 * id, and one more where it is a segment of the line's own, so that the line is indexed under the key too.
    """
    places = lambda e, s: [(k, t) for k in range(e + 1) for t in range(max(-k, s - (e - k)), min(k, s + (e - k)) + 1)]
    tries = [(e, s, k, t) for e in range(1, edits + 1) for s in range(e + 1) for k, t in places(e, s)]
    listed = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip("eskt", row, strict=True)]) for row in tries])
    each = lines.where(F.col("n") >= CHARS_PER_EDIT).select("id", "line", "n", F.inline(listed)).where(allowed(F.col("n") - F.col("s"), edits) == F.col("e"))
    key = _key(F.col("line"), F.col("n") - F.col("s"), F.col("e"), F.col("k"), F.col("t"), F.col("n"))
    own = F.when((F.col("s") == 0) & (F.col("t") == 0), 1).otherwise(0)
    return each.select((2 * F.col("id") + own).alias("probe"), key.alias("key")).where("key IS NOT NULL")


def parities(line: Column) -> Column:
    """For 64 classes of characters, and 64 of neighbouring pairs, whether the line has an odd number of them.

    An edit flips two of the first and four of the second at most.
    """
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int"))

    def step(state: Column, c: Column) -> Column:
        one, two = state["one"].bitwiseXOR(bit(F.ascii(c))), state["two"].bitwiseXOR(bit(F.xxhash64(state["last"], c)))
        return F.struct(c.alias("last"), one.alias("one"), two.alias("two"))

    zero = F.lit(0).cast("long")
    done = lambda state: F.struct(state["one"], state["two"])
    return F.aggregate(F.split(line, ""), F.struct(F.lit("").alias("last"), zero.alias("one"), zero.alias("two")), step, done)


def _fits(x: str, y: str, edits: int) -> Column:
    flips = lambda c: F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    return (flips("one") <= 2 * edits) & (flips("two") <= 4 * edits)


def candidates(lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the lines (id, line, n) that hold a segment of each other and have fitting parities, and the lines (id, line) of these and some more."""
    # a key of one or two lines is kept with them; of a crowded key it is kept that it is one, as its lines are among those that probe it
    index = segment_keys(lines, edits).groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("x"), F.max("id").alias("y"))
    few = F.when(F.col("c") <= CROWD, F.array_distinct(F.array("x", "y")))
    met = index.select("key", few.alias("few")).join(probe_keys(lines, edits), "key").withColumn("id_p", F.shiftright("probe", 1))
    others = F.filter("few", lambda i: i != F.col("id_p"))
    met = met.where(F.col("few").isNull() | (F.size(others) > 0))
    met = materialise(met.select("id_p", others.alias("few"), F.when(F.col("few").isNull(), F.col("key")).alias("key"), (F.col("probe") % 2 == 1).alias("own")), "met")
    wanted = met.select(F.explode(F.concat(F.coalesce("few", F.array().cast("array<bigint>")), F.array("id_p"))).alias("id")).distinct()
    wanted = wanted.hint("merge")  # its size isn't bounded, and the estimate is that of a compressed file
    held = materialise(lines.join(wanted, "id", "left_semi").select("id", "line", parities(F.col("line")).alias("bits")), "held", "zstd")
    bits = held.select("id", "bits")
    bits_p = held.select(F.col("id").alias("id_p"), F.col("bits").alias("bits_p"))
    fits = _fits("bits", "bits_p", edits)
    crowded = met.where("few IS NULL").select("id_p", "key", "own")
    x = crowded.where("own").select(F.col("id_p").alias("id"), "key").join(bits, "id")
    y = crowded.select("id_p", "key").join(bits_p, "id_p")
    dense = x.join(y, (x["key"] == y["key"]) & (F.col("id") != F.col("id_p")) & fits).select("id", "id_p")
    sparse = met.select("id_p", F.explode("few").alias("id")).distinct().join(bits, "id").join(bits_p, "id_p").where(fits).select("id", "id_p")
    pairs = materialise(dense.union(sparse).select(F.least("id", "id_p").alias("a"), F.greatest("id", "id_p").alias("b")).distinct(), "pairs")
    discard(met)
    return pairs, held.select("id", "line")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def kept_lines(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """_row and kept, the numbers of the lines that stay and aren't blank, of the rows that have such lines."""
    texts = rows.select("_row", "text")
    each = texts.select("_row", F.posexplode(_lines(F.col("text"))).alias("i", "line")).where(F.col("line").rlike(r"\S"))
    same = each.groupBy(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2")).agg(F.min(F.struct("_row", "i")).alias("at"))
    firsts = materialise(same.select(F.monotonically_increasing_id().alias("id"), "at._row", "at.i"), "firsts")

    listed = firsts.groupBy("_row").agg(F.collect_list(F.struct("i", "id")).alias("numbers"))
    got = let(_lines(F.col("text")), lambda lines: F.transform("numbers", lambda x: F.struct(x["id"].alias("id"), F.get(lines, x["i"]).alias("line"))))
    lines = texts.join(listed, "_row").select(F.inline(got)).withColumn("n", F.char_length("line")).where(F.col("n") >= CHARS_PER_EDIT)
    lines = materialise(lines, "lines", "zstd")
    pairs, held = candidates(lines, edits)
    discard(lines)
    a, b = (firsts.select(F.col("id").alias(x), F.struct("_row", "i").alias(f"at_{x}")) for x in "ab")
    places = pairs.join(a, "a").join(b, "b")
    la, lb = (held.select(F.col("id").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
    most = allowed(F.least(F.char_length("la"), F.char_length("lb")), edits)
    near = places.join(la, "a").join(lb, "b").where(within_edits(F.col("la"), F.col("lb"), most, edits))
    later = materialise(near.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct(), "later")
    discard(held)
    discard(pairs)
    return materialise(firsts.join(later, "id", "left_anti").groupBy("_row").agg(F.collect_list("i").alias("kept")), "kept")


def dedup_lines(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """Adds n_lines, n_dropped and new_text to a table with _row and text."""
    joined = rows.join(kept_lines(rows, edits), "_row", "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))

    def judged(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda i: i.isNotNull())
        stay = F.transform(F.array_sort(F.concat(kept, blank)), lambda i: F.get(lines, i))
        return let(stay, lambda s: F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(s)).alias("n_dropped"), F.array_join(s, "\n").alias("new_text")))

    out = joined.withColumn("_judged", F.when(F.col("text").isNotNull(), let(_lines(F.col("text")), judged)))
    zero = lambda c: F.coalesce(F.col(f"_judged.{c}"), F.lit(0)).alias(c)
    return out.select(*rows.columns, zero("n_lines"), zero("n_dropped"), F.col("_judged.new_text").alias("new_text"))


def op10_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left) of every document."""
    out = dedup_lines(with_rows(docs.select("doc_id", "text")))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("new_text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the texts without the lines that repeat an earlier one; a document that loses all of its text goes."""
    out = dedup_lines(packed(docs)).where("n_dropped = 0 OR trim(new_text) <> ''")
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("new_text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return unpacked(out, docs.columns, text=F.col("new_text"), n_chars=n_chars)
