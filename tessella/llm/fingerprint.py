"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A document is the set of its paragraphs' 64-bit digests: lines, within a line its sentences, and of sentences over LONG
characters pieces that end where the hash of three neighbouring characters says so. The low 24 bits of a digest are a check hash of its high 40 bits.

A sketch deals the digests to 2**power parts, by bits of theirs, so that a part holds about LOAD of them. A part is an invertible lookup table: rows of
cells, and a digest is added to one cell of each row, by xor. Peeling takes a digest from any cell whose check is right, as it then holds
just one, removes it from its other cells, and goes on until all cells are empty or none is left to take. A part that doesn't peel is drawn
larger: each attempt has its own hash, and twice the cells up to the largest size. A fingerprint is such a sketch, all of whose parts peel, so
the digests can be got back from it alone.

Two fingerprints subtract cell by cell, so what the versions share cancels out, and peeling what is left recovers the
digests that differ; likeness is shared / all digests. Of a fingerprint of another power, or a part of another attempt, the smaller one is drawn again from its
digests like the one it is held against; where what is left doesn't peel, both parts are drawn larger, until it does. As the digests of a
fingerprint can be got back from it, likeness is a function of the two fingerprints.

Cases: null text is empty; an empty text has no digests; two empty sets have likeness 1; equal texts have equal fingerprints; repeated paragraphs
count once; rows that repeat a doc_id are documents of their own, ordered by their numbers, null ids last; with one document, the next is itself; the time
for a very long text grows with the power 1.5 of its paragraphs; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise, tasks_of, with_rows

ROWS_OF_CELLS = 3
#: Cells of a row at the first attempt; twice as many at each further one, up to 16 times.
CELLS, DOUBLINGS = 8, 4
#: Attempts at most; the last ones are never needed, as each has its own hash. A part that peels at none of them is an error.
ATTEMPTS = 64
CHECK_BITS, NAME_BITS = 24, 30
#: Digests that a part of a fingerprint should hold.
LOAD = 8
PARAGRAPH = r"\n+|(?<=[.!?|])\s+"
#: Characters of a sentence from which on it is cut further, and their mean number a piece.
LONG, PIECE = 400, 64


def let(value: Column, f) -> Column:
    """f of a column that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def paragraphs(text: Column) -> Column:
    """The non-empty paragraphs of a text."""
    mark = "\n"  # no sentence holds one

    def pieces(chars: Column) -> Column:
        ends = lambda c, i: F.pmod(F.xxhash64(F.get(chars, i - 2), F.get(chars, i - 1), c), F.lit(PIECE)) == 0
        return F.split(F.array_join(F.transform(chars, lambda c, i: F.when(ends(c, i), F.concat(c, F.lit(mark))).otherwise(c)), ""), mark)

    parts = F.filter(F.split(text, PARAGRAPH), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.when(F.char_length(p) <= LONG, F.array(p)).otherwise(let(F.split(p, ""), pieces)))
    return F.filter(F.flatten(cut), lambda p: p != "")


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    one = lambda p: let(F.shiftright(F.xxhash64(p), CHECK_BITS), lambda h: F.shiftleft(h, CHECK_BITS).bitwiseOR(_check(h)))
    return F.array_distinct(F.transform(paragraphs(text), one))


def _check(high: Column) -> Column:
    return F.xxhash64(high).bitwiseAND(F.lit((1 << CHECK_BITS) - 1).cast("long"))


def _single(cell: Column) -> Column:
    """Whether a cell holds just one digest."""
    return (cell != 0) & (_check(F.shiftright(cell, CHECK_BITS)) == cell.bitwiseAND(F.lit((1 << CHECK_BITS) - 1).cast("long")))


def _width(attempt: Column) -> Column:
    """Cells of a row."""
    return F.call_function("shiftleft", F.lit(CELLS), F.least(attempt, F.lit(DOUBLINGS)))


def _of_row(attempt: Column) -> Column:
    return F.sequence(F.lit(0), _width(attempt) - 1)


def _placed(ds: Column, attempt: Column) -> Column:
    """Digests (u) with the places in each row (c0, c1, c2) that the attempt's hash names."""

    def places(x: Column) -> Column:
        at = lambda r: F.shiftrightunsigned(x["h"], 16 * r).bitwiseAND(x["m"])
        return F.struct(x["u"].alias("u"), *[at(r).cast("int").alias(f"c{r}") for r in range(ROWS_OF_CELLS)])

    hashed = F.transform(ds, lambda u: F.struct(u.alias("u"), F.xxhash64(attempt, u).alias("h"), (_width(attempt) - 1).cast("long").alias("m")))
    return F.transform(hashed, places)


def _xor_of(placed: Column, row: int, place: Column) -> Column:
    """The digests that belong to a cell, by xor."""
    return F.aggregate(placed, F.lit(0).cast("long"), lambda sum, x: F.when(x[f"c{row}"] == place, sum.bitwiseXOR(x["u"])).otherwise(sum))


def drawn(ds: Column, attempt: Column) -> Column:
    """Cells of a part of these digests, row by row."""
    at = lambda placed, r: lambda p: _xor_of(placed, r, p)
    rows = lambda placed: F.concat(*[F.transform(_of_row(attempt), at(placed, r)) for r in range(ROWS_OF_CELLS)])
    return let(_placed(ds, attempt), rows)


def peel(cells: Column, attempt: Column) -> Column:
    """How many digests a part holds, or -1 where peeling stops early."""

    def step(state: Column, _: Column) -> Column:
        def without(pure: Column) -> Column:
            less = lambda r: lambda x, p: x.bitwiseXOR(_xor_of(pure, r, p))
            own = lambda r: F.slice(state["cells"], r * _width(attempt) + 1, _width(attempt))
            left = F.concat(*[F.zip_with(own(r), _of_row(attempt), less(r)) for r in range(ROWS_OF_CELLS)])
            goes_on = F.struct(left.alias("cells"), (state["found"] + F.size(pure)).alias("found"), F.lit(True).alias("more"))
            return F.when(F.size(pure) > 0, goes_on).otherwise(F.struct(state["cells"], state["found"], F.lit(False).alias("more")))

        pure = _placed(F.array_distinct(F.filter(state["cells"], _single)), attempt)
        return F.when(state["more"], let(pure, without)).otherwise(state)

    begin = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("more"))
    done = lambda s: F.when(F.forall(s["cells"], lambda x: x == 0), s["found"]).otherwise(-1)
    # a round takes a digest at least, and no more digests than cells can be peeled
    return F.aggregate(F.sequence(F.lit(1), F.size(cells)), begin, step, done)


def dealt(ds: Column, power: Column) -> Column:
    """Digests dealt to 2**power arrays by the bits above the check, in two steps."""
    low = lambda n: F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), n) - 1)
    mask = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1

    def run(w: Column) -> Column:
        first = F.transform(low(w["q"]), lambda a: F.filter(ds, lambda u: F.shiftright(u, CHECK_BITS).bitwiseAND(mask(w["q"])) == a))
        return F.flatten(F.transform(first, lambda g: F.transform(low(w["r"]), lambda b: F.filter(g, lambda u: F.call_function("shiftright", u, w["q"] + CHECK_BITS).bitwiseAND(mask(w["r"])) == b))))

    widths = F.struct(F.floor((power + 1) / 2).cast("int").alias("q"), F.floor(power / 2).cast("int").alias("r"))
    return F.when(power == 0, F.array(ds)).otherwise(let(widths, run))


def _sure(found: Column, value: Column) -> Column:
    """The value, where something was found."""
    return F.when(found, value).otherwise(F.raise_error(F.lit(f"a part doesn't peel in {ATTEMPTS} attempts")).cast("int"))


def _part(ds: Column) -> Column:
    """A part of a fingerprint, drawn larger until it peels: attempt, cells, and the digests in it."""

    def step(state: Column, _: Column) -> Column:
        def tried(cells: Column) -> Column:
            ok = peel(cells, state["attempt"]) >= 0
            return let(ok, lambda good: F.struct(good.alias("ok"), (state["attempt"] + F.when(good, 0).otherwise(1)).alias("attempt"), cells.alias("cells")))

        return F.when(state["ok"], state).otherwise(let(drawn(ds, state["attempt"]), tried))

    begin = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("attempt"), F.array().cast("array<bigint>").alias("cells"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), begin, step, lambda s: F.struct(_sure(s["ok"], s["attempt"]).alias("attempt"), s["cells"].alias("cells"), ds.alias("ds")))


def _undrawn(ds: Column) -> Column:
    """A part of digests that has no cells yet."""
    return F.struct(F.lit(0).alias("attempt"), F.lit(None).cast("array<bigint>").alias("cells"), ds.alias("ds"))


def fitting_power(ds: Column) -> Column:
    """Power of the number of parts that digests are dealt to."""
    return F.least(F.lit(NAME_BITS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.size(ds) / LOAD))).cast("int"))


def fingerprint(ds: Column) -> Column:
    """The sketch of some digests: an array of parts (attempt, cells, ds), each of which peels."""
    return F.transform(dealt(ds, fitting_power(ds)), _part)


def _differing(x: Column, y: Column) -> Column:
    """How many digests differ between two parts (attempt, cells, ds); what is drawn already is not drawn again."""

    def step(state: Column, _: Column) -> Column:
        def tried(_: Column) -> Column:
            at = lambda p: F.when((p["attempt"] == state["attempt"]) & p["cells"].isNotNull(), p["cells"]).otherwise(drawn(p["ds"], state["attempt"]))
            less = F.zip_with(at(x), at(y), lambda u, v: u.bitwiseXOR(v))
            return F.struct(let(less, lambda c: peel(c, state["attempt"])).alias("d"), (state["attempt"] + 1).alias("attempt"))

        return F.when(state["d"] >= 0, state).otherwise(let(F.lit(0), tried))

    begin = F.struct(F.lit(-1).alias("d"), F.greatest(x["attempt"], y["attempt"]).alias("attempt"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), begin, step, lambda s: _sure(s["d"] >= 0, s["d"]))


def likeness(x: Column, dx: Column, y: Column | None, dy: Column) -> Column:
    """Shared / all digests of two fingerprints that peel to the digests dx and dy; the second may be left to be drawn."""
    power = F.greatest(fitting_power(dx), fitting_power(dy))

    def over(w: Column) -> Column:
        side = lambda made, ds: F.transform(dealt(ds, w), _undrawn) if made is None else F.when(F.size(made) == F.call_function("shiftleft", F.lit(1), w), made).otherwise(F.transform(dealt(ds, w), _undrawn))
        return F.aggregate(F.zip_with(side(x, dx), side(y, dy), _differing), F.lit(0), lambda s, one: s + one)

    total = F.size(dx) + F.size(dy)
    return F.when(total == 0, 1.0).otherwise(let(let(power, over), lambda k: (total - k) / (total + k)))


def as_text(made: Column) -> Column:
    """A fingerprint in hex: two digits of its power, and for each part two of the attempt and 16 a cell."""
    two = lambda n: F.lpad(F.hex(n), 2, "0")
    part = lambda x: F.concat(two(x["attempt"]), F.array_join(F.transform(x["cells"], lambda c: F.lpad(F.hex(c), 16, "0")), ""))
    return F.concat(two(F.log2(F.size(made)).cast("int")), F.array_join(F.transform(made, part), ""))


def previous_rows(rows: DataFrame) -> DataFrame:
    """_row, p_row, p_chars: the row before each in descending doc_id, and its length; before the first, the last.

    The ids are dealt by range; each range sorts its own, and a table of one line a range joins the ends.
    """
    ids = rows.select("_row", "doc_id", F.char_length("text").alias("n"))
    dealt = ids.repartitionByRange(max(8, tasks_of(rows.sparkSession)), F.col("doc_id").desc_nulls_last(), F.col("_row"))
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "order")
    order = (F.col("doc_id").desc_nulls_last(), F.col("_row"))
    inner = Window.partitionBy("part").orderBy(*order)
    rank = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "_row")
    ends = dealt.groupBy("part").agg(F.max_by(F.struct("_row", "n"), rank).alias("last"))
    around = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"), F.max_by("last", "part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    ends = around.select("part", F.coalesce("before", "end").alias("before"))
    inside = dealt.select("part", "_row", F.lag(F.struct("_row", "n")).over(inner).alias("own"))
    found = inside.join(F.broadcast(ends), "part").select("_row", F.coalesce("own", "before").alias("p"))  # a line a range
    return materialise(found.select("_row", F.col("p._row").alias("p_row"), F.col("p.n").alias("p_chars")), "previous")


def op5_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id of every document."""
    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    before = previous_rows(rows)
    # both branches read the same columns of rows, so the texts are shuffled once
    nexts = rows.join(before, "_row").select(F.col("p_row").alias("_row"), F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, int(p_chars div 3))").alias("head"), digests(F.col("text")).alias("nd"))
    both = rows.join(nexts, "_row").withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 3))"), "head"))
    both = both.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("d"), digests(F.col("edited")).alias("ed"), "nd")

    # step by step, as the analyser resolves nested functions level by level
    both = both.select("*", fingerprint(F.col("d")).alias("f"), fingerprint(F.col("ed")).alias("ef"))
    both = both.select("*", *[likeness(F.col("f"), F.col("d"), y, F.col(ds)).alias(name) for name, y, ds in (("near_edited", F.col("ef"), "ed"), ("near_next", None, "nd"))])
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("ef")).alias("edited_fingerprint"), "near_edited", "near_next", "next_id")
