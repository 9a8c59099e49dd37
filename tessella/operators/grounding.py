"""What a reply claims and its sources don't say: quantities with their units, addresses, promises, and placeholders that were left.

Claims of both sides are brought to one form, so that a claim is grounded by an equality join: "$1,500", "1500 USD" and "1.5k dollars" are (1500, usd), "24h" and "24 hours" (24, hour). A link is
grounded by any source link that lies at or below it, so a source link stands under each of its parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import let, placeholders, url_key

#: Written units and what they stand for (our own list); a number takes the unit after it, or the sign before it.
UNITS = {
    "$": "usd", "usd": "usd", "dollar": "usd", "dollars": "usd", "€": "eur", "eur": "eur", "euro": "eur", "euros": "eur", "£": "gbp", "gbp": "gbp", "pounds": "gbp", "btc": "btc", "eth": "eth", "usdt": "usdt", "%": "percent", "percent": "percent", "min": "minute",
    "mins": "minute", "minute": "minute", "minutes": "minute", "h": "hour", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour", "day": "day", "days": "day", "week": "week", "weeks": "week", "month": "month", "months": "month", "year": "year", "years": "year", "spin": "spin", "spins": "spin",
}
SIGNS = ("$", "€", "£")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
#: Words between a number and its unit, and between the ends of a range.
FILLERS, RANGES = ("business", "working", "calendar", "free"), ("-", "–", "to")
#: Phrases that promise (our own list), and words that take a promise back when one stands shortly before it.
PROMISES = ("guarantee", "guaranteed", "i promise", "we promise", "will definitely", "without fail", "100%", "refund you", "will be credited today")
NEGATIONS = ("not", "no", "never", "cannot", "can't", "don't", "won't", "without")
WINDOW = 24
LINK, MAIL = r"(?i)\bhttps?://[^\s<>\"')\]]*[^\s<>\"')\].,;:!?]", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
LEXER = r"[$€£%–-]|\d[\d,]*(?:\.\d+)?|\p{L}+"


def _plain(text: Column) -> Column:
    """A text without addresses, placeholders and the numbers that begin list lines."""
    out = F.coalesce(text, F.lit(""))
    for pattern in (LINK, MAIL, r"\[ENTER [^\]]+\]", r"(?m)^\s*\d+[.)]\s"):
        out = F.regexp_replace(out, pattern, " ")
    return F.lower(out)


def quantities(text: Column) -> Column:
    """The quantities of a text as structs (value, unit, shown): a unit is null where a number has none.

    A walk over tokens: each number looks at the token before it, for a sign, and at those after it, past a filler, for a unit; the first of a range has the unit of the second.
    """
    canon = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    words = F.create_map(*[x for i, w in enumerate(NUMBERS, 1) for x in (F.lit(w), F.lit(str(i)))])

    def number(t: Column) -> Column:
        return F.when(t.rlike(r"^\d"), F.regexp_replace(t, ",", "")).otherwise(F.element_at(words, t))

    def walk(ts: Column) -> Column:
        at = lambda i: F.get(ts, i)  # noqa: E731  null beyond the ends
        past = lambda i: F.when(at(i).isin(*FILLERS), i + 1).otherwise(i)
        is_k = lambda i: F.coalesce(at(i + 1) == "k", F.lit(False))
        after = lambda i: F.element_at(canon, F.coalesce(at(past(i + 1 + F.when(is_k(i), 1).otherwise(0))), F.lit("")))
        before = lambda i: F.when(at(i - 1).isin(*SIGNS), F.element_at(canon, F.coalesce(at(i - 1), F.lit(""))))

        def claim(t: Column, i: Column) -> Column:
            second = F.when(at(i + 1).isin(*RANGES) & number(F.coalesce(at(i + 2), F.lit(""))).isNotNull(), after(i + 2))
            value = (number(t).try_cast("decimal(30,6)") * F.when(is_k(i), 1000).otherwise(1)).try_cast("decimal(30,6)").cast("string")
            short = F.regexp_replace(F.regexp_replace(value, r"(\.\d*?)0+$", "$1"), r"\.$", "")
            return F.when(number(t).isNotNull(), F.struct(F.coalesce(short, number(t)).alias("value"), F.coalesce(before(i), after(i), second).alias("unit"), t.alias("shown")))

        return F.filter(F.transform(ts, claim), lambda c: c.isNotNull())

    return let(F.regexp_extract_all(_plain(text), F.lit(LEXER), F.lit(0)), walk)


def links(text: Column) -> Column:
    """Keys of the links and mail addresses of a text."""
    found = lambda pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.concat(F.transform(found(LINK), url_key), F.transform(found(MAIL), F.lower)))


def _parents(link: Column) -> Column:
    """A link and all links above it on the same host."""
    parts = F.split(link, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def promises(text: Column) -> Column:
    """Phrases that a text promises with, but for those that a negation stands shortly before."""
    low = F.lower(F.coalesce(text, F.lit("")))
    taken_back = "(?:" + "|".join(NEGATIONS) + rf")\b[^.!?]{{0,{WINDOW}}}?"
    affirmed = lambda p: F.contains(F.regexp_replace(low, F.concat(F.lit(rf"\b{taken_back}\Q"), p, F.lit(r"\E")), " "), p)
    return F.filter(F.array(*[F.lit(p) for p in PROMISES]), affirmed)


def issues(replies: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, value, unit: what a reply (keys, text) has and its sources (keys, text, policy: whether it may license a promise) don't. A reply may have any number of sources.

    unsupported_number: a number with a unit that no source has with that unit, or one of two digits and more without a unit that no source has at all. unsupported_url: a link or mail
    address. promise: by the sources with policy only. placeholder_left: whatever the sources say.
    """
    said = replies.select(*keys, "text").select(*keys, F.inline(quantities(F.col("text")))).where("unit IS NOT NULL OR length(value) >= 2").select(*keys, "value", "unit").distinct()
    known = sources.select(*keys, F.inline(quantities(F.col("text")))).select(*keys, "value", "unit").distinct()
    with_unit = said.where("unit IS NOT NULL").join(known.where("unit IS NOT NULL"), [*keys, "value", "unit"], "left_anti").select(*keys, "value", "unit")
    without = said.where("unit IS NULL").join(known.select(*keys, "value").distinct(), [*keys, "value"], "left_anti").select(*keys, "value", "unit")
    numbers = with_unit.unionByName(without).select(*keys, F.lit("unsupported_number").alias("kind"), "value", "unit")
    none = F.lit(None).cast("string").alias("unit")
    one = lambda df, c, kind: df.select(*keys, F.explode(c).alias("value")).distinct().select(*keys, F.lit(kind).alias("kind"), "value", none)
    held = sources.select(*keys, F.explode(F.flatten(F.transform(links(F.col("text")), _parents))).alias("value")).distinct()
    urls = one(replies, links(F.col("text")), "unsupported_url").join(held, [*keys, "value"], "left_anti").select(*keys, "kind", "value", "unit")
    licensed = sources.where("policy").select(*keys, F.explode(promises(F.col("text"))).alias("value")).distinct()
    promised = one(replies, promises(F.col("text")), "promise").join(licensed, [*keys, "value"], "left_anti").select(*keys, "kind", "value", "unit")
    return numbers.unionByName(urls).unionByName(promised).unionByName(one(replies, placeholders(F.coalesce("text", F.lit(""))), "placeholder_left"))
