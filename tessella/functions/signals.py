"""Signals of a message as column expressions: clauses, resolved money flows, products, content words, waits, amounts, language."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let, normalised, tokens

#: Words of each product and of each money flow (our own lists).
PRODUCTS = {"sports": ("bet", "bets", "sportsbook", "odds", "parlay"), "casino": ("casino", "slot", "slots", "roulette", "blackjack"), "poker": ("poker", "tournament")}
FLOWS = {"deposit": ("deposit", "deposits", "deposited", "top up"), "withdrawal": ("withdrawal", "withdrawals", "withdraw", "payout", "cashout")}
#: Evidence that money is there, and against it; a clause is weighed by the words and phrases of both lists that it holds.
THERE = ("arrived", "received", "credited", "cleared", "landed", "came through", "went through", "showed up", "got it", "got my", "reached me", "paid out")
AGAINST = ("not", "cant", "didnt", "hasnt", "havent", "isnt", "wont", "cannot", "never", "nothing", "still", "yet", "missing", "pending", "stuck", "waiting", "rejected", "denied", "lost", "if", "where", "when", "why", "how")
#: Verbs that make a question of a clause that they begin.
AUXILIARY = ("is", "was", "has", "have", "did", "does", "do", "will", "would", "should", "can", "could")
FOR_IT, AGAINST_IT = 2, 9
CONTRAST = r"(?i)\s(?:but|however|though)\s"
WAITING = r"wait|pending|still|nothing|since"
ENGLISH = tuple("the and is to my i you it not for have of in on was with this that how what can please".split())
ACRONYMS = ("btc", "eth", "usdt", "kyc", "vip", "id", "faq")


def _any(words: tuple[str, ...]) -> str:
    return r"(^|[^a-z0-9])(" + "|".join(words) + r")($|[^a-z0-9])"


def clauses(text: Column) -> Column:
    """Clauses of a text, as structs (text, question): what lies between marks and line ends, cut once more where it turns. A question mark holds for all that it ends."""
    marked = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?;,]+)", "$1\n"), "\n")
    halves = lambda part: F.transform(F.split(part, CONTRAST), lambda half: F.struct(F.trim(F.rtrim(half, F.lit(".!?;, "))).alias("text"), F.contains(part, F.lit("?")).alias("question")))
    return F.filter(F.flatten(F.transform(marked, halves)), lambda c: c["text"] != "")


def weighed(clause: Column) -> Column:
    """How much speaks for money being there in a clause (text, question)."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.lower(clause["text"]), "’‘`", "'''"), r"n't\b", " not"), "[^a-z0-9]+", " ")

    def score(words: Column) -> Column:
        held = lambda cues: F.size(F.filter(F.array(*[F.lit(f" {c} ") for c in cues]), lambda c: F.contains(words, c)))
        asks = F.substring_index(F.ltrim(words), " ", 1).isin(*AUXILIARY) | clause["question"]
        return held(THERE) * FOR_IT - held(AGAINST) * AGAINST_IT - F.when(asks, AGAINST_IT).otherwise(0)

    return let(F.concat(F.lit(" "), F.trim(plain), F.lit(" ")), score)


def is_resolved(clause: Column) -> Column:
    """Whether a clause (text, question) reports that money arrived."""
    return weighed(clause) > 0


def flows(text: Column) -> Column:
    """Money flows that a text names."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.rlike(_any(words)), name) for name, words in FLOWS.items()]), lambda x: x.isNotNull())


def resolved_flows(text: Column) -> Column:
    """Flows that clauses report as arrived, without those that another clause leaves open."""
    of = lambda wanted: F.array_distinct(F.flatten(F.transform(F.filter(clauses(text), lambda c: is_resolved(c) if wanted else ~is_resolved(c)), lambda c: flows(c["text"]))))
    return F.array_sort(F.array_except(of(True), of(False)))


def open_text(text: Column) -> Column:
    """The clauses that don't report an arrival, where some clause does; else the text itself."""
    left = F.filter(clauses(text), lambda c: ~(is_resolved(c) & (F.size(flows(c["text"])) > 0)))
    return F.when(F.size(resolved_flows(text)) > 0, F.array_join(F.transform(left, lambda c: c["text"]), "\n")).otherwise(text)


def products(text: Column, norm: Column | None = None) -> Column:
    """Products that a text names. norm: the text, normalised, where the caller has it."""

    def named(t: Column) -> Column:
        some = lambda words: reduce(or_, [F.contains(t, F.lit(w)) for w in words])  # noqa: E731  far cheaper than the pattern, which few texts get to
        return F.filter(F.array(*[F.when(some(words) & t.rlike(_any(words)), name) for name, words in PRODUCTS.items()]), lambda x: x.isNotNull())

    return let(F.coalesce(normalised(text) if norm is None else norm, F.lit("")), named)


def wait_hours(text: Column) -> Column:
    """Hours of the longest stated wait: a count of hours, days or weeks within 40 characters of a word of waiting; null if there is none."""
    near = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(({WAITING})[^.!?]{{0,40}}?)(\d+) (hour|day|week)s?"), F.lit(0))
    hours = lambda x: F.regexp_extract(x, r"(\d+) (hour|day|week)s?$", 1).cast("double") * F.when(F.endswith(F.rtrim(F.regexp_replace(x, "s$", "")), F.lit("hour")), 1).when(F.endswith(F.regexp_replace(x, "s$", ""), F.lit("day")), 24).otherwise(168)
    return F.array_max(F.transform(near, hours))


def normal_number(text: Column) -> Column:
    """Value of a written number: thousands with commas, points or spaces, a decimal comma, a final k."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"\s", "")
    thousand = F.endswith(t, F.lit("k"))
    t = F.regexp_replace(t, "k$", "")
    plain = (
        F.when(t.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(t, ",", ""))
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when(t.rlike(r"^\d+,\d+$"), F.regexp_replace(t, ",", "."))
        .when(t.rlike(r"^\d+(\.\d+)?$"), t)
    )
    return plain.try_cast("double") * F.when(thousand, 1000).otherwise(1)


def largest_amount(text: Column) -> Column:
    """The largest number before a currency word; null if there is none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d[\d.,]*k?) ?(usd|eur|gbp|dollars|euros)\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: normal_number(x)))


def not_english(text: Column) -> Column:
    """Whether a text of eight words and more has hardly an English function word among them, or is mostly in another script."""
    words = tokens(text)
    share = F.size(F.filter(words, lambda w: w.isin(*ENGLISH))) / F.size(words)
    letters = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{L}"))
    latin = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{IsLatin}"))
    return ((letters > 0) & (latin < 0.6 * letters)) | ((F.size(words) >= 8) & (share < 0.05))


def display_term(term: Column) -> Column:
    """Known acronyms in capitals."""
    return F.when(term.isin(*ACRONYMS), F.upper(term)).otherwise(term)


def title_topic(title: Column) -> Column:
    """A title in running text: without [tags], in lower case but for acronyms."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(title, r"\[[^\]]*\]", " "), r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^[A-Z0-9]{2,}$"), w).otherwise(F.lower(w))), " ")


def split_greeting(body: Column) -> Column:
    """A struct (greeting, rest): a first line or sentence that greets, and what follows."""
    greeting = F.regexp_extract(body, r"(?i)^\s*((hi|hello|hey|dear|good (morning|afternoon|evening))\b[^\n.!?,]{0,40}[,.!]?)\s*", 1)
    return F.struct(greeting.alias("greeting"), F.ltrim(F.substring(F.ltrim(body), F.length(greeting) + 1, F.length(body))).alias("rest"))


def ensured_greeting(body: Column, user: Column) -> Column:
    """The body with a greeting, one of its own if it has it."""
    return F.when(split_greeting(body)["greeting"] != "", body).otherwise(F.concat(F.lit("Hi "), F.coalesce(F.nullif(F.trim(user), F.lit("")), F.lit("there")), F.lit(",\n\n"), body))


def split_closing(body: Column) -> Column:
    """A struct (rest, closing): a last paragraph that closes a letter, and what is before it."""
    closing = F.regexp_extract(F.rtrim(body), r"(?is)(?:^|\n)\s*((?:kind regards|best regards|regards|best|sincerely|cheers|let us know)\b[^\n]*(?:\n[^\n]{0,40})?)$", 1)
    return F.struct(F.rtrim(F.substring(F.rtrim(body), F.lit(1), F.length(F.rtrim(body)) - F.length(closing))).alias("rest"), closing.alias("closing"))


def with_fallback(body: Column, fallback: str = "there") -> Column:
    """{{user}} without a fallback of its own gets one."""
    return F.regexp_replace(body, r"(?i)\{\{\s*user\s*\}\}", "{{user|" + fallback + "}}")


def tidy(text: Column) -> Column:
    """Line ends as one new line, no blanks at line ends, one empty line at most between paragraphs."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's code points below 65,536 as one unit each."""
    step = lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619 % (1 << 32)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def tone(sentiment: Column, bank: dict[str, tuple[str, ...]], seed: Column) -> Column:
    """One sentence of a sentiment's bank, chosen by the hash of a seed; null for a sentiment without one."""
    out = F.lit(None).cast("string")
    for name, lines in bank.items():
        out = F.when(sentiment == name, F.element_at(F.array(*[F.lit(x) for x in lines]), (F.pmod(fnv1a(seed), F.lit(len(lines))) + 1).cast("int"))).otherwise(out)
    return out


def summary(template: Column, most: int = 300) -> Column:
    """Plain text of a template, of at most so many characters, as its display has room for no more."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(template, r"\{\{[^{}]*\}\}", " "), r"\s+", " ")), 1, most)


def native_variables(template: Column) -> Column:
    """Vendor variables {{ attr | fallback: "x" }} as {{attr|x}}; first_name and name become user."""
    out = F.regexp_replace(template, r"\{\{\s*([A-Za-z0-9_.]+)\s*\|\s*fallback:\s*[\"']([^\"']*)[\"']\s*\}\}", "{{$1|$2}}")
    return F.regexp_replace(out, r"\{\{\s*(?:user\.)?(?:first_name|name)\s*(\|[^{}]*)?\}\}", "{{user$1}}")


def guessed_format(content: Column) -> Column:
    """json, csv, text or unknown, by the first character and the first line."""
    t = F.ltrim(F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿", ""))
    line = F.substring_index(t, "\n", 1)
    separated = line.rlike(r"(?i)^[^\n]*(title|name|body|text|content)[^\n]*[,;\t]") | line.rlike(r"(?i)[,;\t][^\n]*(title|name|body|text|content)")
    return F.when(t == "", "unknown").when(t.rlike(r"^[\[{]"), "json").when(separated, "csv").when(t.rlike(r"(?m)^(---|### )"), "text").otherwise("unknown")
