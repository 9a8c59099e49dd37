"""Message classification by phrase lists (our own), as column expressions: sentiment, urgency, risk signals, intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import caps_words, let, normalised

ANGRY = r"scam|thie(f|ves)|fraud|ridiculous|disgusting|worst|robbed|liars?"
FRUSTRATED = r"still|again|waiting|no (reply|response|answer)|for (days|weeks)|how long"
CONFUSED = r"don't understand|not sure|how do i|confus(ed|ing)|what does"
POSITIVE = r"thanks?|thank you|great|perfect|appreciate|love|awesome"
LEGAL = r"lawyer|legal action|regulator|police|ombudsman"
CHARGEBACK = r"charge ?back|dispute the payment"
URGENT = r"urgent|asap|emergency|immediately"
RISK = ("addict", "lost everything", "can't stop", "gambling problem", "self exclu", "close my account forever", "chasing my losses")
CRITICAL = ("kill myself", "end my life", "suicid", "hurt myself")
#: intent -> phrases; each phrase that occurs is evidence of weight 1.
INTENTS = {
    "withdrawal_status": ("withdrawal", "payout", "cash out"),
    "deposit_missing": ("deposit", "top up", "not credited"),
    "bonus": ("bonus", "promo", "free spins"),
    "verification": ("verify", "verification", "documents", "passport"),
    "account_access": ("password", "log in", "login", "locked out"),
    "technical": ("error", "crash", "not loading", "bug"),
    "complaint": ("complain", "complaint", "unacceptable"),
}
CURVE, LEAST = 2.2, 0.15


def hits(text: Column, words: str) -> Column:
    return F.regexp_count(text, F.lit(rf"\b({words})\b")).cast("long")


def sentiment(text: Column) -> Column:
    """angry, frustrated, confused, positive or neutral; shouting and !!! only strengthen."""
    norm = F.coalesce(normalised(text), F.lit(""))
    caps = caps_words(text)
    angry, frustrated, confused, positive = (hits(norm, w) for w in (ANGRY, FRUSTRATED, CONFUSED, POSITIVE))
    amplify = (angry > 0) | (frustrated > 0) | (positive == 0)
    loud = F.when(F.coalesce(text, F.lit("")).rlike("!{3,}"), 1).otherwise(0) + F.when(caps["caps"] >= 2, 1).otherwise(0)
    anger = angry + F.when(amplify, loud).otherwise(0)
    return F.when(anger > 0, "angry").when(frustrated > 0, "frustrated").when(confused > 0, "confused").when(positive > 0, "positive").otherwise("neutral")


def phrases(text: Column, words: tuple[str, ...]) -> Column:
    """Those of the phrases that occur."""
    norm = F.coalesce(normalised(text), F.lit(""))
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(norm, w))


def urgency(text: Column, amount: Column, wait_hours: Column) -> Column:
    """critical, high, low or normal."""
    norm = F.coalesce(normalised(text), F.lit(""))
    high = (F.size(phrases(text, RISK)) > 0) | (sentiment(text) == "angry") | (hits(norm, LEGAL) > 0) | (hits(norm, CHARGEBACK) > 0) | (hits(norm, URGENT) > 0) | F.coalesce(wait_hours >= 24, F.lit(False)) | F.coalesce(amount >= 1000, F.lit(False))
    return F.when(F.size(phrases(text, CRITICAL)) > 0, "critical").when(high, "high").when(sentiment(text) == "positive", "low").otherwise("normal")


def intent_scores(text: Column, norm: Column | None = None) -> Column:
    """Array of (intent, score): 1 - e^(-evidence / 2.2), from 0.15 on, best first; `general` at 0.3 where there is none. norm: the text, normalised, where the caller has it."""

    def scored(norm: Column) -> Column:
        found = []
        for intent, words in INTENTS.items():
            raw = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(norm, w)))
            score = F.floor((1 - F.exp(-raw / CURVE)) * 100 + 0.5) / 100
            found.append(F.struct((-score).alias("k"), F.lit(intent).alias("intent"), score.alias("score")))
        return F.slice(F.array_sort(F.filter(F.array(*found), lambda x: x["score"] >= LEAST)), 1, 3)

    general = F.array(F.struct(F.lit("general").alias("intent"), F.lit(0.3).alias("score")))
    named = lambda best: F.transform(best, lambda x: F.struct(x["intent"].alias("intent"), x["score"].alias("score")))
    best = let(F.coalesce(normalised(text) if norm is None else norm, F.lit("")), scored)
    return let(best, lambda b: F.when(F.size(b) > 0, named(b)).otherwise(general))
