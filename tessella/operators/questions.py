"""Questions of a message by topic: sentences, clauses, then an ordered fold that lets clauses join the topic before them.

The fold runs over the clauses of one text, in an Arrow UDF; texts never meet. Of a text at most CLAUSES clauses are read and QUESTIONS questions are
returned, which bounds the report of one message; both are parameters. Null, empty and letterless texts have no question.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessella.functions import classify

CLAUSES, QUESTIONS = 120, 6
#: From which score an intent is a clause's topic, and from which it makes a statement an issue.
TOPIC, ISSUE = 0.3, 0.35
#: Topics that are problems as such.
PROBLEMS = frozenset(("deposit_missing", "account_access", "technical"))
#: Our own words.
TROUBLE = frozenset("not no never unable missing pending stuck still wrong error problem issue failed fails declined rejected locked blocked frozen lost waiting delayed incorrect mistake".split())
CHATTER = frozenset("hi hello hey dear good morning afternoon evening day night greetings thank thanks you thx cheers regards best kind warm sincerely ok okay sure great perfect please team support guys there all everyone so much very a lot again in advance for your the sir madam mate".split())
THANKS = frozenset(("thank", "thanks", "thx"))
FILLERS = frozenset("so and but also ok okay hi hello hey btw then plus well sorry".split())
ASKING = frozenset("what when where why how who whose which".split())
AUXILIARY = frozenset("is are was were do does did can could will would should has have had am may isn't aren't doesn't don't didn't can't won't couldn't hasn't haven't".split())
PERSONS = frozenset("i you u it my there this that we they the your someone anyone a an any these those its".split())
REQUESTS = ("please", "pls", "kindly", "help me", "need help", "i want to", "i need to", "i would like", "i'd like", "can you", "could you", "would you", "let me know", "tell me", "give me", "send me", "check my", "look into")
NEW_TOPIC = ("and also", "also", "plus", "btw", "by the way", "additionally")
CONNECTORS = (*NEW_TOPIC, "and", "but")
STARTS = tuple("when what why how where which who can could would will is are do does did should please".split()) + ("i want", "i need", "i'd like")
SHORTENED = ("e.g.", "i.e.", "etc.", "vs.", "mr.", "mrs.", "ms.", "dr.", "approx.")

END = re.compile(r"[.?!…]+(?=\s|$)|\n+")
LEAD = re.compile(r"\s*(?:(?:[-*•]+|\d{1,2}[.)])\s+)?")
CUT = re.compile(r"(?i)(?:\s*[,;]\s*|\s+)(?:(%s)\s*,?\s+)?(?=(?:%s)\b)" % ("|".join(map(re.escape, sorted(CONNECTORS, key=len, reverse=True))), "|".join(STARTS)))
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


class Clause(NamedTuple):
    start: int
    end: int
    fresh: bool
    topic: str | None
    score: float
    asks: bool
    trouble: bool


def scored(text: str) -> tuple[str | None, float]:
    """The best intent of a text and its score, as classify.intent_scores has it; none below its least score."""
    norm = " ".join(text.translate(str.maketrans("‘’“”", "''\"\"")).lower().split())
    best = (0.0, "")
    for intent, words in sorted(classify.INTENTS.items()):
        n = sum(w in norm for w in words)
        score = math.floor((1 - math.exp(-n / classify.CURVE)) * 100 + 0.5) / 100
        best = max(best, (score, intent), key=lambda x: x[0])
    return (best[1], best[0]) if best[0] >= classify.LEAST else (None, 0.0)


def trimmed(text: str, start: int, end: int) -> tuple[int, int, bool] | None:
    """Without blanks and a list marker, and whether there was a marker; None without a letter."""
    lead = LEAD.match(text, start, end)
    at = lead.end()
    while end > at and text[end - 1].isspace():
        end -= 1
    return (at, end, bool(lead[0].strip())) if any(c.isalpha() for c in text[at:end]) else None


def sentences(text: str) -> Iterator[tuple[int, int, bool]]:
    last = 0
    for m in END.finditer(text):
        if m[0] == "." and text[last : m.end()].lower().endswith(SHORTENED):
            continue
        if piece := trimmed(text, last, m.end()):
            yield piece
        last = m.end()
    if piece := trimmed(text, last, len(text)):
        yield piece


def pieces(text: str) -> Iterator[tuple[int, int, bool]]:
    """Clauses as (start, end, whether a new topic is announced). A sentence is cut where a comma or a connector leads into a question."""
    for start, end, listed in sentences(text):
        fresh = listed or re.match(r"(?i)(?:%s|another (?:question|thing)|one more (?:question|thing))\b" % "|".join(NEW_TOPIC), text[start:end]) is not None
        last = start
        for m in CUT.finditer(text, start, end):
            if not m[1] and m[0].isspace():
                continue
            if piece := trimmed(text, last, m.start()):
                yield piece[0], piece[1], fresh
            fresh, last = " ".join((m[1] or "").lower().split()) in NEW_TOPIC, m.end()
        if piece := trimmed(text, last, end):
            yield piece[0], piece[1], fresh


def asking(text: str, words: list[str]) -> bool:
    """A question or a request: by its mark, by its first words, or by a phrase that asks for something."""
    rest = words[next((i for i, w in enumerate(words) if w not in FILLERS), len(words)) :]
    if text.rstrip().endswith("?") or any(f" {r} " in f" {' '.join(words)} " for r in REQUESTS):
        return True
    return len(rest) > 1 and (rest[0].split("'")[0] in ASKING or (rest[0] in AUXILIARY and rest[1] in PERSONS))


def small_talk(text: str, words: list[str]) -> bool:
    """Greetings, thanks and farewells, with a name of up to three words."""
    thanks = not THANKS.isdisjoint(words)
    rest = [w for w in WORD.findall(text) if w.lower() not in CHATTER and not (thanks and w.lower() == "help")]
    return not rest or (len(rest) < len(words) and len(rest) <= 3 and all(w[0].isupper() for w in rest) and scored(" ".join(rest))[0] is None)


def clause(text: str, start: int, end: int, fresh: bool) -> Clause | None:
    """What a clause is about; None for small talk."""
    part = text[start:end]
    words = [w.lower().replace("’", "'") for w in WORD.findall(part)]
    if small_talk(part, words):
        return None
    topic, score = scored(part)
    topic, score = (topic, score) if score >= TOPIC else (None, 0.0)
    trouble = any(w in TROUBLE or w.endswith("n't") for w in words) or "cannot" in words
    return Clause(start, end, fresh, topic, score, asking(part, words), trouble)


def topic_of(group: list[Clause]) -> str | None:
    return next((c.topic for c in group if c.topic), None)


def grouped(clauses: list[Clause]) -> list[list[Clause]]:
    """Clauses by topic, in order: one without a topic joins the topic before it, and before the first topic those wait for it; an announced topic begins a group."""
    groups: list[list[Clause]] = []
    waiting: list[Clause] = []
    for c in clauses:
        if c.fresh:
            groups += [waiting] if waiting else []
            groups, waiting = [*groups, [c]], []
        elif groups and c.topic in (None, topic_of(groups[-1])):
            groups[-1].append(c)
        elif groups or c.topic:
            groups.append([*waiting, c])
            waiting = []
        else:
            waiting.append(c)
    return [*groups, waiting] if waiting else groups


def wanted(group: list[Clause]) -> bool:
    """Whether a group asks for something, or states an issue."""
    topic = topic_of(group)
    issue = topic not in (None, "complaint") and max(c.score for c in group) >= ISSUE and (topic in PROBLEMS or any(c.trouble for c in group))
    return issue or any(c.asks for c in group)


def split(text: str | None, clauses: int = CLAUSES, most: int = QUESTIONS) -> list[tuple[str, str | None, int, int]]:
    """(text, intent or None, start, end) of the questions of a text."""
    read: list[Clause] = []
    for n, piece in enumerate(pieces(text or "")):
        if n == clauses:
            break
        if c := clause(text, *piece):
            read.append(c)
    out = []
    for group in grouped(read):
        if wanted(group):
            start, end = group[0].start, group[-1].end
            joined = " ".join(text[start:end].split())
            intent, score = scored(joined)
            out.append((joined, intent if score >= TOPIC else None, start, end))
    return out[:most]


QUESTION = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("intent", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def questions(text: Column, clauses: int = CLAUSES, most: int = QUESTIONS) -> Column:
    @pandas_udf(QUESTION)
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("text", "intent", "start", "end"), q, strict=True)) for q in split(t, clauses, most)])

    return of(text)


def question_rows(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """A row for each question: keys, place (from 1), question, intent, start, end. With keys and intent it is the table `asked` of the intents' operators."""
    rows = df.select(*keys, F.posexplode(questions(text)).alias("_p", "_q"))
    return rows.select(*keys, (F.col("_p") + 1).alias("place"), F.col("_q.text").alias("question"), "_q.intent", "_q.start", "_q.end")
