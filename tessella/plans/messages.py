"""Queries of message analysis and intents over messages that are put together from the orders' keys, with SQL that computes the same from the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import classify, signals, text
from tessella.operators import intents, terms
from tessella.plans.queries import _NOISE, _stem_sql, _t, _tokens_sql, query

OPENERS = ("This is a scam!!!", "Still waiting,", "How do I verify my account?", "Thank you, great support.", "I lost everything and can't stop.", "NOT HAPPY WITH THIS", "Hello,")
TOPICS = (
    "my withdrawal has been pending for 3 days", "the deposit was not credited", "where is my bonus?", "the documents were rejected", "I forgot my password, but the deposit arrived", "the slots crash with an error",
    "my deposit arrived; the payout is stuck", "a complaint about the odds of my parlay", "free spins and the promo code", "I will call my lawyer", "please do a charge back", "je ne comprends rien à votre jeu de poker et je voudrais savoir",
)
ENDS = ("", ". I waited 2 weeks", ". It is urgent", ". It was 1,500.50 USD", ". Deposit of 2k EUR", ". Sent 80 usd")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_M = f"m AS (SELECT o_orderkey, {_sql_list(OPENERS)}[o_orderkey % {len(OPENERS)} + 1] || ' ' || {_sql_list(TOPICS)}[o_custkey % {len(TOPICS)} + 1] || {_sql_list(ENDS)}[(o_orderkey + o_custkey) % {len(ENDS)} + 1] AS message FROM orders), n AS (SELECT o_orderkey, message, lower(message) AS norm FROM m)"


def _messages(spark, d) -> DataFrame:
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, d, "orders").select("o_orderkey", F.concat(pick(OPENERS, k), F.lit(" "), pick(TOPICS, c), pick(ENDS, k + c)).alias("message"))


def _hit(words: str, column: str = "norm") -> str:
    return "regexp_matches({}, '\\b({})\\b')".format(column, words.replace("'", "''"))


_CAPS = "len(list_filter(regexp_extract_all(message, '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '\\p{N}') AND regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '\\p{Ll}')))"
_LOUD = f"(regexp_matches(message, '!{{3,}}') OR {_CAPS} >= 2)"
_SENTIMENT = f"CASE WHEN {_hit(classify.ANGRY)} OR ({_LOUD} AND ({_hit(classify.FRUSTRATED)} OR NOT {_hit(classify.POSITIVE)})) THEN 'angry' WHEN {_hit(classify.FRUSTRATED)} THEN 'frustrated' WHEN {_hit(classify.CONFUSED)} THEN 'confused' WHEN {_hit(classify.POSITIVE)} THEN 'positive' ELSE 'neutral' END"
_RISKS = "list_filter({}, lambda w: contains(norm, w))".format(_sql_list(classify.RISK))
_HOURS = r"list_max(list_transform(regexp_extract_all(norm, '((wait|pending|still|nothing|since)[^.!?]{0,40}?)(\d+) (hour|day|week)s?'), lambda x: CAST(regexp_extract(x, '(\d+) (hour|day|week)s?$', 1) AS DOUBLE) * CASE WHEN regexp_matches(x, 'hours?$') THEN 1 WHEN regexp_matches(x, 'days?$') THEN 24 ELSE 168 END))"
_AMOUNT = r"list_max(list_transform(regexp_extract_all(norm, '(\d[\d.,]*k?) ?(usd|eur|gbp|dollars|euros)\b', 1), lambda x: CAST(regexp_replace(replace(x, ',', ''), 'k$', '') AS DOUBLE) * CASE WHEN x LIKE '%k' THEN 1000 ELSE 1 END))"


@query(f"WITH {_M} SELECT o_orderkey, {_SENTIMENT} AS sentiment FROM n")
def sentiment(spark, d):
    """Sentiment of each message."""
    return _messages(spark, d).select("o_orderkey", classify.sentiment(F.col("message")).alias("sentiment"))


@query(f"WITH {_M} SELECT o_orderkey, {_RISKS} AS signals FROM n")
def rg_signals(spark, d):
    """Risk phrases of each message."""
    return _messages(spark, d).select("o_orderkey", classify.phrases(F.col("message"), classify.RISK).alias("signals"))


@query(f"""WITH {_M}, s AS (SELECT o_orderkey, {_SENTIMENT} AS sentiment, len({_RISKS}) > 0 OR {_hit(classify.LEGAL)} OR {_hit(classify.CHARGEBACK)} OR {_hit(classify.URGENT)} OR coalesce({_HOURS} >= 24, false) OR coalesce({_AMOUNT} >= 1000, false) AS high FROM n)
SELECT o_orderkey, CASE WHEN high OR sentiment = 'angry' THEN 'high' WHEN sentiment = 'positive' THEN 'low' ELSE 'normal' END AS urgency FROM s""")
def urgency(spark, d):
    """Urgency of each message, from its words, waits and amounts."""
    return _messages(spark, d).select("o_orderkey", classify.urgency(F.col("message"), signals.largest_amount(F.col("message")), signals.wait_hours(F.col("message"))).alias("urgency"))


@query(f"WITH {_M} SELECT o_orderkey, {_HOURS} AS wait_hours, {_AMOUNT} AS amount FROM n")
def waits_and_amounts(spark, d):
    """Longest wait and largest amount of each message."""
    return _messages(spark, d).select("o_orderkey", signals.wait_hours(F.col("message")).alias("wait_hours"), signals.largest_amount(F.col("message")).alias("amount"))


_SCORES = ", ".join("struct_pack(intent := '{}', score := floor((1 - exp(-(({}) / 2.2))) * 100 + 0.5) / 100)".format(i, " + ".join(f"CASE WHEN contains(norm, '{w}') THEN 1.0 ELSE 0.0 END" for w in words)) for i, words in classify.INTENTS.items())
_TOP = f"scored AS (SELECT o_orderkey, unnest([{_SCORES}]) AS x FROM n), strong AS (SELECT o_orderkey, x.intent AS intent, x.score AS score, row_number() OVER (PARTITION BY o_orderkey ORDER BY x.score DESC, x.intent) AS place FROM scored WHERE x.score >= 0.15), top AS (SELECT o_orderkey, intent, CAST(score AS DOUBLE) AS score FROM strong WHERE place <= 3 UNION ALL SELECT o_orderkey, 'general', 0.3 FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM strong))"


def _scores(spark, d) -> DataFrame:
    return _messages(spark, d).select("o_orderkey", F.inline(classify.intent_scores(F.col("message"))))


@query(f"WITH {_M}, {_TOP} SELECT o_orderkey, intent, score FROM top")
def intent_scores(spark, d):
    """The three best intents of each message."""
    return _scores(spark, d)


_CLAUSE = r"c AS (SELECT o_orderkey, trim(rtrim(x, '.!?;, ')) AS text, contains(p, '?') AS question FROM (SELECT o_orderkey, p, unnest(regexp_split_to_array(p, '(?i)\s(?:but|however|though)\s')) AS x FROM (SELECT o_orderkey, unnest(string_split(regexp_replace(message, '([.!?;,]+)', '\1' || chr(10), 'g'), chr(10))) AS p FROM m)))"
_FLOW = "CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])({})($|[^a-z0-9])') THEN '{}' END"
_FLOWS = "[" + ", ".join(_FLOW.format("|".join(w), n) for n, w in signals.FLOWS.items()) + "]"
_HELD = "len(list_filter({}, lambda w: contains(' ' || trim(regexp_replace(regexp_replace(lower(text), 'n''t\\b', ' not', 'g'), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || w || ' ')))"
_ASKING = "(question OR regexp_extract(lower(text), '[a-z0-9]+') IN ({}))".format(", ".join(f"'{w}'" for w in signals.AUXILIARY))
_DONE = f"({_HELD.format(_sql_list(signals.THERE))} * {signals.FOR_IT} > {_HELD.format(_sql_list(signals.AGAINST))} * {signals.AGAINST_IT} + CASE WHEN {_ASKING} THEN {signals.AGAINST_IT} ELSE 0 END)"
_STATE = f"s AS (SELECT o_orderkey, flow, bool_or(done) AS done, bool_or(NOT done) AS open FROM (SELECT o_orderkey, {_DONE} AS done, unnest({_FLOWS}) AS flow FROM c WHERE text <> '') WHERE flow IS NOT NULL GROUP BY ALL)"
# each message's questions are those of its clauses with a question mark; their intent is the best of the clause's own words
_ASKED = f"""{_CLAUSE}, cq AS (SELECT o_orderkey, row_number() OVER () AS cid, lower(text) AS norm FROM c WHERE question AND text <> ''), cs AS (SELECT cid, unnest([{_SCORES}]) AS x FROM cq),
asked AS (SELECT o_orderkey, coalesce(x.intent, 'general') AS intent FROM cq LEFT JOIN (SELECT cid, x FROM cs WHERE x.score >= 0.15 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY x.score DESC, x.intent) = 1) USING (cid))"""
_MACROS = "macro_intents AS (SELECT p_partkey AS macro_id, unnest([['withdrawal_status', 'complaint'], ['deposit_missing'], ['bonus'], ['verification', 'account_access'], ['technical'], ['general']][p_partkey % 6 + 1]) AS intent FROM part)"
RELATED = (("withdrawal_status", "deposit_missing"), ("verification", "account_access"), ("bonus", "complaint"))
_RELATED = "related AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in RELATED) + ") t(a, b))"
_WEIGHTS = "weights AS (SELECT o_orderkey, intent, max(w) AS weight FROM (SELECT o_orderkey, intent, least(greatest(score, 0), 1) AS w FROM top UNION ALL SELECT o_orderkey, intent, 0.5 FROM asked WHERE intent <> 'general') GROUP BY ALL)"
_WANTED = "wanted AS (SELECT DISTINCT o_orderkey, intent FROM (SELECT o_orderkey, intent FROM top WHERE score >= 0.35 UNION ALL SELECT o_orderkey, intent FROM asked) WHERE intent <> 'general')"


def _asked(spark, d) -> DataFrame:
    each = _messages(spark, d).select("o_orderkey", F.explode(signals.clauses(F.col("message"))).alias("c")).where("c.question")
    top = F.element_at(classify.intent_scores(F.col("c.text")), 1)["intent"]
    return each.select("o_orderkey", top.alias("intent"), F.col("c.text").alias("text"))


def _macro_intents(spark, d) -> DataFrame:
    kinds = (("withdrawal_status", "complaint"), ("deposit_missing",), ("bonus",), ("verification", "account_access"), ("technical",), ("general",))
    listed = F.array(*[F.array(*[F.lit(x) for x in k]) for k in kinds])
    return _t(spark, d, "part").select(F.col("p_partkey").alias("macro_id"), F.explode(F.element_at(listed, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("intent"))


def _related(spark) -> DataFrame:
    return spark.createDataFrame([*RELATED, *[(b, a) for a, b in RELATED]], "a string, b string")


KEYS = ["o_orderkey"]


@query(f"WITH {_M}, {_ASKED} SELECT o_orderkey, intent, count(*) AS n_questions FROM asked GROUP BY ALL")
def question_intents(spark, d):
    """How many questions of a message ask for each intent."""
    return intents.question_counts(_asked(spark, d), KEYS)


@query(f"WITH {_M}, {_TOP}, {_ASKED}, {_WEIGHTS} SELECT o_orderkey, intent, CAST(weight AS DOUBLE) AS weight FROM weights")
def intent_weights(spark, d):
    """Weight of each intent of a message."""
    return intents.weights(_scores(spark, d), _asked(spark, d), KEYS)


@query(f"WITH {_M}, {_TOP}, {_ASKED}, {_WANTED} SELECT o_orderkey, intent FROM wanted WHERE NOT (intent = 'complaint')")
def wanted_intents(spark, d):
    """Intents that a message clearly asks for, without a suppressed one."""
    suppressed = _t(spark, d, "orders").select("o_orderkey", F.lit("complaint").alias("intent"))
    return intents.wanted(_scores(spark, d), _asked(spark, d), KEYS, suppressed)


@query(f"""WITH {_M}, {_TOP}, {_ASKED}, second AS (SELECT o_orderkey, bool_or(place > 1 AND score >= 0.35 AND intent <> 'general') AS s FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, intent) AS place FROM top) GROUP BY o_orderkey)
SELECT o_orderkey, s OR coalesce(n, 0) >= 2 AS multi_topic FROM second LEFT JOIN (SELECT o_orderkey, count(DISTINCT intent) AS n FROM asked WHERE intent <> 'general' GROUP BY o_orderkey) USING (o_orderkey)""")
def multi_topic(spark, d):
    """Whether a message asks for more than one thing."""
    return intents.multi_topic(_scores(spark, d), _asked(spark, d), KEYS)


# pairs of messages and classes of macros, a class being all macros of one set of intents, each pair under the class's smallest macro_id; and each macro's class
@query(f"""WITH {_M}, {_TOP}, {_ASKED}, {_WEIGHTS}, {_MACROS}, {_RELATED}, members AS (SELECT macro_id, list_sort(list(intent)) AS own FROM macro_intents GROUP BY macro_id), classes AS (SELECT own, min(macro_id) AS class_id, count(*) AS n_macros FROM members GROUP BY own), each AS (SELECT own, unnest(own) AS intent FROM classes),
pairs AS (SELECT o_orderkey, own, weight AS score, NULL AS related_to FROM weights JOIN each USING (intent) UNION ALL SELECT o_orderkey, own, weight * 0.5, w.intent FROM each i JOIN related r ON r.a = i.intent JOIN weights w ON w.intent = r.b),
best AS (SELECT * FROM pairs WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey, own ORDER BY score DESC, related_to IS NULL DESC, related_to DESC) = 1)
SELECT 'match' AS part, o_orderkey AS id, class_id, own AS macro_intents, n_macros, CAST(score AS DOUBLE) AS score, related_to FROM best JOIN classes USING (own)
UNION ALL SELECT 'member', macro_id, class_id, own, n_macros, NULL, NULL FROM members JOIN classes USING (own)""")
def match_intents(spark, d):
    """Best intent match, exact or related, of each message and macro: a row `match` for each message (id) and class of macros, class_id being its smallest macro_id, and a row `member` for each macro (id) with its class.

    A class holds the macros of one set of intents, which all match alike; the two parts joined by class_id are the rows of all messages and macros.
    """
    members = _macro_intents(spark, d).groupBy("macro_id").agg(F.array_sort(F.collect_list("intent")).alias("macro_intents"))
    classes = F.broadcast(members.groupBy("macro_intents").agg(F.min("macro_id").alias("class_id"), F.count("*").alias("n_macros")))  # a row a set of intents
    each = F.broadcast(classes.select(F.col("class_id").alias("macro_id"), F.explode("macro_intents").alias("intent")))
    matched = intents.matched(intents.weights(_scores(spark, d), _asked(spark, d), KEYS), each, _related(spark), KEYS).join(classes, F.col("macro_id") == F.col("class_id"))
    shown = ("class_id", "macro_intents", "n_macros")
    pairs = matched.select(F.lit("match").alias("part"), F.col("o_orderkey").alias("id"), *shown, "score", "related_to")
    return pairs.unionByName(members.join(classes, "macro_intents").select(F.lit("member").alias("part"), F.col("macro_id").alias("id"), *shown, F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("related_to")))


_CHOSEN = "chosen AS (SELECT o_orderkey, o_custkey AS macro_id FROM orders)"


@query(f"WITH {_M}, {_TOP}, {_ASKED}, {_WANTED}, {_MACROS}, {_CHOSEN} SELECT o_orderkey, macro_id, intent FROM chosen JOIN macro_intents USING (macro_id) JOIN wanted USING (o_orderkey, intent)")
def covers_intents(spark, d):
    """Intents of a chosen macro that its message asks for."""
    chosen = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("macro_id"))
    return intents.covered(intents.wanted(_scores(spark, d), _asked(spark, d), KEYS), _macro_intents(spark, d), chosen, KEYS)


@query(f"""WITH {_M}, {_TOP}, {_ASKED}, {_WANTED}, {_MACROS}, {_RELATED}, {_CHOSEN}, has AS (SELECT o_orderkey, intent FROM chosen JOIN macro_intents USING (macro_id) UNION SELECT o_orderkey, b FROM chosen JOIN macro_intents i USING (macro_id) JOIN related r ON r.a = i.intent)
SELECT o_orderkey, intent FROM wanted WHERE (o_orderkey, intent) NOT IN (SELECT o_orderkey, intent FROM has)""")
def uncovered_intents(spark, d):
    """Wanted intents that neither a chosen macro's intents nor related ones cover."""
    chosen = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("macro_id"))
    return intents.uncovered(intents.wanted(_scores(spark, d), _asked(spark, d), KEYS), _macro_intents(spark, d), _related(spark), chosen, KEYS)


@query(f"WITH {_M}, {_ASKED}, {_MACROS}, {_CHOSEN} SELECT DISTINCT o_orderkey, intent FROM asked WHERE (o_orderkey, intent) NOT IN (SELECT o_orderkey, intent FROM chosen JOIN macro_intents USING (macro_id))")
def unanswered_questions(spark, d):
    """Intents of questions that no chosen macro answers."""
    chosen = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("macro_id"))
    asked = _asked(spark, d).withColumn("place", F.lit(0))
    return intents.unanswered(asked, chosen, _macro_intents(spark, d), KEYS).select("o_orderkey", "intent").distinct()


@query(f"""WITH {_M}, w AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS answered, unnest(string_split(lower(regexp_replace(message, '[^A-Za-z ]', '', 'g')), ' ')) AS term FROM m), g AS (SELECT o_orderkey // 4 AS grp, term, bool_or(answered) AS own FROM w GROUP BY ALL) SELECT grp, term FROM g WHERE NOT own""")
def foreign_terms(spark, d):
    """Words that only the unanswered messages of a group of four have."""
    words = F.split(F.lower(F.regexp_replace("message", "[^A-Za-z ]", "")), " ")
    rows = _messages(spark, d).select(F.expr("o_orderkey div 4").alias("grp"), (F.col("o_orderkey") % 2 == 0).alias("answered"), words.alias("terms"))
    return intents.foreign_terms(rows, ["grp"])


@query(f"WITH {_M}, {_CLAUSE}, {_STATE} SELECT o_orderkey, coalesce(list_sort(list(flow) FILTER (WHERE done AND NOT open)), []) AS resolved FROM m LEFT JOIN s USING (o_orderkey) GROUP BY o_orderkey")
def resolved_flows(spark, d):
    """Money flows that a message reports as arrived and doesn't leave open."""
    return _messages(spark, d).select("o_orderkey", signals.resolved_flows(F.col("message")).alias("resolved"))


@query(f"WITH {_M}, {_CLAUSE} SELECT o_orderkey, count(*) FILTER (WHERE text <> '') AS n_clauses, count(*) FILTER (WHERE text <> '' AND question) AS n_questions FROM c GROUP BY o_orderkey")
def message_clauses(spark, d):
    """Clauses and questions of each message."""
    c = signals.clauses(F.col("message"))
    return _messages(spark, d).select("o_orderkey", F.size(c).cast("long").alias("n_clauses"), F.size(F.filter(c, lambda x: x["question"])).cast("long").alias("n_questions"))


_PRODUCTS = "list_filter([" + ", ".join("CASE WHEN regexp_matches(norm, '(^|[^a-z0-9])({})($|[^a-z0-9])') THEN '{}' END".format("|".join(w), n) for n, w in signals.PRODUCTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {_M}, p AS (SELECT o_orderkey, {_PRODUCTS} AS products, CASE o_orderkey % 3 WHEN 0 THEN ['casino'] WHEN 1 THEN ['sports', 'poker'] ELSE CAST([] AS VARCHAR[]) END AS own FROM n) SELECT o_orderkey, products, len(products) > 0 AND len(own) > 0 AND NOT list_has_any(products, own) AS mismatch FROM p")
def product_mismatch(spark, d):
    """Products of each message, and whether a macro is for others only."""
    k = F.col("o_orderkey") % 3
    own = F.when(k == 0, F.array(F.lit("casino"))).when(k == 1, F.array(F.lit("sports"), F.lit("poker"))).otherwise(F.array().cast("array<string>"))
    p = _messages(spark, d).select("o_orderkey", signals.products(F.col("message")).alias("products"), own.alias("own"))
    return p.select("o_orderkey", "products", intents.product_mismatch(F.col("products"), F.col("own")).alias("mismatch"))


_WORDS = f"w AS (SELECT o_orderkey, token, min(pos) AS pos FROM (SELECT o_orderkey, unnest({_tokens_sql('message')}) AS token, generate_subscripts({_tokens_sql('message')}, 1) AS pos FROM m) WHERE NOT {_NOISE} GROUP BY ALL), generic AS (SELECT token FROM w GROUP BY token HAVING count(*) > {terms.GENERIC_SHARE} * (SELECT count(*) FROM m))"


@query(f"WITH {_M}, {_WORDS} SELECT o_orderkey, list_sort(list_distinct(list({_stem_sql('token')}))) AS terms FROM w WHERE token NOT IN (SELECT token FROM generic) GROUP BY o_orderkey")
def content_terms(spark, d):
    """Stems of the words of each message that carry a topic."""
    return terms.content_terms(_messages(spark, d), ["o_orderkey"], F.col("message"))


@query(f"WITH {_M}, {_WORDS} SELECT o_orderkey, list(token ORDER BY pos)[1:{terms.KEYWORDS}] AS keywords FROM w WHERE token NOT IN (SELECT token FROM generic) AND token <> 'usd' GROUP BY o_orderkey")
def message_keywords(spark, d):
    """The first words of each message that carry a topic, but for one that shall not be shown."""
    return terms.keywords(_messages(spark, d), ["o_orderkey"], F.col("message"), F.array(F.lit("USD")))


_ENGLISH = ", ".join(f"'{w}'" for w in signals.ENGLISH)


# of a message that has its text in column message
_FOREIGN = f"(len(regexp_extract_all(message, '\\p{{L}}')) > 0 AND len(regexp_extract_all(message, '\\p{{Latin}}')) < 0.6 * len(regexp_extract_all(message, '\\p{{L}}')) OR len({_tokens_sql('message')}) >= 8 AND len(list_filter({_tokens_sql('message')}, lambda x: x IN ({_ENGLISH}))) / len({_tokens_sql('message')}) < 0.05)"


@query(f"WITH {_M} SELECT o_orderkey, {_FOREIGN} AS foreign_text FROM m")
def non_english(spark, d):
    """Messages that are hardly English."""
    return _messages(spark, d).select("o_orderkey", signals.not_english(F.col("message")).alias("foreign_text"))


@query(r"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Hello ' || c_name || ',' ELSE '' END AS greeting, CASE WHEN c_custkey % 2 = 0 THEN 'Hello ' || c_name || ',' || chr(10) || chr(10) ELSE 'Hi ' || c_name || ',' || chr(10) || chr(10) END || 'Your desk is ready.' AS body,
CASE WHEN c_custkey % 3 = 0 THEN 'Kind regards,' || chr(10) || 'Ann' ELSE '' END AS closing, 'Hi {{user|there}} {{plan|x}} {{user|you}}' AS variables FROM customer""")
def reply_parts(spark, d):
    """Greeting, closing and variables of replies to each customer."""
    name, k = F.col("c_name"), F.col("c_custkey")
    body = F.concat(F.when(k % 2 == 0, F.concat(F.lit("Hello "), name, F.lit(",\n\n"))).otherwise(""), F.lit("Your desk is ready."))
    closed = F.concat(body, F.when(k % 3 == 0, F.lit("\n\nKind regards,\nAnn")).otherwise(""))
    raw = F.lit('Hi {{ user }} {{ plan | fallback: "x" }} {{ user.first_name | fallback: \'you\' }}')
    return _t(spark, d, "customer").select(
        "c_custkey", signals.split_greeting(body)["greeting"].alias("greeting"), signals.ensured_greeting(body, name).alias("body"), signals.split_closing(closed)["closing"].alias("closing"),
        signals.with_fallback(signals.native_variables(raw)).alias("variables"),
    )


@query(r"SELECT c_custkey, 'KYC and vip LIMITS2 of ' || c_mktsegment AS topic FROM customer")
def title_topics(spark, d):
    """Titles in running text: words in capitals stay."""
    return _t(spark, d, "customer").select("c_custkey", signals.title_topic(F.concat(F.lit("[all] KYC and Vip LIMITS2  of "), F.col("c_mktsegment"))).alias("topic"))


@query(r"SELECT page_id, octet_length(encode(html)) AS n_bytes, CASE WHEN ltrim(html) = '' THEN 'unknown' WHEN regexp_matches(ltrim(html), '^[\[{]') THEN 'json' WHEN regexp_matches(string_split(ltrim(html), chr(10))[1], '(?i)(title|name|body|text|content)[^\n]*[,;\t]') OR regexp_matches(string_split(ltrim(html), chr(10))[1], '(?i)[,;\t][^\n]*(title|name|body|text|content)') THEN 'csv' WHEN regexp_matches(ltrim(html), '(?m)^(---|### )') THEN 'text' ELSE 'unknown' END AS format FROM pages")
def guess_formats(spark, d):
    """Length in bytes and guessed format of each page's source."""
    return _t(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), signals.guessed_format(F.col("html")).alias("format"))


@query()
def reply_tones(spark, d):
    """A sentence of tone for each message, by its sentiment, chosen by the message's hash."""
    bank = {"angry": ("I understand your anger.", "I am sorry for the trouble."), "frustrated": ("Thank you for your patience.",)}
    m = _messages(spark, d)
    return m.select("o_orderkey", signals.tone(classify.sentiment(F.col("message")), bank, F.col("message")).alias("tone"), text.slug(F.col("message")).alias("slug"))
