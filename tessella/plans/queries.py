"""Named queries over the test tables, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scoring, text
from tessella.operators import entities, features, lexical, library, ranker, vectors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL of the shared parts: tokens, noise, stems
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_NOISE = f"(length(token) < 2 OR length(token) > 32 OR token IN ({_STOP}) OR regexp_matches(token, '^[0-9]+$') OR (regexp_matches(token, '^[a-z0-9]{{16,}}$') AND regexp_matches(token, '[0-9]')))"


def _tokens_sql(column: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower(coalesce({column}, '')), '(\\p{{L}})[''’](\\p{{L}})', '\\1\\2', 'g'), '[\\p{{L}}\\p{{N}}]+')"


def _undouble_sql(b: str) -> str:
    return f"CASE WHEN length({b}) >= 3 AND right({b}, 1) = left(right({b}, 2), 1) AND right({b}, 2) NOT IN ('ll', 'ss', 'zz', 'ff') AND NOT regexp_matches(right({b}, 1), '[aeiouy]') THEN left({b}, length({b}) - 1) ELSE {b} END"


def _stem_sql(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"
    s = (
        f"CASE WHEN regexp_matches({t}, '(ies|ied)$') AND length({t}) >= 5 THEN {cut(3)} || 'y'"
        f" WHEN regexp_matches({t}, 'ing$') AND length({t}) >= 6 THEN CASE WHEN regexp_matches({cut(3)}, '[aeiouy]') THEN {_undouble_sql(cut(3))} ELSE {t} END"
        f" WHEN regexp_matches({t}, '[^e]ed$') AND length({t}) >= 5 THEN CASE WHEN regexp_matches({cut(2)}, '[aeiouy]') THEN {_undouble_sql(cut(2))} ELSE {t} END"
        f" WHEN regexp_matches({t}, 'ly$') AND length({t}) >= 6 THEN {cut(2)}"
        f" WHEN regexp_matches({t}, '([sxz]|ch|sh)es$') AND length({t}) >= 5 THEN {cut(2)}"
        f" WHEN regexp_matches({t}, 's$') AND NOT regexp_matches({t}, '(ss|us|is)$') AND length({t}) >= 4 THEN {cut(1)} ELSE {t} END"
    )
    return f"CASE WHEN length({t}) <= 3 OR regexp_matches({t}, '[0-9]') THEN {t} WHEN length({s}) >= 5 AND right({s}, 1) = 'e' AND right({s}, 2) <> 'ee' THEN left({s}, length({s}) - 1) ELSE {s} END"


_TERMS = f"terms AS (SELECT doc_id, {_stem_sql('token')} AS term FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) WHERE NOT {_NOISE})"
_TF = f"{_TERMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL), post AS (SELECT doc_id, term, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS dl FROM tf)"
_QT = f"""toks AS (SELECT conv_id, turn, token, pos FROM (SELECT conv_id, turn, unnest({_tokens_sql('text')}) AS token, generate_subscripts({_tokens_sql('text')}, 1) AS pos FROM conversations WHERE role = 'user') WHERE NOT {_NOISE}),
qfirst AS (SELECT conv_id, turn, {_stem_sql('token')} AS term, min(pos) AS pos FROM toks GROUP BY ALL),
qt AS (SELECT conv_id, turn, term FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS k FROM qfirst) WHERE k <= 32)"""
_BM25 = f"""{_TF}, {_QT}, stats AS (SELECT count(DISTINCT doc_id) AS n, (SELECT avg(dl) FROM (SELECT DISTINCT doc_id, dl FROM post)) AS avgdl FROM post), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT conv_id, turn, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * dl / avgdl)))) AS bm25 FROM post JOIN qt USING (term) JOIN df USING (term), stats GROUP BY ALL)"""


def _r(c: Column | str, digits: int = 6) -> Column:
    return scoring.rounded(F.col(c) if isinstance(c, str) else c, digits)


def _rs(x: str) -> str:
    return f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"


@query(f"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, count_if({_NOISE}) AS n_noise FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) GROUP BY doc_id")
def tokenize_terms(spark, d):
    """Tokens, distinct tokens and noise tokens of each document."""
    each = _t(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"), F.count_if(text.is_noise(F.col("token"))).alias("n_noise"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS n FROM terms GROUP BY term")
def stem_terms(spark, d):
    """Occurrences of each stem."""
    return lexical.postings(_t(spark, d, "documents"), "doc_id", F.col("text")).groupBy("term").agg(F.sum("tf").alias("n"))


@query(f"WITH {_TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def term_df(spark, d):
    """Document and collection frequency of each term."""
    return lexical.postings(_t(spark, d, "documents"), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_TF} SELECT doc_id, dl, count(*) AS n_terms FROM post GROUP BY ALL")
def doc_len(spark, d):
    """Length and distinct terms of each document."""
    return features.measured(features.whole_texts(_t(spark, d, "documents"), "doc_id", "text"), "doc_id", F.col("text"))


def _lexical_top(spark, d, most: int) -> DataFrame:
    return ranker.lexical_top(_t(spark, d, "conversations").where("role = 'user'"), _t(spark, d, "documents"), ["conv_id", "turn"], "doc_id", most)


@query(f"WITH {_BM25}, r AS (SELECT conv_id, turn, doc_id, {_rs('bm25')} AS bm25 FROM scored) SELECT conv_id, turn, doc_id, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY bm25 DESC, doc_id) AS rank FROM r) WHERE rank <= 3")
def bm25_top3(spark, d):
    """The three best documents of each user message by BM25+."""
    return _lexical_top(spark, d, 3).select("conv_id", "turn", "doc_id", _r("bm25").alias("bm25"), "rank")


@query(f"WITH {_BM25}, m AS (SELECT conv_id, turn, max(bm25) AS best FROM scored GROUP BY ALL) SELECT conv_id, turn, {_rs('best')} AS best, {_rs('1 - exp(-best / 60.0)')} AS saturation FROM m")
def lexical_saturated(spark, d):
    """Best BM25+ of each message and how far it counts."""
    best = _lexical_top(spark, d, 1).withColumnRenamed("bm25", "best")
    return best.select("conv_id", "turn", _r("best").alias("best"), _r(scoring.lexical(F.col("best"), F.col("best"))).alias("saturation"))


# DuckDB counts edits of bytes, so each letter beyond ASCII stands as a capital, which no token has
_ONE_BYTE = "translate(term, 'ßáäçèéêíñóöúü', 'ABCDEFGHIJKLM')"


@query(f"""WITH w AS (SELECT term, {_ONE_BYTE} AS t FROM (SELECT DISTINCT token AS term FROM (SELECT unnest({_tokens_sql('text')}) AS token FROM documents) WHERE NOT {_NOISE} AND length(token) >= 5)),
b AS (SELECT term, {_ONE_BYTE} AS t FROM (SELECT DISTINCT token AS term FROM (SELECT unnest({_tokens_sql('text')}) AS token FROM benchmark) WHERE NOT {_NOISE} AND length(token) >= 5))
SELECT b.term AS a, w.term AS b FROM b JOIN w ON left(b.t, 1) = left(w.t, 1) AND abs(length(b.t) - length(w.t)) <= 1 AND b.t <> w.t AND levenshtein(b.t, w.t) <= 1""")
def fuzzy_terms(spark, d):
    """Terms of the benchmark and of documents within one edit."""
    words = lambda t: _t(spark, d, t).select(F.explode(text.tokens(F.col("text"))).alias("token")).where(~text.is_noise(F.col("token"))).select(F.col("token").alias("term")).distinct()
    return lexical.fuzzy_terms(words("benchmark"), words("documents"))


@query()
def term_reach(spark, d):
    """What every stem of the benchmark reaches among the stems of the documents: itself, longer terms, and terms within two edits, with weights."""
    stems = lambda t, key: lexical.postings(_t(spark, d, t), key, F.col("text")).select("term").distinct()
    asked = stems("benchmark", "item_id").select(F.col("term").alias("asked"), "term", F.lit(1.0).alias("weight"))
    return lexical.reach(asked, stems("documents", "doc_id"), ["asked"]).select("asked", "term", _r("weight").alias("weight"))


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id, e.vec_id AS other, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS c FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT vec_id, other, floor(c * 10000.0 + 0.5) / 10000.0 AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other) AS rank FROM s) WHERE rank <= 10""")
def cosine_top10(spark, d):
    """The ten nearest vectors of every twentieth vector."""
    e = _t(spark, d, "embeddings")
    found = vectors.top_k(e.where("vec_id % 20 = 0"), e, 10)
    return found.select("vec_id", "other", _r("cosine", 4).alias("cosine"), "rank")


_HYBRID = """use AS (SELECT user_id, count_if(event_type = 'purchase') AS uses, count_if(event_type = 'click') AS clicks, max(value) AS top FROM events GROUP BY user_id), m AS (SELECT max(uses) AS most FROM use),
h AS (SELECT user_id, uses, CASE WHEN most > 0 THEN ln(1 + uses) / ln(1 + most) ELSE 0 END AS used, clicks % 5 = 0 AS favourite, (clicks % 100) / 100.0 AS semantic, (uses % 50) / 50.0 AS lex FROM use, m),
c AS (SELECT user_id, uses, favourite, least(greatest((semantic - 0.08) / 0.67, 0), 1) * 0.42 + lex * 0.30 + 0.5 * 0.22 + least(1, 0.6 * used + CASE WHEN favourite THEN 0.4 ELSE 0 END) * 0.06 AS s FROM h)"""


@query(f"WITH {_HYBRID} SELECT user_id, floor(s * 10000.0 + 0.5) / 10000.0 AS combined, CAST(floor(100 / (1 + exp(-6.5 * (s - 0.45))) + 0.5) AS BIGINT) AS confidence, floor(100 / (1 + exp(-6.5 * (s - 0.45))) + 0.5) < 45 AS no_match FROM c")
def hybrid_rank(spark, d):
    """Hybrid score, confidence and no-match flag from usage counts and derived signals."""
    e = _t(spark, d, "events")
    use = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("uses"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    most = use.agg(F.max("uses").alias("most"))
    h = use.crossJoin(F.broadcast(most))  # one row
    use_score = scoring.usage(F.col("uses"), F.col("most"), F.col("clicks") % 5 == 0)
    s = scoring.combined(scoring.calibrated((F.col("clicks") % 100) / 100.0), (F.col("uses") % 50) / 50.0, F.lit(0.5), use_score)
    out = h.select("user_id", s.alias("s"))
    return out.select("user_id", _r("s", 4).alias("combined"), scoring.confidence(F.col("s")).alias("confidence"), (scoring.confidence(F.col("s")) < scoring.NO_MATCH_BELOW).alias("no_match"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE version = n")
def latest_version(spark, d):
    """The latest order of each customer, orders being the customer's versions."""
    v = library.with_versions(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")])
    return library.latest(v, "o_custkey", "version").select("o_custkey", "o_orderkey", "o_totalprice", "version")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def version_history(spark, d):
    """All versions of each customer."""
    return library.with_versions(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "version")


_FACTS = "facts AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'contradicted' WHEN l_returnflag = 'A' AND l_quantity > 30 THEN 'outdated' WHEN l_returnflag = 'N' THEN 'verified' ELSE 'unchecked' END AS status FROM lineitem)"


def _facts(spark, d) -> DataFrame:
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    status = F.when((flag == "R") & (q > 40), "contradicted").when((flag == "A") & (q > 30), "outdated").when(flag == "N", "verified").otherwise("unchecked")
    return _t(spark, d, "lineitem").select("l_orderkey", status.alias("status"))


@query(f"WITH {_FACTS} SELECT l_orderkey, CASE WHEN bool_or(status = 'contradicted') THEN 'conflict' WHEN bool_or(status = 'outdated') THEN 'outdated' WHEN bool_and(status = 'verified') THEN 'verified' ELSE 'unverified' END AS verification, count(*) AS n_facts FROM facts GROUP BY l_orderkey")
def fact_rollup(spark, d):
    """Verification state of each order from its lines' states."""
    return library.rollup(_facts(spark, d), "l_orderkey")


@query(f"WITH {_FACTS} SELECT l_orderkey, count_if(status = 'contradicted') AS contradicted, count_if(status = 'outdated') AS outdated, count_if(status IN ('unchecked', 'unverifiable')) AS unchecked FROM facts GROUP BY l_orderkey")
def fact_warnings(spark, d):
    """Counts behind the warnings of each order."""
    return library.warnings(_facts(spark, d), "l_orderkey")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total FROM orders GROUP BY ALL")
def month_totals(spark, d):
    """Count and sum by month."""
    return _t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), scoring.rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type = 'click'")
def event_scan(spark, d):
    """Clicks of the last seven days."""
    e = _t(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.where("event_type = 'click'").join(F.broadcast(last), F.expr("ts >= last - INTERVAL 7 DAY")).select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type")
def event_retention(spark, d):
    """What a retention cutoff leaves, by type."""
    return library.retained(_t(spark, d, "events"), F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("SELECT user_id, count(*) AS use_count, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_used FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def use_counts(spark, d):
    """Uses and last use of each user."""
    return library.use_counts(_t(spark, d, "events"), "user_id", "purchase").withColumn("last_used", F.unix_timestamp("last_used"))


@query(r"WITH k AS (SELECT doc_id, lower(trim(regexp_replace(left(text, 60), '\s+', ' ', 'g'))) AS t FROM documents), f AS (SELECT t, min(doc_id) AS first FROM k GROUP BY t) SELECT doc_id, CASE WHEN first < doc_id THEN first END AS duplicate_of FROM k JOIN f USING (t)")
def dup_titles(spark, d):
    """Earlier document with the same title (a text's first 60 characters)."""
    return library.first_of_title(_t(spark, d, "documents"), "doc_id", F.substring("text", 1, 60))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def orphan_prune(spark, d):
    """Rows whose key is still in use."""
    return library.pruned(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def archived_anti(spark, d):
    """Rows that are not archived."""
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') AS url_key FROM pages")
def url_normalize(spark, d):
    """Comparison key of each page's URL."""
    return _t(spark, d, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query("""SELECT c_custkey, 'Hi ' || trim(c_name) || ', your segment is unknown and your desk is [ENTER DESK NAME].' AS reply, ['[ENTER DESK NAME]'] AS placeholders FROM customer""")
def render_template(spark, d):
    """A reply rendered for each customer: value, fallback and placeholder."""
    body = F.lit("Hi {{user}}, your segment is {{segment|unknown}} and your desk is {{desk_name}}.")
    reply = text.render(body, {"user": F.col("c_name"), "segment": F.lit(" "), "desk_name": F.lit(None).cast("string")})
    return _t(spark, d, "customer").select("c_custkey", reply.alias("reply")).withColumn("placeholders", text.placeholders(F.col("reply")))


@query(r"SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+([''’]\p{L}+)*')) AS n_words FROM conversations")
def word_counts(spark, d):
    """Words of each turn."""
    return _t(spark, d, "conversations").select("conv_id", "turn", text.word_count(F.col("text")).cast("long").alias("n_words"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')) AS w FROM documents), k AS (SELECT * FROM w WHERE length(w) >= 2 AND NOT regexp_matches(w, '\p{N}'))
SELECT doc_id, coalesce(n, 0) AS words, coalesce(c, 0) AS caps FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}')) AS c FROM k GROUP BY doc_id) USING (doc_id)""")
def caps_ratio(spark, d):
    """Words and shouted words of each document."""
    return _t(spark, d, "documents").select("doc_id", text.caps_words(F.col("text")).alias("x")).select("doc_id", "x.words", "x.caps")


@query("""WITH m AS (SELECT o_orderkey, [CAST(o_orderkey % 7 AS BIGINT), CAST(o_orderkey % 5 AS BIGINT), 3] AS a, [CAST(o_custkey % 7 AS BIGINT), 3, 4] AS b FROM orders)
SELECT o_orderkey, list_sort(list_distinct(a || b)) AS both_or_one, list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x)))) AS common, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS missing FROM m""")
def intent_setops(spark, d):
    """Union, intersection and difference of derived intent sets."""
    m = _t(spark, d, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 7, F.col("o_orderkey") % 5, F.lit(3).cast("long")).alias("a"), F.array(F.col("o_custkey") % 7, F.lit(3).cast("long"), F.lit(4).cast("long")).alias("b"))
    return m.select("o_orderkey", F.array_sort(F.array_union("a", "b")).alias("both_or_one"), F.array_sort(F.array_intersect("a", "b")).alias("common"), F.array_sort(F.array_except("a", "b")).alias("missing"))


@query("""WITH s AS (SELECT d.doc_id, quality, (length(text) % 101) / 100.0 AS score FROM documents d JOIN labels USING (doc_id))
SELECT quality, count(*) AS n, floor(avg(CASE WHEN (score >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END) * 1000000.0 + 0.5) / 1000000.0 AS accuracy, floor(avg(score) * 10000.0 + 0.5) / 10000.0 AS mean_score, quantile_disc(score, 0.95) AS p95 FROM s GROUP BY quality""")
def eval_metrics(spark, d):
    """Accuracy, mean and 95th percentile of a fixed score against the labels."""
    s = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("quality", ((F.char_length("text") % 101) / 100.0).alias("score"))
    right = F.when((F.col("score") >= 0.5) == (F.col("quality") == 1), 1.0).otherwise(0.0)
    return s.groupBy("quality").agg(F.count("*").alias("n"), _r(F.avg(right)).alias("accuracy"), _r(F.avg("score"), 4).alias("mean_score"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY score)").alias("p95"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM customer")
def slugs(spark, d):
    """Slug of each customer's name."""
    return _t(spark, d, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, floor(avg(value) * 10000.0 + 0.5) / 10000.0 AS mean_value FROM events GROUP BY event_type")
def event_summary(spark, d):
    """Events by type."""
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), _r(F.avg("value"), 4).alias("mean_value"))


@query()
def entity_spans(spark, d):
    """Entities of each document."""
    return entities.entity_rows(_t(spark, d, "documents"), "doc_id", F.col("text"))


@query()
def pii_spans(spark, d):
    """Personal data of each document, and how long its masked text is."""
    found = entities.personal_parts(_t(spark, d, "documents"), "doc_id", F.col("text"))
    return found.select("doc_id", "n_personal", F.char_length("masked").cast("long").alias("masked_chars"))


@query()
def question_spans(spark, d):
    """Questions of each user turn."""
    return _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", entities.questions(F.col("text")).alias("questions"))


@query()
def grounding(spark, d):
    """Claims of each document that its earlier neighbour, as its source, doesn't have."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return entities.ungrounded(docs, docs.select((F.col("doc_id") + 1).alias("doc_id"), "text"), "doc_id")


# further groups of queries register themselves
from tessella.plans import catalogue as _catalogue  # noqa: E402, F401
from tessella.plans import messages as _message_queries  # noqa: E402, F401
from tessella.plans import concepts as _concept_queries  # noqa: E402, F401
from tessella.plans import replies as _reply_queries  # noqa: E402, F401
from tessella.plans import texts as _text_queries  # noqa: E402, F401
from tessella.plans import ranking as _ranking_queries  # noqa: E402, F401
from tessella.plans import turns as _turn_queries  # noqa: E402, F401
from tessella.plans import mentions as _mention_queries  # noqa: E402, F401
from tessella.plans import imports as _import_queries  # noqa: E402, F401
