"""Segmentation, word shapes, zones and dictionaries over ``documents``, ``events`` and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import lookup, segment
from .tables import Plans, table

P = Plans()

#: white space as both engines split it
_WS = r"[ \t\n\r\f\x0B]+"
#: word shapes over ASCII, first true wins (SQL side)
_SHAPE_SQL = """CASE WHEN regexp_full_match(token, '[0-9]{2}') THEN 'twoDigitNum' WHEN regexp_full_match(token, '[0-9]{4}') THEN 'fourDigitNum'
  WHEN regexp_full_match(token, '[0-9]+') THEN 'otherNum' WHEN regexp_full_match(token, '[A-Z]+') THEN 'allCaps' WHEN regexp_full_match(token, '[A-Z][a-z]+') THEN 'initCap'
  WHEN regexp_full_match(token, '[a-z]+') THEN 'lowerCase' WHEN regexp_full_match(token, '[A-Za-z0-9]+(-[A-Za-z0-9]+)+') THEN 'hyphenated' ELSE 'other' END"""
_WORDS_SQL = r"SELECT doc_id, lang, source, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS token FROM documents"
_EMAIL_SQL = r"[a-zA-Z0-9_.-]+(?: ?\.\.\. ?)?@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z0-9]+"


@P.add(
    "p0_language_profile",
    f"""WITH w AS ({_WORDS_SQL}), t AS (SELECT lang, {_SHAPE_SQL} AS shape FROM w),
n AS (SELECT lang, shape, count(*) AS tokens FROM t GROUP BY ALL),
m AS (SELECT lang, CAST(count(*) FILTER (WHERE len(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}')) > 0) AS BIGINT) AS email_docs FROM documents GROUP BY lang)
SELECT n.lang, shape, tokens, email_docs FROM n JOIN m ON n.lang IS NOT DISTINCT FROM m.lang""",
)
def language_profile(spark, sf):
    """Flagship: tokens of each shape and documents that mention an e-mail address, per language."""
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    shapes = docs.select("lang", F.explode(segment.word_array(F.col("text"))).alias("token")).groupBy("lang", strings.word_shape(F.col("token")).alias("shape")).agg(F.count("*").alias("tokens"))
    mails = docs.groupBy("lang").agg(F.count(F.when(F.size(segment.emails(F.col("text"))) > 0, 1)).alias("email_docs"))
    return shapes.join(F.broadcast(mails.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "shape", "tokens", "email_docs")  # a row per language


@P.add("seg3_email_tokens", f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n_emails, array_to_string(x, ' ') AS emails FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}') AS x FROM documents) WHERE len(x) > 0")
def email_tokens(spark, sf):
    x = segment.emails(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", x.alias("x")).where(F.size("x") > 0).select("doc_id", F.size("x").cast("long").alias("n_emails"), F.array_join("x", " ").alias("emails"))


@P.add("seg4_ws_tokens_by_lang", f"SELECT lang, count(*) AS tokens, count(DISTINCT token) AS types, CAST(sum(length(token)) AS BIGINT) AS chars FROM ({_WORDS_SQL}) GROUP BY lang")
def ws_tokens(spark, sf):
    """Token counts are summed up per type first: the shuffle carries types, not tokens."""
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    types = docs.select("lang", F.explode(segment.word_array(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return types.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.sum(F.col("n") * F.length("token")).alias("chars"))


@P.add("fea10_word_shape_counts", f"SELECT shape, count(*) AS tokens FROM (SELECT {_SHAPE_SQL} AS shape FROM ({_WORDS_SQL})) GROUP BY shape")
def word_shapes(spark, sf):
    docs = table(spark, sf, "documents", "text")
    return docs.select(F.explode(segment.word_array(F.col("text"))).alias("token")).groupBy(strings.word_shape(F.col("token")).alias("shape")).agg(F.count("*").alias("tokens"))


#: name, Java regular expression of a whole token
_FLAGS = {"initcap": "[A-Z].*", "allcaps": "[A-Z]+", "alldigits": "[0-9]+", "fourdigits": "[0-9]{4}", "multidot": r".*\..*\..*", "endsindot": r"[^.]+.*\.", "containsdash": ".*-.*", "singlechar": ".", "punctuation": "[,.;:?!-]"}


@P.add("fea1_token_flags", f"SELECT {', '.join(f'''CAST(count(*) FILTER (WHERE regexp_full_match(token, '{r}')) AS BIGINT) AS {n}''' for n, r in _FLAGS.items())} FROM ({_WORDS_SQL})")
def token_flags(spark, sf):
    token = F.explode(segment.word_array(F.col("text"))).alias("token")
    return table(spark, sf, "documents", "text").select(token).agg(*[F.count(F.when(strings.whole_match(F.col("token"), r), 1)).alias(n) for n, r in _FLAGS.items()])


@P.add(
    "fea5_shapes",
    f"""SELECT shape, short, count(*) AS tokens FROM (
SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '[^A-Za-z0-9]', '_', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '0', 'g') AS shape,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '[^A-Za-z0-9]+', '_', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '0', 'g') AS short FROM ({_WORDS_SQL})) GROUP BY ALL""",
)
def shapes(spark, sf):
    """FEA5: full and summarized shapes, counted per type before they meet."""
    t = F.col("token")
    swap = lambda c, plus: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"[^A-Za-z0-9]{plus}", "_"), f"[A-Z]{plus}", "A"), f"[a-z]{plus}", "a"), f"[0-9]{plus}", "0")
    tokens = table(spark, sf, "documents", "text").select(F.explode(segment.word_array(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.groupBy(swap(t, "").alias("shape"), swap(t, "+").alias("short")).agg(F.sum("n").alias("tokens"))


@P.add("fea4_letters_only", f"SELECT lang, CAST(sum(length(regexp_replace(token, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS letters, CAST(sum(length(regexp_replace(token, '[A-Za-z]', '', 'g'))) AS BIGINT) AS others FROM ({_WORDS_SQL}) GROUP BY lang")
def letters_only(spark, sf):
    words = F.array_join(segment.word_array(F.col("text")), "")
    n = lambda p: F.coalesce(F.sum(F.length(F.regexp_replace(words, p, "")).cast("long")), F.lit(0))
    return table(spark, sf, "documents", "lang", "text").where(F.size(segment.word_array(F.col("text"))) > 0).groupBy("lang").agg(n("[^A-Za-z]").alias("letters"), n("[A-Za-z]").alias("others"))


@P.add("seg6_sentences")
def sentence_counts(spark, sf):
    """Sentences per document, and their length."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    return segment.sentences(docs).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("chars"))


@P.add("seg1_tokens")
def token_counts(spark, sf):
    """Linguistic tokens per document and kind."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    t = segment.tokenize(docs)
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count("case").alias("n_caps"), F.count("intvalue").alias("n_numbers"), F.count("type").alias("n_typed"))


@P.add(
    "seg7_gap_sessions",
    """WITH s AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, CAST(min(epoch_us(ts)) AS BIGINT) AS first_us, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us FROM s GROUP BY user_id, session""",
)
def gap_sessions(spark, sf):
    """SEG7: a session ends where the gap to the next event is greater than an hour."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events", "event_id", "user_id", "ts").select("event_id", "user_id", us.alias("us"))
    return segment.gap_sessions(rows, "user_id", "us", F.lit(3_600_000_000), ["us", "event_id"]).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@P.add(
    "seg8_datelines",
    """SELECT doc_id, CAST(CASE WHEN at_ > 1 AND at_ <= 80 THEN at_ + 3 + length(regexp_extract(substr(text, at_ + 4), '^[ \\t\\n\\r\\f\\x0B]*')) END AS BIGINT) AS dateline_end
FROM (SELECT doc_id, 'Paris ' || chr(40) || 'AP) ' || coalesce(text, '') AS text, instr('Paris ' || chr(40) || 'AP) ' || coalesce(text, ''), '(AP)') AS at_ FROM documents)""".replace("\\\\", "\\"),
)
def datelines(spark, sf):
    """SEG8 over texts that begin with an agency mark."""
    text = F.concat(F.lit("Paris (AP) "), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", segment.dateline_end(text).cast("long").alias("dateline_end"))


@P.add(
    "seg9_text_breaks",
    r"""SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE t = '') AS BIGINT) AS n_blank, CAST(count(*) FILTER (WHERE t = '' OR regexp_full_match(t, '[-_~]+')) AS BIGINT) AS n_breaks
FROM (SELECT doc_id, regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)) GROUP BY doc_id""",
)
def text_breaks(spark, sf):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    n = lambda p: F.size(F.filter(lines, p)).cast("long")
    docs = table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines"), n(segment.is_blank).alias("n_blank"), n(segment.is_text_break).alias("n_breaks"))


@P.add("seg11_monocase", "SELECT doc_id, up AS upper, low AS lower, up = 0 OR up * 2 > up + low AS monocase FROM (SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS BIGINT) AS up, CAST(length(regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g')) AS BIGINT) AS low FROM documents)")
def monocase(spark, sf):
    text = F.coalesce("text", F.lit(""))
    up, low = segment.letter_cases(text)
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", up.cast("long").alias("upper"), low.cast("long").alias("lower"), segment.is_monocase(text).alias("monocase"))


@P.add("seg12_title_case")
def title_case(spark, sf):
    """SEG12 over the lines of all texts, in any script; SQL has no such classes, so tests compare it with brute force."""
    return _titles(table(spark, sf, "documents", "lang", "text"))


def _titles(docs):
    lines = docs.select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count(F.when(segment.is_title_case(F.col("line")), 1)).alias("titles"), F.count("*").alias("lines"))


@P.add("ann14_normalized_text", r"SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars_normal, sha256(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS t FROM documents)")
def normalized_text(spark, sf):
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _WS, " "))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.length(t).cast("long").alias("n_chars_normal"), F.sha2(t.cast("binary"), 256).alias("digest"))


@P.add("src10_erased_markup", "SELECT page_id, CAST(length(t) AS BIGINT) AS n, sha256(t) AS digest FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g') AS t FROM pages)")
def erased_markup(spark, sf):
    t = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")
    return table(spark, sf, "pages", "page_id", "html").select("page_id", F.length(t).cast("long").alias("n"), F.sha2(t.cast("binary"), 256).alias("digest"))


# ---------------------------------------------------------------- dictionaries
@P.add(
    "dic7_lookup",
    """SELECT c_custkey, n_name AS country, r_name AS region, coalesce(r_name, 'unknown') AS place_type FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def gazetteer_lookup(spark, sf):
    """DIC7/DIC10: dimension lookups, a miss is null; tables under the broadcast threshold are broadcast by Spark."""
    nation = table(spark, sf, "nation")
    out = table(spark, sf, "customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.coalesce("r_name", F.lit("unknown")).alias("place_type"))


@P.add(
    "dic5_token_classes",
    f"""WITH w AS ({_WORDS_SQL}), c AS (SELECT lower(split_part(p_type, ' ', 1)) AS word, min(p_brand) AS brand FROM part GROUP BY 1),
top AS (SELECT token, count(*) AS n FROM w GROUP BY token)
SELECT brand IS NOT NULL AS known, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types FROM top LEFT JOIN c ON lower(token) = word GROUP BY 1""",
)
def token_classes(spark, sf):
    """DIC5: class of each word by a left join on word types."""
    classes = table(spark, sf, "part", "p_type", "p_brand").groupBy(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("word")).agg(F.min("p_brand").alias("brand"))
    types = table(spark, sf, "documents", "text").select(F.explode(segment.word_array(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return types.join(classes, F.lower("token") == F.col("word"), "left").groupBy(F.col("brand").isNotNull().alias("known")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@P.add(
    "dic4_prefix_search",
    "SELECT p.p_brand AS key, CAST(count(*) AS BIGINT) AS hits, min(q.p_brand) AS first_hit FROM (SELECT DISTINCT p_brand FROM part) p JOIN (SELECT DISTINCT p_brand FROM part) q ON starts_with(p.p_brand || '9', q.p_brand) GROUP BY p.p_brand",
)
def prefix_search(spark, sf):
    """DIC4: all dictionary keys that are prefixes of a query, by equality on every prefix of it."""
    keys = table(spark, sf, "part", "p_brand").distinct()
    return lookup.common_prefixes(keys.select(F.concat("p_brand", F.lit("9")).alias("query")), keys.select(F.col("p_brand").alias("k")), "query", "k", 64).groupBy(F.col("query").substr(F.lit(1), F.length("query") - 1).alias("key")).agg(F.count("*").alias("hits"), F.min("k").alias("first_hit"))


@P.add("dic3_phrases")
def phrases(spark, sf):
    """DIC1/DIC3: greedy longest phrases of a small dictionary (the commonest word pairs' own words) over documents."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    entries = spark.createDataFrame([("of the", "P"), ("of the thin", "Q"), ("and", "C"), ("in the", "P"), ("the", "D")], "phrase string, class string")
    return lookup.annotate_texts(docs, entries).groupBy("class").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("docs"))


@P.add(
    "dic13_inflections",
    """SELECT word, CASE WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, length(word) - 1) || 'ies' ELSE word || 's' END AS plural,
CASE WHEN regexp_matches(word, 'e$') THEN word || 'd' WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, length(word) - 1) || 'ied' ELSE word || 'ed' END AS past,
CASE WHEN regexp_matches(word, '[^ei]e$') THEN left(word, length(word) - 1) || 'ing' WHEN regexp_matches(word, 'ie$') THEN left(word, length(word) - 2) || 'ying' ELSE word || 'ing' END AS participle
FROM (SELECT DISTINCT lower(split_part(p_type, ' ', 2)) AS word FROM part UNION SELECT unnest(['dog', 'box', 'city', 'day', 'church', 'bake', 'free', 'try']))""",
)
def inflections(spark, sf):
    more = spark.createDataFrame([(w,) for w in ("dog", "box", "city", "day", "church", "bake", "free", "try")], "word string")
    words = table(spark, sf, "part", "p_type").select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(2))).alias("word")).union(more).distinct()
    w = F.col("word")
    return words.select("word", lookup.plural(w).alias("plural"), lookup.past(w).alias("past"), lookup.present_participle(w).alias("participle"))


QUERIES, ORACLES = P.queries, P.oracles
