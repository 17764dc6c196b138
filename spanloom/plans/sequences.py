"""Counts and decoders of sequence models over ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import segment, sequence
from ..tasks import spread
from .tables import Plans, table

P = Plans()

_WORDS = r"SELECT doc_id, lang, unnest(w) AS token, unnest(range(len(w))) AS seq FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents)"


@P.add("seq6_emission_logprob", f"""WITH n AS (SELECT lang AS state, token, count(*) AS n FROM ({_WORDS}) WHERE lang IS NOT NULL GROUP BY ALL)
SELECT state, token, n, round(ln(n / sum(n) OVER (PARTITION BY state)), 9) AS logp FROM n""")
def emissions(spark, sf):
    """SEQ5/SEQ6: log probabilities of tokens given states (languages stand for states)."""
    docs = table(spark, sf, "documents", "lang", "text").where("lang IS NOT NULL")
    tagged = docs.select(F.col("lang").alias("tag"), F.explode(segment.word_array(F.col("text"))).alias("w")).select("tag", F.col("w").alias("token"))
    return sequence.emission_counts(tagged).select("state", "token", "n", F.round("logp", 9).alias("logp"))


@P.add("seq6_transition_logprob", """WITH s AS (SELECT user_id, event_type AS tag, coalesce(lag(event_type) OVER w, 'start') AS source, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
a AS (SELECT source, tag AS target FROM s UNION ALL SELECT tag, 'end' FROM s WHERE nxt IS NULL), n AS (SELECT source, target, count(*) AS n FROM a GROUP BY ALL)
SELECT source, target, n, round(ln(n / sum(n) OVER (PARTITION BY source)), 9) AS logp FROM n""")
def transitions(spark, sf):
    """HMM2/SEQ6: arcs of the event types of each user, with start and end states."""
    rows = table(spark, sf, "events", "user_id", "event_id", "event_type").withColumnRenamed("event_type", "tag")
    return sequence.transition_counts(rows, ["user_id"], "event_id").select("source", "target", "n", F.round("logp", 9).alias("logp"))


@P.add("seq6_bigram_logprob", f"""WITH w AS (SELECT doc_id, seq, token, lag(token) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM ({_WORDS})),
n AS (SELECT prev, token, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY ALL)
SELECT prev, token, n, round(ln(n / sum(n) OVER (PARTITION BY prev)), 9) AS logp FROM n""")
def bigrams(spark, sf):
    """SEQ5: bigrams of words.  Neighbours are read inside a row's word array: no shuffle before the counts, and one behind them, as totals are summed where the counts lie."""
    n = sequence.bigram_counts(table(spark, sf, "documents", "text"))
    total = F.sum("n").over(W.partitionBy("prev"))
    return n.select("prev", "token", "n", F.round(F.log(F.col("n") / total), 9).alias("logp"))


@P.add("hmm4_name_list", """WITH w AS (SELECT p_brand AS type, string_split(p_name, ' ') AS w FROM part), x AS (SELECT type, len(w) AS k, unnest(w) AS token, unnest(range(len(w))) AS p FROM w)
SELECT CASE WHEN k = 1 THEN 'i-' WHEN p = 0 THEN 'b-' WHEN p = k - 1 THEN 'e-' ELSE 'm-' END || type AS state, token, count(*) AS n FROM x GROUP BY ALL""")
def name_list(spark, sf):
    names = table(spark, sf, "part", "p_name", "p_brand").select(F.col("p_brand").alias("type"), F.col("p_name").alias("name"))
    return sequence.name_list_counts(names)


@P.add("seq11_context_features", """SELECT conv_id, CAST(turn AS BIGINT) AS turn, 'p=' || coalesce(lag(role) OVER w, '-') || ' c=' || role || ' n=' || coalesce(lead(role) OVER w, '-') || ' n2=' || coalesce(lead(role, 2) OVER w, '-') || ' shape=lowerCase' AS features
FROM conversations WHERE role IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "role").where("role IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").alias("token"))
    return sequence.context_features(rows, ["conv_id"], "turn").select("conv_id", "turn", F.array_join("features", " ").alias("features"))


@P.add("seq17_softmax", """WITH w AS (SELECT * FROM (VALUES ('A', 'x', 1.5), ('A', 'y', -0.5), ('N', 'x', 0.25), ('R', 'y', 2.0), ('O', 'x', 0.5), ('F', 'y', 0.75), ('F', 'x', 0.1)) t(feature, outcome, weight)),
e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS event_id, l_returnflag AS a, l_linestatus AS b FROM lineitem),
z AS (SELECT event_id, outcome, sum(CAST(weight AS DOUBLE)) AS z FROM (SELECT event_id, a AS feature FROM e UNION ALL SELECT event_id, b FROM e) JOIN w USING (feature) GROUP BY ALL)
SELECT event_id, outcome, round(exp(z) / sum(exp(z)) OVER (PARTITION BY event_id), 9) AS p FROM z""")
def softmax(spark, sf):
    """SEQ17: probabilities of a linear log model as joins and aggregates."""
    weights = [("A", "x", 1.5), ("A", "y", -0.5), ("N", "x", 0.25), ("R", "y", 2.0), ("O", "x", 0.5), ("F", "y", 0.75), ("F", "x", 0.1)]
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    events = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.array("l_returnflag", "l_linestatus").alias("features"))
    events = spread(events, rows.count(), "event_id").distinct()  # one shuffle serves all steps
    return sequence.softmax_scores(events, spark.createDataFrame(weights, "feature string, outcome string, weight double")).select("event_id", "outcome", F.round("p", 9).alias("p"))


@P.add("seq1_viterbi")
def viterbi(spark, sf):
    """SEQ1-SEQ3: event types decoded by a model counted on the same table (two states: before and after noon)."""
    rows = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type").withColumn("tag", F.when(F.hour(F.col("ts").cast("timestamp")) < 12, "am").otherwise("pm")).withColumnRenamed("event_type", "token")
    model = sequence.Hmm.from_tables(sequence.emission_counts(rows), sequence.transition_counts(rows, ["user_id"], "event_id"))
    sentences = rows.groupBy(F.col("user_id").alias("sent_id"), F.window(F.col("ts").cast("timestamp"), "1 day").alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "token"))), lambda x: x["token"]).alias("words"))
    out = sequence.decode(sentences.select("sent_id", "words"), model)
    return out.select("sent_id", "rank", F.round("logp", 6).alias("logp"), F.array_join("tags", " ").alias("tags"))


QUERIES, ORACLES = P.queries, P.oracles
