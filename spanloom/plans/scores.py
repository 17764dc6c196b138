"""Scoring, corpus counts, relations, events and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, scoring, sequence
from .tables import Plans, table

P = Plans()


def _r(c):
    return F.round(c, 9)


_PRF = "round(correct / nullif(response, 0), 9) AS precision, round(correct / nullif(key, 0), 9) AS recall, round(2 * (correct / response) * (correct / key) / nullif(correct / response + correct / key, 0), 9) AS f"


def _prf(df, *keep):
    return df.select(*keep, *[F.col(c).cast("long").alias(c) for c in ("correct", "response", "key")], *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f")])


@P.add("agg2_micro_rollup", f"""WITH m AS (SELECT source, d.doc_id % 3 = 0 AS r, quality = 1 AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NOT NULL),
c AS (SELECT source, CAST(count(*) FILTER (WHERE r AND k) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE r) AS BIGINT) AS response, CAST(count(*) FILTER (WHERE k) AS BIGINT) AS key FROM m GROUP BY ROLLUP (source))
SELECT source, correct, response, key, {_PRF} FROM c""")
def micro_rollup(spark, sf):
    """AGG1-AGG3: labels as keys, a fixed predictor as response; per source and in total."""
    d = table(spark, sf, "documents", "doc_id", "source").join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id")
    yes = F.lit("good")
    rows = d.select("source", F.when(F.col("doc_id") % 3 == 0, yes).alias("response_label"), F.when(F.col("quality") == 1, yes).alias("key_label"))
    rows = rows.withColumn("agrees", F.coalesce(F.col("response_label") == F.col("key_label"), F.lit(False)))
    return _prf(scoring.score_tags(rows, "source"), "source")


@P.add("agg1_tag_match", """SELECT coalesce(k.l_orderkey, r.l_orderkey) AS doc_id, CAST(count(*) FILTER (WHERE k.f = r.f) AS BIGINT) AS agree, CAST(count(*) FILTER (WHERE r.f IS NOT NULL) AS BIGINT) AS response, CAST(count(*) FILTER (WHERE k.f IS NOT NULL) AS BIGINT) AS key
FROM (SELECT l_orderkey, l_suppkey, max_by(l_returnflag, l_linenumber * 100000000 + l_partkey) AS f FROM lineitem WHERE l_quantity > 10 GROUP BY ALL) k
FULL JOIN (SELECT l_orderkey, l_suppkey, l_linestatus AS s, CASE WHEN l_discount > 0.05 THEN 'N' ELSE l_returnflag END AS f FROM lineitem WHERE l_quantity < 40) r
ON k.l_orderkey = r.l_orderkey AND k.l_suppkey = r.l_suppkey GROUP BY 1""")
def tag_match(spark, sf):
    """AGG1: exact-span outer join of responses and keys (order = document, supplier = span, flag = label)."""
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity")
    base = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("start"), F.col("l_suppkey").alias("end"), (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")).alias("seq"), F.lit(False).alias("optional"), F.col("l_returnflag").alias("kind"), "l_discount", "l_quantity")
    response = base.where("l_quantity < 40").withColumn("kind", F.when(F.col("l_discount") > 0.05, "N").otherwise(F.col("kind")))
    m = scoring.match_tags(response, base.where("l_quantity > 10"))
    n = lambda c: F.count(F.when(c, 1))
    return m.groupBy("doc_id").agg(n(F.col("agrees")).alias("agree"), n(F.col("response_label").isNotNull()).alias("response"), n(F.col("key_label").isNotNull()).alias("key"))


_SIDE = """SELECT a.doc, sum(a.mapped - a.parts) AS links, sum(a.mapped - 1) AS possible FROM (
  SELECT x.doc, x.entity, count(*) AS mapped, count(DISTINCT y.other) AS parts FROM {0} x JOIN (SELECT doc, head, max(entity) AS other FROM {1} GROUP BY ALL) y ON x.doc = y.doc AND x.head = y.head GROUP BY ALL) a GROUP BY a.doc"""


@P.add("agg5_coref_links", f"""WITH k AS (SELECT l_orderkey AS doc, l_linenumber AS head, l_suppkey % 3 AS entity FROM lineitem), r AS (SELECT l_orderkey AS doc, l_linenumber AS head, l_partkey % 3 AS entity FROM lineitem),
rec AS ({_SIDE.format('k', 'r')}), pre AS ({_SIDE.format('r', 'k')}),
b AS (SELECT coalesce(rec.doc, pre.doc) AS doc, rec.links AS rl, rec.possible AS rp, pre.links AS pl, pre.possible AS pp FROM rec FULL JOIN pre ON rec.doc = pre.doc),
t AS (SELECT doc, CAST(sum(rl) AS BIGINT) AS r_links, CAST(sum(rp) AS BIGINT) AS r_possible, CAST(sum(pl) AS BIGINT) AS p_links, CAST(sum(pp) AS BIGINT) AS p_possible FROM b GROUP BY ROLLUP (doc))
SELECT doc AS doc_id, r_links, r_possible, p_links, p_possible, round(r_links / nullif(r_possible, 0), 9) AS recall, round(p_links / nullif(p_possible, 0), 9) AS precision FROM t""")
def coref_links(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    side = lambda c: rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("head_end"), (F.col(c) % 3).alias("entity"))
    out = scoring.score_coref(side("l_partkey"), side("l_suppkey"))
    return out.select("doc_id", "r_links", "r_possible", "p_links", "p_possible", _r(F.col("recall")).alias("recall"), _r(F.col("precision")).alias("precision"))


@P.add("agg6_antecedent_lag", "SELECT conv_id, CAST(turn AS BIGINT) AS mention, CAST(lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS BIGINT) AS antecedent FROM conversations")
def antecedents(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "role").withColumn("mention", F.col("turn").cast("long"))
    return scoring.previous_mention(rows, ["conv_id", "role"], ["mention"]).select("conv_id", "mention", "antecedent")


@P.add("agg7_chain_diff", """WITH s AS (SELECT l_orderkey AS doc_id, l_suppkey % 2 AS e, list_sort(list(DISTINCT l_linenumber)) AS m FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey AS doc_id, l_partkey % 2 AS e, list_sort(list(DISTINCT l_linenumber)) AS m FROM lineitem GROUP BY ALL),
b AS (SELECT CASE WHEN s.m IS NULL THEN 'response' WHEN p.m IS NULL THEN 'key' ELSE 'OK' END AS status FROM (SELECT DISTINCT doc_id, m FROM s) s FULL JOIN (SELECT DISTINCT doc_id, m FROM p) p ON s.doc_id = p.doc_id AND s.m = p.m)
SELECT status, count(*) AS n FROM b GROUP BY status""")
def chain_diff(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    side = lambda c: rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("mention"), (F.col(c) % 2).alias("entity"))
    return scoring.compare_chains(side("l_partkey"), side("l_suppkey")).groupBy("status").agg(F.count("*").alias("n"))


@P.add("agg8_relation_scores", f"""WITH k AS (SELECT DISTINCT l_orderkey AS d, l_returnflag AS t, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_linenumber <= 3),
r AS (SELECT DISTINCT l_orderkey AS d, l_returnflag AS t, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_linenumber >= 2),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM k)) AS correct, (SELECT count(*) FROM r) AS response, (SELECT count(*) FROM k) AS key)
SELECT correct, response, key, {_PRF} FROM c""")
def relation_scores(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_suppkey", "l_partkey", "l_linenumber")
    side = lambda w, a, b: rows.where(w).select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("type"), F.col(a).alias("arg1"), F.col(b).alias("arg2"))
    return _prf(scoring.score_relations(side("l_linenumber >= 2", "l_suppkey", "l_partkey"), side("l_linenumber <= 3", "l_partkey", "l_suppkey"), ["A", "N", "R"]))


@P.add("agg9_set_scores", f"""WITH k AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), r AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM k)) AS correct, (SELECT count(*) FROM r) AS response, (SELECT count(*) FROM k) AS key)
SELECT correct, response, key, {_PRF} FROM c""")
def set_scores(spark, sf):
    """AGG9/SET1/SET2: trigger and role keys of two annotators (even events and every third one)."""
    rows = table(spark, sf, "events", "event_id", "user_id", "event_type")
    side = lambda m: rows.where(F.col("event_id") % m == 0).select("user_id", "event_type")
    return _prf(scoring.set_scores(side(3), side(2)))


@P.add("agg11_events_by_type", "SELECT event_type AS type, count(*) AS mentions, count(DISTINCT user_id) AS documents FROM events GROUP BY 1")
def events_by_type(spark, sf):
    return scoring.event_type_counts(table(spark, sf, "events", "event_type", "user_id"), "event_type", "user_id").withColumnRenamed("event_type", "type")


@P.add("agg12_zero_inclusive_histogram", "SELECT CAST(k AS BIGINT) AS k, count(*) AS units FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY k")
def histogram(spark, sf):
    orders = table(spark, sf, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    return scoring.histogram(table(spark, sf, "customer", "c_custkey"), orders, "c_custkey")


@P.add("agg13_coherence", """SELECT turn AS place, count(*) AS mentions, CAST(count(later) AS BIGINT) AS has_anaphor, CAST(count(earlier) AS BIGINT) AS has_antecedent FROM (
SELECT turn, lead(1) OVER w AS later, lag(1) OVER w AS earlier FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)) WHERE turn < 50 GROUP BY turn""")
def coherence(spark, sf):
    rows = table(spark, sf, "conversations", "conv_id", "turn", "role")
    return scoring.coherence(rows, ["conv_id", "role"], ["turn"], "turn").withColumnRenamed("turn", "place")


@P.add("agg15_best_type", """SELECT head, min_by(type, (-n, type)) AS best, CAST(sum(n) AS BIGINT) AS total FROM (SELECT split_part(p_name, ' ', 1) AS head, p_brand AS type, count(*) AS n FROM part GROUP BY ALL) GROUP BY head""".replace("min_by(type, (-n, type))", "arg_min(type, row(-n, type))"))
def best_type(spark, sf):
    rows = table(spark, sf, "part", "p_name", "p_brand").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.col("p_brand").alias("type"))
    return scoring.best_type(rows)


@P.add("agg14_name_history", """WITH c AS (SELECT c_nationkey AS e, c_custkey AS k, 'Ann ' || c_mktsegment AS name FROM customer),
p AS (SELECT row_number() OVER (PARTITION BY e ORDER BY k) AS i, row_number() OVER (PARTITION BY e, name ORDER BY k) AS j FROM c)
SELECT CASE WHEN i = 1 THEN 'first' WHEN j > 1 THEN 'identical' ELSE 'other' END AS class, count(*) AS n FROM p GROUP BY 1""")
def name_history(spark, sf):
    """AGG14 on names whose words never shorten each other: first, identical or other."""
    return _name_classes(table(spark, sf, "customer", "c_nationkey", "c_custkey", "c_mktsegment"))


def _name_classes(customers):
    from pyspark.sql.window import Window as W

    rows = customers.select("c_nationkey", "c_custkey", F.concat(F.lit("Ann "), "c_mktsegment").alias("name"))
    w = W.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("prior", F.collect_set("name").over(w)).groupBy(scoring.name_history_class(F.col("name"), F.col("prior")).alias("class")).agg(F.count("*").alias("n"))


@P.add("agg17_event_lines", "SELECT replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' ') || '_' || role AS line FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def event_lines(spark, sf):
    return scoring.event_lines(table(spark, sf, "conversations", "text", "role").where("text IS NOT NULL AND role IS NOT NULL").withColumnRenamed("role", "subtype"))


# ---------------------------------------------------------------- relations, events
@P.add("rel1_pair_window", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT a.l_orderkey, a.l_partkey AS p1, b.l_partkey AS p2, CAST(b.k - a.k AS BIGINT) AS distance FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND b.k - a.k BETWEEN 1 AND 4 AND a.l_partkey <> b.l_partkey""")
def pair_window(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    pairs = extract.mention_pairs(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")
    return pairs.select("l_orderkey", F.col("m1.l_partkey").alias("p1"), F.col("m2.l_partkey").alias("p2"), F.col("distance").cast("long").alias("distance"))


@P.add("rel4_as_of", "SELECT e.event_id, CAST(epoch_us(e.ts) AS BIGINT) AS pos, (SELECT CAST(max(epoch_us(o.o_orderdate)) AS BIGINT) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate <= e.ts) AS last_order FROM events e")
def as_of(spark, sf):
    """REL4/SEG10: the last span that starts at or before a position (orders before each event of their customer)."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    places = table(spark, sf, "events", "event_id", "user_id", "ts").select(F.col("user_id").alias("doc_id"), "event_id", us("ts").alias("pos"))
    spans = table(spark, sf, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("doc_id"), us("o_orderdate").alias("start"))
    return extract.last_before(places, spans, "last_order").select("event_id", "pos", "last_order")


@P.add("rel5_argument_types", "SELECT l_returnflag AS type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (l_returnflag = 'A' AND p_size < 10) OR (l_returnflag = 'R' AND p_size >= 40) GROUP BY 1")
def argument_types(spark, sf):
    rows = table(spark, sf, "lineitem", "l_partkey", "l_returnflag").join(table(spark, sf, "part", "p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") >= 40, "large").otherwise("middle")
    rel = rows.select(F.col("l_returnflag").alias("type"), kind.alias("arg1_type"), F.lit("any").alias("arg2_type"))
    allowed = spark.createDataFrame([("A", "arg1", "small"), ("R", "arg1", "large"), ("A", "arg2", "any"), ("R", "arg2", "any"), ("A", "arg1", "small")], "type string, arg string, entity_type string")
    return extract.fits_argument_types(rel, allowed).groupBy("type").agg(F.count("*").alias("n"))


@P.add("rel7_relation_groups", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_returnflag) AS BIGINT) AS relation FROM lineitem")
def relation_groups(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return extract.relation_groups(rows, ["l_orderkey"], ["l_suppkey", "l_returnflag"]).select("l_orderkey", "l_partkey", "l_suppkey", F.col("relation").cast("long").alias("relation"))


@P.add("rel8_enclosing_pairs", """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS start, l_linenumber + CAST(l_quantity AS BIGINT) % 5 AS e FROM lineitem)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS stop FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.start >= a.start AND b.e <= a.e AND (b.start <> a.start OR b.e <> a.e))""")
def enclosing(spark, sf):
    n = F.col("l_linenumber").cast("long")
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").select(F.col("l_orderkey").alias("doc_id"), n.alias("start"), (n + F.col("l_quantity").cast("long") % 5).alias("end"))
    return extract.drop_enclosing(rows, ["doc_id"]).select("doc_id", "start", F.col("end").alias("stop"))


@P.add("rel14_pattern_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def pattern_counts(spark, sf):
    return extract.pattern_counts(table(spark, sf, "lineitem", "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")


@P.add("evt5_argmax_per_role", "SELECT l_orderkey AS event, l_returnflag AS role, l_partkey AS value, l_extendedprice AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def argmax_per_role(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_partkey", "l_extendedprice", "l_linenumber").select(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("role"), F.col("l_partkey").alias("value"), F.col("l_extendedprice").alias("p"), "l_linenumber")
    return extract.collect_arguments(rows, ["event"], "role", "p", ["l_linenumber", "value"]).select("event", "role", "value", "p")


@P.add("evt6_pruned", "SELECT o_orderstatus AS type, count(DISTINCT o_orderkey) AS events, count(*) AS arguments FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice / 500000 >= 0.5 AND l_discount * (o_totalprice / 500000) >= 0.05 GROUP BY 1")
def pruned(spark, sf):
    events = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").select(F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("type"), (F.col("o_totalprice") / 500000).alias("p"))
    args = table(spark, sf, "lineitem", "l_orderkey", "l_discount").select(F.col("l_orderkey").alias("event"), F.col("l_discount").alias("confidence"))
    e, a = extract.prune_events(events, args, 0.5, 0.05)
    return a.join(e.select("event", "type"), "event").groupBy("type").agg(F.countDistinct("event").alias("events"), F.count("*").alias("arguments"))


@P.add("ent7_pruned_values", "SELECT p_partkey AS value_id FROM part WHERE p_size <= 5 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def pruned_values(spark, sf):
    values = table(spark, sf, "part", "p_partkey", "p_size").select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("value_id"), F.when(F.col("p_size") <= 5, "Numeric").otherwise("Job-Title").alias("type"))
    used = table(spark, sf, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45").select(F.lit(0).alias("doc_id"), F.col("l_partkey").alias("value"))
    return extract.prune_values(values, used).select("value_id")


@P.add("ent1_positional_ids", "SELECT o_custkey AS doc_id, o_orderkey, CAST(o_custkey AS VARCHAR) || '-' || CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS id FROM orders")
def positional_ids(spark, sf):
    rows = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate").withColumnRenamed("o_custkey", "doc_id")
    return extract.positional_ids(rows, ["o_orderdate", "o_orderkey"]).select("doc_id", "o_orderkey", "id")


@P.add("evt10_nearest_first", "SELECT l_orderkey, l_partkey, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_partkey - 1000), l_partkey, l_linenumber) AS rank FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem))")
def nearest_first(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").distinct()
    from pyspark.sql.window import Window as W

    w = W.partitionBy("l_orderkey").orderBy(F.abs(F.col("l_partkey") - 1000), "l_partkey", "l_linenumber")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).select("l_orderkey", "l_partkey", "rank")


@P.add("top2_smallest_margin", "SELECT o_orderkey AS sent_id, o_totalprice AS margin FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def smallest_margin(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("sent_id"), F.col("o_totalprice").alias("margin"), F.lit(0).alias("rank"))
    return sequence.smallest_margins(rows, 25).select("sent_id", "margin")


@P.add("set3_edge_union", "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem")
def edge_union(spark, sf):
    """SET3/PRS11: edges and their inverses, each once."""
    rows = table(spark, sf, "lineitem", "l_suppkey", "l_partkey")
    return rows.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).union(rows.select("l_partkey", "l_suppkey")).distinct()


QUERIES, ORACLES = P.queries, P.oracles
