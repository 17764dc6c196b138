"""Whole documents, features, orderings and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import strings
from ..operators import documents
from .tables import Plans, table

P = Plans()


@P.add("ann21_copied", """SELECT -doc_id - 1 AS doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY doc_id UNION ALL SELECT doc_id, count(*), CAST(sum(length(text)) AS BIGINT) FROM documents GROUP BY doc_id""")
def copied(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    both = docs.union(documents.copy_documents(docs, docs.limit(0), -F.col("doc_id") - 1)[0])
    return both.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@P.add("lim2_first_documents", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def first_documents(spark, sf):
    return documents.first_documents(table(spark, sf, "documents", "doc_id", "source"), 25, "source", "doc_id")


@P.add("fea6_token_basics", r"""SELECT lower, count(*) AS n, CAST(count(*) FILTER (WHERE first) AS BIGINT) AS n_first FROM (
SELECT lower(unnest(w)) AS lower, unnest(range(len(w))) = 0 AS first FROM (SELECT list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents)) GROUP BY lower""")
def token_basics(spark, sf):
    """FEA6, counted per lower-cased word."""
    out = documents.token_basics(table(spark, sf, "documents", "doc_id", "text"))
    return out.groupBy("lower").agg(F.count("*").alias("n"), F.count(F.when(F.col("first"), 1)).alias("n_first"))


@P.add("fea7_lexicon_categories", """WITH c AS (SELECT lower(split_part(p_type, ' ', 2)) AS token, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS categories FROM part GROUP BY 1),
t AS (SELECT p_partkey AS doc_id, lower(unnest(string_split(p_type, ' '))) AS token, unnest(range(len(string_split(p_type, ' ')))) AS seq FROM part)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, t.token, coalesce(categories, '') AS categories FROM t LEFT JOIN c USING (token)""")
def lexicon_categories(spark, sf):
    """FEA7/FEA8: every word of a part's type with all brands known for it as a second word."""
    part = table(spark, sf, "part", "p_partkey", "p_type", "p_brand")
    classes = part.select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(2))).alias("token"), F.col("p_brand").alias("category"))
    tokens = part.select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split("p_type", " ")).alias("seq", "token")).withColumn("token", F.lower("token"))
    return documents.class_features(tokens, classes).select("doc_id", F.col("seq").cast("long").alias("seq"), "token", F.array_join("categories", ",").alias("categories"))


@P.add("fea9_labelled_sentences", """WITH t AS (SELECT o_custkey AS sent_id, o_orderkey AS seq, o_orderpriority AS token, nullif(o_orderstatus, 'O') AS category FROM orders),
l AS (SELECT *, lag(category) OVER (PARTITION BY sent_id ORDER BY seq) AS before FROM t)
SELECT sent_id, string_agg(token, '|' ORDER BY seq) AS tokens, string_agg(CASE WHEN category IS NULL THEN 'O' WHEN category IS NOT DISTINCT FROM before THEN 'I-' || category ELSE 'B-' || category END, ' ' ORDER BY seq) AS labels FROM l GROUP BY sent_id""")
def labelled_sentences(spark, sf):
    """FEA9: the orders of a customer as a sentence, their status as name category (O is outside)."""
    t = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    t = t.select(F.col("o_custkey").alias("sent_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("token"), F.expr("nullif(o_orderstatus, 'O')").alias("category"))
    out = documents.labelled_sentences(t, ["sent_id"], "seq")
    return out.select("sent_id", F.array_join("tokens", "|").alias("tokens"), F.array_join("labels", " ").alias("labels"))


@P.add("set6_arrays_meet", """WITH a AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN [] ELSE string_split(p_type, ' ') END AS a, CASE WHEN p_size % 6 = 0 THEN [] ELSE string_split(upper(p_name), ' ') || ['STEEL'] END AS b FROM part)
SELECT p_partkey, len(a) = 0 OR len(b) = 0 OR len(list_intersect(a, b)) > 0 AS meet FROM a""")
def arrays_meet(spark, sf):
    none = F.array().cast("array<string>")
    a = F.when(F.col("p_size") % 4 == 0, none).otherwise(F.split("p_type", " "))
    b = F.when(F.col("p_size") % 6 == 0, none).otherwise(F.concat(F.split(F.upper("p_name"), " "), F.array(F.lit("STEEL"))))
    return table(spark, sf, "part", "p_partkey", "p_type", "p_name", "p_size").select("p_partkey", strings.arrays_meet(a, b).alias("meet"))


@P.add("top3_nearest_least", """SELECT o_custkey, o_orderkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1""")
def nearest_least(spark, sf):
    """TOP3: the lexicographic minimum of (priority, price, key) of each customer, by an aggregate that combines before the shuffle."""
    rows = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.groupBy("o_custkey").agg(F.min(F.struct("o_orderpriority", "o_totalprice", "o_orderkey"))["o_orderkey"].alias("best"))


@P.add("top1_longest_earliest", """SELECT doc_id, s AS start, n AS length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS k FROM (
SELECT doc_id, CAST(unnest(range(len(w))) AS BIGINT) AS s, CAST(length(unnest(w)) AS BIGINT) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents))) WHERE k = 1""")
def longest_earliest(spark, sf):
    """TOP1: each document's longest line, the earliest of equals, without leaving its row."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    best = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).cast("long").alias("n"), (-i).cast("long").alias("at"))))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", best.alias("b")).select("doc_id", (-F.col("b.at")).alias("start"), F.col("b.n").alias("length"))


@P.add("snk7_tagged_sentences", """SELECT p_partkey AS doc_id, CAST(k AS BIGINT) AS seq, CASE k WHEN 0 THEN '<name>' || p_brand || '</name> came.' ELSE 'It is <kind>' || p_type || '</kind>.' END AS line FROM part, (VALUES (0), (1)) t(k)""")
def tagged_sentences(spark, sf):
    """SNK7: two sentences a part, with its brand and type tagged."""
    part = table(spark, sf, "part", "p_partkey", "p_brand", "p_type")
    n, m = F.length("p_brand"), F.length("p_type")
    cut = n + 6
    span = lambda t, a, b: F.struct(F.lit(t).alias("type"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    found = F.array(span("sentence", F.lit(0), cut), span("sentence", cut + 1, cut + m + 8), span("name", F.lit(0), n), span("kind", cut + 7, cut + 7 + m), span("other", F.lit(0), cut))
    docs = part.select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", F.lit(" came. It is "), "p_type", F.lit(".")).alias("text"), found.alias("s"))
    spans = docs.select("doc_id", F.explode("s").alias("x")).select("doc_id", "x.*")
    return documents.inline_sentences(docs, spans, ["name", "kind"])


@P.add("prs10_head_chains", "SELECT p_size AS doc_id, p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_size) AS root FROM part")
def head_chains(spark, sf):
    """PRS10: each part's head is the one before it of the same size."""
    w = W.partitionBy("p_size").orderBy("p_partkey")
    links = table(spark, sf, "part", "p_partkey", "p_size").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("node"), F.lag("p_partkey").over(w).alias("head"))
    return documents.head_roots(links)


QUERIES, ORACLES = P.queries, P.oracles
