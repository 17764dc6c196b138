"""Operators whose inputs the driver's tables do not hold: literal rows, joined with tables where that is useful."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import coref, extract, lookup, patterns, segment, sequence, timex, trees
from ..sources import markup
from .tables import Plans, table

P = Plans()


@P.add("tim4_period_shift", """SELECT o_orderkey, u AS unit, CASE u WHEN 'Y' THEN strftime(d + to_years(CAST(n AS INTEGER)), '%Y') WHEN 'M' THEN strftime(d + to_months(CAST(n AS INTEGER)), '%Y-%m') WHEN 'W' THEN strftime(d + to_days(CAST(7 * n AS INTEGER)), '%Y-%m-%d') ELSE strftime(d + to_days(CAST(n AS INTEGER)), '%Y-%m-%d') END AS val
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 - 3 AS n FROM orders), (VALUES ('Y'), ('M'), ('W'), ('D')) t(u)""")
def period_shift(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 7 - 3).cast("int").alias("n"), F.explode(F.array(*map(F.lit, "YMWD"))).alias("unit"))
    return rows.select("o_orderkey", "unit", timex.period_shift(F.col("d"), F.col("unit"), F.col("n")).alias("val"))


@P.add("tim6_month_inference", """SELECT o_orderkey, CAST(year(d) + CASE WHEN month(d) < 4 AND m > 9 THEN -1 WHEN month(d) > 9 AND m < 4 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS val
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 1 + o_orderkey % 12 AS m FROM orders)""")
def month_inference(spark, sf):
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return rows.select("o_orderkey", timex.month_value(F.col("o_orderdate").cast("date"), (1 + F.col("o_orderkey") % 12).cast("int")).alias("val"))


@P.add("tim4_iso_week", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%G-W%V') AS val FROM orders")
def iso_week(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", timex.iso_week_value(F.col("o_orderdate").cast("date")).alias("val"))


@P.add("tim7_reference_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') ELSE '2001-01-01' END AS ref FROM orders""")
def reference_date(spark, sf):
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 3
    tag = F.when(k == 0, F.date_format(d, "'DATE' yyyy-MM-dd"))
    doc = F.concat(F.lit("NYT"), F.when(k == 1, F.date_format(d, "yyyyMMdd")).otherwise("none"))
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", timex.reference_date(F.coalesce(tag, F.lit("")), doc, F.lit("2001-01-01").cast("date")).cast("string").alias("ref"))


TIMES = [
    "today", "yesterday", "tomorrow", "next month", "last month", "a month ago", "next year", "past year", "a year ago", "3 years ago", "four years later", "4 months ago", "8 months later", "2005", "May 2001", "May 15, 2001", "9/24/1982", "this week",
    "last week", "next week", "Monday", "last Tuesday", "Last September", "2004/01/05", "1999-10-05", "20000404", "the 20th century", "10.20 pm", "January next year", "two weeks ago", "twenty days ago", "the fifteenth of January", "several years ago", "coming months", "December 31",
]


@P.add("tim2_timex")
def timexes(spark, sf):
    """TIM1-TIM5, TIM8: time expressions against the dates of orders."""
    refs = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    text = F.concat(F.lit("It was "), F.element_at(F.array(*map(F.lit, TIMES)), (F.col("o_orderkey") % len(TIMES) + 1).cast("int")), F.lit(" , they said ."))
    docs = refs.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), F.col("o_orderdate").alias("ref"))
    return timex.tag_timexes(docs).select("doc_id", "start", "end", "val")


RULES = """
det := [token string=the] | [token string=a];
noun := [token string=cat] | [token string=dog];
pattern set chunks;
when ( "the" | "a" ) ( "big" | "old" )* ( "cat" | "dog" ) : Head
  add [ngroup det=yes head=Head];
when "sat" add [verb];
"""


@P.add("pat1_match")
def pattern_match(spark, sf):
    """PAT1-PAT14, SRC23: noun groups and verbs over short sentences, one a customer."""
    words = [F.array(*map(F.lit, xs)) for xs in (("the", "a", "no"), ("big", "old", "small"), ("cat", "dog", "bird"))]
    k = F.col("c_custkey")
    pick = lambda i, d: F.element_at(words[i], (F.floor(k / d) % 3 + 1).cast("int"))
    docs = table(spark, sf, "customer", "c_custkey").select(k.alias("doc_id"), F.concat_ws(" ", pick(0, 1), pick(1, 3), pick(2, 9), F.lit("sat"), F.lit("by"), pick(0, 27), pick(2, 1), F.lit(".")).alias("text"))
    return patterns.apply_patterns(segment.tokenize(docs), RULES, "chunks").select("doc_id", "type", "start", "end", F.element_at("attrs", "head").alias("head"))


@P.add("ref12_ref_chain_entities", "SELECT o_custkey AS doc_id, o_orderkey AS mention, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus) AS root FROM orders")
def ref_chains(spark, sf):
    """REF12: index to chains, chains to links, links back to entities by pointer doubling."""
    rows = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("entity"), F.col("o_orderkey").alias("mention"))
    return coref.chains_from_links(coref.links_from_chains(coref.chains_from_index(rows))).select("doc_id", "mention", "root")


@P.add("ref7_pronouns", """SELECT p AS pronoun, n AS number, h AS human, g AS gender,
CASE p WHEN 'he' THEN coalesce(n, 'singular') = 'singular' AND coalesce(h, 't') = 't' AND coalesce(g, 'm') = 'm' WHEN 'her' THEN coalesce(n, 'singular') = 'singular' AND coalesce(h, 't') = 't' AND coalesce(g, 'f') = 'f'
WHEN 'its' THEN coalesce(n, 'singular') = 'singular' AND coalesce(h, 'nil') = 'nil' WHEN 'they' THEN coalesce(n, 'plural') = 'plural' WHEN 'us' THEN coalesce(n, 'plural') = 'plural' AND coalesce(h, 't') = 't' ELSE false END AS matches
FROM (VALUES ('he'), ('her'), ('its'), ('they'), ('us'), ('xyz')) a(p), (VALUES ('singular'), ('plural'), (NULL)) b(n), (VALUES ('t'), ('nil'), (NULL)) c(h), (VALUES ('m'), ('f'), (NULL)) d(g)""")
def pronouns(spark, sf):
    each = lambda *xs: F.explode(F.array(*map(F.lit, xs)))
    rows = spark.range(1).select(each("he", "her", "its", "they", "us", "xyz").alias("pronoun")).select("*", each("singular", "plural", None).alias("number")).select("*", each("t", "nil", None).alias("human")).select("*", each("m", "f", None).alias("gender"))
    return rows.withColumn("matches", coref.pronoun_matches(*map(F.col, ("pronoun", "number", "human", "gender"))))


@P.add("ref4_coref")
def coreference(spark, sf):
    """REF4-REF7, REF10: names, nominals and pronouns of a document per customer, resolved in order."""
    k = F.col("c_custkey")
    item = lambda seq, cat, text, head, number, human, gender: F.struct(F.lit(seq).alias("seq"), F.lit(cat).alias("category"), text.alias("text"), head.alias("head"), F.lit(seq).alias("sentence"), F.lit(seq * 10).alias("pos"), F.lit(number).alias("number"), F.lit(human).alias("human"), F.lit(gender).alias("gender"))
    lit, first = F.lit, F.element_at(F.array(*map(F.lit, ("Ann", "Bob", "Cy"))), (k % 3 + 1).cast("int"))
    rows = F.array(
        item(0, "name", F.concat(first, lit(" Smith")), lit("Smith"), "singular", "t", "f"), item(1, "name", lit("United Nations"), lit("Nations"), "singular", "nil", None),
        item(2, "pronoun", lit("she"), lit("she"), "singular", "t", "f"), item(3, "name", lit("UN"), lit("UN"), "singular", "nil", None), item(4, "name", lit("Smith"), lit("Smith"), "singular", "t", None), item(5, "pronoun", lit("it"), lit("it"), "singular", "nil", None),
    )
    mentions = table(spark, sf, "customer", "c_custkey").select(k.alias("doc_id"), F.explode(rows).alias("m")).select("doc_id", "m.*")
    return coref.resolve_documents(mentions)


@P.add("evt3_node_scores", "SELECT p_partkey, CAST(CASE WHEN p_size = 7 THEN 10300 WHEN p_size % 5 = 0 THEN 10200 WHEN p_size % 2 = 0 THEN 10100 WHEN p_size > 20 THEN 10000 ELSE 0 END AS INTEGER) AS score FROM part")
def node_scores(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", extract.pattern_node_score(s > 20, s % 2 == 0, s % 5 == 0, s == 7).alias("score"))


@P.add("evt4_evaluation", "SELECT p_partkey, CAST(CASE WHEN s >= f * 2 THEN (s * 50) // (s + f + 10) ELSE -1 END AS INTEGER) AS score FROM (SELECT p_partkey, p_size AS s, p_partkey % 20 AS f FROM part)")
def evaluation(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", extract.evaluation_score(F.col("p_size"), F.col("p_partkey") % 20, 2.0).alias("score"))


@P.add("ent2_mention_types", "SELECT kind, CASE WHEN kind IN ('name', 'NNP') THEN 'NAME' WHEN kind IN ('PRP', 'det') THEN 'PRONOUN' ELSE 'NOMINAL' END AS type FROM (VALUES ('name'), ('NNP'), ('PRP'), ('det'), ('NN'), ('adj')) t(kind)")
def mention_types(spark, sf):
    return spark.createDataFrame([(x,) for x in ("name", "NNP", "PRP", "det", "NN", "adj")], "kind string").select("kind", extract.mention_type(F.col("kind")).alias("type"))


@P.add("rel10_nearest_pattern", """WITH p AS (SELECT * FROM (VALUES ('of', 'city', 'state', 'GPE', 'GPE', 'PART', 3), ('of', 'head', 'firm', 'PER', 'ORG', 'ORG-AFF', 2), ('of', 'man', 'firm', 'PER', 'ORG', 'PHYS', 5)) t(link, h1, h2, t1, t2, type, n)),
q AS (SELECT p_partkey AS query, 'of' AS link, CASE p_size % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'head' ELSE 'dog' END AS h1, CASE p_size % 2 WHEN 0 THEN 'firm' ELSE 'state' END AS h2, CASE p_size % 3 WHEN 0 THEN 'GPE' ELSE 'PER' END AS t1, CASE p_size % 2 WHEN 0 THEN 'ORG' ELSE 'GPE' END AS t2 FROM part),
d AS (SELECT query, type, n, (q.h1 <> p.h1)::INT + (q.h2 <> p.h2)::INT + 10 * (q.t1 <> p.t1)::INT + 10 * (q.t2 <> p.t2)::INT AS d FROM q JOIN p USING (link)),
m AS (SELECT query, min(d) AS d FROM d WHERE d <= 21 GROUP BY query),
v AS (SELECT query, d, type, sum(n) AS n FROM d JOIN m USING (query, d) GROUP BY ALL)
SELECT query, CAST(d AS INTEGER) AS d, arg_min(type, row(-n, type)) AS type, round((21 - d) / 21, 9) AS confidence FROM v GROUP BY query, d""")
def nearest_pattern(spark, sf):
    rows = [("of", "city", "state", "GPE", "GPE", "PART", 3), ("of", "head", "firm", "PER", "ORG", "ORG-AFF", 2), ("of", "man", "firm", "PER", "ORG", "PHYS", 5)]
    known = spark.createDataFrame(rows, "link string, head1 string, head2 string, type1 string, type2 string, type string, n int").withColumn("direction", F.lit(1))
    s = F.col("p_size")
    q = table(spark, sf, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").alias("query"), F.lit("of").alias("link"), F.when(s % 3 == 0, "city").when(s % 3 == 1, "head").otherwise("dog").alias("head1"), F.when(s % 2 == 0, "firm").otherwise("state").alias("head2"),
        F.when(s % 3 == 0, "GPE").otherwise("PER").alias("type1"), F.when(s % 2 == 0, "ORG").otherwise("GPE").alias("type2"), F.lit(1).alias("direction"),
    )
    return extract.nearest_pattern(q, known).select("query", "d", "type", F.round("confidence", 9).alias("confidence"))


@P.add("seq19_class_rules", "SELECT p_partkey, y BETWEEN 1000 AND 2030 AS year, h <= 24 AND m <= 60 AS hour_minute FROM (SELECT p_partkey, p_partkey * 37 % 9000 + 1000 AS y, p_partkey % 30 AS h, p_partkey % 70 + 10 AS m FROM part)")
def class_rules(spark, sf):
    k = F.col("p_partkey")
    y, hm = (k * 37 % 9000 + 1000).cast("string"), F.concat((k % 30).cast("string"), F.lit(":"), (k % 70 + 10).cast("string"))
    return table(spark, sf, "part", "p_partkey").select("p_partkey", strings.year_bounds(y).alias("year"), strings.hour_minute(hm).alias("hour_minute"))


@P.add("src21_closure", "WITH RECURSIVE e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region), up(d, a) AS (SELECT x, x FROM (SELECT c AS x FROM e UNION SELECT p FROM e) UNION SELECT up.d, e.p FROM up JOIN e ON up.a = e.c) SELECT d AS descendant, a AS ancestor FROM up")
def class_closure(spark, sf):
    """SRC21/SRC22/ANN18: reflexive-transitive closure of nation, region, world."""
    region = table(spark, sf, "region")
    edges = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return lookup.closure(edges.union(region.select("r_name", F.lit("WORLD"))))


@P.add("src16_gazetteer", """SELECT * FROM (VALUES ('country', 'France', 'nationality', 'French'), ('country', 'France', 'capital', 'Paris'), ('country', 'France', 'national', 'French'), ('country', 'France', 'nationals', 'Frenchs'),
('country', 'Spain', 'nationality', 'Spanish'), ('country', 'Spain', 'national', 'Spaniard')) t(kind, name, relation, value)""")
def gazetteer(spark, sf):
    lines = spark.createDataFrame([('country "France" nationality "French" capital "Paris";',), ('country "Spain" nationality "Spanish" national "Spaniard";',), ("// nothing",)], "value string")
    return lookup.read_gazetteer(lines)


@P.add("dic11_stems", "SELECT * FROM (VALUES ('The', 'DT', 'the'), ('has', 'VBZ', 'have'), ('I', 'PRP', NULL), ('Smith', 'NNP', NULL), ('plane', 'NN', NULL), (NULL, 'NN', NULL)) t(token, pos, stem)")
def stems(spark, sf):
    forms = spark.createDataFrame([("has", "have"), ("swapped", "swap")], "form string, stem string")
    tokens = spark.createDataFrame([("The", "DT"), ("has", "VBZ"), ("I", "PRP"), ("Smith", "NNP"), ("plane", "NN"), (None, "NN")], "token string, pos string")
    return lookup.stem(tokens, forms).select("token", "pos", "stem")


PTB = (
    "( (S (NP-SBJ (DT The) (NN tower) (NN clock)) (VP (VBD struck) (NP (DT a) (JJ late) (NN hour))) (. .)) )",
    "(S (NP (PRP She)) (VP (VBD said) (SBAR (IN that) (S (NP (NNS rains)) (VP (VBD fell))))) (. .))",
    "(S (NP (PRP It)) (VP (VBD was) (VP (VBN seen))) (. .))",
)


@P.add("prs5_trees", """SELECT o_orderkey AS sent_id, w AS words, h AS heads FROM orders JOIN (VALUES
(0, 'The tower clock struck a late hour .', '2,2,3,-1,6,6,3,3'), (1, 'She said that rains fell .', '1,-1,1,4,2,1'), (2, 'It was seen .', '1,-1,1,1')) t(k, w, h) ON o_orderkey % 3 = k""")
def parse_trees(spark, sf):
    """SRC12, PRS4-PRS5: heads of a tree per order, with nested clauses."""
    rows = table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("sent_id"), F.element_at(F.array(*map(F.lit, PTB)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("ptb"))
    out = trees.parse_table(rows)
    return out.select("sent_id", F.array_join("words", " ").alias("words"), F.array_join(F.transform("heads", lambda x: x.cast("string")), ",").alias("heads"))


@P.add("prs6_tree_chunks", """SELECT n_nationkey AS sent_id, 'B-NP I-NP I-NP B-VP B-NP I-NP I-NP O' AS chunks FROM nation""")
def tree_chunks(spark, sf):
    """PRS6-PRS7: chunks of a tree per nation, the subject's name being the nation's."""
    ptb = F.concat(F.lit("(S (NP-SBJ (DT The) (JJ old) (NNP "), F.regexp_replace("n_name", " ", "_"), F.lit(")) (VP (VBD struck) (NP (DT a) (JJ late) (NN hour))) (. .))"))
    out = trees.parse_table(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("sent_id"), ptb.alias("ptb")))
    return out.select(F.col("sent_id").cast("int").alias("sent_id"), F.array_join("chunks", " ").alias("chunks"))


@P.add("src4_references", "SELECT p_partkey AS doc_id, CAST(1 AS BIGINT) AS ann_id, CAST(0 AS BIGINT) AS ref FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, NULL FROM part WHERE p_partkey % 2 = 1")
def references(spark, sf):
    """SRC1, SRC4: ``#id`` attributes resolved by a join."""
    sgml = F.concat(F.lit('<a id="k1">x</a> <b of=#'), F.when(F.col("p_partkey") % 2 == 0, "k1").otherwise("k2"), F.lit(">y</b>"))
    docs = table(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("doc_id"), sgml.alias("text"))
    return markup.dereference(markup.annotation_rows(markup.parse(docs)), "of").where("type = 'b'").select("doc_id", "ann_id", "ref")


@P.add("seq16_chunker")
def chunker(spark, sf):
    """SEQ16/SEQ17: a maximum entropy chunker trained on toy sentences; one row a sentence."""
    events = [(["pos=DT", "prev=O"], "B"), (["pos=NN", "prev=B"], "I"), (["pos=VB", "prev=I"], "O"), (["pos=NN", "prev=O"], "B"), (["pos=JJ", "prev=B"], "I"), (["pos=NN", "prev=I"], "I"), (["pos=VB", "prev=O"], "O")]
    model = sequence.train_maxent(events * 5)
    toy = [("the cat sat", "DT NN VB"), ("the old dog saw birds", "DT JJ NN VB NN")]
    return spark.createDataFrame([(w, " ".join(sequence.chunk_greedily(w.split(), t.split(), model))) for w, t in toy], "words string, chunks string")


QUERIES, ORACLES = P.queries, P.oracles
