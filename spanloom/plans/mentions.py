"""Mentions, functions of constituents, relation files and event scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import mentions, scoring
from ..sources import relations
from .tables import Plans, table

P = Plans()

CATS = ("np", "cconj", "ngroup", "det", "name", "timex", "np", "s")

#: orders as constituents of their customer: category by key, next order as head unless status F, the next three as children
_C = """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS node, list_extract(['np', 'cconj', 'ngroup', 'det', 'name', 'timex', 'np', 's'], CAST((o_orderkey * 7 + o_custkey) % 8 + 1 AS BIGINT)) AS cat,
 CASE WHEN o_orderkey % 11 = 0 THEN 'There' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 't' END AS tposs, o_orderstatus <> 'F' AS linked, o_orderkey % 4 = 0 AS has_pa, o_totalprice > 100000 AS big FROM orders),
l AS (SELECT *, lead(node) OVER w AS nxt, lead(cat) OVER w AS c1, lead(cat, 2) OVER w AS c2, lead(cat, 3) OVER w AS c3 FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY node)),
h AS (SELECT *, CASE WHEN linked THEN nxt END AS head, min(CASE WHEN NOT linked OR nxt IS NULL THEN node END) OVER v AS root, min(CASE WHEN NOT linked OR nxt IS NULL OR has_pa THEN node END) OVER v AS at FROM l
 WINDOW v AS (PARTITION BY doc_id ORDER BY node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT h.*, r.cat AS root_cat, trim(regexp_replace(r.text, '\\s+', ' ', 'g')) AS root_text, p.has_pa AS near, lower(p.text) AS pa_head, CASE WHEN p.big THEN 'plural' ELSE 'singular' END AS pa_number, p.big AS pa_big
 FROM h JOIN h r ON h.doc_id = r.doc_id AND h.root = r.node JOIN h p ON h.doc_id = p.doc_id AND h.at = p.node),
g AS (SELECT *, CASE WHEN near THEN pa_head ELSE replace(root_text, ' ', '-') END AS word FROM f)
"""


def _constituents(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    key, w = F.col("o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderkey")
    cat = F.element_at(F.array(*map(F.lit, CATS)), ((key * 7 + F.col("o_custkey")) % 8 + 1).cast("int"))
    text = F.when(key % 11 == 0, "There").otherwise(F.col("o_orderpriority"))
    pa = F.when(key % 4 == 0, F.struct(F.lower(text).alias("head"), F.lit(None).cast("string").alias("det"), F.when(F.col("o_totalprice") > 100000, "plural").otherwise("singular").alias("number"), F.when(F.col("o_totalprice") > 100000, "t").alias("human")))
    next3 = F.array(*[F.lead(key, i).over(w) for i in (1, 2, 3)])
    none = F.lit(None).cast("string")
    return o.select(
        F.col("o_custkey").alias("doc_id"), key.alias("node"), cat.alias("cat"), F.when(F.col("o_orderstatus") != "F", F.lead(key).over(w)).alias("head"), F.lit(0).alias("start"), F.lit(0).alias("end"),
        text.alias("text"), none.alias("det"), F.when(key % 3 == 0, "t").alias("tposs"), none.alias("nhuman"), pa.alias("pa"), F.filter(next3, lambda x: x.isNotNull()).alias("children"),
    )


@P.add("ref1_mentions", _C + """, m AS (SELECT doc_id, node, head FROM g WHERE (cat IN ('ngroup', 'name') OR (cat = 'np' AND NOT coalesce(c1 = 'np' AND c2 = 'cconj' AND c3 = 'np', false)) OR (cat = 'det' AND tposs = 't')) AND root_cat <> 'timex' AND lower(word) <> 'there')
SELECT doc_id, node FROM m ANTI JOIN (SELECT doc_id, head AS node FROM m) x USING (doc_id, node)""")
def gathered_mentions(spark, sf):
    return mentions.gather_mentions(_constituents(spark, sf))


@P.add("ref2_clauses", _C + "SELECT doc_id, node FROM o WHERE cat = 's'")
def gathered_clauses(spark, sf):
    return mentions.gather_clauses(_constituents(spark, sf))


@P.add("prs9_functions", _C + "SELECT doc_id, node, word AS head, CASE WHEN root_cat = 'name' THEN root_text END AS name, CASE WHEN near THEN pa_number END AS number, near AND pa_big AS human FROM g")
def constituent_functions(spark, sf):
    return mentions.functions(_constituents(spark, sf)).drop("det")


@P.add("prs9_parents", "SELECT o_custkey AS doc_id, lead(o_orderkey, CAST(i AS BIGINT)) OVER (PARTITION BY o_custkey, i ORDER BY o_orderkey) AS node, o_orderkey AS parent FROM orders, (VALUES (1), (2), (3)) t(i) QUALIFY node IS NOT NULL")
def child_parents(spark, sf):
    return mentions.parents(_constituents(spark, sf))


@P.add("evt11_anchor_extents", """SELECT p_partkey AS doc_id, 1 AS anchor, CASE WHEN p_size % 4 = 0 THEN 47 WHEN p_size % 3 = 0 AND p_size <= 40 THEN 50 - p_size ELSE 50 END AS start, CASE WHEN p_size % 4 <> 0 AND p_size % 3 = 0 AND p_size <= 40 THEN 60 ELSE 55 END AS end, p_size % 8 = 0 AS passive FROM part""")
def anchor_extents(spark, sf):
    """EVT11: a part's anchor at 50 to 55, in a verb group if its size divides by 4, and in noun phrases of its size if by 3."""
    size = F.col("p_size")
    none = F.lit(None).cast("string")
    row = lambda node, cat, head, a, b: F.struct(F.lit(node).alias("node"), cat.alias("cat"), F.lit(head).cast("int").alias("head"), a.cast("int").alias("start"), b.cast("int").alias("end"), none.alias("text"), none.alias("nhuman"))
    verb, noun = F.when(size % 4 != 0, "x").when(size % 8 == 0, "vg-pass").otherwise("vg"), F.when(size % 3 == 0, "np").otherwise("x")
    rows = F.array(row(1, F.lit("n"), None, F.lit(50), F.lit(55)), row(2, verb, None, F.lit(47), F.lit(55)), row(3, noun, 1, 50 - size, F.lit(60)), row(4, noun, 3, F.lit(50), F.lit(55)))
    docs = table(spark, sf, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("doc_id"), F.explode(rows).alias("c")).select("doc_id", "c.*")
    return mentions.anchor_extents(docs.where("node = 1").withColumn("anchor", F.lit(1)), docs)


@P.add("dic8_location_types", """WITH k AS (SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 1 WHEN n_nationkey % 4 = 1 THEN 2 WHEN n_nationkey % 4 = 2 THEN 3 END AS r FROM nation),
c AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN 'Upper ' || n_name || CASE WHEN c_custkey % 2 = 0 THEN ' District' ELSE ' City' END ELSE n_name END AS name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT doc_id, c.name, CASE WHEN r = 1 THEN 'country' WHEN r = 2 THEN 'stateorprovince' WHEN r = 3 THEN 'city' WHEN c_custkey % 3 = 0 THEN 'city' WHEN c_custkey % 3 = 1 THEN 'stateorprovince' WHEN c.name LIKE '% District' THEN 'stateorprovince' WHEN c.name LIKE '% City' THEN 'city' END AS location FROM c LEFT JOIN k ON k.name = c.name""")
def location_types(spark, sf):
    """DIC8: nations as a gazetteer of three kinds (every fourth unknown), made-up longer names, and head nouns of mentions."""
    n = table(spark, sf, "nation", "n_nationkey", "n_name")
    k = F.col("n_nationkey") % 4
    gazetteer = n.select(F.col("n_name").alias("name"), F.when(k == 0, "country").when(k == 1, "state").when(k == 2, "capital").otherwise("none").alias("kind"))
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    name = F.when(key % 7 == 0, F.concat(F.lit("Upper "), "n_name", F.when(key % 2 == 0, " District").otherwise(" City"))).otherwise(F.col("n_name"))
    names = c.select(key.alias("doc_id"), name.alias("name"))
    heads = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("place"), F.lit("town"), F.lit("county"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("county"), F.lit("port"))).otherwise(F.array(F.lit("island")))
    said = names.select("doc_id", F.col("name").alias("entity_name"), F.posexplode(heads).alias("seq", "head"))
    return mentions.location_types(names, gazetteer, said)


@P.add("ent8_timex_entities", """SELECT o_custkey AS doc_id, o_custkey || '-T' || (row_number() OVER w - 1) AS timex, o_custkey || '-T' || (row_number() OVER w - 1) || '-1' AS mention, strftime(o_orderdate, '%Y-%m-%d') AS val, o_orderkey AS start, o_orderkey + 10 AS end FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def timex_entities(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return mentions.timex_entities(o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 10).alias("end"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("val")))


@P.add("agg16_name_features", """WITH m AS (SELECT o_custkey AS doc_id, o_orderstatus AS entity, o_orderkey AS seq, o_orderkey % 3 <> 0 AS is_name, o_orderpriority AS type, o_orderkey % 17 AS margin, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1 AS first,
 coalesce(o_orderkey % 5 > 1 AND (o_orderkey % 4 <> 0 OR o_orderpriority = '1-URGENT'), false) AS agrees FROM orders)
SELECT doc_id, entity, seq, CASE WHEN agrees THEN '1' ELSE '-1' END || ' 1:' || margin || ' 2:' || first::INT || ' 3:' || n AS line FROM m WHERE is_name""")
def name_features(spark, sf):
    """AGG16: orders as names of a customer's entities (by status); keys lack some, end elsewhere or have another type for others."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    m = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("entity"), key.alias("seq"), key.alias("start"), (key + 3).alias("end"), (key % 3 != 0).alias("is_name"), F.col("o_orderpriority").alias("type"), (key % 17).alias("margin"))
    k = m.where(F.col("seq") % 5 != 0).select("doc_id", "seq", "start", F.when(F.col("seq") % 5 == 1, F.col("end") + 1).otherwise(F.col("end")).alias("end"), F.when(F.col("seq") % 4 == 0, "1-urgent").otherwise(F.lower("type")).alias("type"))
    return mentions.name_features(m, k)


@P.add("agg10_event_scores", """WITH e AS (SELECT o_orderkey AS event, o_orderkey % 6 <> 0 AS r, o_orderkey % 5 <> 0 AS k, o_orderkey % 7 <> 0 AS same FROM orders),
a AS (SELECT DISTINCT l_orderkey AS event, l_returnflag AS role, l_suppkey AS value, l_quantity >= 10 AS r, l_quantity < 40 AS k FROM lineitem),
x AS (SELECT event, role, value, bool_or(a.r) AS r, bool_or(a.k) AS k FROM a JOIN e USING (event) WHERE e.r AND e.k AND same GROUP BY ALL)
SELECT (SELECT count(*) FROM e WHERE r AND k AND same) AS events_correct, (SELECT count(*) FROM e WHERE r AND k AND NOT same) AS events_mistyped, (SELECT count(*) FROM e WHERE r AND NOT k) AS events_spurious, (SELECT count(*) FROM e WHERE k AND NOT r) AS events_missing,
 (SELECT count(*) FROM x WHERE r AND k) AS arguments_correct, (SELECT count(*) FROM x WHERE r AND NOT k) AS arguments_spurious, (SELECT count(*) FROM x WHERE k AND NOT r) AS arguments_missing""")
def event_scores(spark, sf):
    """AGG10: orders as events and their lines as arguments, of which responses and keys hold different parts."""
    o, line = table(spark, sf, "orders", "o_orderkey"), table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_suppkey", "l_quantity")
    key = F.col("o_orderkey")
    event = lambda rows, kind: rows.select(F.lit(0).alias("doc_id"), key.alias("start"), key.alias("end"), kind.alias("subtype"))
    argument = lambda rows: rows.select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("start"), F.col("l_orderkey").alias("end"), F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("value"))
    response, gold = event(o.where(key % 6 != 0), F.lit("Die")), event(o.where(key % 5 != 0), F.when(key % 7 != 0, "Die").otherwise("Attack"))
    return scoring.score_events(response, gold, argument(line.where("l_quantity >= 10")), argument(line.where("l_quantity < 40")))


@P.add("src14_tuple_edges", """WITH p AS (SELECT p_partkey AS d, p_size AS s, lower(p_brand) AS b FROM part),
t AS (SELECT d, 0 AS src, 'give' AS src_word, CASE WHEN s % 3 = 0 THEN 'RELATIVE' WHEN s % 3 = 1 THEN 'NIL' ELSE 'OBJ' END AS label, CASE WHEN s % 2 = 0 THEN 2 ELSE 1 END AS dst, CASE WHEN s % 2 = 0 THEN b ELSE 'of' END AS dst_word FROM p
 UNION ALL SELECT d, 0, 'give', 'ARG1', CASE WHEN s % 2 = 0 THEN 2 ELSE 1 END, CASE WHEN s % 2 = 0 THEN b ELSE 'of' END FROM p WHERE s % 3 <> 0
 UNION ALL SELECT d, 1, 'of', 'OBJ', 2, b FROM p), e AS (SELECT DISTINCT * FROM t WHERE label NOT IN ('RELATIVE', 'NIL'))
SELECT d AS doc_id, src, src_word, label, dst, dst_word FROM e UNION ALL SELECT d, dst, dst_word, label || '-1', src, src_word FROM e""")
def tuple_edges(spark, sf):
    """SRC14: two tuples a part: a verb with ``of`` and ``of`` with the part's brand, transparent for even sizes."""
    s = F.col("p_size")

    def line(role, pa, transparent, word, src, arg, dst):
        f = [F.lit("-")] * relations.FIELDS
        put = {relations.ROLE: role, relations.PA_ROLE: pa, relations.TRANSPARENT: transparent, relations.FUNCTOR: word, relations.BASE: word, relations.OFFSET: src, relations.VERB: F.lit("nil"), relations.ARG: arg, relations.ARG_BASE: arg, relations.ARG_OFFSET: dst}
        for k, v in put.items():
            f[k] = v
        return F.concat_ws(" | ", *f)

    c = F.lit
    first = line(F.when(s % 3 == 0, "RELATIVE").when(s % 3 == 1, "NIL").otherwise("OBJ"), c("ARG1"), c("NIL"), c("Give"), c("0"), c("of"), c("1"))
    second = line(c("OBJ"), c("SUPPORT"), F.when(s % 2 == 0, "T").otherwise("NIL"), c("of"), c("1"), F.col("p_brand"), c("2"))
    lines = table(spark, sf, "part", "p_partkey", "p_size", "p_brand").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.array(first, second, c("; a comment"), c("too | short"))).alias("n", "value"))
    return relations.tuple_edges(lines)


@P.add("src29_relation_patterns", """WITH p AS (SELECT split_part(p_type, ' ', 1) AS h1, p_brand AS h2, p_size % 4 AS k, p_partkey % 2 = 1 AS flip, p_size % 3 AS m FROM part),
g AS (SELECT h1 AS head1, CASE k WHEN 0 THEN '0' WHEN 1 THEN 's-of-in' WHEN 2 THEN 'o-at' ELSE 'poss' END AS link, CASE m WHEN 0 THEN '' WHEN 1 THEN 'v(see)' ELSE 'np(x)|0' END AS linear, h2 AS head2, CASE WHEN flip THEN 'PHYS-1' ELSE 'PHYS' END AS relation, count(*) AS n FROM p GROUP BY ALL)
SELECT *, unnest(list_filter([CASE link WHEN '0' THEN NULL WHEN 's-of-in' THEN 'in' WHEN 'o-at' THEN 'at' ELSE link END, CASE linear WHEN '' THEN '**' WHEN 'v(see)' THEN 'v(see)' END], lambda x: x IS NOT NULL)) AS key FROM g""")
def relation_patterns(spark, sf):
    """SRC29: a pattern line a part, counted and put under its keys."""
    k, m = F.col("p_size") % 4, F.col("p_size") % 3
    link = F.when(k == 0, "0").when(k == 1, "s-of-in").when(k == 2, "o-at").otherwise("poss")
    linear = F.when(m == 0, "adv(now) ").when(m == 1, "v(see) ' ").otherwise("np(x) 0 ")
    value = F.concat(F.when(F.col("p_partkey") % 2 == 1, "arg2-arg1").otherwise("arg1-arg2"), F.lit(" PERSON * "), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit(" [ "), link, F.lit(" : "), linear, F.lit("] GPE Nation "), "p_brand", F.lit(" --> PHYS Located"))
    out = relations.link_index(relations.relation_patterns(table(spark, sf, "part", "p_partkey", "p_size", "p_type", "p_brand").select(value.alias("value"))))
    return out.select("head1", "link", F.array_join("linear", "|").alias("linear"), "head2", "relation", "n", "key")


@P.add("src30_dependency_paths", """SELECT path, arg_max(type, k) AS type FROM (SELECT 'nsubj:' || lower(split_part(p_type, ' ', 1)) || ':dobj' AS path, p_brand AS type, p_partkey AS k FROM part) GROUP BY path""")
def dependency_paths(spark, sf):
    """SRC30: a path a part, with auxiliaries for odd keys; the last line of a path wins."""
    aux = F.when(F.col("p_partkey") % 2 == 1, "would:vch:be:vch:").otherwise("")
    value = F.concat(F.lit("nsubj:"), aux, F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit(":dobj\t"), "p_brand")
    return relations.dependency_paths(table(spark, sf, "part", "p_partkey", "p_type", "p_brand").select(F.col("p_partkey").alias("n"), value.alias("value")))


@P.add("src31_anchored_paths", """SELECT p_partkey AS n, p_brand AS arg1, 'nsubj:' || CASE WHEN p_size % 2 = 0 THEN 'give' ELSE 'went' END || ':dobj:' || lower(split_part(p_type, ' ', 1)) || ':prep' AS path, p_name AS arg2 FROM part""")
def anchored_paths(spark, sf):
    """SRC31: a line a part in either form; ``gave`` has a lemma, ``went`` has none here."""
    path = F.concat(F.lit("nsubj:"), F.when(F.col("p_size") % 2 == 0, "gave").otherwise("went"), F.lit(":dobj:"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit(":prep"))
    body = F.concat_ws(" -- ", "p_brand", path, "p_name")
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(body, F.lit("|doc"))).otherwise(F.concat(F.lit("doc\t"), body))
    lemmas = spark.createDataFrame([("gave", "give"), ("nsubj", "wrong")], "word string, lemma string")
    return relations.anchored_paths(table(spark, sf, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_name").select(F.col("p_partkey").alias("n"), value.alias("value")), lemmas)


QUERIES, ORACLES = P.queries, P.oracles
