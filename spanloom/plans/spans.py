"""The annotation algebra over line and word spans of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..operators import segment, spans
from ..sources import markup
from .tables import Plans, table

P = Plans()

#: spans of lines and of space-separated words, as the store has them
_PARTS_SQL = """WITH RECURSIVE parts AS (SELECT doc_id, string_split(coalesce(text, ''), {sep}) AS p FROM documents),
flat AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS seq FROM parts),
spans AS (SELECT doc_id, seq, CAST(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) - 1 AS e, length(part) AS n FROM flat)
"""
_LINES_WORDS = """WITH lp AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lf AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS seq FROM lp),
line AS (SELECT doc_id, seq, CAST(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) - 1 AS e, length(part) AS n FROM lf),
wp AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS p FROM documents),
wf AS (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS seq FROM wp),
word AS (SELECT doc_id, seq, CAST(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) - 1 AS e, length(part) AS n FROM wf)
"""


def _docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text")


def _lines(spark, sf):
    return segment.pieces(_docs(spark, sf), "\n", "line")


def _words(spark, sf):
    return segment.pieces(_docs(spark, sf), " ", "word")


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@P.add("ann7_containment", _LINES_WORDS + """SELECT l.doc_id, CAST(l.seq AS BIGINT) AS line, count(*) AS words, CAST(min(w.e - w.n) AS BIGINT) AS first_start, CAST(max(w.e) AS BIGINT) AS last_end
FROM line l JOIN word w ON l.doc_id = w.doc_id AND w.e - w.n >= l.e - l.n AND w.e <= l.e AND w.n > 0 GROUP BY ALL""")
def containment(spark, sf):
    """Words inside lines.  Lines do not overlap, so the line of a word is the last one that starts at or before it: an as-of step, not a range join."""
    words, lines = _words(spark, sf).where("`end` > start"), _lines(spark, sf)
    inside = spans.within_disjoint(words, lines)
    return inside.groupBy("doc_id", F.col("outer_seq").cast("long").alias("line")).agg(F.count("*").alias("words"), F.min("start").cast("long").alias("first_start"), F.max("end").cast("long").alias("last_end"))


@P.add("ann3_starting_at", _LINES_WORDS + "SELECT l.doc_id, CAST(l.seq AS BIGINT) AS line, CAST(w.n AS BIGINT) AS word_length FROM line l JOIN word w ON l.doc_id = w.doc_id AND l.e - l.n = w.e - w.n")
def starting_at(spark, sf):
    """ANN3: words that start where a line starts."""
    places = _lines(spark, sf).select("doc_id", F.col("seq").cast("long").alias("line"), F.col("start").alias("pos"))
    return spans.starting_at(_words(spark, sf), places).select(places["doc_id"], "line", (F.col("end") - F.col("start")).cast("long").alias("word_length"))


@P.add("ann4_ending_at", _LINES_WORDS + "SELECT l.doc_id, CAST(l.seq AS BIGINT) AS line, CAST(w.n AS BIGINT) AS word_length FROM line l JOIN word w ON l.doc_id = w.doc_id AND l.e = w.e")
def ending_at(spark, sf):
    places = _lines(spark, sf).select("doc_id", F.col("seq").cast("long").alias("line"), F.col("end").alias("pos"))
    return spans.ending_at(_words(spark, sf), places).select(places["doc_id"], "line", (F.col("end") - F.col("start")).cast("long").alias("word_length"))


@P.add("ann5_first_token", _LINES_WORDS + "SELECT doc_id, CAST(min_by(e, seq) AS BIGINT) AS first_end FROM word WHERE n > 2 GROUP BY doc_id")
def first_token(spark, sf):
    words = _words(spark, sf).where("`end` - start > 2")
    return spans.first_at(words, "doc_id").select("doc_id", F.col("end").cast("long").alias("first_end"))


@P.add("ann2_removed", _LINES_WORDS + "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, seq, n FROM word UNION ALL SELECT doc_id, seq, n FROM line) GROUP BY doc_id".replace("SELECT doc_id, seq, n FROM word", "SELECT doc_id, seq, n FROM word WHERE n <> 3"))
def removed(spark, sf):
    """ANN1/ANN2: insert lines into the words' store, delete the words of three signs."""
    words = _words(spark, sf).withColumn("ann_id", F.col("seq").cast("long"))
    store = spans.remove(words, words.where("`end` - start = 3"))
    return spans.add(store, _lines(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n"))


@P.add("ann6_types", "SELECT * FROM (VALUES ('line'), ('word')) t(type)")
def types(spark, sf):
    """ANN6/ANN8: distinct annotation types."""
    return spans.types(spans.of_type(spans.add(_words(spark, sf), _lines(spark, sf)), "word", "line"))


@P.add("ann11_stretch", r"""SELECT doc_id, CAST(sum(greatest(0, length(t) - length(regexp_replace(t, '[ \t\n\x0B\f\r]+$', '')))) AS BIGINT) AS trailing FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents) GROUP BY doc_id""")
def shrunk(spark, sf):
    """ANN11/ANN13: trailing white space of lines, as lines shrink."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cut = F.transform(lines, lambda x: (F.length(x) - F.length(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+$", ""))).cast("long"))
    return _docs(spark, sf).select("doc_id", F.aggregate(cut, F.lit(0).cast("long"), lambda a, x: a + x).alias("trailing"))


@P.add("ann15_feature_sets", "SELECT nation, CAST(c1 AS BIGINT) AS subset, CAST(c2 AS BIGINT) AS unified FROM (SELECT n_name AS nation, count(*) FILTER (WHERE c_nationkey % 2 = 0) AS c1, count(*) FILTER (WHERE c_nationkey % 3 = 0) AS c2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)")
def feature_sets(spark, sf):
    """ANN15: subset and unification of feature maps."""
    k = F.col("c_nationkey")
    a = F.create_map(F.lit("parity"), (k % 2).cast("string"))
    b = F.create_map(F.lit("parity"), F.lit("0"), F.lit("x"), F.lit("1"))
    third = F.create_map(F.lit("third"), (k % 3).cast("string"))
    rows = table(spark, sf, "customer", "c_nationkey").join(table(spark, sf, "nation"), k == F.col("n_nationkey"))
    one = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(F.col("n_name").alias("nation")).agg(one(spans.attrs_subset(a, b)).alias("subset"), one(spans.unify(third, F.create_map(F.lit("third"), F.lit("0"))).isNotNull()).alias("unified"))


@P.add("ann19_erased", _LINES_WORDS + """SELECT w.doc_id, count(*) AS outside FROM word w WHERE NOT EXISTS (SELECT 1 FROM line l WHERE l.doc_id = w.doc_id AND l.seq = 0 AND w.e - w.n >= l.e - l.n AND w.e <= l.e) GROUP BY w.doc_id""")
def erased(spark, sf):
    """ANN19: words inside a document's first line go."""
    return spans.erase_inside(_words(spark, sf), _lines(spark, sf).where("seq = 0")).groupBy("doc_id").agg(F.count("*").alias("outside"))


@P.add("ann9_hypotheses", "SELECT o_orderpriority AS hypo, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%' GROUP BY 1")
def hypotheses(spark, sf):
    """ANN9: rows of active hypotheses (order priorities stand for them)."""
    rows = table(spark, sf, "orders", "o_orderpriority").withColumnRenamed("o_orderpriority", "hypo")
    active = [r.hypo for r in rows.distinct().where("hypo LIKE '1%' OR hypo LIKE '5%'").collect()]  # names of hypotheses: as few as priorities
    return spans.visible(rows, *active).where("hypo IS NOT NULL").groupBy("hypo").agg(F.count("*").alias("n"))


@P.add("ann22_bio", """WITH e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
b AS (SELECT *, CASE WHEN event_type <> 'purchase' THEN 0 WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = 'purchase' THEN 0 ELSE 1 END AS opens FROM e),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM b WHERE event_type = 'purchase')
SELECT user_id AS doc_id, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos FROM (SELECT user_id, pos, sum(opens) OVER (PARTITION BY user_id ORDER BY pos) AS run, event_type FROM b) WHERE event_type = 'purchase' GROUP BY user_id, run""")
def bio(spark, sf):
    """ANN22/SEQ8: runs of one event type of a user as B/I tags, packed into spans."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    pos, prev = F.row_number().over(w), F.lag("event_type").over(w)
    tag = F.when(F.col("event_type") != "purchase", "O").when(prev == "purchase", "I-buy").otherwise("B-buy")
    tokens = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type").select(F.col("user_id").alias("doc_id"), pos.cast("long").alias("start"), pos.cast("long").alias("end"), tag.alias("tag"))
    return spans.bio_to_spans(tokens).select("doc_id", F.col("start").alias("first_pos"), F.col("end").alias("last_pos"))


@P.add("seq8_islands", """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, count(*) AS n FROM e GROUP BY user_id, event_type, pos - k""")
def islands(spark, sf):
    rows = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type")
    return spans.islands(rows, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_type", *_long("first_pos", "last_pos"), "n")


@P.add("srt1_write_order", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice) AS place FROM lineitem")
def write_order(spark, sf):
    """SRT1/SRT2: places in a document by end descending, then seq."""
    from pyspark.sql.window import Window as W

    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_extendedprice")
    w = W.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq"), F.row_number().over(w).cast("long").alias("place"))


@P.add("lim1_first_sentences", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, k FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations) WHERE k <= 3")
def first_rows(spark, sf):
    """LIM1: the first rows of each document (three turns of each conversation)."""
    from pyspark.sql.window import Window as W

    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), k.alias("k")).where("k <= 3")


@P.add("src1_pages_markup")
def pages_markup(spark, sf):
    """SRC1-SRC3: element spans of every page by the markup reader."""
    pages = table(spark, sf, "pages", "page_id", "html").withColumnRenamed("page_id", "doc_id")
    found = markup.annotation_rows(markup.parse(pages, "html"))
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("chars"))


@P.add("snk1_round_trip", "SELECT doc_id, true AS same FROM documents WHERE NOT contains(coalesce(text, ''), '<')")
def round_trip(spark, sf):
    """SNK1/SRC1: lines written as markup and read back give the same spans and text."""
    docs = _docs(spark, sf).where(~F.contains(F.coalesce("text", F.lit("")), F.lit("<")))
    lines = segment.pieces(docs, "\n", "line").where("`end` > start").withColumn("attrs", F.create_map(F.lit("n"), F.col("seq").cast("string")))
    sgml = markup.render(docs, lines)
    back = markup.parse(sgml, "sgml", ["line"])
    lines = F.array_sort(F.transform(F.col("annotations"), lambda a: F.struct(a["start"], a["end"])))
    want = segment.pieces(docs, "\n", "line").where("`end` > start").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("want"))
    both = back.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").join(want, "doc_id", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return both.select("doc_id", ((F.col("text") == F.coalesce("old", F.lit(""))) & (lines.cast("array<struct<start:int,end:int>>") == F.coalesce("want", none))).alias("same"))


@P.add("snk6_sentence_lines")
def sentence_lines(spark, sf):
    """SNK6: ``offset text`` lines of sentences, white space normalized."""
    docs = _docs(spark, sf)
    s = segment.sentences(docs).join(docs, "doc_id")
    return s.select("doc_id", F.concat_ws(" ", F.col("start").cast("string"), spans.normalized(spans.span_text(F.col("text")))).alias("line"))


@P.add("fn_strings", """SELECT s_suppkey, upper(left(lower(s_name), 1)) || substr(lower(s_name), 2) AS cap, replace(replace(replace(replace('<' || s_name || ' & "x">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml,
'a.b/' || s_name AS path, 'GPE' AS main, 'Nation' AS sub FROM supplier""")
def string_functions(spark, sf):
    """Capitalize, XML escape, strip extension, type and subtype."""
    name = F.col("s_name")
    t = F.lit("GPE:Nation")
    return table(spark, sf, "supplier", "s_suppkey", "s_name").select("s_suppkey", strings.capitalize(F.lower(name)).alias("cap"), strings.xml_escape(F.concat(F.lit("<"), name, F.lit(" & \"x\">"))).alias("xml"), strings.strip_extension(F.concat(F.lit("a.b/"), name, F.lit(".txt"))).alias("path"), strings.main_type(t).alias("main"), strings.sub_type(t).alias("sub"))


QUERIES, ORACLES = P.queries, P.oracles
