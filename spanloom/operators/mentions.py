"""Mentions, clauses and syntactic functions of constituents, as joins over one table.

Constituents are rows (doc_id, node, cat, head, start, end, text, det, tposs,
nhuman, pa, children): ``head`` is the node of the head constituent (null: it is its own),
``pa`` a struct (head, det, number, human) or null, ``children`` an array of nodes.
Chains of heads are followed once for all constituents (``documents.head_roots``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import tasks
from .documents import head_roots

CLAUSES = ("s", "rn-wh", "rn-vingo")
NO_MENTION_HEADS = ("timex", "ordinal", "adv", "ving")
CITY_WORDS = ("city", "town", "village", "port")
STATE_WORDS = ("province", "state", "county", "district")
#: how far before an anchor's head an enclosing noun phrase may begin
PHRASE_REACH = 40


def with_roots(constituents: DataFrame, count: int | None = None) -> DataFrame:
    """PRS10: each constituent with the category, text and place at the end of its head chain (``root``, ``root_cat``, ``root_text``, ``root_start``, ``root_nhuman``).

    ``count`` is the number of constituents, if it is known.
    """
    count = constituents.count() if count is None else count
    roots = head_roots(constituents.select("doc_id", "node", "head"))
    ends = constituents.select("doc_id", F.col("node").alias("root"), F.col("cat").alias("root_cat"), F.col("text").alias("root_text"), F.col("start").alias("root_start"), F.col("nhuman").alias("root_nhuman"))
    rooted = tasks.join(constituents, roots, ["doc_id", "node"], "inner", count)
    return tasks.join(rooted, ends, ["doc_id", "root"], "left", count)


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def functions(constituents: DataFrame, rooted: DataFrame | None = None) -> DataFrame:
    """PRS9: (doc_id, node, head, name, det, number, human) of each constituent.

    The first ``pa`` on the head chain counts; without one, the chain's last
    text is the head, its tokens joined by hyphens.  ``rooted`` are ``with_roots``
    of the constituents, if they are there already.
    """
    rooted = with_roots(constituents) if rooted is None else rooted
    known = F.col("pa").isNotNull()
    first = head_roots(constituents.select("doc_id", "node", F.when(~known, F.col("head")).alias("head"))).withColumnRenamed("root", "at")
    pa = constituents.where(known).select("doc_id", F.col("node").alias("at"), F.col("pa").alias("near"))
    c = rooted.drop("head").join(first, ["doc_id", "node"]).join(pa, ["doc_id", "at"], "left")
    text = _plain(F.col("root_text"))
    head = F.when(F.col("near").isNull(), F.replace(text, F.lit(" "), F.lit("-"))).otherwise(F.col("near.head"))
    return c.select("doc_id", "node", head.alias("head"), F.when(F.col("root_cat") == "name", text).alias("name"), F.coalesce("det", "pa.det").alias("det"), F.col("near.number").alias("number"), (F.col("near.human").isNotNull() | F.col("root_nhuman").isNotNull()).alias("human"))


def parents(constituents: DataFrame) -> DataFrame:
    """PRS9: (doc_id, node, parent) of each child of a constituent."""
    return constituents.select("doc_id", F.explode("children").alias("node"), F.col("node").alias("parent"))


def conjoined(constituents: DataFrame) -> DataFrame:
    """(doc_id, node) of noun phrases whose children are np, cconj, np."""
    three = constituents.where((F.col("cat") == "np") & (F.size("children") == 3)).select("doc_id", "node", F.posexplode("children").alias("i", "child"))
    cats = constituents.select("doc_id", F.col("node").alias("child"), F.col("cat").alias("c"))
    fits = F.col("c") == F.when(F.col("i") == 1, "cconj").otherwise("np")
    return three.join(cats, ["doc_id", "child"]).where(fits).groupBy("doc_id", "node").agg(F.count("*").alias("k")).where("k = 3").select("doc_id", "node")


def gather_mentions(constituents: DataFrame, names: bool = True) -> DataFrame:
    """REF1: (doc_id, node) of noun groups, phrases that aren't conjunctions, possessive determiners and (``names``) names.

    Those headed by times, ordinals, adverbs, participles or ``there`` are no
    mentions, nor is the immediate head of another mention.
    """
    cat, head = F.col("cat"), F.coalesce(F.col("h"), F.lit(""))
    rooted = with_roots(constituents)  # chains are followed once for both
    c = rooted.join(functions(constituents, rooted).select("doc_id", "node", F.col("head").alias("h")), ["doc_id", "node"])
    c = c.join(conjoined(constituents).withColumn("conjunction", F.lit(True)), ["doc_id", "node"], "left")
    wanted = (cat == "ngroup") | ((cat == "np") & F.col("conjunction").isNull()) | ((cat == "det") & F.coalesce(F.col("tposs") == "t", F.lit(False)))
    wanted = wanted | (cat == "name") if names else wanted
    found = c.where(wanted & ~F.coalesce(F.col("root_cat").isin(*NO_MENTION_HEADS), F.lit(False)) & (F.lower(head) != "there")).select("doc_id", "node", "head")
    heads = found.where(F.col("head").isNotNull()).select("doc_id", F.col("head").alias("node")).distinct()
    return found.select("doc_id", "node").join(heads, ["doc_id", "node"], "left_anti")


def gather_clauses(constituents: DataFrame) -> DataFrame:
    """REF2: clauses among the constituents."""
    return constituents.where(F.col("cat").isin(*CLAUSES)).select("doc_id", "node")


def anchor_extents(anchors: DataFrame, constituents: DataFrame) -> DataFrame:
    """EVT11: (doc_id, anchor, start, end, passive) of anchors (doc_id, anchor, start, end), widened.

    A verb group that ends with the anchor is its extent; else the noun phrase
    of the same head start that reaches furthest; else the anchor's own span.
    Places without constituents don't end the search.  Both joins have keys,
    (doc_id, end) and (doc_id, head start); tasks follow the rows in all of them.
    """
    a = anchors.select("doc_id", "anchor", F.col("start").alias("a0"), F.col("end").alias("a1"))
    known = constituents.count()
    count = max(known, a.count())
    verbs = tasks.spread(constituents.where(F.col("cat").isin("vg", "vg-pass")), known, "doc_id", "end").groupBy("doc_id", F.col("end").alias("a1")).agg(F.min_by(F.struct("start", "cat"), "node").alias("vg"))
    span = F.struct(F.col("end").alias("e"), (-F.col("start")).alias("s"))
    phrases = with_roots(constituents, known).where("cat = 'np'").select("doc_id", F.col("root_start").alias("a0"), span.alias("np"))
    near = tasks.join(a, phrases, ["doc_id", "a0"], "inner", count).where((-F.col("np.s")).between(F.col("a0") - PHRASE_REACH, F.col("a0")) & ~((-F.col("np.s") >= F.col("a0")) & (F.col("np.e") <= F.col("a1"))))
    near = tasks.spread(near, count, "doc_id", "anchor").groupBy("doc_id", "anchor").agg(F.max("np").alias("np"))
    out = tasks.join(tasks.join(a, verbs, ["doc_id", "a1"], "left", count), near, ["doc_id", "anchor"], "left", count)
    verb = F.col("vg").isNotNull()
    start = F.when(verb, F.col("vg.start")).otherwise(F.coalesce(-F.col("np.s"), "a0"))
    end = F.when(verb, F.col("a1")).otherwise(F.coalesce("np.e", "a1"))
    return out.select("doc_id", "anchor", start.alias("start"), end.alias("end"), F.coalesce(F.col("vg.cat") == "vg-pass", F.lit(False)).alias("passive"))


def location_types(names: DataFrame, gazetteer: DataFrame, mentions: DataFrame) -> DataFrame:
    """DIC8: (doc_id, name, location) of names (doc_id, name): gazetteer, then a head noun of a co-mention, then the last word.

    ``gazetteer`` has (name, kind) of kinds country, nationality, state, capital;
    ``mentions`` (doc_id, entity_name, seq, head), where the first head noun known decides.
    """
    rank = F.when(F.col("kind").isin("country", "nationality"), 1).when(F.col("kind") == "state", 2).when(F.col("kind") == "capital", 3)
    known = gazetteer.groupBy("name").agg(F.min(rank).alias("rank"))
    noun = F.when(F.col("head").isin(*CITY_WORDS), "city").when(F.col("head").isin(*STATE_WORDS), "stateorprovince")
    said = mentions.withColumn("noun", noun).where("noun IS NOT NULL").groupBy("doc_id", F.col("entity_name").alias("name")).agg(F.min_by("noun", "seq").alias("noun"))
    last = F.element_at(F.split("name", " "), -1)
    place = F.when(F.col("rank") == 1, "country").when(F.col("rank") == 2, "stateorprovince").when(F.col("rank") == 3, "city")
    by_word = F.when(last.isin("Province", "District", "County", "State"), "stateorprovince").when(last == "City", "city")
    return names.join(known, "name", "left").join(said, ["doc_id", "name"], "left").select("doc_id", "name", F.coalesce(place, "noun", by_word).alias("location"))


def timex_entities(annotations: DataFrame) -> DataFrame:
    """ENT8: each TIMEX2 annotation (doc_id, seq, start, end, val) as a time entity and its one mention; ids count from 0 in order."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1
    rows = annotations.withColumn("timex", F.concat(F.col("doc_id").cast("string"), F.lit("-T"), n.cast("string")))
    return rows.select("doc_id", "timex", F.concat("timex", F.lit("-1")).alias("mention"), "val", "start", "end")


def name_features(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """AGG16: a training line of each name mention: agreement, margin, whether it is its entity's first mention, mention count.

    ``mentions`` (doc_id, entity, seq, start, end, is_name, type, margin); ``keys`` (doc_id, seq, start, end, type),
    of which the first that starts at a place counts.
    """
    w = W.partitionBy("doc_id", "entity")
    m = mentions.withColumn("n", F.count("*").over(w)).withColumn("first", (F.row_number().over(w.orderBy("seq")) == 1).cast("int")).where("is_name")
    k = keys.groupBy("doc_id", "start").agg(F.min_by(F.struct("end", "type"), "seq").alias("k"))
    agrees = F.coalesce((F.col("k.end") == F.col("end")) & (F.lower("k.type") == F.lower("type")), F.lit(False))
    line = F.concat(F.when(agrees, "1").otherwise("-1"), F.lit(" 1:"), F.coalesce(F.col("margin").cast("string"), F.lit("null")), F.lit(" 2:"), F.col("first").cast("string"), F.lit(" 3:"), F.col("n").cast("string"))
    return m.join(k, ["doc_id", "start"], "left").select("doc_id", "entity", "seq", line.alias("line"))
