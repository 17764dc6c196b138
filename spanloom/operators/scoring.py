"""Scores and corpus counts: joins and aggregates, nothing per document on the driver.

Responses and keys are annotation tables.  All ratios guard against an empty
denominator with null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..tasks import spread


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def with_prf(counts: DataFrame, correct: str = "correct", response: str = "response", key: str = "key") -> DataFrame:
    """Precision, recall and their harmonic mean."""
    p, r = ratio(F.col(correct), F.col(response)), ratio(F.col(correct), F.col(key))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def match_tags(response: DataFrame, key: DataFrame, by: str = "kind") -> DataFrame:
    """AGG1: outer join on exact spans; optional keys don't count, of equal key spans the last inserted counts.

    Rows: doc_id, start, end, the label on each side, and whether they agree.
    """
    span = ["doc_id", "start", "end"]
    k = key.groupBy(*span).agg(F.max_by(by, "seq").alias("key_label"), F.max_by("optional", "seq").alias("optional"))
    r = response.select(*span, F.col(by).alias("response_label"))
    both = r.join(k, span, "full_outer").where(~F.coalesce("optional", F.lit(False)))
    return both.select(*span, "response_label", "key_label", F.coalesce(F.col("response_label") == F.col("key_label"), F.lit(False)).alias("agrees"))


def score_tags(matched: DataFrame, *by: str) -> DataFrame:
    """AGG2/AGG3: counts and P/R/F per group and in total (null group)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = matched.rollup(*by).agg(one(F.col("agrees")).alias("correct"), one(F.col("response_label").isNotNull()).alias("response"), one(F.col("key_label").isNotNull()).alias("key"))
    return with_prf(out)


def coref_link_side(own: DataFrame, other: DataFrame) -> DataFrame:
    """AGG5: per document, sum over own entities of (mapped mentions - distinct other entities) and of (mapped - 1).

    ``own`` and ``other`` are (doc_id, entity, head_end); mentions map by head
    end, the last one of the other side counting.
    """
    o = other.groupBy("doc_id", "head_end").agg(F.max("entity").alias("other"))
    per = own.join(o, ["doc_id", "head_end"]).groupBy("doc_id", "entity").agg(F.count("*").alias("mapped"), F.countDistinct("other").alias("parts"))
    return per.groupBy("doc_id").agg(F.sum(F.col("mapped") - F.col("parts")).alias("links"), F.sum(F.col("mapped") - 1).alias("possible"))


def score_coref(response: DataFrame, key: DataFrame) -> DataFrame:
    """AGG5: recall and precision of coreference links, per document and overall (null)."""
    rec = coref_link_side(key, response).select("doc_id", F.col("links").alias("r_links"), F.col("possible").alias("r_possible"))
    pre = coref_link_side(response, key).select("doc_id", F.col("links").alias("p_links"), F.col("possible").alias("p_possible"))
    both = rec.join(pre, "doc_id", "full_outer")
    tot = both.rollup("doc_id").agg(*[F.sum(c).alias(c) for c in ("r_links", "r_possible", "p_links", "p_possible")])
    out = tot.withColumn("recall", ratio(F.col("r_links"), F.col("r_possible"))).withColumn("precision", ratio(F.col("p_links"), F.col("p_possible")))
    return out.withColumn("f", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def previous_mention(mentions: DataFrame, keys: list[str], order: list) -> DataFrame:
    """AGG6: the mention before each one in its chain."""
    w = W.partitionBy(*keys).orderBy(*order)
    return mentions.withColumn("antecedent", F.lag("mention").over(w))


def pronoun_accuracy(response: DataFrame, key: DataFrame) -> DataFrame:
    """AGG6: a pronoun is right if its antecedent is any mention of its key chain."""
    k = key.select("doc_id", F.col("mention").alias("m"), F.col("entity").alias("chain"))
    own = response.where("is_pronoun").join(k.withColumnRenamed("m", "mention").withColumnRenamed("chain", "own"), ["doc_id", "mention"], "left")
    hit = own.join(k.withColumnRenamed("m", "antecedent"), ["doc_id", "antecedent"], "left")
    return hit.agg(F.count("*").alias("pronouns"), F.sum(F.when(F.col("own") == F.col("chain"), 1).otherwise(0)).alias("right"))


def compare_chains(response: DataFrame, key: DataFrame) -> DataFrame:
    """AGG7/SET5: entities as sorted mention sets on both sides: OK, key or response."""
    sets = lambda d: d.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_set("mention")).alias("mentions")).select("doc_id", "mentions").distinct()
    r, k = sets(response).withColumn("r", F.lit(True)), sets(key).withColumn("k", F.lit(True))
    both = r.join(k, ["doc_id", "mentions"], "full_outer")
    return both.select("doc_id", "mentions", F.when(F.col("r") & F.col("k"), "OK").when(F.col("k"), "key").otherwise("response").alias("status"))


def score_relations(response: DataFrame, key: DataFrame, symmetric: list[str]) -> DataFrame:
    """AGG8: relations (doc_id, type, arg1, arg2 as head ends) agree on type and arguments; symmetric types in either order."""
    def canon(d):
        swap = F.col("type").isin(*symmetric) & (F.col("arg1") > F.col("arg2"))
        return d.select("doc_id", "type", F.when(swap, F.col("arg2")).otherwise(F.col("arg1")).alias("a"), F.when(swap, F.col("arg1")).otherwise(F.col("arg2")).alias("b"))

    return set_scores(canon(response), canon(key))


def set_scores(response: DataFrame, key: DataFrame) -> DataFrame:
    """AGG9/SET1/SET2: one row: common, response only, key only, P/R/F of two sets of rows.

    Equal rows of both sides meet in one group, over as many tasks as there are rows for.
    """
    columns = sorted(response.columns)
    tag = lambda d, r, k: d.select(*columns, F.lit(r).alias("_r"), F.lit(k).alias("_k"))
    both = spread(tag(response, 1, 0).unionAll(tag(key, 0, 1)), response.count() + key.count(), *columns)
    per = both.groupBy(*columns).agg(F.max("_r").alias("_r"), F.max("_k").alias("_k"))
    r, k = F.col("_r"), F.col("_k")
    c = per.agg(*[F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(n) for n, e in (("correct", r * k), ("response", r), ("key", k))])
    return with_prf(c).withColumn("spurious", F.col("response") - F.col("correct")).withColumn("missing", F.col("key") - F.col("correct"))


def event_type_counts(events: DataFrame, type_: str = "type", doc: str = "doc_id") -> DataFrame:
    """AGG11: mentions and distinct documents of each type."""
    return events.groupBy(type_).agg(F.count("*").alias("mentions"), F.countDistinct(doc).alias("documents"))


def histogram(units: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """AGG12: how many units have k items, zero included."""
    per = items.groupBy(key).agg(F.count("*").alias("k"))
    return units.select(key).join(per, key, "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(F.count("*").alias("units"))


def coherence(mentions: DataFrame, entity: list[str], order: list, place: str, limit: int = 50) -> DataFrame:
    """AGG13: per sentence number below ``limit``: mentions, those with a later and those with an earlier mention of their entity."""
    w = W.partitionBy(*entity).orderBy(*order)
    one = lambda c: F.sum(F.when(c.isNotNull(), 1).otherwise(0)).cast("long")
    rows = mentions.withColumn("later", F.lead(F.lit(1)).over(w)).withColumn("earlier", F.lag(F.lit(1)).over(w)).where(F.col(place) < limit)
    return rows.groupBy(place).agg(F.count("*").alias("mentions"), one(F.col("later")).alias("has_anaphor"), one(F.col("earlier")).alias("has_antecedent"))


def best_type(mentions: DataFrame, head: str = "head", type_: str = "type") -> DataFrame:
    """AGG15: the most frequent type of each head word; ties go to the first in name order."""
    n = mentions.groupBy(head, type_).agg(F.count("*").alias("n"))
    return n.groupBy(head).agg(F.min_by(type_, F.struct(-F.col("n"), F.col(type_))).alias("best"), F.sum("n").alias("total"))


def name_history_class(name: Column, priors: Column) -> Column:
    """AGG14: how a name relates to earlier names of its entity (array, oldest first); the first class that fits."""
    low = F.lower(name)
    rev = F.reverse(priors)
    last = lambda x, k: F.array_join(F.slice(F.split(x, " "), -k, k), " ")
    many = lambda x, k: F.size(F.split(x, " ")) > k
    initials = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.substring(w, 1, 1)), "")
    tests = [
        ("identical", lambda p: p == name),
        ("ignore case", lambda p: F.lower(p) == low),
        ("last name", lambda p: many(p, 1) & (last(p, 1) == name)),
        ("last two names", lambda p: many(p, 2) & (last(p, 2) == name)),
        ("first name", lambda p: many(p, 1) & (F.element_at(F.split(p, " "), 1) == name)),
        ("acronym", lambda p: many(p, 1) & (initials(p) == name)),
        ("reverse acronym", lambda p: many(name, 1) & (initials(name) == p)),
        ("abbreviation", lambda p: F.startswith(low, F.lower(F.regexp_replace(p, r"\.$", ""))) | F.startswith(F.lower(p), F.regexp_replace(low, r"\.$", ""))),
    ]
    fits = F.lit("other")
    for label, test in reversed(tests[1:]):
        fits = F.when(F.exists(rev, test), label).otherwise(fits)
    return F.when(F.size(priors) == 0, "first").when(F.array_contains(priors, name), "identical").otherwise(fits)


def event_lines(events: DataFrame) -> DataFrame:
    """AGG17: one line per event mention: its text, line ends as spaces, and its subtype."""
    return events.select(F.concat_ws("_", F.regexp_replace("text", r"[\r\n]", " "), "subtype").alias("line"))


def score_events(response: DataFrame, key: DataFrame, response_arguments: DataFrame, key_arguments: DataFrame) -> DataFrame:
    """AGG10: one row of counts of correct, mistyped, spurious and missing events, and of arguments of the correct ones.

    Events (doc_id, start, end, subtype) meet by anchor, of equal anchors one
    counts; arguments (doc_id, start, end, role, value) by anchor, role and value.
    """
    span, whole = ["doc_id", "start", "end"], ["doc_id", "start", "end", "role", "value"]
    count = response.count() + key.count() + response_arguments.count() + key_arguments.count()
    one = lambda df, name: spread(df, count, *span).groupBy(*span).agg(F.min("subtype").alias(name))
    both = one(response, "r").hint("merge").join(one(key, "k"), span, "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    r, k = F.col("r"), F.col("k")
    events = both.agg(n(r == k).alias("events_correct"), n(r != k).alias("events_mistyped"), n(k.isNull()).alias("events_spurious"), n(r.isNull()).alias("events_missing"))
    side = lambda df, name: df.select(*whole, F.lit(True).alias(name))
    args = side(response_arguments, "ra").unionByName(side(key_arguments, "ka"), allowMissingColumns=True)
    args = spread(args, count, *span).hint("merge").join(both.where(r == k).select(*span), span, "left_semi")
    args = args.groupBy(*whole).agg(F.max("ra").alias("ra"), F.max("ka").alias("ka"))
    a = args.agg(n(F.col("ra") & F.col("ka")).alias("arguments_correct"), n(F.col("ka").isNull()).alias("arguments_spurious"), n(F.col("ra").isNull()).alias("arguments_missing"))
    return events.withColumn("_", F.lit(0)).join(a.withColumn("_", F.lit(0)), "_").drop("_")
