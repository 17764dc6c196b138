"""Entities, values, relations and events as joins, windows and aggregates.

Tables: mentions (doc_id, mention, entity, sentence, head_start, head_end,
start, end, text, head, category, type, subtype), relations (doc_id, type,
subtype, arg1, arg2), events (doc_id, event, type, subtype, p) and arguments
(event, role, value, p).  Order-dependent event coreference is one fold per
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WINDOW, LOCAL = 4, 0.25
EVENT_P, ARGUMENT_P, MERGE_P = 0.50, 0.10, 0.40
KNN_CUTOFF = 21


# ---------------------------------------------------------------- ENT
def positional_ids(rows: DataFrame, order: list, prefix: str = "", name: str = "id") -> DataFrame:
    """Ids like doc-1, doc-T2, doc-R3 in document order."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    return rows.withColumn(name, F.concat(F.col("doc_id").cast("string"), F.lit(f"-{prefix}"), n.cast("string")))


def build_entities(mentions: DataFrame) -> DataFrame:
    """ENT1: one row per typed entity with its mentions and names in text order; type OTHER is dropped."""
    rows = mentions.where(F.col("type") != "OTHER")
    names = F.array_sort(F.collect_list(F.when(F.col("category") == "NAME", F.struct("head_start", "text"))))
    e = rows.groupBy("doc_id", "entity", "type").agg(F.min("head_start").alias("first"), F.array_sort(F.collect_list("mention")).alias("mentions"), names.alias("n"))
    return positional_ids(e.select("doc_id", "entity", "type", "first", "mentions", F.col("n.text").alias("names")), ["first", "entity"])


def mention_type(head_category: Column) -> Column:
    """ENT2: NAME, PRONOUN or NOMINAL by the category of the head."""
    return F.when(head_category.isin("name", "nnp", "nnps", "NNP", "NNPS"), "NAME").when(head_category.isin("pro", "det", "PRP", "PRP$", "tpos"), "PRONOUN").otherwise("NOMINAL")


def gpe_role(type_: Column, governing_preposition: Column, sentence: Column) -> Column:
    """ENT2: role of a GPE mention: LOC behind a locative preposition or in the first sentence, else GPE."""
    return F.when(type_ == "GPE", F.when(governing_preposition.isin("in", "at", "to", "near", "from") | (sentence == 0), "LOC").otherwise("GPE"))


def is_generic(category: Column, det: Column, number: Column, verb_tense: Column, generic_head: Column) -> Column:
    """ENT3: a nominal of a generic head, a bare plural or an indefinite, outside of past clauses."""
    open_ = F.coalesce(det.isin("a", "an", "any"), F.lit(False)) | (det.isNull() & F.coalesce(number == "plural", F.lit(False)))
    return (category == "NOMINAL") & F.coalesce(generic_head, F.lit(False)) & open_ & ~F.coalesce(verb_tense == "past", F.lit(False))


def entity_type(gazetteer: Column, name: Column, partitive: Column, hand: Column, dictionary: Column) -> Column:
    """ENT4: the first source that knows, else OTHER."""
    return F.coalesce(gazetteer, name, partitive, hand, dictionary, F.lit("OTHER"))


def find_values(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """ENT6: values by head word, and e-mail and URL tokens as contact information."""
    h = heads.select(F.col("word").alias("token"), F.col("type").alias("_t"))
    out = tokens.join(h, "token", "left")
    kind = F.when(F.col("type") == "email", "Contact-Info:E-Mail").when(F.col("type") == "url", "Contact-Info:URL").otherwise(F.col("_t"))
    return out.withColumn("value_type", kind).where(F.col("value_type").isNotNull()).drop("_t")


def prune_values(values: DataFrame, arguments: DataFrame) -> DataFrame:
    """ENT7/SET4: values that an event uses, and all of Numeric and Contact-Info."""
    used = arguments.select("doc_id", F.col("value").alias("value_id")).distinct().withColumn("_u", F.lit(True))
    out = values.join(used, ["doc_id", "value_id"], "left")
    return out.where(F.col("_u") | F.col("type").isin("Numeric", "Contact-Info")).drop("_u")


def reciprocal_links(rows: DataFrame, column: str) -> DataFrame:
    """ENT9: for each target of a reference the first row that refers to it (subject -> subject-1)."""
    first = rows.where(F.col(column).isNotNull()).groupBy("doc_id", F.col(column).alias("ann_id")).agg(F.min("seq").alias("seq"))
    back = first.join(rows.select("doc_id", "seq", F.col("ann_id").alias(f"{column}-1")), ["doc_id", "seq"]).drop("seq")
    return rows.join(back, ["doc_id", "ann_id"], "left")


# ---------------------------------------------------------------- REL
def mention_pairs(mentions: DataFrame, group: list[str], order: list, different: str, window: int = WINDOW) -> DataFrame:
    """REL1: pairs of rows of one group at most ``window`` places apart that differ in ``different``.

    Neighbours come from ``lead``, so work is linear: no self-join.
    """
    w = W.partitionBy(*group).orderBy(*order)
    own = F.struct(*mentions.columns)
    ahead = F.array(*[F.struct(F.lit(k).alias("distance"), F.lead(own, k).over(w).alias("m")) for k in range(1, window + 1)])
    pairs = mentions.withColumn("_a", ahead).select(*group, own.alias("m1"), F.explode(F.filter("_a", lambda x: x["m"].isNotNull())).alias("x"))
    return pairs.select(*group, "m1", F.col("x.m").alias("m2"), F.col("x.distance").alias("distance")).where(F.col(f"m1.{different}") != F.col(f"m2.{different}"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """REL2: names of the features of a mention pair (heads, types, levels, nesting, order)."""
    a, b = (lambda c: F.col(f"m1.{c}")), (lambda c: F.col(f"m2.{c}"))
    named = {"h1": a("head"), "h2": b("head"), "h12": F.concat_ws("-", a("head"), b("head")), "et12": F.concat_ws("-", a("type"), b("type")), "est12": F.concat_ws("-", a("subtype"), b("subtype")), "ml12": F.concat_ws("-", a("category"), b("category")), "hm12+m1>m2": F.concat_ws("-", a("type"), b("type"), (a("end") >= b("end")).cast("string")), "m1>m2": (a("end") >= b("end")).cast("string"), "m1<m2": ((b("start") <= a("start")) & (b("end") >= a("end"))).cast("string"), "dist": F.col("distance").cast("string")}
    return pairs.withColumn("features", F.array(*[F.concat(F.lit(k + "="), F.coalesce(v, F.lit("-"))) for k, v in named.items()]))


def predict_relations(scored: DataFrame, threshold: float = LOCAL) -> DataFrame:
    """REL3: identification keeps p / (p + p_nil) >= threshold; the best type is taken, a type in -1 swaps the arguments."""
    kept = scored.where(F.try_divide(F.col("p"), F.col("p") + F.col("p_nil")) >= threshold)
    inverse = F.col("best").endswith("-1")
    return kept.select("doc_id", F.regexp_replace("best", "-1$", "").alias("type"), F.when(inverse, F.col("arg2")).otherwise(F.col("arg1")).alias("arg1"), F.when(inverse, F.col("arg1")).otherwise(F.col("arg2")).alias("arg2"))


def last_before(positions: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """REL4 (as-of): for each (doc_id, pos) the span that starts last at or before it.

    One union and one window per document order; no range join.
    """
    p = positions.select("doc_id", F.col("pos").alias("at"), F.lit(1).alias("side"), F.struct(*positions.columns).alias("row"), F.lit(None).cast("long").alias("s"))
    s = spans.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(p.schema["row"].dataType).alias("row"), F.col("start").cast("long").alias("s"))
    w = W.partitionBy("doc_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    return p.unionByName(s).withColumn(name, F.last("s", ignorenulls=True).over(w)).where("side = 1").select("row.*", name)


def fits_argument_types(relations: DataFrame, allowed: DataFrame) -> DataFrame:
    """REL5: relations whose argument types a table (type, arg, entity_type) allows on both sides."""
    for k in ("arg1", "arg2"):
        a = allowed.where(F.col("arg") == k).select("type", F.col("entity_type").alias(f"{k}_type")).distinct()
        relations = relations.join(a, ["type", f"{k}_type"], "left_semi")
    return relations


def extend_to_conjuncts(relations: DataFrame, conjuncts: DataFrame) -> DataFrame:
    """REL6: relations also between conjuncts of their arguments, without those that exist."""
    c = conjuncts.select("doc_id", F.col("a").alias("m"), F.col("b").alias("n"))
    c1, c2 = c.select("doc_id", F.col("m").alias("arg1"), F.col("n").alias("n1")), c.select("doc_id", F.col("m").alias("arg2"), F.col("n").alias("n2"))
    one = relations.join(c1, ["doc_id", "arg1"]).select("doc_id", "type", "subtype", F.col("n1").alias("arg1"), "arg2")
    two = relations.join(c2, ["doc_id", "arg2"]).select("doc_id", "type", "subtype", "arg1", F.col("n2").alias("arg2"))
    both = one.join(c2, ["doc_id", "arg2"]).select("doc_id", "type", "subtype", "arg1", F.col("n2").alias("arg2"))
    new = one.unionByName(two).unionByName(both).where("arg1 <> arg2").distinct()
    old = relations.select("doc_id", "arg1", "arg2")
    return relations.select("doc_id", "type", "subtype", "arg1", "arg2").unionByName(new.join(old, ["doc_id", "arg1", "arg2"], "left_anti").select("doc_id", "type", "subtype", "arg1", "arg2"))


def relation_groups(relations: DataFrame, group: list[str], by: list[str]) -> DataFrame:
    """REL7: mentions of one relation share a number per document, in order of the keys."""
    return relations.withColumn("relation", F.dense_rank().over(W.partitionBy(*group).orderBy(*by)))


def drop_enclosing(rows: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """REL8: rows whose span does not enclose another, different span of its group.

    A span encloses another iff some span that starts at or behind it ends at or
    before its end; one window over starts finds the least such end.
    """
    spans = rows.select(*group, start, end).distinct()
    # at one start the shorter spans stand behind the longer ones
    w = W.partitionBy(*group).orderBy(start, F.col(end).desc()).rowsBetween(1, W.unboundedFollowing)
    bad = spans.withColumn("_least", F.min(end).over(w)).where(F.col("_least") <= F.col(end)).select(*group, start, end)
    return rows.join(bad, [*group, start, end], "left_anti")


def neighbour_names(mentions: DataFrame) -> DataFrame:
    """REL9: adjacent names of a sentence."""
    w = W.partitionBy("doc_id", "sentence").orderBy("head_start")
    return mentions.where("category = 'NAME'").withColumn("next", F.lead("mention").over(w)).where("next IS NOT NULL").select("doc_id", F.col("mention").alias("a"), F.col("next").alias("b"), F.lit("sameSentence").alias("type"))


def pattern_distance(q: str, p: str) -> Column:
    """REL10: weighted distance of two relation patterns: head words 1 each, types 10 each, 100 for another direction."""
    ne = lambda c: F.when(F.col(f"{q}.{c}").eqNullSafe(F.col(f"{p}.{c}")), 0)
    return ne("head1").otherwise(1) + ne("head2").otherwise(1) + ne("type1").otherwise(10) + ne("type2").otherwise(10) + ne("direction").otherwise(100)


def nearest_pattern(queries: DataFrame, patterns: DataFrame, cutoff: int = KNN_CUTOFF) -> DataFrame:
    """REL10: per query the majority type (by count) of its nearest patterns with the same link, and (cutoff - d) / cutoff."""
    pairs = queries.alias("q").join(patterns.alias("p"), F.col("q.link") == F.col("p.link")).select("q.query", F.col("p.type").alias("type"), F.col("p.n").alias("n"), pattern_distance("q", "p").alias("d")).where(F.col("d") <= cutoff)
    best = pairs.groupBy("query").agg(F.min("d").alias("d"))
    votes = pairs.join(best, ["query", "d"]).groupBy("query", "d", "type").agg(F.sum("n").alias("n"))
    return votes.groupBy("query", "d").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type")).withColumn("confidence", (cutoff - F.col("d")) / F.lit(float(cutoff)))


def relations_by_path(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """REL12: relation of a dependency path, auxiliaries taken out."""
    clean = F.regexp_replace("path", r"(?:^|(?<=:))aux(?:pass)?(?:-1)?:[^:]+:", "")
    return pairs.withColumn("path", clean).join(paths, "path")


def chunk_path(chunks: list[tuple[int, int, str]], a: tuple[int, int], b: tuple[int, int]) -> str | None:
    """REL13: heads of the chunks between two spans joined by ``-``; null if they overlap."""
    if a[1] > b[0]:
        return None
    return "-".join(head for s, e, head in chunks if s >= a[1] and e <= b[0])


def pattern_counts(relations: DataFrame, *columns: str) -> DataFrame:
    """REL14/SRC29: relation patterns with their counts."""
    return relations.groupBy(*columns).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- EVT
def pattern_node_score(any_: Column, type_: Column, subtype: Column, word: Column) -> Column:
    """EVT3: 10300 for the word, 10200 subtype, 10100 type, 10000 a wildcard, 0 no match."""
    return F.when(word, 10300).when(subtype, 10200).when(type_, 10100).when(any_, 10000).otherwise(0)


def evaluation_score(success: Column, failure: Column, ratio: float = 1.0) -> Column:
    """EVT4: 50 s / (s + f + 10), whole, where s >= f * ratio; else -1."""
    return F.when(success >= failure * ratio, F.floor(success * 50 / (success + failure + 10))).otherwise(-1).cast("int")


def detect_events(anchors: DataFrame, patterns: DataFrame) -> DataFrame:
    """EVT1: best pattern of each anchor word; ties go to the first in name order."""
    hit = anchors.join(patterns, "word")
    return hit.groupBy("doc_id", "anchor", "word").agg(F.min_by(F.struct("type", "subtype", "score"), F.struct(-F.col("score"), F.col("type"), F.col("subtype"))).alias("x")).select("doc_id", "anchor", "word", "x.*")


def collect_arguments(candidates: DataFrame, keys: list[str], role: str, p: str, tie: list) -> DataFrame:
    """EVT5/TOP4: the likeliest candidate of each role."""
    w = W.partitionBy(*keys, role).orderBy(F.col(p).desc(), *tie)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unique_values(arguments: DataFrame, keys: list[str], value: str, p: str) -> DataFrame:
    """EVT5: a value fills one role of an event only: that of the greatest probability."""
    w = W.partitionBy(*keys, value).orderBy(F.col(p).desc(), "role")
    return arguments.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prune_events(events: DataFrame, arguments: DataFrame, event_p: float = EVENT_P, argument_p: float = ARGUMENT_P) -> tuple[DataFrame, DataFrame]:
    """EVT6: events of p >= event_p; of theirs, arguments of confidence * p >= argument_p."""
    e = events.where(F.col("p") >= event_p)
    a = arguments.join(e.select("event", F.col("p").alias("_p")), "event").where(F.col("confidence") * F.col("_p") >= argument_p).drop("_p")
    return e, a


def coref_features(pairs: DataFrame) -> DataFrame:
    """EVT8: distance in hundreds (at most 9), same anchor, number of shared and of conflicting roles."""
    d = F.least(F.lit(9), F.floor(F.abs(F.col("pos2") - F.col("pos1")) / 100))
    same = F.size(F.filter(F.map_keys("args1"), lambda r: F.element_at("args2", r) == F.element_at("args1", r)))
    clash = F.size(F.filter(F.map_keys("args1"), lambda r: F.element_at("args2", r) != F.element_at("args1", r)))
    return pairs.withColumn("features", F.array(F.concat(F.lit("dist="), d.cast("string")), F.concat(F.lit("anchor="), (F.col("anchor1") == F.col("anchor2")).cast("string")), F.concat(F.lit("overlap="), same.cast("string")), F.concat(F.lit("conflict="), clash.cast("string"))))


def merge_events(events: list[dict], probability, threshold: float = MERGE_P) -> list[int]:
    """EVT7: each event joins the likeliest earlier one of its type and subtype above the threshold; arguments are united."""
    groups: list[dict] = []
    out = []
    for e in events:
        scored = [(probability(g, e), -n) for n, g in enumerate(groups) if (g["type"], g["subtype"]) == (e["type"], e["subtype"])]
        best = max(scored, default=None)
        if best and best[0] > threshold:
            n = -best[1]
            groups[n]["args"] = groups[n]["args"] | e["args"]
        else:
            n = len(groups)
            groups.append(dict(e))
        out.append(n)
    return out


def nearest_arguments(mentions: DataFrame, keys: list[str], position: str, anchor: str) -> DataFrame:
    """EVT10/SRT5: mentions by distance from their anchor."""
    w = W.partitionBy(*keys).orderBy(F.abs(F.col(position) - F.col(anchor)), position)
    return mentions.withColumn("rank", F.row_number().over(w))


def role_counts(arguments: DataFrame) -> DataFrame:
    """EVT9: how often a value type fills a role of an event type."""
    return arguments.groupBy("type", "role", "value_type").agg(F.count("*").alias("n"))
