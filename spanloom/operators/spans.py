"""Annotation algebra: typed spans over documents as DataFrame operations.

An annotation is a row ``doc_id, ann_id, seq, type, start, end, attrs, hypo``
(half-open spans in code points; ``seq`` is the insertion order, which decides
between annotations at one place; ``hypo`` null: visible in every hypothesis).
Containment and position queries join on ``doc_id`` first, so a span predicate
is only ever a residual condition, never a cartesian product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ANNOTATION = "doc_id bigint, ann_id bigint, seq bigint, type string, start int, `end` int, attrs map<string,string>, hypo string"


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """ANN1: insert annotations; columns they lack are null."""
    return store.unionByName(new, allowMissingColumns=True)


def remove(store: DataFrame, gone: DataFrame) -> DataFrame:
    """ANN2: delete the given annotations."""
    return store.join(gone.select("doc_id", "ann_id").distinct(), ["doc_id", "ann_id"], "left_anti")


def remove_type(store: DataFrame, *types: str) -> DataFrame:
    """ANN2: delete all annotations of the types."""
    return store.where(~F.col("type").isin(*types) | F.col("type").isNull())


def of_type(store: DataFrame, *types: str) -> DataFrame:
    """ANN6."""
    return store.where(F.col("type").isin(*types))


def starting_at(store: DataFrame, places: DataFrame, at: str = "pos") -> DataFrame:
    """ANN3: annotations that start at each place (doc_id, ``at``)."""
    return places.join(store, (places["doc_id"] == store["doc_id"]) & (places[at] == store["start"])).drop(store["doc_id"])


def ending_at(store: DataFrame, places: DataFrame, at: str = "pos") -> DataFrame:
    """ANN4: annotations that end at each place."""
    return places.join(store, (places["doc_id"] == store["doc_id"]) & (places[at] == store["end"])).drop(store["doc_id"])


def first_at(found: DataFrame, *keys: str) -> DataFrame:
    """ANN5: of the annotations found for each key, the one inserted first."""
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("x")).select(*keys, "x.*")


def within(inner: DataFrame, outer: DataFrame, prefix: str = "outer_") -> DataFrame:
    """ANN7: pairs of an annotation and a span of the same document that contains it."""
    o = outer.select(*[F.col(c).alias(c if c == "doc_id" else prefix + c) for c in outer.columns])
    return inner.join(o, "doc_id").where((F.col("start") >= F.col(prefix + "start")) & (F.col("end") <= F.col(prefix + "end")))


def within_disjoint(inner: DataFrame, outer: DataFrame, prefix: str = "outer_") -> DataFrame:
    """ANN7 where spans of ``outer`` do not overlap: only the last one that starts at or before a span can hold it.

    One union and one window per document instead of a range join.
    """
    o = F.struct(*[F.col(c).alias(prefix + c) for c in outer.columns if c != "doc_id"])
    i = F.struct(*[c for c in inner.columns if c != "doc_id"])
    holders = outer.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), o.alias("o"))
    rows = inner.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("side"), i.alias("i"))
    both = holders.unionByName(rows, allowMissingColumns=True)
    w = W.partitionBy("doc_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    last = both.withColumn("o", F.last("o", ignorenulls=True).over(w)).where("side = 1 AND o IS NOT NULL")
    return last.select("doc_id", "i.*", "o.*").where(F.col("end") <= F.col(prefix + "end"))


def types(store: DataFrame) -> DataFrame:
    """ANN8: distinct types, in name order."""
    return store.select("type").distinct().orderBy("type")


def visible(store: DataFrame, *hypotheses: str) -> DataFrame:
    """ANN9: annotations outside all hypotheses or in an active one."""
    return store.where(F.col("hypo").isNull() | F.col("hypo").isin(*hypotheses)) if hypotheses else store.where(F.col("hypo").isNull())


def annotate_between_tags(docs: DataFrame, tag: str, text: str = "text") -> DataFrame:
    """ANN10: content between literal <tag> and </tag>; tags stay in the text."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>.*?</{tag}>"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("xs"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.instr(F.substring(F.col(text), acc["at"] + 1, F.length(text)), m) - 1
        inner = F.struct((at + len(tag) + 2).alias("start"), (at + F.length(m) - len(tag) - 3).alias("end"))
        return F.struct((at + F.length(m)).alias("at"), F.concat(acc["xs"], F.array(inner)).alias("xs"))

    spans = F.aggregate(found, zero, step, lambda acc: acc["xs"])
    return docs.select("doc_id", F.posexplode(spans).alias("seq", "s")).select("doc_id", "seq", F.lit(tag).alias("type"), "s.start", "s.end")


def stretch(store: DataFrame, docs: DataFrame) -> DataFrame:
    """ANN11: move ends over following white space, but not past the next start of an annotation."""
    starts = store.groupBy("doc_id").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    full = store.join(docs.select("doc_id", "text"), "doc_id").join(starts, "doc_id")
    gap = F.length(F.regexp_extract(F.substring(F.col("text"), F.col("end") + 1, F.length("text")), r"^\s*", 0))
    nxt = F.array_min(F.filter("starts", lambda s: s >= F.col("end")))
    return full.withColumn("end", F.least(F.col("end") + gap, F.coalesce(nxt, F.lit(2**31 - 1)))).select(*store.columns)


def shrink(store: DataFrame, docs: DataFrame) -> DataFrame:
    """ANN11: move ends back over trailing white space."""
    full = store.join(docs.select("doc_id", "text"), "doc_id")
    inside = span_text(F.col("text"))
    return full.withColumn("end", F.col("start") + F.length(F.regexp_replace(inside, r"\s+$", ""))).select(*store.columns)


def put(attrs: Column | str, key: str, value: Column) -> Column:
    """ANN12: attribute set; an old value goes."""
    c = F.col(attrs) if isinstance(attrs, str) else attrs
    return F.map_concat(F.map_filter(c, lambda k, v: k != key), F.create_map(F.lit(key), value))


def drop_attr(attrs: str, key: str) -> Column:
    """ANN12: attribute removed."""
    return F.map_filter(attrs, lambda k, v: k != key)


def assign_ids(store: DataFrame) -> DataFrame:
    """ANN12: ids that are unique in their document, in insertion order."""
    return store.withColumn("ann_id", F.row_number().over(W.partitionBy("doc_id").orderBy("seq")).cast("long"))


def span_text(text: Column, start: str = "start", end: str = "end") -> Column:
    """ANN14: text of a span."""
    return F.substring(text, F.col(start) + 1, F.col(end) - F.col(start))


def normalized(c: Column) -> Column:
    """ANN14: white space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def end_without_space(text: Column) -> Column:
    """ANN13: end of a span without trailing white space."""
    return F.col("start") + F.length(F.regexp_replace(span_text(text), r"\s+$", ""))


def attrs_subset(a: Column, b: Column) -> Column:
    """ANN15: every feature of ``a`` has the same value in ``b``."""
    return F.forall(F.map_entries(a), lambda e: F.coalesce(F.element_at(b, e["key"]) == e["value"], F.lit(False)))


def attrs_equal(a: Column, b: Column) -> Column:
    """ANN15: the same features with the same values."""
    return (F.size(a) == F.size(b)) & attrs_subset(a, b)


def unify(a: Column, b: Column) -> Column:
    """ANN15: joint features, or null where the two disagree."""
    merged = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))
    clash = F.exists(F.map_values(F.map_zip_with(a, b, lambda k, x, y: x.isNotNull() & y.isNotNull() & (x != y))), lambda v: v)
    return F.when(~clash, merged)


def erase_outside(store: DataFrame, zones: DataFrame) -> DataFrame:
    """ANN19: only annotations inside some zone of their document stay."""
    z = zones.select("doc_id", F.col("start").alias("zs"), F.col("end").alias("ze"))
    return store.join(z, (store["doc_id"] == z["doc_id"]) & (store["start"] >= z["zs"]) & (store["end"] <= z["ze"]), "left_semi")


def erase_inside(store: DataFrame, zones: DataFrame) -> DataFrame:
    """ANN19: annotations inside a zone of their document go."""
    z = zones.select("doc_id", F.col("start").alias("zs"), F.col("end").alias("ze"))
    return store.join(z, (store["doc_id"] == z["doc_id"]) & (store["start"] >= z["zs"]) & (store["end"] <= z["ze"]), "left_anti")


def hide(store: DataFrame, type_: str, span: DataFrame) -> DataFrame:
    """ANN20: everything of a type that starts in a span is marked hidden."""
    s = span.select("doc_id", F.col("start").alias("zs"), F.col("end").alias("ze")).distinct()
    hit = store.where(F.col("type") == type_).join(s, (store["doc_id"] == s["doc_id"]) & (store["start"] >= s["zs"]) & (store["start"] < s["ze"]), "left_semi").select("doc_id", "ann_id", F.lit(True).alias("h"))
    return store.join(hit, ["doc_id", "ann_id"], "left").withColumn("hidden", F.coalesce("h", F.lit(False))).drop("h")


def islands(rows: DataFrame, keys: list[str], order: list, label: str) -> DataFrame:
    """SEQ8/ANN22: maximal runs of equal labels: keys, run, label, first, last position and length."""
    w = W.partitionBy(*keys).orderBy(*order)
    pos = F.row_number().over(w)
    marked = rows.withColumn("pos", pos).withColumn("new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(w))
    return marked.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


def bio_to_spans(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """SEQ8/ANN22: B-x/I-x/O tags of ordered tokens as spans; an I without its B opens one."""
    w = W.partitionBy("doc_id").orderBy("start")
    kind = F.regexp_extract(tag, r"^[BI]-(.*)$", 1)
    prev = F.lag(F.when(F.col(tag) != "O", kind)).over(w)
    opens = F.when(F.col(tag) == "O", 0).when(F.col(tag).startswith("B-") | prev.isNull() | (prev != kind), 1).otherwise(0)
    runs = tokens.withColumn("kind", kind).withColumn("opens", opens).withColumn("run", F.sum("opens").over(w)).where(F.col(tag) != "O")
    return runs.groupBy("doc_id", "run").agg(F.first("kind").alias("type"), F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def spans_to_bio(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """ANN22: token tags from name spans (the first name by start, then the longest, wins)."""
    n = names.select("doc_id", F.col("type").alias("kind"), F.col("start").alias("ns"), F.col("end").alias("ne"))
    hit = tokens.join(n, (tokens["doc_id"] == n["doc_id"]) & (tokens["start"] >= n["ns"]) & (tokens["end"] <= n["ne"]), "left").drop(n["doc_id"])
    best = hit.groupBy(*tokens.columns).agg(F.min_by(F.struct("kind", "ns"), F.struct("ns", -F.col("ne"))).alias("x"))
    return best.withColumn("tag", F.when(F.col("x.kind").isNull(), "O").when(F.col("start") == F.col("x.ns"), F.concat(F.lit("B-"), "x.kind")).otherwise(F.concat(F.lit("I-"), "x.kind"))).drop("x")


def sorted_for_writing(store: DataFrame) -> DataFrame:
    """SRT1: by end descending, then start ascending (parents before children), then insertion."""
    return store.orderBy("doc_id", F.col("end").desc(), "start", "seq")


def sorted_by_start(store: DataFrame) -> DataFrame:
    """SRT2: stable by start."""
    return store.orderBy("doc_id", "start", "seq")
