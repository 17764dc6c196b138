"""Readers of relation files: predicate-argument tuples, relation patterns, dependency paths, anchored paths.

Each takes lines as (n, value), or (doc_id, n, value), and stays a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: places of the fields used in a tuple line of FIELDS fields; fixed values of the file format
FIELDS = 25
ROLE, PA_ROLE, TRANSPARENT, FUNCTOR, OFFSET, BASE, VERB, ARG, ARG_OFFSET, ARG_BASE = 0, 2, 4, 5, 6, 9, 10, 17, 18, 21
#: auxiliaries that paths go through; fixed values
AUXILIARIES = ("would:vch:", "be:vch:", "were:vch:")


def _fields(lines: DataFrame) -> DataFrame:
    rows = lines.select("doc_id", "n", F.split(F.trim("value"), r" \| ").alias("f"))
    rows = rows.where((F.size("f") == FIELDS) & ~F.startswith(F.col("f")[0], F.lit(";")) & ~F.trim(F.col("f")[ROLE]).isin("RELATIVE", "RED-RELATIVE"))
    at = lambda k: F.trim(F.col("f")[k])
    place = lambda k: at(k).try_cast("int")
    return rows.select("doc_id", "n", at(ROLE).alias("role"), at(PA_ROLE).alias("pa"), (at(TRANSPARENT) == "T").alias("transparent"), at(FUNCTOR).alias("word"), F.lower(at(BASE)).alias("base"), place(OFFSET).alias("src"), F.lower(at(VERB)).alias("verb"), at(ARG).alias("arg"), F.lower(at(ARG_BASE)).alias("arg_base"), place(ARG_OFFSET).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")


def tuple_edges(lines: DataFrame, base_forms: bool = True) -> DataFrame:
    """SRC14: edges (doc_id, src, src_word, label, dst, dst_word) of tuple lines (doc_id, n, value), and their inverses.

    The logical role and the predicate-argument role make an edge each.  An
    argument that is a transparent ``of`` or ``by`` gives way to that word's own
    object (the first of them).
    """
    f = _fields(lines)
    words = [F.col("base" if base_forms else "word").alias("src_word"), F.col("arg_base" if base_forms else "arg").alias("dst_word")]
    logical = f.where("role <> 'NIL'").select("doc_id", "n", F.col("role").alias("label"), "src", "dst", "transparent", *words)
    pa = f.where("pa NOT IN ('NIL', 'SUPPORT')").select("doc_id", "n", F.col("pa").alias("label"), "src", "dst", F.lit(False).alias("transparent"), *words)
    edges = logical.union(pa)
    objects = logical.where("label = 'OBJ' AND transparent").groupBy("doc_id", F.col("src").alias("dst")).agg(F.min_by(F.struct("dst", "dst_word"), "n").alias("o"))
    moved = F.col("label").isin("ARG0", "ARG1", "ARG2", "SBJ", "OBJ") & F.col("dst_word").isin("of", "by") & F.col("o").isNotNull()
    pick = lambda c: F.when(moved, F.col(f"o.{c}")).otherwise(F.col(c)).alias(c)
    out = edges.join(objects, ["doc_id", "dst"], "left").select("doc_id", "src", "src_word", "label", pick("dst"), pick("dst_word"))
    back = out.select("doc_id", F.col("dst").alias("src"), F.col("dst_word").alias("src_word"), F.concat("label", F.lit("-1")).alias("label"), F.col("src").alias("dst"), F.col("src_word").alias("dst_word"))
    return out.union(back).distinct()


def nominal_verbs(lines: DataFrame, base_forms: bool = True) -> DataFrame:
    """SRC14: (noun, verb) pairs of nominalizations in tuple lines."""
    return _fields(lines).where("verb <> 'nil'").select(F.col("base" if base_forms else "word").alias("noun"), "verb").distinct()


PATTERN = r"^\s*arg([12])-\S*\s+(\S+)\s+(\S+)\s+(\S+)\s+\[\s+(\S+)\s+:\s(.*?)\]\s+(\S+)\s+(\S+)\s+(\S+)\s+-->\s+(\S+)(?:\s+(\S+))?\s*$"


def relation_patterns(lines: DataFrame) -> DataFrame:
    """SRC29: distinct patterns of lines (value) with how often they occur; a pattern from the second argument has its relation inverted."""
    g = lambda k: F.regexp_extract("value", PATTERN, k)
    star = lambda c: F.when(c == "*", "").otherwise(c)
    noise = lambda x: x.rlike(r"^(adv|timex|q)\(") | x.isin("'", "''", '"', "")
    linear = F.filter(F.split(g(6), r"\s+"), lambda x: ~noise(x))
    relation = F.concat(g(10), F.when(g(1) == "2", "-1").otherwise(""))
    rows = lines.where(F.col("value").rlike(PATTERN)).select(g(2).alias("type1"), star(g(3)).alias("subtype1"), g(4).alias("head1"), g(5).alias("link"), linear.alias("linear"), g(7).alias("type2"), star(g(8)).alias("subtype2"), g(9).alias("head2"), relation.alias("relation"), g(11).alias("subtype"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def link_index(patterns: DataFrame) -> DataFrame:
    """SRC29: patterns under each ``key`` that can find them: preposition or syntactic link, and the last linear element (``**`` if there is none)."""
    link, last = F.col("link"), F.try_element_at("linear", F.lit(-1))
    by_link = F.when(link.rlike("^[so]-"), F.regexp_extract(link, "-([^-]*)$", 1)).when(link != "0", link)
    by_last = F.when(F.size("linear") == 0, "**").when(last != "0", last)
    return patterns.withColumn("key", F.explode(F.array_distinct(F.filter(F.array(by_link, by_last), lambda x: x.isNotNull()))))


def _without_auxiliaries(path: Column) -> Column:
    for x in AUXILIARIES:
        path = F.replace(path, F.lit(x), F.lit(""))
    return path


def dependency_paths(lines: DataFrame) -> DataFrame:
    """SRC30: (path, type) of ``path TAB type`` lines (n, value) without auxiliaries; the later line of a path wins."""
    p = F.split("value", "\t")
    return lines.where(F.size(p) >= 2).groupBy(_without_auxiliaries(p[0]).alias("path")).agg(F.max_by(p[1], "n").alias("type"))


def anchored_paths(lines: DataFrame, lemmas: DataFrame) -> DataFrame:
    """SRC31: (n, arg1, path, arg2) of ``x TAB arg1 -- path -- arg2`` or ``arg1 -- path -- arg2|x`` lines (n, value).

    Words of the path (its even parts) become lemmas of ``lemmas`` (word, lemma),
    gathered by word, so a path's words travel and the table doesn't.  Plain equality filters
    serve as indexes by path and by arguments.
    """
    tab = F.split("value", "\t")
    body = F.split(F.when(F.size(tab) == 2, tab[1]).otherwise(F.split("value", r"\|")[0]), " -- ")
    rows = lines.where(F.size(body) == 3).select("n", body[0].alias("arg1"), body[1].alias("p"), body[2].alias("arg2"))
    parts = rows.select("n", F.posexplode(F.split("p", ":")).alias("i", "word"))
    known = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma"))
    parts = parts.join(known, "word", "left").select("n", "i", F.when(F.col("i") % 2 == 1, F.coalesce("lemma", "word")).otherwise(F.col("word")).alias("w"))
    path = parts.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), ":").alias("path"))
    return rows.join(path, "n").select("n", "arg1", "path", "arg2")
