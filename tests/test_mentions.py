"""Mentions, relation files and settings: literal cases, nulls and empty tables."""

from spanloom.config import Settings
from spanloom.operators import mentions, scoring
from spanloom.sources import relations

CONSTITUENT = "doc_id long, node long, cat string, head long, start int, end int, text string, det string, tposs string, nhuman string, pa struct<head:string,det:string,number:string,human:string>, children array<long>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_settings():
    s = Settings.parse("# a comment\n! another\nPattern.fileName1 = a.txt\nPattern.fileName2:b\\\n   c.txt\nplain\nJet.dataPath data\nname\\ x=\\u0041\\tb\n")
    assert s == {"Pattern.fileName1": "a.txt", "Pattern.fileName2": "bc.txt", "plain": "", "Jet.dataPath": "data", "name x": "A\tb"}
    assert list(s.family("Pattern.fileName")) == ["Pattern.fileName1", "Pattern.fileName2"] and s.family("none") == {}
    assert s.path("Pattern.fileName1", "/home", "Jet.dataPath") == "/home/data/a.txt" and s.path("none") is None
    assert Settings.parse("d=hdfs://x/y\nf=z").path("f", "/home", "d") == "hdfs://x/y/z"


def test_mentions_of_one_sentence(spark):
    # "the man and there": np(1) of ngroup(2), cconj(3), np(4) of there(5) in a coordinated np(6)
    c = [
        (1, 1, "np", 2, 0, 7, "the man", "the", None, None, None, []), (1, 2, "ngroup", None, 0, 7, "the  man", None, None, "t", None, []), (1, 3, "cconj", None, 8, 11, "and", None, None, None, None, []),
        (1, 4, "np", 5, 12, 17, "There", None, None, None, None, []), (1, 5, "n", None, 12, 17, "There", None, None, None, None, []), (1, 6, "np", 1, 0, 17, "the man and There", None, None, None, None, [1, 3, 4]),
        (1, 7, "s", None, 0, 17, None, None, None, None, None, None), (2, 1, "det", None, 0, 3, "his", None, "t", None, None, []), (2, 2, None, None, 0, 3, None, None, None, None, None, []), (2, 3, "name", None, 4, 7, "Mr.\nX", None, None, None, ("x", "a", "plural", "t"), []),
    ]
    df = spark.createDataFrame(c, CONSTITUENT)
    assert rows(mentions.gather_mentions(df)) == [(1, 1), (2, 1), (2, 3)]
    assert rows(mentions.gather_clauses(df)) == [(1, 7)]
    got = {(r.doc_id, r.node): tuple(r)[2:] for r in mentions.functions(df).collect()}
    assert got[1, 1] == ("the-man", None, "the", None, True) and got[2, 3] == ("x", "Mr. X", "a", "plural", True) and got[2, 2] == (None, None, None, None, False)
    assert rows(mentions.parents(df)) == [(1, 1, 6), (1, 3, 6), (1, 4, 6)]
    none = df.limit(0)
    assert not rows(mentions.gather_mentions(none)) and not rows(mentions.functions(none)) and not rows(mentions.parents(none))


def test_anchor_extents_prefer_verb_groups_then_far_phrases(spark):
    c = [(1, 1, "n", None, 50, 55, "war", None, None, None, None, []), (1, 2, "np", 1, 46, 55, None, None, None, None, None, []), (1, 3, "np", 2, 46, 70, None, None, None, None, None, []), (1, 4, "np", 1, 5, 90, None, None, None, None, None, [])]
    c += [(1, 5, "vg-pass", None, 95, 103, None, None, None, None, None, [])]
    a = spark.createDataFrame([(1, 1, 50, 55), (1, 2, 99, 103), (1, 3, 200, 205)], "doc_id long, anchor int, start int, end int")
    assert rows(mentions.anchor_extents(a, spark.createDataFrame(c, CONSTITUENT))) == [(1, 1, 46, 70, False), (1, 2, 95, 103, True), (1, 3, 200, 205, False)]


def test_malformed_relation_lines_are_left_out(spark):
    lines = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 2, "; x"), (1, 3, " | ".join(["x"] * relations.FIELDS))], "doc_id long, n int, value string")
    assert not rows(relations.tuple_edges(lines)) and not rows(relations.nominal_verbs(lines)) and not rows(relations.relation_patterns(lines)) and not rows(relations.dependency_paths(lines))
    lemmas = spark.createDataFrame([("went", "go"), ("went", "wend")], "word string, lemma string")
    assert rows(relations.anchored_paths(spark.createDataFrame([(1, None), (2, "a -- b"), (3, "a -- s:went:o -- b|x")], "n int, value string"), lemmas)) == [(3, "a", "s:go:o", "b")]


def test_event_scores_of_nothing_are_zero(spark):
    e = spark.createDataFrame([], "doc_id long, start int, end int, subtype string")
    a = spark.createDataFrame([], "doc_id long, start int, end int, role string, value string")
    assert rows(scoring.score_events(e, e, a, a)) == [(0,) * 7]
