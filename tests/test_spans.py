"""Operators on spans: literal cases and invariants."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import coref, patterns, segment, sequence, spans, timex, trees
from spanloom.sources import apf, files, markup
from spanloom.streaming import sessions


# ---------------------------------------------------------------- markup
@pytest.mark.parametrize(
    "source, text, found",
    [
        ("We <w>read</w> maps.", "We read maps.", [("w", 3, 7, {})]),
        ('We <w a="b">read</w> maps.', "We read maps.", [("w", 3, 7, {"a": "b"})]),
        ("We <mark/>read maps.", "We read maps.", [("mark", 3, 3, {})]),
        ("We <>read < >maps.", "We <>read < >maps.", []),
        ("<a>x<b>y</a>z</b>", "xyz", [("a", 0, 2, {}), ("b", 1, 3, {})]),
    ],
)
def test_markup_reader(source, text, found):
    got, anns, _ = markup.read_markup(source)
    assert got == text and [a[1:] for a in anns] == found


def test_markup_round_trip():
    text = "Mr. Smith died."
    anns = [("name", 0, 9, {"TYPE": "PERSON"}), ("token", 4, 9, {}), ("mark", 15, 15, {})]
    back, found, problems = markup.read_markup(markup.write_markup(text, anns))
    assert back == text and not problems and sorted(a[1:] for a in found) == sorted(anns)


# ---------------------------------------------------------------- tokens and sentences
@pytest.mark.parametrize(
    "text, words",
    [("don't", ["do", "n't"]), ("1,000 men", ["1,000", "men"]), ("... wait", ["...", "wait"]), ("a--b", ["a", "--", "b"]), ("He left.", ["He", "left", "."]), ("mail a@b.com now", ["mail", "a@b.com", "now"]), ("x &amp; y", ["x", "&amp;", "y"]), ("", [])],
)
def test_tokens(text, words):
    assert [t[2] for t in segment.tokens_of(text)] == words


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from(list("aB.,-'!? \n&;@1")), max_size=60))
def test_tokens_tile_the_text(text):
    toks = list(segment.tokens_of(text))
    assert "".join(t[2] for t in toks) == "".join(text.split())
    assert all(a[1] <= b[0] for a, b in zip(toks, toks[1:]))
    s = segment.sentences_of(text)
    assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))


def test_sentences():
    text = 'Mr. Smith went. He saw the U.S. Army! "Good." Then? yes'
    assert [text[a:b].strip() for a, b in segment.sentences_of(text)] == ["Mr. Smith went.", "He saw the U.S. Army!", '"Good."', "Then? yes"]


# ---------------------------------------------------------------- time
REF = datetime(2000, 4, 5)


@pytest.mark.parametrize(
    "text, ref, val",
    [
        ("today", REF, "2000-04-05"), ("yesterday", REF, "2000-04-04"), ("next month", REF, "2000-05"), ("a year ago", REF, "1999-04-05"), ("3 years ago", REF, "1997"), ("8 months later", REF, "2000-12"), ("May 15, 2001", REF, "2001-05-15"), ("9/24/1982", REF, "1982-09-24"),
        ("this week", datetime(2005, 1, 1), "2004-W53"), ("March", datetime(2005, 11, 4), "2006-03"), ("December 31", datetime(2000, 2, 6), "1999-12-31"), ("Wednesday", datetime(2006, 7, 25), "2006-07-19"), ("last Tuesday", datetime(2006, 7, 25), "2006-07-18"), ("Last October", datetime(2006, 10, 1), "2005-10"),
        ("20000404", datetime(2000, 5, 10), "2000-04-04"), ("0915 GMT", datetime(2004, 1, 6), "2004-01-06T09:15Z"), ("two weeks ago", datetime(1990, 5, 28), "1990-05-14"), ("twenty days ago", datetime(1980, 3, 21), "1980-03-01"), ("the fifteenth of January", datetime(1999, 10, 10), "2000-01-15"), ("several years ago", datetime(2000, 5, 5), "PAST_REF"),
    ],
)
def test_time_values(text, ref, val):
    assert [t[2]["VAL"] for t in timex.timexes_of(text, ref)] == [val]


@pytest.mark.parametrize("words, value, ordinal", [("Eleven", 11, False), ("fifty second", 52, True), ("fifth", 5, True), ("thousandth", 1000, True), ("two hundred three", 203, False)])
def test_numbers(words, value, ordinal):
    assert [x[2:] for x in timex.numbers_of(list(segment.tokens_of(words)))] == [(value, ordinal)]


RULE_FILE = """
config: {sortByPatternLength: true}
rules:
  - {type: simple, pattern: harvest, params: {set_month: '9', format: yyyy-MM}}
  - {type: simple, patterns: [(number) moons ago, (number) moons back], params: {diff: P(1)M, dir: minus, format: yyyy-MM}}
  - {type: simple, pattern: (year) by (number), params: {value: (1)-(3)-01, format: yyyy-MM-dd}}
"""


def test_rule_files():
    pytest.importorskip("yaml")
    rules = timex.read_rules(RULE_FILE)
    got = [t[2]["VAL"] for t in timex.timexes_of("harvest , two moons back , 2001 by 7", REF, rules=rules)]
    assert got == ["2000-09", "2000-02", "2001-07-01"]
    with pytest.raises(ValueError, match="script"):
        timex.read_rules("rules: [{type: script, pattern: x}]")
    scripted = timex.read_rules("rules: [{type: script, pattern: x}]", {"x": lambda t, v: {"VAL": "1"}})
    assert timex.timexes_of("x y", REF, rules=scripted) == [(0, 1, {"VAL": "1"})]


# ---------------------------------------------------------------- trees
@pytest.mark.parametrize(
    "ptb, heads, chunks",
    [
        ("( (S (NP (DT The) (NN tower) (NN clock)) (VP (VBD struck) (NP (DT a) (JJ late) (NN hour))) (. .)) )", [2, 2, 3, -1, 6, 6, 3, 3], "B-NP I-NP I-NP B-VP B-NP I-NP I-NP O"),
        ("(S (NP (PRP She)) (VP (VBD said) (SBAR (IN that) (S (NP (NNS rains)) (VP (VBD fell))))) (. .))", [1, -1, 1, 4, 2, 1], None),
        ("(S (NP (PRP It)) (VP (VBD was) (VP (VBN seen))) (. .))", [1, -1, 1, 1], None),
        ("(S (NP (NP (NNS maps)) (PP (IN of) (NP (NNP Rome)))) (VP (VBZ fade)))", [3, 0, 1, -1], None),
    ],
)
def test_heads_and_chunks(ptb, heads, chunks):
    tree = trees.read_trees(ptb)[0]
    assert trees.terminal_heads(tree) == heads
    assert chunks is None or trees.tree_chunks(tree) == chunks.split()


def test_head_rules_from_text_and_without_a_list():
    rules = trees.read_head_rules("# comment\nXP left-to-right B A")
    assert trees.head_of("XP", ["A", "B", "B"], rules) == 1
    assert trees.head_of("XP", [".", "C"], rules, [".", "c"]) == 1 and trees.head_of("XP", [".", ","], rules, [".", ","]) == 0
    assert trees.head_of("QQ", ["A", "B"], rules) == 0 and trees.head_of("NP", ["NN", "POS", "PP"]) == 1 and trees.head_of("NP", ["DT", "NP", "NP"]) == 1


def test_chart_parser_finds_both_readings():
    g = trees.read_grammar("S -> NP VP\nNP -> n | NP PP\nVP -> v NP | VP PP\nPP -> p NP")
    cats = {"I": ["n"], "saw": ["v"], "men": ["n"], "with": ["p"], "dogs": ["n"]}
    assert len(trees.chart_parse(g, "I saw men with dogs".split(), cats, "S")) == 2
    assert not trees.recognize(g, "saw I".split(), cats, "S")


# ---------------------------------------------------------------- sequences
def test_viterbi_and_nbest_equal_enumeration():
    import itertools
    import math

    hmm = sequence.Hmm([("A", "x", -0.5), ("A", "y", -1.5), ("B", "x", -2.0), ("B", "y", -0.3)], [("start", "A", -0.7), ("start", "B", -0.7), ("A", "A", -0.4), ("A", "B", -1.1), ("B", "B", -0.6), ("B", "A", -0.9), ("A", "end", -1.0), ("B", "end", -0.5)])
    words = ["x", "y", "x", "y"]

    def logp(path):
        seq = ["start", *path, "end"]
        return sum(hmm.arcs.get(p, -math.inf) for p in zip(seq, seq[1:])) + sum(hmm.emissions[s][w] for s, w in zip(path, words))

    ranked = sorted(((logp(p), list(p)) for p in itertools.product("AB", repeat=4)), reverse=True)
    best, p = hmm.viterbi(words)
    assert best == ranked[0][1] and abs(p - ranked[0][0]) < 1e-9
    assert [round(x[1], 9) for x in hmm.nbest(words, 5)] == [round(x[0], 9) for x in ranked[:5]]


# ---------------------------------------------------------------- patterns
def test_longest_pattern_wins():
    rules = patterns.Rules('pattern set s; when "a" add [short]; when "a" "b"+ : V add [long over=no];')
    text = "a b b c a"
    toks = [(t[0], t[1]) for t in segment.tokens_of(text)]
    new, _ = patterns.Matcher(rules).run("s", text, toks, [])
    assert [(a["type"], a["start"]) for a in new] == [("long", 0), ("short", 8)]


# ---------------------------------------------------------------- reference resolution
@pytest.mark.parametrize("a, b, d", [("John Smith", "Smith", 1), ("UN", "United Nations", 1), ("U.N.", "United Nations", 1), ("Smith", "Jones", -1), ("A B", "A B", 0)])
def test_names(a, b, d):
    assert coref.match_names(a.split(), b.split()) == d


# ---------------------------------------------------------------- tables
def test_within_disjoint_equals_within(spark):
    outer = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 9), (2, 0, 2, 4)], "doc_id int, seq int, start int, `end` int")
    inner = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 4, 7), (1, 2, 7, 8), (2, 0, 0, 1), (2, 1, 2, 3), (3, 0, 0, 1)], "doc_id int, seq int, start int, `end` int")
    key = lambda df: sorted((r.doc_id, r.seq, r.outer_seq) for r in df.collect())
    assert key(spans.within_disjoint(inner, outer)) == key(spans.within(inner, outer)) == [(1, 0, 0), (1, 2, 1), (2, 1, 0)]


def test_bio_round_trip(spark):
    tokens = spark.createDataFrame([(1, k, k + 1) for k in range(6)], "doc_id int, start int, `end` int")
    names = spark.createDataFrame([(1, "P", 1, 3), (1, "P", 3, 4), (1, "Q", 5, 6)], "doc_id int, type string, start int, `end` int")
    back = spans.bio_to_spans(spans.spans_to_bio(tokens, names))
    assert sorted((r.type, r.start, r.end) for r in back.collect()) == [("P", 1, 3), ("P", 3, 4), ("Q", 5, 6)]


def test_collections(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "doc_id int, text string")
    files.write_collection(docs, str(tmp_path))
    (tmp_path / "list").write_text("sgml|texts/doc=1\ntexts/doc=2\n")
    got = {r.path.rsplit("=", 1)[1][0]: (r.format, r.text.strip()) for r in spark.read.text(f"{tmp_path}/list").selectExpr("value AS path", "'' AS format", "value AS text").collect()}
    assert set(got) == {"1", "2"}
    assert sorted((r.format, r.path) for r in files.read_manifest(spark, f"{tmp_path}/list").collect()) == [("sgml", f"{tmp_path}/texts/doc=1"), ("sgml", f"{tmp_path}/texts/doc=2")]
    stream = spark.createDataFrame([('<DOC id="a" type="advis">x</DOC>\n<DOC><DOCID> b </DOCID>y</DOC>',)], "text string")
    assert [r.document_id for r in files.wanted_blocks(files.split_stream(stream)).collect()] == ["b"]


def test_line_formats(spark):
    lines = lambda *xs: spark.createDataFrame([(k, x, "f") for k, x in enumerate(xs)], "n int, value string, file string")
    assert [tuple(r)[1:] for r in files.pos_tokens(spark.createDataFrame([(1, "a/DT 1/2/CD")], "doc_id int, text string")).collect()] == [(0, "a", "DT"), (1, "1/2", "CD")]
    edge = lines("subj | had | 3 | he | 0", "bad line")
    assert files.edge_text(files.edge_lines(edge)).first().value == "subj | had | 3 | he | 0"
    assert [tuple(r) for r in files.name_lines(lines("X\tP", "X\tQ\tr")).collect()] == [("X", "Q", "r")]
    assert [tuple(r) for r in files.phrase_lines(lines("New York / GPE", "New York / LOC")).collect()] == [("New York", ["GPE", "LOC"])]
    assert files.indented_tree(["a", " b", "  c", " d"]) == [("b", "a"), ("c", "b"), ("d", "a")]
    assert [(r.doc, r.k) for r in files.document_breaks(lines("s1", "s2", "", "s3"), limit=1).orderBy("n").collect()] == [(0, 1), (1, 1)]


def test_apf_round_trip(spark):
    rows = [("d", "entity", "d-1", "PER", "Individual", "d-1-0", "NAME", None, None, 0, 9, "Mr. <Smith>"), ("d", "relation", "d-R1", "PHYS", "Near", None, None, "Arg-1", "d-1", None, None, None), ("d", "event", "d-EV1", "Life", "Die", "d-EV1-1", None, None, None, 10, 14, "died")]
    df = spark.createDataFrame(rows, apf.ROW)
    back = apf.parse(apf.render(df), "apf")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert apf.parse(spark.createDataFrame([("no xml",), (None,)], "text string")).count() == 0


def test_stream_sessions_and_annotation(spark, tmp_path):
    spark.createDataFrame([(1, "2020-01-01 00:00:00"), (1, "2020-01-01 00:30:00"), (1, "2020-01-01 03:00:00")], "user int, ts string").selectExpr("user", "CAST(ts AS TIMESTAMP) ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user int, ts timestamp").parquet(f"{tmp_path}/in")
    q = sessions.stream_sessions(stream, "user", "ts").writeStream.format("memory").queryName("s").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("s").collect()) == [1, 2]
    spark.createDataFrame([(1, "a b")], "doc_id int, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.readStream.schema("doc_id int, text string").parquet(f"{tmp_path}/docs")
    sessions.annotate_stream(docs, segment.words, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_long_reference_chains_reach_their_roots(spark):
    chain = [(d, k, k - 1 if k else None) for d, n in ((1, 700), (None, 300), (2, 1)) for k in range(n)]
    odd = [(3, 1, 2), (3, 2, 3), (3, 3, 1), (4, 5, 5), (5, 6, 99)]
    got = {(r.doc_id, r.mention): r.root for r in coref.chains_from_links(spark.createDataFrame(chain + odd, "doc_id long, mention long, ref long")).collect()}
    assert len(got) == len(chain) + len(odd) and all(got[d, k] == 0 for d, k, _ in chain)
    assert got[4, 5] == 5 and got[5, 6] == 99 and all(got[3, k] in (1, 2, 3) for k in (1, 2, 3))


def test_title_case_of_all_texts_equals_brute_force(spark, tmp_path):
    import re

    from spanloom.plans import registry

    words = "a|an|and|as|at|but|by|for|from|in|into|of|on|or|the|to|with|over|under|after".split("|")

    def title(line):
        capital = any(c.isupper() and (k == 0 or not (line[k - 1].isalnum() or line[k - 1] == "_")) for k, c in enumerate(line))
        small = [w for w in re.split(r"[ \t\n\x0b\f\r\u2003]", line) if w and w[0].islower() and re.match(r"\w+", w)[0] not in words]
        return capital and not small

    texts = [("de", "Über den Wolken\nÜber Wolken\nÄrger in Köln"), ("fr", "Étude of Étoiles\nÉtude école\nétude"), ("en", "A Title\nNot a title\nThe End of It"), ("ru", "Война\u00a0и Мир\nВойна и Мир"), ("fr", None), ("fr", "École\u2003École\nÉcole\u2003école")]
    spark.createDataFrame(texts, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for lang, text in texts:
        for line in (text or "").split("\n"):
            a, b = want.get(lang, (0, 0))
            want[lang] = (a + title(line), b + 1)
    got = {r.lang: (r.titles, r.lines) for r in registry.QUERIES["seg12_title_case"](spark, str(tmp_path)).collect()}
    assert got == want and want["ru"] == (1, 2) and want["de"] == (2, 3)
