"""Work and memory of operators don't follow the size of a batch, a group or a table."""

import pyarrow as pa

from pyspark.sql import functions as F

from spanloom import arrow, tasks
from spanloom.operators import coref, lookup, mentions, patterns, scoring, segment, sequence


def test_batches_are_cut_by_bytes():
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["x" * 50, None, "y" * 500, "z"])], names=["doc_id", "t"])
    parts = list(arrow.slices([b], 100))
    assert [p.num_rows for p in parts] == [2, 1, 1]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [1, 2, 3, 4]
    got = list(arrow.record_batches(((i,) for i in range(7)), [pa.int64()], ["i"], 3))
    assert [g.num_rows for g in got] == [3, 3, 1] and list(arrow.record_batches((), [pa.int64()], ["i"])) == []


ENTRIES = [("of the", "P"), ("of the thin", "Q"), ("and", "C"), ("the", "D"), ("the", "E")]


def phrases_by_hand(text):
    toks = list(segment.tokens_of(text))
    table = {}
    for p, c in ENTRIES:
        table.setdefault(p, []).append(c)
    return [(toks[a][0], toks[b - 1][1], c) for a, b, cs in lookup.longest_matches([t[2] for t in toks], lookup.phrase_trie(table)) for c in cs]


def test_phrases_without_a_group_a_document(spark):
    texts = {1: "of the thin man and the dog", 2: None, 3: "", 4: "of the of the thin", 5: "the " * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    entries = spark.createDataFrame(ENTRIES, "phrase string, class string")
    want = sorted((d, *h) for d, t in texts.items() for h in phrases_by_hand(t or ""))
    for out in (lookup.annotate_texts(docs, entries), lookup.annotate_phrases(segment.tokenize(docs).orderBy("token"), entries)):
        assert sorted(map(tuple, out.collect())) == want
        plan = out._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan  # a group a document has a fixed cost


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_softmax_deals_no_rows_by_feature(spark):
    from pyspark.sql import functions as F

    events = spark.range(100).select(F.col("id").alias("event_id"), F.array(F.lit("a"), F.lit("b")).alias("features"))
    weights = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "feature string, outcome string, weight double")
    out = sequence.softmax_scores(events, weights)
    assert "hashpartitioning(feature" not in plan_of(out) and "BroadcastHashJoin" in plan_of(out)
    assert {(r.outcome, round(r.p, 6)) for r in out.collect()} == {("x", 0.268941), ("y", 0.731059)}


def test_tasks_follow_the_rows(spark):
    assert tasks.tasks_for(spark, 100) == 1 and tasks.tasks_for(spark, 3_000_000_000) == 6000
    assert tasks.spread(spark.range(10), 5_000_000, "id").rdd.getNumPartitions() == 10


def test_set_scores_by_tasks(spark):
    df = lambda xs: spark.createDataFrame(xs, "a int, b string")
    r, k = df([(1, "x"), (1, "x"), (2, "y"), (None, None)]), df([(1, "x"), (3, "z"), (None, None)])
    row = scoring.set_scores(r, k).collect()[0]
    assert (row.correct, row.response, row.key, row.spurious, row.missing) == (2, 3, 3, 1, 1)
    assert "REPARTITION_BY_NUM" in plan_of(scoring.set_scores(r, k))


def test_coreference_and_patterns_have_no_group_a_document(spark):
    cols = "doc_id long, seq int, category string, text string, head string, sentence int, pos int, number string, human string, gender string"
    one = lambda d: [(d, 1, "pronoun", "she", "she", 1, 10, "singular", "t", "f"), (d, 0, "name", "Ann Smith", "Smith", 0, 0, "singular", "t", "f"), (d, 2, "name", "Bob", "Bob", 2, 20, None, None, None)]
    out = coref.resolve_documents(spark.createDataFrame([r for d in range(30) for r in one(d)], cols).repartition(5))
    assert sorted(map(tuple, out.collect())) == [(d, s, e) for d in range(30) for s, e in ((0, 0), (1, 0), (2, 1))]
    docs = spark.createDataFrame([(d, "the cat sat") for d in range(30)], "doc_id long, text string")
    found = patterns.apply_patterns(segment.tokenize(docs).repartition(5), 'pattern set s; when ("the" | "a") ("cat" | "dog") : Head add [ngroup head=Head];', "s")
    assert sorted((r.doc_id, r.type, r.start, r.end, r.attrs["head"]) for r in found.collect()) == [(d, "ngroup", 0, 8, "cat") for d in range(30)]
    assert "FlatMapGroups" not in plan_of(out) + plan_of(found)


def test_mentions_follow_chains_once(spark, monkeypatch):
    seen = []
    real = mentions.head_roots
    monkeypatch.setattr(mentions, "head_roots", lambda links: seen.append(1) or real(links))
    c = spark.createDataFrame([(1, 1, "np", 2), (1, 2, "ngroup", None)], "doc_id long, node long, cat string, head long")
    none = {n: F.lit(None).cast("string") for n in ("det", "tposs", "nhuman")}
    c = c.withColumns({"start": F.lit(0), "end": F.lit(0), "text": F.lit("dog"), **none, "pa": F.lit(None).cast("struct<head:string,det:string,number:string,human:string>"), "children": F.array().cast("array<long>")})
    assert [(r.doc_id, r.node) for r in mentions.gather_mentions(c).collect()] == [(1, 1)]
    assert len(seen) == 2  # to the end, and to the first with a predicate


def test_chains_send_nothing_by_broadcast(spark):
    links = spark.range(1000).select(F.lit(1).alias("doc_id"), F.col("id").alias("mention"), F.when(F.col("id") > 0, F.col("id") - 1).alias("ref"))
    joins = []
    real = coref._written
    coref._written = lambda df: joins.append(plan_of(df)) or real(df)
    try:
        assert {r.root for r in coref.chains_from_links(links).collect()} == {0}
    finally:
        coref._written = real
    assert len(joins) > 5 and not any("Broadcast" in p for p in joins)


def test_tokens_keep_no_long_blocks():
    segment._plain_block.cache_clear()
    long = "a,b" * 100
    text = f"short {long} words {long} end"
    got = list(segment.tokens_of(text))
    assert "".join(text[a:b] for a, b, *_ in got) == text and [t[2] for t in got].count("a") == 2
    assert segment._plain_block.cache_info().currsize == 2  # short, words
    assert segment._plain_block.cache_info().maxsize * segment.CACHED_SIGNS < 1 << 20


def test_spans_go_out_in_slices(spark, monkeypatch):
    from spanloom.operators import segment as s

    docs = spark.createDataFrame([(d, "one two. Three four.\nFive six. " * 20) for d in range(200)], "doc_id long, text string").coalesce(1)
    whole = [sorted(map(tuple, f.collect())) for f in (s.pieces(docs, "\n", "line"), s.sentences(docs), s.tokenize(docs))]
    sizes = []
    for f in (lambda: s.pieces(docs, "\n", "line"), lambda: s.sentences(docs), lambda: s.tokenize(docs)):
        monkeypatch.setattr(s, "slices", lambda batches: arrow.slices(batches, 1000))
        sizes.append(sorted(map(tuple, f().collect())))
    assert sizes == whole  # a slice's limits don't show in the rows


def test_anchor_extents_by_tasks(spark):
    cols = "doc_id long, node int, cat string, head int, start int, `end` int, text string, nhuman string"
    c = spark.createDataFrame([(1, 1, "n", None, 50, 55, None, None), (1, 3, "np", 1, 40, 60, None, None)], cols)
    out = mentions.anchor_extents(c.where("node = 1").withColumn("anchor", F.lit(1)), c)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 40, 60, False)]
    plan = plan_of(out)
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("REPARTITION_BY_NUM") >= 8


def bounded(batches):
    for b in batches:
        assert b.nbytes < 5 << 20
        yield from arrow.slices([b])


def wide(spark):
    return spark.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x" * 999 + " "), 90).alias("text"))  # 9 MB, far below a batch's rows


def test_pieces_get_batches_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(segment, "slices", bounded)
    out = segment.pieces(wide(spark), " ", "word")
    assert out.columns == ["doc_id", "seq", "type", "start", "end"]
    assert out.where("type = 'word'").agg(F.count("*"), F.max("end"), F.max("seq")).collect() == [(9100, 90000, 90)]


def test_a_session_keeps_its_own_bound_of_batches(spark):
    key, held = arrow.BATCH_BYTES[0], spark.conf.get(arrow.BATCH_BYTES[0], None)
    try:
        spark.conf.set(key, "1m")
        segment.pieces(wide(spark), " ", "word")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, held or arrow.BATCH_BYTES[1])


def first_rows(batches):
    for b in batches:
        assert b.nbytes < 5 << 20
        yield b.slice(0, 1)


def test_sentences_and_tokens_get_batches_of_few_bytes(spark, monkeypatch):
    monkeypatch.setattr(segment, "slices", first_rows)
    for f in (segment.sentences, segment.tokenize):
        assert f(wide(spark)).select("doc_id").distinct().count() > 1  # several batches, one row of each


def test_bigrams_are_counted_once(spark, tmp_path):
    from spanloom.plans import sequences

    texts = [(1, "a b a c"), (2, " a b\n"), (3, None), (4, ""), (5, "a")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sequences.bigrams(spark, str(tmp_path))
    assert {(r.prev, r.token, r.n, round(r.logp, 3)) for r in out.collect()} == {("a", "b", 2, -0.405), ("a", "c", 1, -1.099), ("b", "a", 1, 0.0)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == plan.count("FileScan parquet") == 1
