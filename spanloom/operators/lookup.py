"""Dictionaries, gazetteers and phrase tables.

Dimension tables are joined; Spark broadcasts them while their size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles them beyond.  Only greedy
longest match, where one decision moves the next, runs as a function over the
tokens of documents, which stream past in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import groups, in_order, key_type, map_batches, record_batches, slices
from .segment import tokens_of


def phrase_trie(entries: dict[str, list[str]], fold: bool = False) -> dict:
    """DIC1/DIC3: word trie of phrases; ``""`` holds a phrase's classes."""
    root: dict = {}
    for phrase, classes in entries.items():
        node = root
        for w in phrase.split():
            node = node.setdefault(w.lower() if fold else w, {})
        node.setdefault("", []).extend(c for c in classes if c not in node.get("", []))
    return root


def longest_matches(words: list[str], trie: dict, fold: Callable[[int], bool] | bool = False) -> list[tuple[int, int, list[str]]]:
    """Greedy, leftmost, longest, not overlapping: (first word, word behind, classes)."""
    out, i = [], 0
    while i < len(words):
        node, best = trie, None
        for j in range(i, len(words)):
            w = words[j].lower() if (fold(j) if callable(fold) else fold) else words[j]
            node = node.get(w)
            if node is None:
                break
            if "" in node:
                best = (j + 1, node[""])
        if best:
            out.append((i, *best))
            i = best[0]
        else:
            i += 1
    return out


def _dictionary(entries: DataFrame, phrase: str, classes: str, fold: bool, max_entries: int) -> dict:
    """Trie of a dictionary, whose size is checked before it is sent to the executors."""
    if entries.count() > max_entries:
        raise ValueError("dictionary too large to broadcast; use phrase_join")
    table: dict[str, list[str]] = {}
    for r in entries.select(phrase, classes).collect():
        table.setdefault(r[0], []).append(r[1])
    return phrase_trie(table, fold)


def _hits(doc, rows: list[tuple], trie: dict, fold: bool):
    """Spans of phrases in a document's tokens (start, end, token)."""
    for a, b, cs in longest_matches([r[2] for r in rows], trie, fold):
        for c in cs:
            yield doc, rows[a][0], rows[b - 1][1], c


def annotate_phrases(tokens: DataFrame, entries: DataFrame, phrase: str = "phrase", classes: str = "class", fold: bool = False, max_entries: int = 2_000_000) -> DataFrame:
    """DIC1/DIC3: spans of dictionary phrases over ``tokens`` (doc_id, seq, start, end, token).

    Tokens of a document come to one task, sorted, and stream past: a task holds
    one document at a time.  The dictionary is checked against ``max_entries``
    before it is sent to the executors; beyond it, use ``phrase_join``.  Texts that
    are still whole go through ``annotate_texts``, without a shuffle.
    """
    trie, kind, like = _dictionary(entries, phrase, classes, fold, max_entries), dict(tokens.dtypes)["doc_id"], key_type(tokens)

    def run(batches):
        import pyarrow as pa

        rows = (h for d, x in groups(batches) for h in _hits(d, x, trie, fold))
        yield from record_batches(rows, [like, pa.int32(), pa.int32(), pa.string()], ["doc_id", "start", "end", "class"])

    rows = in_order(tokens, "doc_id", "seq").select("doc_id", "start", "end", "token")
    return map_batches(rows, run, f"doc_id {kind}, start int, `end` int, class string")


def annotate_texts(docs: DataFrame, entries: DataFrame, text: str = "text", phrase: str = "phrase", classes: str = "class", fold: bool = False, max_entries: int = 2_000_000) -> DataFrame:
    """DIC1/DIC3: ``annotate_phrases`` over the linguistic tokens of whole texts, in one pass: tokens never leave their document."""
    trie, kind = _dictionary(entries, phrase, classes, fold, max_entries), dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = (r for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _hits(d, [t[:3] for t in tokens_of(x or "")], trie, fold))
            yield from record_batches(rows, [b.schema.field(0).type, pa.int32(), pa.int32(), pa.string()], ["doc_id", "start", "end", "class"])

    return map_batches(docs.select("doc_id", text), run, f"doc_id {kind}, start int, `end` int, class string")


def phrase_join(grams: DataFrame, entries: DataFrame, phrase: str = "phrase") -> DataFrame:
    """DIC1/DIC4 as an equi-join: word n-grams (doc_id, start, end, phrase) that the dictionary holds, longest per start."""
    hit = grams.join(entries, phrase)
    return hit.groupBy("doc_id", "start").agg(F.max("end").alias("end"), F.max_by(phrase, "end").alias(phrase))


def prefixes(c: Column, longest: int) -> Column:
    """All prefixes of up to ``longest`` signs (DIC4: explode, join, keep all or the longest)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(c), F.lit(longest)))), lambda n: F.substring(c, F.lit(1), n))


def common_prefixes(keys: DataFrame, table: DataFrame, key: str, entry: str, longest: int) -> DataFrame:
    """DIC4: entries of ``table`` that begin each key."""
    return keys.select(key, F.explode(prefixes(F.col(key), longest)).alias(entry)).join(table, entry)


def longest_prefix(keys: DataFrame, table: DataFrame, key: str, entry: str, longest: int) -> DataFrame:
    """DIC4: the longest of them."""
    return common_prefixes(keys, table, key, entry, longest).groupBy(key).agg(F.max_by(entry, F.length(entry)).alias(entry))


def lookup(rows: DataFrame, dim: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """DIC5/DIC7/DIC9/DIC12: value of each key, null (or a default) on a miss."""
    out = rows.join(dim.select(key, value), key, "left")
    return out.withColumn(value, F.coalesce(value, default)) if default is not None else out


def normalize_location(rows: DataFrame, nationality: DataFrame, alias: DataFrame, name: str) -> DataFrame:
    """DIC10: nationality to country, alias to canonical name, else the name itself."""
    out = rows.join(nationality.select(F.col("nationality").alias(name), F.col("country").alias("_n")), name, "left").join(alias.select(F.col("alias").alias(name), F.col("country").alias("_a")), name, "left")
    return out.withColumn("canonical", F.coalesce("_n", "_a", name)).drop("_n", "_a")


# ---------------------------------------------------------------- DIC11, DIC13
_VOWEL = "[aeiou]"


def plural(noun: Column) -> Column:
    """DIC13: -s, -es after s, x, z, ch, sh; -ies for a consonant and y."""
    return F.when(noun.rlike(r"(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es"))).when(noun.rlike(rf"[^aeiou]y$"), F.regexp_replace(noun, "y$", "ies")).otherwise(F.concat(noun, F.lit("s")))


def past(verb: Column) -> Column:
    """DIC13: -d after e, -ied for a consonant and y, else -ed."""
    return F.when(verb.rlike("e$"), F.concat(verb, F.lit("d"))).when(verb.rlike(r"[^aeiou]y$"), F.regexp_replace(verb, "y$", "ied")).otherwise(F.concat(verb, F.lit("ed")))


def present_participle(verb: Column) -> Column:
    """DIC13: final e dropped before -ing (not ee, ie)."""
    return F.when(verb.rlike(r"[^ei]e$"), F.regexp_replace(verb, "e$", "ing")).when(verb.rlike("ie$"), F.regexp_replace(verb, "ie$", "ying")).otherwise(F.concat(verb, F.lit("ing")))


def stem(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """DIC11: dictionary stem of (token, pos); I and proper nouns stay; ``stem`` is null where nothing changes."""
    f = forms.select(F.col("form").alias("_f"), F.col("stem").alias("_s")).dropDuplicates(["_f"])
    out = tokens.join(f, F.lower("token") == F.col("_f"), "left")
    fixed = (F.col("token") == "I") | F.coalesce(F.col("pos").isin("NNP", "NNPS"), F.lit(False))
    found = F.coalesce("_s", F.lower("token"))
    return out.withColumn("stem", F.when(~fixed & (found != F.col("token")), found)).drop("_f", "_s")


# ---------------------------------------------------------------- SRC16-SRC22, SRC28
GAZETTEER = "kind string, name string, relation string, value string"


def read_gazetteer(lines: DataFrame) -> DataFrame:
    """SRC16: ``country "X" nationality "Y" ...;`` lines as (kind, name, relation, value); nationals follow from national."""
    entry = F.col("value")
    kind = F.regexp_extract(entry, r"^\s*(\w+)\s+\"", 1)
    name = F.regexp_extract(entry, r'^\s*\w+\s+"([^"]*)"', 1)
    pairs = F.regexp_extract_all(entry, F.lit(r'(\w+)((?:\s*"[^"]*")+)'), F.lit(0))
    rows = lines.where(entry.rlike(r'^\s*\w+\s+"')).select(kind.alias("kind"), name.alias("name"), F.explode(pairs).alias("p"))
    rows = rows.select("kind", "name", F.regexp_extract("p", r"^(\w+)", 1).alias("relation"), F.explode(F.regexp_extract_all("p", F.lit('"([^"]*)"'), F.lit(1))).alias("value")).where("relation <> kind")
    nat = rows.where("relation = 'nationality'")
    have = rows.where("relation IN ('national', 'nationals')").select("kind", "name").distinct()
    derived = nat.join(have, ["kind", "name"], "left_anti")
    return rows.unionByName(derived.withColumn("relation", F.lit("national"))).unionByName(derived.withColumn("relation", F.lit("nationals")).withColumn("value", F.concat("value", F.lit("s"))))


def read_sections(lines: DataFrame, order: str = "n") -> DataFrame:
    """SRC28: ``=type`` headings carried down over the words below; the later entry of a word wins.

    A value dictionary is one small file: its lines go by one window.
    """
    from pyspark.sql.window import Window as W

    w = W.orderBy(order)
    rows = lines.withColumn("type", F.last(F.when(F.col("value").startswith("="), F.trim(F.substring("value", 2, 1000))), ignorenulls=True).over(w))
    words = rows.where(~F.col("value").startswith("=") & (F.trim("value") != "")).select(F.split(F.trim("value"), " ")[0].alias("word"), "type", order)
    return words.groupBy("word").agg(F.max_by("type", order).alias("type"))


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """SRC21/SRC22/ANN18: reflexive-transitive closure (descendant, ancestor) of a class tree, by recursive SQL."""
    spark = edges.sparkSession
    view = "closure_edges"
    edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH RECURSIVE up(descendant, ancestor, depth) AS (
          SELECT n, n, 0 FROM (SELECT c AS n FROM {view} UNION SELECT p FROM {view})
          UNION ALL SELECT u.descendant, e.p, u.depth + 1 FROM up u JOIN {view} e ON u.ancestor = e.c)
        SELECT DISTINCT descendant, ancestor FROM up""")
