"""Reference resolution: names, nominals, pronouns, and chains.

Each mention looks at the entities built so far in its document, so resolution
is one ordered fold per document; matching rules are pure functions, and chain
conversions are joins and aggregates.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..arrow import groups, in_order, key_type, map_batches, record_batches
from ..tasks import spread

_SKIP = {"the", "a", "an", "of", "and"}


# ---------------------------------------------------------------- REF5
def is_acronym(short: str, words: list[str]) -> bool:
    """First letters of two or more words; small function words may be left out."""
    if len(words) < 2 or not re.fullmatch(r"[A-Za-z]{2,}", short):
        return False
    full = "".join(w[0] for w in words)
    bare = "".join(w[0] for w in words if w.lower() not in _SKIP)
    return short.upper() in (full.upper(), bare.upper()) and short.isupper()


def is_abbreviation(short: str, words: list[str]) -> bool:
    """Dotted letters (U.N., U.N) that are the words' first letters."""
    letters = re.sub(r"\.", "", short)
    return bool(re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]?\.?", short)) and (letters.upper() == "".join(w[0] for w in words).upper() or is_acronym(letters.upper(), words))


def _subsequence(few: list[str], many: list[str]) -> bool:
    it = iter(many)
    return all(any(w == x for x in it) for w in few)


def match_names(a: list[str], b: list[str]) -> int:
    """Dissimilarity of two names, -1 if they don't match: words of one left out of the other, 1 for short forms."""
    if not a or not b:
        return -1
    x, y = [w.lower() for w in a], [w.lower() for w in b]
    if x == y:
        return 0
    if _subsequence(x, y) or _subsequence(y, x):
        return abs(len(x) - len(y))
    for s, full in ((a, b), (b, a)):
        if len(s) == 1 and (is_acronym(s[0], full) or is_abbreviation(s[0], full)):
            return 1
    return -1


# ---------------------------------------------------------------- REF7
PRONOUNS = [
    ("he", "singular", "t", "m"), ("she", "singular", "t", "f"), ("it", "singular", "nil", "n"), ("they", "plural", None, None), ("i", "singular", "t", None),
    ("we", "plural", "t", None), ("you", None, "t", None), ("who", None, "t", None), ("which", None, "nil", None), ("that", None, "nil", None),
]
NOMINATIVE = {
    "him": "he", "his": "he", "himself": "he", "her": "she", "hers": "she", "herself": "she", "its": "it", "itself": "it", "them": "they", "their": "they", "theirs": "they", "themselves": "they",
    "me": "i", "my": "i", "mine": "i", "myself": "i", "us": "we", "our": "we", "ours": "we", "ourselves": "we", "your": "you", "yours": "you", "yourself": "you", "whom": "who", "whose": "who",
}
_FORMS = {p[0]: p[1:] for p in PRONOUNS}


def match_pronoun(pronoun: str, number: str | None, human: str | None, gender: str | None) -> bool:
    """Number, humanness and gender agree where both sides say."""
    p = NOMINATIVE.get(pronoun.lower(), pronoun.lower())
    if p not in _FORMS:
        return False
    n, h, g = _FORMS[p]
    return all(want is None or have is None or want == have for want, have in ((n, number), (h, human))) and (g in (None, "n") or gender is None or g == gender)


def nominative(c: Column) -> Column:
    out = F.lower(c)
    low = out
    for k, v in NOMINATIVE.items():
        out = F.when(low == k, F.lit(v)).otherwise(out)
    return out


def pronoun_matches(pronoun: Column, number: Column, human: Column, gender: Column) -> Column:
    """REF7 as a column expression."""
    p, out = nominative(pronoun), F.lit(False)
    for form, n, h, g in PRONOUNS:
        fits = F.lit(True)
        for want, have in ((n, number), (h, human), (g if g != "n" else None, gender)):
            if want is not None:
                fits = fits & (have.isNull() | (have == want))
        out = F.when(p == form, fits).otherwise(out)
    return out


# ---------------------------------------------------------------- REF4, REF6, REF10
def match_nominal(m: dict, e: dict, sentence: int) -> int:
    """REF6: -1 or a dissimilarity: same head, agreeing number, no indefinite determiner, no other modifiers; lone nominals reach 4 sentences."""
    if m.get("det") in ("a", "an", "another", "some") or m["head"].lower() not in e["heads"]:
        return -1
    if m.get("number") and e.get("number") and m["number"] != e["number"]:
        return -1
    extra = set(m.get("modifiers") or ()) - set(e["modifiers"])
    if extra or (len(e["mentions"]) == 1 and sentence - e["last"] > 4):
        return -1
    return len(e["modifiers"]) - len(m.get("modifiers") or ())


def resolve(mentions: list[dict]) -> list[int]:
    """REF4: entity number of each mention, in order: least (dissimilarity, distance) wins, else a new entity.

    A mention: category (name, nominal, pronoun), words, head, sentence, pos,
    and optionally number, human, gender, det, modifiers, link (index of a
    mention that syntax says is the same, REF3).
    """
    entities, out = [], []
    for k, m in enumerate(mentions):
        chosen = out[m["link"]] if m.get("link") is not None and m["link"] < k else None
        if chosen is None:
            scored = []
            for n, e in enumerate(entities):
                if m["category"] == "name":
                    d = min((x for w in e["names"] if (x := match_names(m["words"], w)) >= 0), default=-1)
                elif m["category"] == "pronoun":
                    d = 0 if match_pronoun(m["head"], e.get("number"), e.get("human"), e.get("gender")) else -1
                else:
                    d = match_nominal(m, e, m["sentence"])
                if d >= 0:
                    scored.append((d, m["pos"] - e["pos"], n))
            chosen = min(scored)[2] if scored else None
        if chosen is None:
            chosen = len(entities)
            entities.append({"mentions": [], "names": [], "heads": set(), "modifiers": set()})
        e = entities[chosen]
        e["mentions"].append(k)
        e["last"], e["pos"] = m["sentence"], m["pos"]
        if m["category"] == "name":
            e["names"].append(m["words"])
        if m["category"] != "pronoun":
            e["heads"].add(m["head"].lower())
            e["modifiers"] |= set(m.get("modifiers") or ())
        for f in ("number", "human", "gender"):
            if m.get(f) and not e.get(f):
                e[f] = m[f]
        out.append(chosen)
    return out


def resolve_documents(mentions: DataFrame) -> DataFrame:
    """REF4 over (doc_id, seq, category, text, head, sentence, pos, number, human, gender): adds ``entity``.

    One document is one fold; the documents of a task stream past in order.
    """
    kind = dict(mentions.dtypes)["doc_id"]

    cols = ["doc_id", "seq", "category", "text", "head", "sentence", "pos", "number", "human", "gender"]
    like = key_type(mentions)

    def run(batches):
        import pyarrow as pa

        def found():
            for d, rows in groups(batches):
                read = [dict(zip(cols[1:], r)) | {"words": (r[2] or "").split()} for r in rows]
                yield from ((d, r[0], e) for r, e in zip(rows, resolve(read)))

        yield from record_batches(found(), [like, pa.int32(), pa.int32()], ["doc_id", "seq", "entity"])

    return map_batches(in_order(mentions.select(*cols), "doc_id", "seq"), run, f"doc_id {kind}, seq int, entity int")


# ---------------------------------------------------------------- REF3, REF11, REF12
def syntactic_links(mentions: DataFrame) -> DataFrame:
    """REF3: pairs that apposition, predicate complement or a pre-name say are one: mentions with ref columns joined to their targets."""
    parts = []
    for rel in ("apposite", "predComp", "preName"):
        if rel in mentions.columns:
            parts.append(mentions.where(F.col(rel).isNotNull()).select("doc_id", F.col("ann_id").alias("a"), F.col(rel).alias("b"), F.lit(rel).alias("rel")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ids = mentions.select("doc_id", F.col("ann_id").alias("b"))
    return out.join(ids, ["doc_id", "b"], "left_semi")


def rewrite_references(events: DataFrame, mention_entity: DataFrame, column: str) -> DataFrame:
    """REF11: mention ids of a column as entity ids; unknown ones stay."""
    m = mention_entity.select("doc_id", F.col("mention").alias(column), F.col("entity").alias("_e"))
    return events.join(m, ["doc_id", column], "left").withColumn(column, F.coalesce("_e", column)).drop("_e")


def chains_from_index(mentions: DataFrame) -> DataFrame:
    """REF12: entity index to arrays of mentions."""
    return mentions.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_list("mention")).alias("mentions"))


def links_from_chains(chains: DataFrame) -> DataFrame:
    """REF12: each mention with the one before it in its entity (null for the first)."""
    m = chains.select("doc_id", "entity", F.posexplode("mentions").alias("i", "mention"))
    return m.withColumn("ref", F.lag("mention").over(W.partitionBy("doc_id", "entity").orderBy("i"))).select("doc_id", "mention", "ref")


def _written(df: DataFrame) -> DataFrame:
    """``df`` read back from the checkpoint folder: without it the plan doubles with every round."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/spanloom/chains-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chains_from_links(links: DataFrame) -> DataFrame:
    """REF12: (doc_id, mention, root) of (doc_id, mention, ref), following every chain to its end.

    Pointer doubling: every round halves what is left of a chain, until all roots
    are reached; a round writes only mentions that were still on their way.  Mentions
    that refer to each other in a circle have no root and get one of the circle's.
    """
    at_end = F.col("ref").isNull() | (F.col("ref") == F.col("mention"))
    rest = _written(links.select("doc_id", "mention", F.coalesce("ref", "mention").alias("root"), at_end.alias("done")))
    count = rest.count()
    ends = rest.where("done")
    for _ in range(count.bit_length() + 1):  # no chain is longer than there are mentions
        rest = rest.where("NOT done")
        if rest.isEmpty():
            break
        up = ends.unionByName(rest).select(F.col("doc_id").alias("doc"), F.col("mention").alias("to"), F.col("root").alias("next"), F.col("done").alias("last"))
        same = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("root") == F.col("to"))
        moved = spread(rest, count, "doc_id", "root").hint("merge").join(up, same, "left")  # a broadcast would pass through the driver in every round
        rest = _written(moved.select("doc_id", "mention", F.coalesce("next", "root").alias("root"), F.coalesce("last", F.lit(True)).alias("done")))
        ends = ends.unionByName(rest.where("done"))
    return ends.unionByName(rest.where("NOT done")).select("doc_id", "mention", "root")
