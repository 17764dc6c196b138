"""Whole documents: copies, first ones of a collection, features of their tokens, labelled sentences, head chains, converters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import map_batches, slices
from .coref import chains_from_links
from .segment import word_array


def copy_documents(documents: DataFrame, annotations: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """ANN21: documents and their annotations under the ids that ``new_id`` (over ``doc_id``) gives; offsets and order stay."""
    return documents.withColumn("doc_id", new_id), annotations.withColumn("doc_id", new_id)


def first_documents(documents: DataFrame, n: int, *order: str) -> DataFrame:
    """LIM2: the first n documents of a collection in the order given: a top-n, not a sample."""
    return documents.orderBy(*order).limit(n)


def token_basics(documents: DataFrame, text: str = "text") -> DataFrame:
    """FEA6: (doc_id, seq, lower, first) of each white-space token."""
    return documents.select("doc_id", F.posexplode(word_array(F.col(text))).alias("seq", "token")).select("doc_id", F.col("seq").cast("long").alias("seq"), F.lower("token").alias("lower"), (F.col("seq") == 0).alias("first"))


def class_features(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """FEA7/FEA8: ``tokens`` (doc_id, seq, token) with all categories of the lexicon (token, category) as a sorted array, empty on a miss.

    Categories are gathered per word first, so the join adds no rows.
    """
    per = classes.groupBy("token").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    return tokens.join(per, "token", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def labelled_sentences(tokens: DataFrame, keys: list[str], order: str) -> DataFrame:
    """FEA9: one row a sentence: its tokens and O/B/I labels in order.

    ``tokens`` have a token and a category, null outside names; a name is a run of
    one category, so its first token is where the category changes.
    """
    rows = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "token", "category"))).alias("x"))
    at = F.sequence(F.lit(1), F.size("x"))

    def label(i: Column) -> Column:
        own, before = F.element_at("x", i)["category"], F.when(i > 1, F.get("x", i - 2)["category"])
        return F.when(own.isNull(), "O").when(own.eqNullSafe(before), F.concat(F.lit("I-"), own)).otherwise(F.concat(F.lit("B-"), own))

    return rows.select(*keys, F.transform("x", lambda t: t["token"]).alias("tokens"), F.transform(at, label).alias("labels"))


def head_roots(links: DataFrame) -> DataFrame:
    """PRS10: (doc_id, node, root) by following head links (doc_id, node, head) to their end; see ``coref.chains_from_links``."""
    out = chains_from_links(links.select("doc_id", F.col("node").alias("mention"), F.col("head").alias("ref")))
    return out.select("doc_id", F.col("mention").alias("node"), "root")


def inline_sentences(documents: DataFrame, spans: DataFrame, types: list[str], text: str = "text") -> DataFrame:
    """SNK7: each sentence with inline tags of the chosen types.

    ``spans`` have (doc_id, type, start, end); rows of type ``sentence`` are the
    sentences.  A tag is written where it lies in one sentence; tags that cross are left out.
    """
    from ..sources.markup import write_markup

    kind = dict(documents.dtypes)["doc_id"]
    rows = spans.where(F.col("type").isin("sentence", *types)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "type"))).alias("spans"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            out = []
            for d, t, found in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for k, s in enumerate(x for x in found or () if x["type"] == "sentence"):
                    inner = [(x["type"], x["start"] - s["start"], x["end"] - s["start"], {}) for x in found if x["type"] != "sentence" and s["start"] <= x["start"] and x["end"] <= s["end"]]
                    out.append((d, k, write_markup((t or "")[s["start"] : s["end"]], inner)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.schema.field(0).type), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["doc_id", "seq", "line"])

    return map_batches(documents.select("doc_id", text).join(rows, "doc_id"), run, f"doc_id {kind}, seq long, line string")
