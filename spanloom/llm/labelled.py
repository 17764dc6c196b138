"""Bounded labelled samples and hold-outs for the classifiers."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bounds of a training sample: rows, and bytes of text
MAX_ROWS, MAX_BYTES = 5000, 24 << 20


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of at most ``max_rows`` labelled rows outside the hold-out, and the share of label 1 in all of them.

    Rows are taken in hash order of their ids; the rarer label fills up to half of the sample.

    Repeated labels of one id count once (the largest); null labels, null ids
    and labels without a document are left out.  Only rows whose remainder is
    not ``held_out`` are ever read here.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(remainder("doc_id", mod) != held_out)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few_y = min(shares.values(), default=0)
    ids, order = [], (F.xxhash64("doc_id"), F.col("doc_id"))
    for y, n in sorted(shares.items()):
        want = max_rows // 2 if len(shares) > 1 and min(n, few_y) >= max_rows // 2 else n if n == few_y and len(shares) > 1 else max_rows - (few_y if len(shares) > 1 else 0)
        ids += known.where(F.col("y") == y).orderBy(*order).limit(min(n, want, max_rows)).collect()
    ids.sort(key=lambda r: zlib.crc32(str(r.doc_id).encode()[::-1]))
    if not ids:
        return [], 0.0
    share = shares.get(1, 0) / sum(shares.values())
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in ids], "doc_id long, y int"))  # max_rows at most
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).join(few, "doc_id").groupBy("doc_id").agg(F.max("size").alias("size")).collect()
    size, taken, total = {r.doc_id: r.size for r in sizes}, [], 0
    for r in ids:
        if r.doc_id in size and total + size[r.doc_id] <= max_bytes:
            taken.append((r.doc_id, r.y))
            total += size[r.doc_id]
    if not taken:
        return [], share
    few = F.broadcast(spark.createDataFrame(taken, "doc_id long, y int"))
    rows = docs.join(few, "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: r.doc_id)], share
