"""Readers and writers of document collections and of small line formats.

Texts are read by Spark's own readers, so a path may lie in any store that Spark
knows; nothing opens a file on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# ---------------------------------------------------------------- collections
def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: ``format|file`` lines (``sgml`` where no format is given) as (format, path); relative paths hang on the manifest's folder.

    A line with more than one bar stops the read.
    """
    top = path.rsplit("/", 1)[0]
    line = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\|").alias("p"), F.trim("value").alias("value"))
    checked = F.when(F.size("p") > 2, F.raise_error(F.concat(F.lit("invalid line in manifest: "), "value"))).otherwise(F.element_at("p", -1))
    file = F.when(checked.rlike(r"^(/|[a-z0-9]+:/)"), checked).otherwise(F.concat(F.lit(f"{top}/"), checked))
    return line.select(F.when(F.size("p") > 1, F.element_at("p", 1)).otherwise("sgml").alias("format"), file.alias("path"))


def read_collection(spark: SparkSession, manifest: str) -> DataFrame:
    """SRC5/SRC7: whole texts of a manifest's files: (path, format, text).  The manifest, one line a file, passes the driver."""
    listed = [(r.format, r.path) for r in read_manifest(spark, manifest).collect()]
    if not listed:
        return spark.createDataFrame([], "path string, format string, text string")
    texts = spark.read.text([p for _, p in listed], wholetext=True).select(F.input_file_name().alias("at"), F.col("value").alias("text"))
    known = spark.createDataFrame([(p, f) for f, p in listed], "path string, format string")
    name = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/*", "/")
    return known.join(texts, name(F.col("path")) == name(F.col("at"))).select("path", "format", "text")


def split_stream(texts: DataFrame, text: str = "text") -> DataFrame:
    """SRC8/SNK15: ``<DOC ...> ... </DOC>`` blocks of a text: (document_id, kind, block); the id is the attribute or the DOCID element."""
    blocks = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<DOC\b[^>]*>.*?</DOC>"), F.lit(0))
    rows = texts.select(F.explode(blocks).alias("block"))
    attr = lambda n: F.nullif(F.regexp_extract("block", rf'^<DOC\b[^>]*\b{n}="([^"]*)"', 1), F.lit(""))
    inner = F.nullif(F.trim(F.regexp_extract("block", r"(?s)<DOCID>(.*?)</DOCID>", 1)), F.lit(""))
    return rows.select(F.coalesce(attr("id"), inner).alias("document_id"), attr("type").alias("kind"), "block")


def wanted_blocks(blocks: DataFrame) -> DataFrame:
    """SNK15: without advisories and other kinds."""
    return blocks.where(~F.coalesce(F.col("kind").isin("advis", "other"), F.lit(False)))


def write_collection(docs: DataFrame, folder: str, format_: str = "sgml") -> None:
    """SNK2/SNK3: texts as one file a document (``doc=<id>/``), and a manifest beside them."""
    docs.select(F.col("doc_id").cast("string").alias("doc"), "text").write.mode("overwrite").partitionBy("doc").text(f"{folder}/texts")
    docs.select(F.concat(F.lit(f"{format_}|texts/doc="), F.col("doc_id").cast("string")).alias("value")).write.mode("overwrite").text(f"{folder}/manifest")


# ---------------------------------------------------------------- line formats
def pos_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """SRC6: ``word/POS`` tokens, split at the last slash: doc_id, seq, token, pos."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select("doc_id", F.posexplode(words).alias("seq", "w"))
    return rows.select("doc_id", "seq", F.regexp_extract("w", r"^(.*)/[^/]*$", 1).alias("token"), F.regexp_extract("w", r"/([^/]*)$", 1).alias("pos"))


def edge_lines(lines: DataFrame) -> DataFrame:
    """SRC13: ``label | word | position | word | position`` lines as edges."""
    p = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    at = lambda k: F.element_at(p, k)
    return lines.where(F.size(F.split("value", r"\|")) == 5).select(at(1).alias("label"), at(2).alias("src_word"), at(3).cast("int").alias("src"), at(4).alias("dst_word"), at(5).cast("int").alias("dst"))


def edge_text(edges: DataFrame) -> DataFrame:
    """SNK10: edges as such lines."""
    return edges.select(F.concat_ws(" | ", "label", "src_word", F.col("src").cast("string"), "dst_word", F.col("dst").cast("string")).alias("value"))


def name_lines(lines: DataFrame, order: str = "n") -> DataFrame:
    """SRC17: ``name TAB type [TAB subtype]`` lines; the later line of a name wins."""
    p = F.split("value", "\t")
    rows = lines.where(F.size(p).between(2, 3)).select(F.element_at(p, 1).alias("name"), F.element_at(p, 2).alias("type"), F.try_element_at(p, F.lit(3)).alias("subtype"), order)
    return rows.groupBy("name").agg(F.max_by(F.struct("type", "subtype"), order).alias("x")).select("name", "x.*")


def phrase_lines(lines: DataFrame) -> DataFrame:
    """SRC18: ``phrase / class`` lines: each phrase with its set of classes."""
    p = r"^(.*\S)\s*/\s*(\S+)\s*$"
    rows = lines.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).alias("phrase"), F.regexp_extract("value", p, 2).alias("class"))
    return rows.groupBy("phrase").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def class_table(lines: DataFrame) -> DataFrame:
    """SRC20: ``word TAB class [TAB class ...]`` lines, one row a class."""
    p = F.split("value", "\t")
    return lines.where(F.size(p) > 1).select(F.element_at(p, 1).alias("word"), F.explode(F.slice(p, 2, F.size(p))).alias("class"))


def indented_tree(lines: list[str]) -> list[tuple[str, str]]:
    """SRC21/SRC22: (child, parent) of a class file whose indentation shows the tree."""
    stack: list[tuple[int, str]] = []
    out = []
    for line in lines:
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            out.append((line.strip(), stack[-1][1]))
        stack.append((depth, line.strip()))
    return out


def cluster_prefixes(words: DataFrame, bits: str = "bits", lengths: tuple[int, ...] = (4, 6, 10, 20)) -> DataFrame:
    """SRC34: features of word clusters: prefixes of their bit strings."""
    return words.withColumn("prefixes", F.array(*[F.substring(bits, 1, n) for n in lengths]))


def document_breaks(lines: DataFrame, order: str = "n", limit: int = 100) -> DataFrame:
    """SRC32/LIM1: lines of one file as sentences of documents parted by blank lines, at most ``limit`` each (the format's own limit)."""
    from pyspark.sql.window import Window as W

    blank = F.trim("value") == ""
    doc = F.sum(F.when(blank, 1).otherwise(0)).over(W.partitionBy("file").orderBy(order))
    rows = lines.withColumn("doc", doc).where(~blank)
    return rows.withColumn("k", F.row_number().over(W.partitionBy("file", "doc").orderBy(order))).where(F.col("k") <= limit)


def bio_lines(tokens: DataFrame) -> DataFrame:
    """SNK8: ``token TAB tag`` lines in reading order, one string a document."""
    row = F.struct("start", F.concat_ws("\t", "token", "tag").alias("line"))
    return tokens.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n").alias("text"))


def escaped(c: Column) -> Column:
    """Text for XML."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
