"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct 5-word shingles.  The sketch has a fixed number
of coordinates: in round i every element is thrown into one bin (chosen by a hash
of element and round) with a value that grows with the round, and each
coordinate keeps its smallest value.  The first rounds choose bins at random, the
next, one for each coordinate, aim at one bin each, so every coordinate fills,
and agreement concentrates around the Jaccard similarity like sampling does
(Dahlgaard, Knudsen, Thorup: Fast similarity sketching, FOCS 2017).

Bands of ``ROWS`` coordinates each are hashed to buckets; there are as many
(``bands_for``) as let a pair at the threshold miss all buckets with probability
below ``MISS``.  Equal sets are one class first.  Then, round by round, each bucket
names leaders, and every other member is compared with them on full sets.  The
member that meets most others leads first.  Members that are connected already are
not compared again.  Members that can only be linked through rare shingles (an
exact bound) meet their partners through these and leave.  Leaders double each
round, so rounds follow the logarithm of a bucket's size.  A bucket rests once its
members are known to be connected or have led; no partner is ever dropped for being
one of many, so a bucket of any size is searched exactly.

Shingles are told apart by ``common.word_keys``: words by their bytes, and 64 bits
of a hash whose secret key every run draws anew, so no text can be made to collide.

Components: labels are passed along links and through labels of labels until
nothing changes; every step is a join, nothing is collected.

Cases: null or wordless texts have the empty set and no links; fewer than 5
words are one shingle; a null id is in no class and keeps its row; ids are
expected to be unique (rows of a repeated id follow their own sets each); an empty
table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import math
import secrets

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE_MASK, drop, materialize, mix, settle, slices, text_buffers, word_keys

SHINGLE, PERCENT = 5, 85
ROWS, MISS = 6, 1e-6
LEADERS, PAIRS_PER_MEMBER, RARE = 3, 32, 64
SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
_G = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int) -> int:
    """Bands of ROWS coordinates with which a pair at the threshold is missed with probability below MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-min(0.999999, (percent / 100) ** ROWS)))


def shingle_hashes(raw: np.ndarray, offs: np.ndarray, key: bytes = b"-") -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row offsets into them), each row's sorted."""
    h, rows = word_keys(raw, offs, ~SPACE_MASK, LOWER, key)
    n = len(h)
    g = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        g = g * _G + h[j : j + len(g)]
    g = mix(g + np.uint64(SHINGLE))
    out, at = [], [0]
    for r in range(len(offs) - 1):
        a, b = rows[r], rows[r + 1]
        if b - a >= SHINGLE:
            s = np.unique(g[a : b - SHINGLE + 1])
        elif b > a:  # the whole sequence as one
            w = np.zeros(1, np.uint64)
            for x in range(a, b):
                w = w * _G + h[x : x + 1]
            s = mix(w + np.uint64(b - a))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        at.append(at[-1] + len(s))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(at, np.int64)


def sketches(e: np.ndarray, at: np.ndarray, coords: int) -> np.ndarray:
    """(rows x coords) fast similarity sketches of ragged sets."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    out = np.full(n * coords, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 52) - 1)
    for i in range(2 * coords):
        if not len(row):
            break
        h = mix(e ^ np.uint64((i + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        place = (h >> np.uint64(52)).astype(np.int64) * coords >> 12 if i < coords else i - coords
        np.minimum.at(out, row * coords + place, (np.uint64(i) << np.uint64(52)) | (h & low))
        if i < 8 or i % 8 == 0:
            open_rows = (out.reshape(n, coords) == np.iinfo(np.uint64).max).any(1)
            still = open_rows[row]
            e, row = e[still], row[still]
    return out.reshape(n, coords)


def band_hashes(sk: np.ndarray) -> np.ndarray:
    bands = sk.shape[1] // ROWS
    x = np.zeros((len(sk), bands), np.uint64)
    parts = sk.reshape(len(sk), bands, ROWS)
    for j in range(ROWS):
        x = x * _G + mix(parts[:, :, j])
    return mix(x + np.arange(bands, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sketch_table(docs: DataFrame, key: bytes, percent: int = PERCENT) -> DataFrame:
    """SKETCH rows of (doc_id, text): set size, a 128-bit digest of the set, and its bands."""
    bands = bands_for(percent)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, offs = text_buffers(b.column(1))
            for i, j in slices(offs):
                e, at = shingle_hashes(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], key)
                c1 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(e, dtype=np.uint64)))
                c2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(e ^ _G), dtype=np.uint64)))
                found = band_hashes(sketches(e, at, bands * ROWS)).astype(np.int64)
                size = np.diff(at)
                bo = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0))))
                lists = pa.ListArray.from_arrays(pa.array(bo, pa.int32()), pa.array(found[size > 0].ravel()))
                cols = [b.column(0).slice(i, j - i), pa.array(size), pa.array((c1[at[1:]] - c1[at[:-1]]).astype(np.int64)), pa.array((c2[at[1:]] - c2[at[:-1]]).astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def set_table(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, shingles): full sets as sorted 64-bit hashes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, offs = text_buffers(b.column(1))
            for i, j in slices(offs):
                e, at = shingle_hashes(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], key)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(e.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) with 100 * intersection >= percent * union on full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    fits = F.least(F.size("sa"), F.size("sb")) * 100 >= percent * F.greatest(F.size("sa"), F.size("sb"))
    return pairs.join(left, "a").join(right, "b").where(fits).where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(links: DataFrame, labels: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(node, label): smallest node reachable over ``links`` (a, b; at most ``most``); ``labels`` are known ones to start from."""
    if labels is not None:  # links between labels instead of nodes
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        links = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    links = links.where("a <> b")
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select(F.col("b"), F.col("a"))).distinct(), "links", most and 2 * most)
    size = both.count()  # of nodes at most, too
    if not size and labels is not None:
        return labels
    now = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "labels", size)
    while True:
        spent = now
        heard = both.join(now.select(F.col("node").alias("to"), F.col("label").alias("l")), "to").select("node", "l", F.lit(None).cast("long").alias("own"))
        nxt = heard.union(now.select("node", "label", "label")).groupBy("node").agg(F.min("l").alias("near"), F.max("own").alias("old"))
        up = now.select(F.col("node").alias("near"), F.col("label").alias("far"))
        nxt = materialize(nxt.join(up, "near", "left").select("node", F.least("near", "far").alias("label"), "old"), "labels", size)
        now = nxt.select("node", "label")
        now._written_to = nxt._written_to
        drop(spent)
        if nxt.where("label <> old").isEmpty():
            break
    drop(both)
    if labels is None:
        return now
    moved = now.select(F.col("node").alias("label"), F.col("label").alias("l2"))
    kept = labels.join(moved, "label", "left").select("node", F.coalesce("l2", "label").alias("label"))
    out = materialize(kept.union(now.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels", labels.count() + size)
    drop(now, labels)
    return out


def rare_step(rest: DataFrame, size: int, sets: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(labels, rest of ``size`` rows, tables to drop when rest is read) with all links found that need a rare shingle, and without the members that need one.

    A shingle is rare if at most RARE of the members have it.  A member with q
    rare ones among n meets a partner of size m that shares none of them in n - q
    shingles at most; where that is too few for every partner of a bucket, all its
    links there go through rare shingles, whose postings are short, and it leaves
    the bucket.  Pairs whose shared rare shingles and other shingles together are
    too few for a link are not verified (both bounds are exact).
    """
    members = rest.groupBy("rep").agg(F.first("label").alias("label"), F.first("n").alias("n"))
    own = sets.join(members, sets["doc_id"] == members["rep"]).select("rep", "label", "n", F.explode("shingles").alias("s"))
    few = own.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    rare = materialize(own.join(few, "s"), "rare", members.agg(F.sum("n")).first()[0])
    q = materialize(rare.groupBy("rep").agg(F.count("*").alias("q")), "rare-counts", size)
    left = rare.where("df > 1").select("s", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
    right = rare.where("df > 1").select("s", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = left.join(right, "s").where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    pairs = pairs.join(q.select(F.col("rep").alias("a"), F.col("q").alias("qa")), "a").join(q.select(F.col("rep").alias("b"), F.col("q").alias("qb")), "b")
    most = F.col("c") + F.least(F.col("na") - F.col("qa"), F.col("nb") - F.col("qb"))
    pairs = pairs.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")
    labels = components(verified(pairs, sets, percent), labels)
    smallest = rest.groupBy("bucket").agg(F.min("n").alias("y"))
    stay = rest.select("bucket", "rep", "n").join(q, "rep", "left").join(smallest, "bucket")
    stay = stay.where((100 + percent) * (F.col("n") - F.coalesce("q", F.lit(0))) >= percent * (F.col("n") + F.col("y"))).select("bucket", "rep", "n")
    return labels, several(labelled(stay, labels)), [rare, q]


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, rep, n, label): a member without a link is its own label."""
    return rows.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    settle(docs.sparkSession)
    secret = secrets.token_bytes(16)
    docs = docs.select("doc_id", "text")
    sketched = materialize(sketch_table(docs, secret, percent), "sketches")
    key = ["n_shingles", "s1", "s2"]
    classes = materialize(sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes", sketched.count() * bands_for(percent))
    buckets = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("bucket", "size")
    buckets = materialize(buckets.join(sizes, "bucket"), "buckets", classes.count() * bands_for(percent))
    size = buckets.count()
    # the members that meet most others lead first: originals stand nearer to all than copies of copies
    fame = materialize(buckets.groupBy("rep").agg(F.sum("size").alias("fame")), "members", size)
    sets = materialize(set_table(docs.join(fame.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), secret), "sets")
    famous = buckets.join(fame, "rep")
    led = famous.groupBy("bucket").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("a"))
    active, labels, shares = buckets.select("bucket", "rep", "n"), None, LEADERS
    spent = [buckets, fame]
    while size:
        pairs = active.join(led, "bucket").where("a <> rep") if labels is None else once(active, led)
        pairs = pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        # of a member, a pair with the first leader, later with those that ``leaders`` allows
        most = size if labels is None else max(PAIRS_PER_MEMBER, shares) * size
        first, labels = labels is None, components(verified(pairs, sets, percent), labels, most)
        # who has led is done; buckets go on while the rest is of several components
        rest = active.select("bucket", "rep", "n").join(led.select("bucket", F.col("a").alias("rep")), ["bucket", "rep"], "left_anti")
        rest = materialize(several(labelled(rest, labels)), "active", size)
        size = rest.count()
        drop(*spent)
        spent = [rest]
        if first and size:  # later rounds have members that need no rare shingles
            labels, rest, used = rare_step(rest, size, sets, labels, percent)
            rest = materialize(rest, "active", size)
            size = rest.count()
            drop(*used)
            spent.append(rest)
        active = rest
        if not size:
            break
        led = materialize(leaders(active, shares), "leaders", size)
        spent.append(led)
        shares *= 2
    drop(*spent, sets)
    of_class = classes.select(*key, "rep")
    if labels is not None:
        of_class = of_class.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(*key, F.coalesce("label", "rep").alias("component_id"))
    else:
        of_class = of_class.withColumnRenamed("rep", "component_id")
    # rows without a set need no partner; Spark splits the rest where copies crowd
    rows = sketched.select("doc_id", *key)
    out = rows.where("n_shingles > 0").join(of_class, key, "left").unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def once(active: DataFrame, led: DataFrame) -> DataFrame:
    """Leaders and members of other components, in the first bucket that they share only (both sides' lists have an entry for each band at most)."""
    mine = active.groupBy("rep").agg(F.collect_set("bucket").alias("mine"))
    leads = led.groupBy("a").agg(F.collect_set("bucket").alias("leads"))
    first = F.col("bucket") == F.array_min(F.array_intersect("mine", "leads"))
    return active.join(mine, "rep").join(led.join(leads, "a"), "bucket").where((F.col("a_label") != F.col("label")) & first)


def several(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components."""
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return rows.join(mixed, "bucket")


def leaders(active: DataFrame, shares: int = LEADERS) -> DataFrame:
    """(bucket, a, a_label): who leads next.

    All members outside a bucket's largest component, if that makes at most
    PAIRS_PER_MEMBER pairs a member overall, most of them met in several buckets (a link between components has an end
    there, so this round is the last); else ``shares`` of each bucket, of the rarest
    components among each share of them.
    """
    part = active.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.min("rep").alias("rep"))
    top = part.groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("size"))
    work = top.agg(F.sum((F.col("size") - F.col("top.k")) * F.col("size")).alias("pairs"), F.sum("size").alias("members")).first()
    if (work.pairs or 0) <= PAIRS_PER_MEMBER * (work.members or 0):
        return active.join(top.select("bucket", F.col("top.label").alias("largest")), "bucket").where("label <> largest").select("bucket", F.col("rep").alias("a"), F.col("label").alias("a_label"))
    best = part.groupBy("bucket", F.pmod(F.xxhash64("label"), F.lit(shares)).alias("share")).agg(F.min(F.struct("k", "rep", "label")).alias("x"))
    return best.select("bucket", F.col("x.rep").alias("a"), F.col("x.label").alias("a_label"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
