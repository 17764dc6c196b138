"""Sequence labelling: hidden Markov models, maximum entropy, constraints.

Training is counting (``groupBy``) and runs as SQL.  Decoding depends on order,
so a model, which is small, travels in a closure and sentences are decoded in
Arrow batches.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..arrow import map_batches, slices
from .segment import word_array

START, END = "start", "end"
NEVER = -math.inf


# ---------------------------------------------------------------- SEQ5, SEQ6, HMM2: training
def emission_counts(tagged: DataFrame) -> DataFrame:
    """SEQ6: (state, token, n, logp) of rows (…, tag, token)."""
    n = tagged.groupBy(F.col("tag").alias("state"), "token").agg(F.count("*").alias("n"))
    total = n.groupBy("state").agg(F.sum("n").alias("total"))
    return n.join(total, "state").select("state", "token", "n", F.log(F.col("n") / F.col("total")).alias("logp"))


def transition_counts(tagged: DataFrame, sentence: list[str], order: str = "seq") -> DataFrame:
    """SEQ6/HMM2: (source, target, n, logp) with start and end states."""
    w = W.partitionBy(*sentence).orderBy(order)
    row = tagged.select(*sentence, order, "tag", F.coalesce(F.lag("tag").over(w), F.lit(START)).alias("source"), F.lead("tag").over(w).alias("nxt"))
    arcs = row.select("source", F.col("tag").alias("target")).unionAll(row.where("nxt IS NULL").select(F.col("tag").alias("source"), F.lit(END).alias("target")))
    n = arcs.groupBy("source", "target").agg(F.count("*").alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("total"))
    return n.join(total, "source").select("source", "target", "n", F.log(F.col("n") / F.col("total")).alias("logp"))


def bigram_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """SEQ5: (prev, token, n) of neighbouring white-space words; words are split once a text."""
    words = documents.select(word_array(F.col(text)).alias("w")).where(F.size("w") > 1)
    at = words.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i"))
    return at.select(F.get("w", F.col("i")).alias("prev"), F.get("w", F.col("i") + 1).alias("token")).groupBy("prev", "token").agg(F.count("*").alias("n"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """HMM4: counts of a trained model and of a name list added up."""
    out = tables[0].select("state", "token", "n")
    for t in tables[1:]:
        out = out.unionAll(t.select("state", "token", "n"))
    return out.groupBy("state", "token").agg(F.sum("n").alias("n"))


def name_list_counts(names: DataFrame) -> DataFrame:
    """HMM4: (state, token, n) of a list (name, type): i- for one word, b-, m-, e- for the first, inner, last."""
    words = names.select("type", F.split(F.trim("name"), r"\s+").alias("w")).select("type", F.size("w").alias("k"), F.posexplode("w").alias("p", "token"))
    place = F.when(F.col("k") == 1, "i-").when(F.col("p") == 0, "b-").when(F.col("p") == F.col("k") - 1, "e-").otherwise("m-")
    return words.groupBy(F.concat(place, "type").alias("state"), "token").agg(F.count("*").alias("n"))


class Hmm:
    """States with emission and transition log probabilities.

    ``allowed`` maps (position, state) to a bool (SEQ12: user constraints);
    ``bonus`` is added to emissions of the state ``other`` (HMM1).
    """

    def __init__(self, emissions: Iterable[tuple[str, str, float]], arcs: Iterable[tuple[str, str, float]], unknown: float = -10.0, emit: Callable | None = None, bonus: float = 0.0):
        self.emissions, self.arcs, self.into = defaultdict(dict), {}, defaultdict(list)
        for state, token, p in emissions:
            self.emissions[state][token] = p
        for a, b, p in arcs:
            self.arcs[a, b] = p
            self.into[b].append((a, p))
        self.states = sorted({s for a in self.arcs for s in a} - {START, END})
        self.unknown, self.bonus, self._emit = unknown, bonus, emit

    @classmethod
    def from_tables(cls, emissions: DataFrame, arcs: DataFrame, **kw) -> Hmm:
        """Model from count tables; its size is that of the vocabulary, fixed by training."""
        return cls([(r.state, r.token, r.logp) for r in emissions.collect()], [(r.source, r.target, r.logp) for r in arcs.collect()], **kw)

    def emission(self, state: str, token: str, prior: str | None) -> float:
        p = self._emit(state, token, prior) if self._emit else self.emissions[state].get(token, self.unknown)
        return p + (self.bonus if state == "other" else 0.0)

    def _columns(self, words: list[str], allowed=None, banned: set[tuple[int, str]] = frozenset()):
        cols, prior = [{START: (0.0, None)}], None
        for t, w in enumerate(words):
            now = {}
            for s in self.states:
                if (t, s) in banned or (allowed and not allowed(t, s)):
                    continue
                best = max(((cols[-1][a][0] + p, a) for a, p in self.into[s] if a in cols[-1]), default=None, key=lambda x: (x[0], x[1]))
                if best and (e := self.emission(s, w, prior)) > NEVER:
                    now[s] = (best[0] + e, best[1])
            cols.append(now)
            prior = w
        last = max(((cols[-1][a][0] + p, a) for a, p in self.into[END] if a in cols[-1]), default=None, key=lambda x: (x[0], x[1]))
        return cols, last

    def viterbi(self, words: list[str], allowed=None, banned=frozenset()) -> tuple[list[str], float]:
        """SEQ1: most probable path and its log probability; an impossible sentence gives ([], -inf)."""
        cols, last = self._columns(words, allowed, banned)
        if not words or last is None:
            return [], NEVER
        path, s = [], last[1]
        for col in reversed(cols[1:]):
            path.append(s)
            s = col[s][1]
        return path[::-1], last[0]

    def nbest(self, words: list[str], n: int, allowed=None) -> list[tuple[list[str], float]]:
        """SEQ2/TOP5: the n best paths, best first (A* backwards over the Viterbi columns)."""
        cols, last = self._columns(words, allowed)
        if not words or last is None:
            return []
        heap, out, tie = [], [], 0
        for a, p in self.into[END]:
            if a in cols[-1]:
                heap.append((-(cols[-1][a][0] + p), tie, len(words), a, p, (a,)))
                tie += 1
        heapq.heapify(heap)
        while heap and len(out) < n:
            cost, _, t, s, tail, path = heapq.heappop(heap)
            if t == 0:
                out.append((list(path[1:]), -cost))
                continue
            e = self.emission(s, words[t - 1], words[t - 2] if t > 1 else None)
            for a, p in self.into[s]:
                if a in cols[t - 1]:
                    tie += 1
                    heapq.heappush(heap, (-(cols[t - 1][a][0] + p + e + tail), tie, t - 1, a, p + e + tail, (a, *path)))
        return out

    def margin(self, words: list[str]) -> float:
        """SEQ3: best minus second best path."""
        two = self.nbest(words, 2)
        return two[0][1] - two[1][1] if len(two) == 2 else math.inf

    def local_margin(self, words: list[str], at: int) -> float:
        """SEQ3: best path minus the best one with another state at a position."""
        path, p = self.viterbi(words)
        return p - self.viterbi(words, banned={(at, path[at])})[1] if path else math.inf


def decode(sentences: DataFrame, model: Hmm, n: int = 1) -> DataFrame:
    """SEQ1/SEQ2/SEQ9: rows (sent_id, rank, logp, margin, tags, hypo) of (sent_id, words array)."""
    kind = dict(sentences.dtypes)["sent_id"]

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for d, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                paths = model.nbest(w or [], max(n, 2))
                m = paths[0][1] - paths[1][1] if len(paths) > 1 else None
                rows += [(d, r, p, m, t, f"{d}-{r}" if n > 1 else None) for r, (t, p) in enumerate(paths[:n])]
            types = [b.schema.field(0).type, pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["sent_id", "rank", "logp", "margin", "tags", "hypo"])

    return map_batches(sentences.select("sent_id", "words"), run, f"sent_id {kind}, rank int, logp double, margin double, tags array<string>, hypo string")


def decode_with_cache(documents: DataFrame, model: Hmm) -> DataFrame:
    """SEQ4: sentences of a document in order; a word's earlier tag in the document is preferred (+1) later on.

    Rows (doc_id, sent, words): the cache makes a document one ordered fold.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def run(g):
        import pandas as pd

        cache: dict[str, str] = {}
        base, out = model.emission, []
        for r in g.sort_values("sent").itertuples():
            words = list(r.words)
            cached = Hmm([], [(a, b, p) for (a, b), p in model.arcs.items()], emit=lambda s, w, p: base(s, w, p) + (1.0 if cache.get(w) == s else 0.0))
            tags, logp = cached.viterbi(words)
            cache.update(zip(words, tags))
            out.append((r.doc_id, r.sent, tags, logp))
        return pd.DataFrame(out, columns=["doc_id", "sent", "tags", "logp"])

    return documents.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, sent int, tags array<string>, logp double")


def smallest_margins(decoded: DataFrame, k: int) -> DataFrame:
    """SEQ22/TOP2: the k sentences a model is least sure of."""
    return decoded.where("rank = 0 AND margin IS NOT NULL").orderBy("margin", "sent_id").limit(k)


def name_constraints(spans: list[tuple[int, int, bool]], n: int) -> Callable[[int, str], bool]:
    """SEQ12: lattice mask from user spans (first, behind, exact): words inside must be B-/I-; exact ones begin and end there."""
    inside = [False] * n
    begin, never_begin, stop = set(), set(), set()
    for a, b, exact in spans:
        for i in range(a, b):
            inside[i] = True
        if exact:
            begin.add(a)
            never_begin.update(range(a + 1, b))
            stop.add(b)

    def allowed(t: int, s: str) -> bool:
        if inside[t] and s in ("O", "other"):
            return False
        if t in begin and not s.startswith("B-") or t in never_begin and not s.startswith("I-"):
            return False
        return not (t in stop and s.startswith("I-"))

    return allowed


# ---------------------------------------------------------------- SEQ11, SEQ14: features
def context_features(tokens: DataFrame, sentence: list[str], order: str = "seq") -> DataFrame:
    """SEQ11: previous, current, next and next-but-one words and the shape of each token."""
    from ..functions.strings import word_shape

    w = W.partitionBy(*sentence).orderBy(order)
    near = {"p": F.lag("token").over(w), "c": F.col("token"), "n": F.lead("token").over(w), "n2": F.lead("token", 2).over(w)}
    named = [F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit("-"))) for k, v in near.items()]
    return tokens.withColumn("features", F.array(*named, F.concat(F.lit("shape="), word_shape(F.col("token")))))


# ---------------------------------------------------------------- SEQ17: maximum entropy
class MaxEnt:
    """Linear log model: weight of (feature, outcome)."""

    def __init__(self, weights: dict[tuple[str, str], float], outcomes: list[str]):
        self.weights, self.outcomes = weights, outcomes

    def probabilities(self, features: Iterable[str]) -> dict[str, float]:
        z = {o: sum(self.weights.get((f, o), 0.0) for f in features) for o in self.outcomes}
        top = max(z.values())
        e = {o: math.exp(v - top) for o, v in z.items()}
        total = sum(e.values())
        return {o: v / total for o, v in e.items()}

    def best(self, features: Iterable[str]) -> str:
        p = self.probabilities(features)
        return min(self.outcomes, key=lambda o: (-p[o], o))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(f, o, w) for (f, o), w in self.weights.items()], "feature string, outcome string, weight double")


def train_maxent(events: Iterable[tuple[list[str], str]], iterations: int = 100, cutoff: int = 1, rate: float = 0.5, l2: float = 1e-3) -> MaxEnt:
    """SEQ17/CHK2: gradient ascent on (features, outcome) events, features below ``cutoff`` dropped."""
    import numpy as np

    events = [(list(f), o) for f, o in events]
    count: dict[str, int] = defaultdict(int)
    for f, _ in events:
        for x in set(f):
            count[x] += 1
    names = sorted(x for x, n in count.items() if n >= cutoff)
    at, outcomes = {x: i for i, x in enumerate(names)}, sorted({o for _, o in events})
    x = np.zeros((len(events), len(names)))
    for i, (f, _) in enumerate(events):
        for name in f:
            if name in at:
                x[i, at[name]] = 1
    y = np.array([outcomes.index(o) for _, o in events])
    w, g2 = np.zeros((len(names), len(outcomes))), np.full((len(names), len(outcomes)), 1e-8)
    for _ in range(iterations):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ p / len(y) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return MaxEnt({(f, o): float(w[i, j]) for f, i in at.items() for j, o in enumerate(outcomes)}, outcomes)


def read_gis(lines: Iterable[str]) -> MaxEnt:
    """SRC27: a model stored as text: constant, correction, outcomes, outcome patterns, predicates, parameters."""
    it = (x.rstrip("\n") for x in lines)
    if next(it) != "GIS":
        raise ValueError("not a GIS model")
    next(it), next(it)
    outcomes = [next(it) for _ in range(int(next(it)))]
    patterns = [[int(v) for v in next(it).split()] for _ in range(int(next(it)))]
    predicates = [next(it) for _ in range(int(next(it)))]
    weights, at = {}, 0
    for count, *which in patterns:
        for name in predicates[at : at + count]:
            for o in which:
                weights[name, outcomes[o]] = float(next(it))
        at += count
    return MaxEnt(weights, outcomes)


def softmax_scores(events: DataFrame, weights: DataFrame) -> DataFrame:
    """SEQ17 as joins: (event_id, outcome, p) of (event_id, features array) and (feature, outcome, weight).

    Weights are a model and broadcast: joined by a shuffle, all rows of a feature would meet in one task.
    """
    z = events.select("event_id", F.explode("features").alias("feature")).join(F.broadcast(weights), "feature").groupBy("event_id", "outcome").agg(F.sum("weight").alias("z"))
    w = W.partitionBy("event_id")
    e = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return e.select("event_id", "outcome", (F.col("e") / F.sum("e").over(w)).alias("p"))


def chunk_greedily(words: list[str], tags: list[str], model: MaxEnt) -> list[str]:
    """SEQ16: B/I/O noun groups from left to right; the label before is a feature of the next."""
    out, prev = [], "O"
    for i, w in enumerate(words):
        pos = [tags[k] if 0 <= k < len(tags) else "-" for k in (i - 1, i, i + 1)]
        label = model.best([f"prev={prev}", f"word={w}", f"pos={pos[1]}", f"pos01={pos[0]}:{pos[1]}", f"pos12={pos[1]}:{pos[2]}", f"pos012={':'.join(pos)}"])
        label = "B" if label == "I" and prev == "O" else label
        out.append(label)
        prev = label
    return out


# ---------------------------------------------------------------- SEQ18, MAT*: transform rules
def rule_applies(slot: dict, token: dict) -> bool:
    """MAT1-MAT5: all conditions of a slot; a ``not_`` prefix negates, but a missing part of speech never fits."""
    for key, want in slot.items():
        negated, name = key.startswith("not_"), key.removeprefix("not_")
        value = token.get(name)
        if name == "pos" and value is None:
            return False
        if name == "regex":
            import re

            hit = re.fullmatch(want, token["string"]) is not None
        else:
            have = set(value) if isinstance(value, (list, set, tuple)) else {value}
            hit = bool(have & set(want))
        if hit == negated:
            return False
    return True


def transform(tokens: list[dict], rules: list[tuple[list[dict], int, int, str, bool]]) -> list[dict]:
    """SEQ18/MAT6: rules (slots, first, behind, category, forced) in order, left to right; a change sets B-/I- tags.

    Without force a change needs all its tokens to be without a category.
    """
    out = [dict(t) for t in tokens]
    for slots, a, b, category, forced in rules:
        for i in range(len(out) - len(slots) + 1):
            if all(rule_applies(s, t) for s, t in zip(slots, out[i:])):
                span = out[i + a : i + b]
                if forced or all(not t.get("category") for t in span):
                    for k, t in enumerate(span):
                        t["category"] = [("B-" if k == 0 else "I-") + category]
    return out
