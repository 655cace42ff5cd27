"""Toxicity by a learned lexicon, matched with misspellings, and the context of each match.

Learning: from a bounded sample of labelled documents, thinned to one of each group of near copies, words
and word stems are kept that occur in toxic documents, in many different surroundings, far more often
than chance allows. They form a trie. Scoring: the trie is intersected with Levenshtein automata; the
intersection is made deterministic step by step as texts need it, so a word costs one lookup per
character, and most words leave it after a few. Runs of non-blanks with digits or signs among their letters are matched
whole as well, so that a masked letter is one edit. Terms under five letters allow none, as too many clean words
are one letter away from them. Each match is then looked at in its context window:
inside quotation marks, or near a word that reports speech, it counts as quoted, else as abuse. A logistic
model over these sums gives the score. Nothing but the text goes into a score.

Empty and null texts have no match and get the score of a text without any. Without toxic labels every
score is 0. Labels that are null or without an id are left out; of several labels the highest counts.
Documents without an id are never learned from and count as held out.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.session import stored

# Bounds of the sample the model is learned from.
MOST_TOXIC, MOST_CLEAN = 8_000, 32_000
FOLDS = 5
STEM = 4
LEAST_SURROUNDINGS = 4
WINDOW = 6
MOST_STATES = 100_000
# Words that report what others say, next to which a term is more likely quoted. A fixed list.
REPORTING = frozenset(
    "said says quoted quote called wrote term word insult insults dit cite mot sagte nannte wort zitat dijo palabra cita".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W_](?:\S*[^\W_])?")
_OPENING, _CLOSING, _EITHER = "“«„‹", "”»‟›", "\"'`"
N_FEATURES = 6


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


class Matcher:
    """Levenshtein automata of all terms, intersected with their trie and made deterministic on the way.

    A state is a set of (trie node, edits so far). Below a stem's node anything may follow.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.reach: list[int] = [0]  # most edits that any term below the node allows
        for i, term in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], edits_allowed(term.text))
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits_allowed(term.text))
            self.ends[node] = i
        self.reset()

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With the nodes reached by leaving out characters of a term."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            edits = nodes[node] + 1
            for child in self.children[node].values():
                if edits <= self.reach[child] and edits < nodes.get(child, 99):
                    nodes[child] = edits
                    todo.append(child)
        return frozenset(nodes.items())

    def _state(self, nodes: frozenset) -> int:
        """The number of a state; -1 for the one without a way on."""
        if not nodes:
            return -1
        found = self.number.get(nodes)
        if found is None:
            found = self.number[nodes] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
            hits = [(edits, self.ends[node]) for node, edits in nodes if self.ends[node] is not None]
            hits = [h for h in hits if h[0] <= edits_allowed(self.terms[h[1]].text)]
            self.accepts.append(min(hits) if hits else None)
        return found

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < after.get(node, 99):
                after[node] = edits

        for node, edits in self.states[state]:
            end = self.ends[node]
            if end is not None and self.terms[end].stem and edits <= edits_allowed(self.terms[end].text):
                put(node, edits)
            put(node, edits + 1)
            for label, child in self.children[node].items():
                put(child, edits + (label != c))
        found = self._state(self._closed(after))
        self.steps[state][c] = found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or None."""
        state, steps = self.start, self.steps
        for c in word:
            after = steps[state].get(c)
            if after is None:
                after = self._step(state, c)
            if after < 0:
                return None
            state = after
        return self.accepts[state]

    def tidy(self) -> None:
        if len(self.states) > MOST_STATES:
            self.reset()


class _Marks:
    """The quotation marks of a line, found once."""

    def __init__(self, line: str):
        self.line = line
        self.opening = [i for i, c in enumerate(line) if c in _OPENING]
        self.closing = [i for i, c in enumerate(line) if c in _CLOSING]
        self.either = []
        for q in _EITHER:
            if q in line:
                marks = [m.start() for m in re.finditer(rf"(?<!\w){q}|{q}(?!\w)", line)]
                self.either.append((q, marks, line.rfind(q)))

    def around(self, start: int, end: int) -> bool:
        """Whether quotation marks stand around the place."""
        if bisect_left(self.opening, start) > bisect_left(self.closing, start) and self.closing and self.closing[-1] >= end:
            return True
        for q, marks, last in self.either:
            before = bisect_left(marks, start)
            # Right before the place a mark opens, whatever it touches.
            if start and self.line[start - 1] == q and not (before and marks[before - 1] == start - 1):
                before += 1
            if before % 2 and last >= end:
                return True
        return False


def _matched(body: str, matcher: Matcher) -> dict[str, tuple[int, int]]:
    """The matches among a text's words, and among its runs of non-blanks that have other signs between letters."""
    words = set(_WORD.findall(body))
    for token in set(body.split()):
        if not token.isalpha():
            core = _MASKED.search(token)
            if core is not None and not core[0].isalpha() and _WORD.search(core[0]):
                words.add(core[0])
    return {w: m for w in words if (m := matcher.match(w)) is not None}


def _hits(line: str, hits: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int, int, tuple[int, int]]], list[re.Match]]:
    """(start, end, number of the word there, match) of the terms of a line, and its words."""
    places = list(_WORD.finditer(line))
    found = [(p.start(), p.end(), i, hits[p[0]]) for i, p in enumerate(places) if p[0] in hits]
    starts, taken = [p.start() for p in places], {h[0] for h in found}
    for place in _MASKED.finditer(line):
        if place[0] in hits and not place[0].isalpha():
            first = bisect_left(starts, place.start())
            if taken.isdisjoint(starts[first:bisect_left(starts, place.end())]):
                found.append((place.start(), place.end(), first, hits[place[0]]))
    return found, places


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Sums over the matches of a text: abuse, quoted, misspelled abuse, strongest abuse, share of words, different terms."""
    body = (text or "").lower()
    matcher.tidy()
    hits = _matched(body, matcher)
    if not hits:
        return [0.0] * N_FEATURES
    abuse = quoted = misspelled = strongest = 0.0
    n_abuse, n_words, kinds = 0, 0, set()
    for line in body.split("\n"):
        found, places = _hits(line, hits)
        n_words += len(places)
        if not found:
            continue
        marks = _Marks(line)
        for start, end, i, hit in found:
            weight = matcher.terms[hit[1]].weight
            window = places[max(0, i - WINDOW):i + WINDOW + 1]
            if marks.around(start, end) or any(p[0] in REPORTING for p in window):
                quoted += weight
                continue
            kinds.add(hit[1])
            n_abuse += 1
            if hit[0]:
                misspelled += weight
            else:
                abuse += weight
            strongest = max(strongest, weight / (1 + hit[0]))
    return [
        math.log1p(abuse), math.log1p(quoted), math.log1p(misspelled), strongest,
        min(1.0, 10 * n_abuse / max(n_words, 1)), math.log1p(len(kinds)),
    ]


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, row: list[float]) -> float:
        if not self.terms:
            return 0.0
        z = self.bias + sum(w * (x - c) / s for w, x, c, s in zip(self.weights, row, self.centre, self.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@functools.lru_cache(maxsize=4)
def _matcher(terms: tuple[Term, ...]) -> Matcher:
    return Matcher(list(terms))


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """At most MOST_TOXIC and MOST_CLEAN labelled documents outside the held-out fold, by hash of their id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("id__"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic__")).where(~in_fold(F.col("id__")))
    order = [F.xxhash64("id__"), "id__"]
    chosen = (
        known.where("toxic__ = 1").orderBy(*order).limit(MOST_TOXIC).union(known.where("toxic__ = 0").orderBy(*order).limit(MOST_CLEAN))
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id__"), F.col(text).alias("text"))
    # The bound on the sample is the bound on what is broadcast.
    return rows.join(F.broadcast(chosen), "id__").select(F.col("id__").alias("doc_id"), F.col("toxic__").alias("toxic"), "text")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three min-hashes of the word triples of each document."""
    for batch in batches:
        rows = []
        for body in batch.column(2).to_pylist():
            words = (body or "").split()
            triples = {zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))}
            base = np.fromiter(triples, dtype=np.uint64)
            rows.append([int((base * np.uint64(m) % np.uint64(4294967291)).min()) for m in (2654435761, 2246822519, 3266489917)])
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "m0", "m1", "m2"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (word, label, hash of the words beside it)."""
    for batch in batches:
        found = set()
        for toxic, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = _WORD.findall((body or "").lower())
            for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                if len(word) >= 3:
                    found.add((word, toxic, zlib.crc32(f"{before} {after}".encode())))
        columns = list(zip(*found)) or [(), (), ()]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)]
        yield pa.record_batch(arrays, names=["word", "toxic", "beside"])


def learn_terms(sample: DataFrame) -> list[Term]:
    """Words and stems that mark toxic documents."""
    kept = sample.mapInArrow(_sketches, "doc_id bigint, m0 bigint, m1 bigint, m2 bigint")
    for m in ("m0", "m1", "m2"):
        kept = kept.groupBy(m).agg(F.min_by(F.struct("doc_id", "m0", "m1", "m2"), "doc_id").alias("r")).select("r.*")
    thinned = sample.join(F.broadcast(kept.select("doc_id").distinct()), "doc_id").select("doc_id", "toxic", "text")
    seen = thinned.mapInArrow(_surroundings, "word string, toxic int, beside bigint").distinct()
    words = stored(seen.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "toxic-words")
    pos_all, neg_all = words.agg(F.sum("pos"), F.sum("neg")).first()
    if not pos_all:
        return []
    share = pos_all / (pos_all + (neg_all or 0))
    lengths = F.sequence(F.lit(STEM), F.char_length("word"))
    stems = F.when(F.char_length("word") >= STEM, F.transform(lengths, lambda n: F.struct(F.substring("word", F.lit(1), n).alias("term"), F.lit(True).alias("stem"))))
    own = F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem")))
    terms = words.select(F.explode(F.concat(own, F.coalesce(stems, F.slice(own, 1, 0)))).alias("t"), "pos", "neg")
    terms = terms.groupBy("t.term", "t.stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 2")
    n = F.col("pos") + F.col("neg")
    # Log-likelihood of the toxic share of the term's surroundings against the share of all.
    gain = F.col("pos") * F.log(F.col("pos") / (n * share)) + F.when(
        F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * max(1 - share, 1e-9)))
    ).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.1) / (pos_all + 1.0)) - F.log((F.col("neg") + 0.1) / ((neg_all or 0) + 1.0))
    rated = stored(terms.withColumn("gain", gain).withColumn("odds", odds), "toxic-terms")
    bar = math.log(max(rated.count(), 2)) + 1.0
    best = (
        rated.where((F.col("gain") > bar) & (F.col("odds") > 3) & (F.col("pos") >= LEAST_SURROUNDINGS))
        .orderBy(F.desc("gain"), F.desc(F.char_length("term")), "term", "stem")
        .collect()
    )
    return _chosen([(r.term, r.stem, r.pos, r.odds) for r in best])


def _chosen(rated: list[tuple[str, bool, int, float]]) -> list[Term]:
    """Of a stem and its longer forms only what adds support: whole words before stems, long stems before short ones."""
    support = {(term, stem): pos for term, stem, pos, _ in rated}
    taken: list[Term] = []
    stems: set[str] = set()
    longest: dict[str, int] = {}
    for term, stem, pos, _ in rated:
        if stem:
            longest[term[:-1]] = max(pos, longest.get(term[:-1], 0))
    for term, stem, pos, odds in sorted(rated, key=lambda r: (len(r[0]), r[1], r[0])):
        if any(term[:k] in stems for k in range(STEM, len(term) + 1)):
            continue
        if stem:
            if support.get((term, False), 0) >= 0.8 * pos:
                continue
            if longest.get(term, 0) >= 0.8 * pos:
                continue
            stems.add(term)
        taken.append(Term(term, stem, float(odds)))
    return taken


def fitted(sample: DataFrame, terms: list[Term]) -> Model:
    """A logistic model on the features of the sample; they are a few numbers per document of a bounded sample."""
    if not terms:
        return Model((), (), (), (), 0.0)
    rows = sample.select("toxic", F.arrow_udf(_feature_arrays(tuple(terms)), "array<double>")("text").alias("x")).collect()
    x = np.array([r.x for r in rows], dtype=float)
    y = np.array([r.toxic for r in rows], dtype=float)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    design = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    beta, ridge = np.zeros(design.shape[1]), np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(tuple(terms), tuple(centre), tuple(scale), tuple(beta[:-1]), float(beta[-1]))


def _feature_arrays(terms: tuple[Term, ...]):
    def run(texts: pa.Array) -> pa.Array:
        matcher = _matcher(terms)
        return pa.array([features(t, matcher) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    sample = stored(training_sample(docs, labels, text), "toxic-sample")
    return fitted(sample, learn_terms(sample))


def scores(model: Model, text: str | Column = "text") -> Column:
    """The score of each text."""

    def run(texts: pa.Array) -> pa.Array:
        matcher = _matcher(model.terms)
        return pa.array([model.score(features(t, matcher)) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(F.col(text) if isinstance(text, str) else text)


def passing(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    return docs.where(scores(model, text) < threshold)
