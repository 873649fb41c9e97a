"""Toxic passages by maximum-scoring segments.

Training counts in how many toxic and other labelled texts a word or a word's beginning occurs. Their log-odds ratio, with a
Dirichlet prior proportional to the pooled counts, is a word's score; a word without a telling feature gets the small
negative log-odds of that fact. A linear-time scan finds all maximal-scoring segments of a text. Under scores of other
texts' words, a segment's score follows an extreme-value law: exp(-lambda * score) for each of n places. Segments that
are significant under it are the toxic passages; a document's evidence is the sum of their normalised scores, turned into
a probability by a logistic curve over the same labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import stored, text_slices, words_of
from quarryline.llm.shingles import minhashes, shingles

#: Labelled rows that the model is fitted on at most, by a hash of their ids. Counts and scores of documents cover all rows.
MAX_TRAIN = 40_000
#: Lengths of word beginnings that are features besides the whole word.
PREFIXES = (4, 5)
#: Weight of the prior against the labelled texts; log-odds that a feature has at least, and their standard errors from 0.
PRIOR, MIN_LOG_ODDS, MIN_Z = 0.05, 2.5, 3.5
#: Share of passages in clean text that may look as toxic as a significant one, for each text.
SIGNIFICANCE = 0.05

#: Minhashes by which near copies among the labelled texts are told.
SKETCH = 32

TOKEN = re.compile(r"\w+")


def features(token: str) -> list[str]:
    """The features of a lower-case token, the most telling first."""
    return [f"={token}", *(f"{k}{token[:k]}" for k in sorted(PREFIXES, reverse=True) if len(token) >= k)]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    rest: float
    scale: float
    intercept: float
    slope: float

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * evidence)))

    def word_score(self, word: str) -> float:
        """The highest score of a feature in a run of characters without white space, or the rest's."""
        found = [self.weights[f] for token in TOKEN.findall(word.lower()) for f in features(token) if f in self.weights]
        return max(found, default=self.rest)


def segments(hits: list[tuple[int, float]], rest: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments, (score, first, last), of a text whose positive words are ``hits``: (place, score).

    Words between hits score ``rest``, below 0 or 0. Each word is looked at once: a segment joins the last one that began
    lower, as long as that ends lower.
    """
    # Of each candidate: the sum before it, the sum up to its end, its places, and the candidate before that began lower.
    stack: list[tuple[float, float, int, int]] = []
    total, place = 0.0, 0
    for at, score in hits:
        total += rest * (at - place)
        place = at + 1
        left, right, first = total, total + score, at
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                break
            # What lies between belongs to the joined segment.
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, right, first, at))
    return [(right - left, first, last) for left, right, first, last in stack]


def normalised(score: float, n: int, scale: float) -> float:
    """How far a segment's score is beyond the highest that is usual in n clean words."""
    return scale * score - math.log(max(n, 1))


def evidence(found: list[tuple[float, int, int]], n: int, scale: float) -> tuple[float, list[tuple[float, int, int]]]:
    """The document's evidence and its significant segments."""
    least = -math.log(SIGNIFICANCE)
    beyond = [(normalised(s, n, scale), a, b) for s, a, b in found]
    significant = [x for x in beyond if x[0] >= least]
    total = sum(x[0] for x in significant) if significant else max((max(0.0, x[0]) for x in beyond), default=0.0)
    return min(total, 100.0), significant


class Scanner:
    """Scores texts of Arrow slices; distinct words are scored once, and remembered up to ``most`` bytes or so."""

    def __init__(self, model: ToxicityModel, most: int = 16 << 20) -> None:
        self.model, self.most, self.held = model, most, 0
        self.known: dict[str, float] = {}

    def __call__(self, text: pa.Array) -> list[tuple[int, list[tuple[float, int, int]]]]:
        """(number of words, all maximal segments) of each text."""
        words, offsets = words_of(text)
        coded = words.dictionary_encode()
        if self.held > self.most:
            self.known, self.held = {}, 0
        known, score = self.known, self.model.word_score
        scores = np.empty(len(coded.dictionary))
        for i, w in enumerate(coded.dictionary.to_pylist()):
            s = known.get(w)
            if s is None:
                s = score(w)
                if len(w) <= 64:
                    known[w] = s
                    self.held += 160 + len(w)
            scores[i] = s
        codes = coded.indices.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(scores[codes] > 0) if len(codes) else np.zeros(0, np.int64)
        hits = scores[codes[at]]
        ends = np.searchsorted(at, offsets)
        out = []
        for k in range(len(text)):
            a, b = ends[k], ends[k + 1]
            own = list(zip((at[a:b] - offsets[k]).tolist(), hits[a:b].tolist(), strict=True)) if b > a else []
            out.append((int(offsets[k + 1] - offsets[k]), segments(own, self.model.rest) if own else []))
        return out


def log_odds(toxic: float, n_toxic: float, other: float, n_other: float, prior: float, all_prior: float) -> tuple[float, float]:
    """The log-odds ratio under the prior, and its standard error."""
    a, b = toxic + prior, other + prior
    return math.log(a / (n_toxic + all_prior - a)) - math.log(b / (n_other + all_prior - b)), math.sqrt(1 / a + 1 / b)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a lightly regularised logistic curve, by Newton's method; the slope isn't negative."""
    # Both classes have half an observation at each end, so a perfect split stays finite.
    x = np.concatenate([x, [0.0, 0.0, 10.0, 10.0]]) / 10
    y = np.concatenate([y, [0.0, 1.0, 0.0, 1.0]])
    w = np.concatenate([np.ones(len(x) - 4), [0.9, 0.1, 0.1, 0.9]])
    design = np.stack([np.ones_like(x), x], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 1e-3 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0) / 10


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """A model from ``labels`` (doc_id, toxic) and the texts of ``docs``.

    Rows whose toxic is neither 0 nor 1, or whose id is null or unknown, are left out; a null text has no words. Of equal texts, and of
    near copies, one of each class counts, so a family's own words aren't evidence: a family has the same least shingle, and
    what agrees with its first text on 0.8 of ``SKETCH`` minhashes or more is a near copy of that. Without rows of both
    classes every text gets the share of toxic rows; empty tables are such a case. Long texts are read whole.
    """
    rows = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").filter("doc_id is not null and toxic in (0, 1)")
    chosen = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = minhashes(*shingles(batch.column("text")), SKETCH)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * SKETCH, pa.int32()), pa.array(found.ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("text").cast(pa.string()), batch.column("toxic"), pa.array(found[:, 0], pa.int64()), lists], ["text", "toxic", "family", "sketch"])

    rows = texts.select("text", "toxic").mapInArrow(sketch, "text string, toxic int, family long, sketch array<int>")
    rows = stored(rows.groupBy("family", "toxic", F.xxhash64("text").alias("copy")).agg(F.min(F.struct("text", "sketch")).alias("m")).select("family", "toxic", "copy", "m.*"), "texts")
    heads = rows.groupBy("family", "toxic").agg(F.min(F.struct("copy", "sketch")).alias("head"))
    agree = F.aggregate(F.zip_with("sketch", "head.sketch", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    sample = rows.join(heads, ["family", "toxic"]).filter((F.col("copy") == F.col("head.copy")) | (agree < 0.8 * SKETCH)).select("text", "toxic")
    sample = stored(sample, "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            tallies: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                tokens = TOKEN.findall(text.lower())
                tallies[toxic].update({f for token in set(tokens) for f in features(token)})
                tallies[toxic]["n"] += 1
                tallies[toxic]["words"] += len(tokens)
            names = sorted(tallies[0].keys() | tallies[1].keys())
            yield pa.RecordBatch.from_pydict({"feature": names, "toxic": pa.array([tallies[1][f] for f in names], pa.int64()), "other": pa.array([tallies[0][f] for f in names], pa.int64())})

    counts = sample.selectExpr("text", "toxic").mapInArrow(count, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # A feature that is 3.5 errors from 0 has a count of several at least.
    table = {r.feature: (r.toxic, r.other) for r in counts.filter("toxic >= 3 or feature in ('n', 'words')").toLocalIterator()}
    n = table.pop("n", (0, 0))
    words = table.pop("words", (0, 0))
    if not n[0] or not n[1]:
        share = min(max(n[0] / max(sum(n), 1), 0.01), 0.49)
        return ToxicityModel({}, 0.0, 1.0, math.log(share / (1 - share)), 0.0)
    weights, null = {}, []
    for feature, (toxic, other) in table.items():
        prior = PRIOR * (toxic + other)
        value, error = log_odds(toxic, n[0], other, n[1], prior, PRIOR * sum(n))
        if value >= MIN_LOG_ODDS and value / error >= MIN_Z:
            weights[feature] = value
            null.append(((other + prior) / max(words[1], 1), value))
    in_toxic = sum(table[f][0] for f in weights if f[0] == "=") / max(words[0], 1)
    in_other = sum(p for p, _ in null)
    rest = min(math.log1p(-min(in_toxic, 0.5)) - math.log1p(-min(in_other, 0.4)), -1e-3)
    if in_other >= 0.5:
        null = [(p * 0.5 / in_other, s) for p, s in null]
        in_other = 0.5
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        mean = sum(p * math.exp(min(mid * s, 500)) for p, s in null) + (1 - in_other) * math.exp(mid * rest)
        low, high = (mid, high) if mean < 1 else (low, mid)
    model = ToxicityModel(weights, rest, low if weights else 1.0, 0.0, 1.0)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model)
        for batch in text_slices(batches):
            got = [evidence(found, words, model.scale)[0] for words, found in scan(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), batch.column("toxic")], ["x", "toxic"])

    pairs = sample.selectExpr("text", "toxic").mapInArrow(judge, "x double, toxic int").toPandas()
    model.intercept, model.slope = logistic(pairs["x"].to_numpy(float), pairs["toxic"].to_numpy(float))
    return model


SCORED = "doc_id long, score double, n_words long, passages array<struct<first:int,last:int,score:double>>"


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_words, passages) of each row: the probability that its text is toxic, and its significant passages
    as word numbers, both inclusive, with their normalised scores.

    Every whole text is read, a very long one in a batch of its own. A null or empty text has no passage and the lowest
    score. Null ids and repeated rows are scored as they come; other columns are not read; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scan = Scanner(model)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in text_slices(batches):
            scores, counts, passages = [], [], []
            for n, found in scan(batch.column("text")):
                x, significant = evidence(found, n, model.scale)
                scores.append(model.probability(x))
                counts.append(n)
                passages.append([{"first": a, "last": b, "score": s} for s, a, b in significant])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(passages, kind)], ["doc_id", "score", "n_words", "passages"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCORED)


def clean_rows(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts score below ``limit``. Each row is judged by itself: null and
    repeated ids, and repeated rows, stay or go one by one. A null text stays null, a long one is read whole; an empty table
    stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scan = Scanner(model)
        for whole in batches:
            begin = 0
            for batch in text_slices(iter([whole])):
                found = [model.probability(evidence(found, n, model.scale)[0]) for n, found in scan(batch.column(at))]
                yield whole.slice(begin, batch.num_rows).filter(pa.array(np.array(found, float) < limit))
                begin += batch.num_rows

    return docs.mapInArrow(run, docs.schema)
