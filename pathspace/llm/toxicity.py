"""Toxicity by maximum-scoring segments.

Log-odds of words between toxic and other labelled documents, with an informative
Dirichlet prior, make a lexicon; every other token scores ``drift``. A linear scan
over a document finds all maximal-scoring segments; extreme-value (Karlin-Altschul)
parameters fitted on the non-toxic training documents turn a segment's score and the
document's length into a p-value, every significant one is a passage, and a logistic
curve over the best evidence gives the probability of the label.

Learning reads at most ``max_labelled`` labelled rows (the lowest id hashes if there
are more), each group of near copies counted once; the lexicon has at most
``max_lexicon`` words. Everything else covers all texts, whole.

Defined results: a null or empty text has no passage and the base probability; rows
are scored each for itself; without training rows of both kinds the lexicon is empty
and the probability is the share of toxic rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import stored

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_TOKEN[0x80:] = True


PREFIXES = (4, 5, 6, 7, 8)


class Tokens:
    """Lower-cased runs of letters, digits and bytes above 0x7F: span and row of each, and hashes of its features."""

    def __init__(self, s: tv.Slice):
        data = tv.LOWER[s.data]
        self.starts, self.ends = tv.spans(_TOKEN[data], s.off)
        self.first = np.searchsorted(self.starts, s.off)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(s.n), self.count)
        self._data, self._hash = data, tv.SpanHash(data) if len(self.starts) else None

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token numbers and their hashes: the words, then their beginnings of some bytes, where these are whole characters."""
        if self._hash is None:
            return
        kind = lambda h, k: (h & ~np.uint64(7)) | np.uint64(k)  # noqa: E731  the last bits tell longer features from shorter ones
        yield np.arange(len(self.starts)), kind(self._hash(self.starts, self.ends), 7)
        for i, k in enumerate(PREFIXES):
            at = np.flatnonzero(self.ends - self.starts >= k)
            cut = self.starts[at] + k
            whole = (cut == self.ends[at]) | ((self._data[np.minimum(cut, len(self._data) - 1)] & 0xC0) != 0x80)
            at, cut = at[whole], cut[whole]
            yield at, kind(self._hash(self.starts[at], cut), i)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring disjoint segments (start, end, score) of a sequence, in linear time."""
    total = 0.0
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    return [(a, b, r - l) for a, b, l, r in held]


@dataclass
class Model:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = -0.5
    rate: float = 1.0  # Karlin-Altschul lambda
    size: float = 0.1  # Karlin-Altschul K
    intercept: float = 0.0
    slope: float = 1.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -500, 500)))


def hits_of(t: Tokens, table: tv.HashTable) -> np.ndarray:
    """For each token, of its features the first in the lexicon, or -1."""
    none = np.iinfo(np.int32).max
    at = np.full(len(t.starts), none, np.int32)
    for token, h in t.features():
        found = table.find(h)
        hit = found >= 0
        at[token[hit]] = np.minimum(at[token[hit]], found[hit])
    at[at == none] = -1
    return at


def segments_of(s: tv.Slice, model: Model, table: tv.HashTable) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Row, number of tokens and segments (byte span, score) of rows that hold a word of the lexicon."""
    t = Tokens(s)
    at = hits_of(t, table)
    hits = np.flatnonzero(at >= 0)
    if not len(hits):
        return
    row = t.row[hits]
    cuts = np.flatnonzero(np.diff(row)) + 1
    for group in np.split(hits, cuts):
        i = int(t.row[group[0]])
        # Runs of other tokens are one step down each; the scan stays linear in the hits.
        scores: list[float] = []
        where: list[int] = []
        last = None
        for h in group.tolist():
            if last is not None and h - last > 1:
                scores.append((h - last - 1) * model.drift)
                where.append(-1)
            scores.append(float(model.scores[at[h]]))
            where.append(h)
            last = h
        yield i, int(t.count[i]), [(int(t.starts[where[a]] - s.off[i]), int(t.ends[where[b - 1]] - s.off[i]), x) for a, b, x in maximal_segments(scores)]


def log_evidence(score: float, tokens: int, model: Model) -> float:
    """-ln of the p-value of a segment's score in a text of so many tokens."""
    expected = model.size * tokens * math.exp(-model.rate * score)
    return -math.log(max(-math.expm1(-expected), 1e-40))


def _labelled(labels: DataFrame, use: Column, max_labelled: int) -> DataFrame:
    """doc_id and toxic of at most ``max_labelled`` labelled documents."""
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(use).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = given.count()
    return given if n <= max_labelled else given.filter(hashed < 0.9 * max_labelled / n).limit(max_labelled)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in tv.slices(b.column(2)):
            least = [int(x[0].view(np.int64)) if len(x) else 0 for x in tv.shingle_sets(s)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), b.column(1).slice(s.first, s.n), pa.array(least, pa.int64())], ["doc_id", "toxic", "sketch"])


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each label, in how many documents of the task a feature is."""
    held = {0: tv.Counts(), 1: tv.Counts()}

    def give(label: int) -> pa.RecordBatch:
        keys, n = held[label].take()
        zero = np.zeros(len(keys), np.int64)
        y = [n, zero] if label else [zero, n]
        return pa.RecordBatch.from_arrays([pa.array(tv.signed(keys)), *map(pa.array, y)], ["word", "y1", "y0"])

    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False)
        for s in tv.slices(b.column(2)):
            t = Tokens(s)
            for token, h in t.features():
                row = t.row[token]
                _, later = tv.repeated(h, row)
                h, row = h[~later], row[~later]
                for label in held:
                    held[label].add(h[(toxic[s.first + row] > 0) == label])
            for label in held:
                if held[label].full():
                    yield give(label)
    for label in held:
        yield give(label)


def learn(docs: DataFrame, labels: DataFrame, use: Column, max_labelled: int = 200_000, max_lexicon: int = 50_000, prior: float = 50.0, least_docs: int = 4, z_least: float = 4.0, least_delta: float = 1.0, drift: float = -0.5) -> Model:
    """A model from the labelled documents for which ``use`` (over doc_id) holds."""
    given = _labelled(labels, use, max_labelled)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(given), "doc_id").select("doc_id", "toxic", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketched = stored(rows.mapInArrow(_sketches, f"doc_id {kind}, toxic int, sketch bigint"), "toxic-train")
    # Near copies share their least shingle hash more often than not: one document of each such group and label counts.
    once = sketched.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    n1, n, positive = sketched.join(F.broadcast(once), "doc_id", "left_semi").agg(F.sum("toxic"), F.count("*"), F.avg("toxic")).first()
    n1, n0, share = n1 or 0, n - (n1 or 0), positive or 0.0
    model = Model(drift=drift, intercept=math.log(share + 1e-6) - math.log(1 - share + 1e-6), slope=0.0)
    if not n1 or not n0:
        return model
    per_word = rows.join(F.broadcast(once), "doc_id", "left_semi").select("doc_id", "toxic", "text").mapInArrow(_documents_with, "word bigint, y1 bigint, y0 bigint").groupBy("word").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    # Documents holding the word, against the prior: the word's share in all documents, worth ``prior`` of them.
    alpha = prior * (F.col("y1") + F.col("y0")) / float(n1 + n0) + 0.01
    odds = lambda y, n: F.log((y + alpha) / F.greatest(F.lit(n + prior) - y - alpha, F.lit(0.5)))
    delta = odds(F.col("y1"), float(n1)) - odds(F.col("y0"), float(n0))
    spread = F.sqrt(1 / (F.col("y1") + alpha) + 1 / (F.col("y0") + alpha))
    lexicon = per_word.filter(F.col("y1") >= least_docs).withColumn("delta", delta).withColumn("z", F.col("delta") / spread).filter((F.col("z") >= z_least) & (F.col("delta") >= least_delta))
    longer = F.pmod(F.col("word"), F.lit(8))
    got = lexicon.orderBy(F.desc(F.round("z", 2)), F.desc(longer), "word").limit(max_lexicon).select("word").collect()
    if not got:
        return model
    model.words = np.array([r[0] for r in got], np.int64).view(np.uint64)
    if not _weigh(model, rows, prior, least_docs, least_delta):
        return Model(intercept=model.intercept, slope=0.0)
    _calibrate(model, rows)
    return model


def _weigh(model: Model, rows: DataFrame, prior: float, least: int, least_delta: float) -> bool:
    """Scores from how many tokens of toxic and of other documents each lexicon word gets; words that get too few go. False if none is left."""
    shared = rows.sparkSession.sparkContext.broadcast(model.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        table, held = tv.HashTable(words), np.zeros((2, len(words) + 1), np.int64)
        for b in batches:
            toxic = b.column(0).to_numpy(zero_copy_only=False) > 0
            for s in tv.slices(b.column(1)):
                t = Tokens(s)
                at = hits_of(t, table)
                label = toxic[s.first + t.row].astype(int)
                np.add.at(held, (label, at), 1)  # -1, no word of the lexicon, is the last column
        label, word = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(held[label, word])], ["toxic", "word", "n"])

    n = np.zeros((2, len(model.words) + 1))
    for label, word, x in rows.select("toxic", "text").mapInArrow(run, "toxic int, word int, n bigint").groupBy("toxic", "word").agg(F.sum("n")).collect():
        n[label, word] = x
    total = n.sum(1)
    alpha = prior * n.sum(0) / max(total.sum(), 1) + 0.01
    y = n + alpha
    scores = np.log(y[1] / (total[1] + prior)) - np.log(y[0] / (total[0] + prior))
    good = (n[1] >= least) & (scores >= least_delta)
    good[-1] = False
    if not good.any():
        return False
    model.words, model.scores = model.words[good[:-1]], scores[good]
    inside = n[:, good].sum(1)
    # The log-odds of a token that isn't in the lexicon.
    model.drift = min(float(np.log1p(-inside[1] / max(total[1], 1)) - np.log1p(-inside[0] / max(total[0], 1))), -1e-4)
    chance = (n[0, good] + 0.5) / (total[0] + good.sum())
    rest = max(1 - chance.sum(), 1e-9)
    low, high = 1e-6, 60.0
    f = lambda x: float((chance * np.exp(np.minimum(x * model.scores, 600))).sum() + rest * np.exp(x * model.drift) - 1)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    model.rate = min(max(low, 0.05), 5.0)
    return True


def bent(evidence: np.ndarray) -> np.ndarray:
    """Evidence as the logistic curve takes it: growing without end, but ever slower beyond 20, so that no text ties with a stronger one and few strong ones don't decide the slope."""
    return 20 * np.log1p(evidence / 20)


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Extreme-value size from the non-toxic documents, then the logistic curve: from each training document's label, tokens and best segment."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = tv.HashTable(m.words)
        for b in batches:
            for s in tv.slices(b.column(1)):
                tokens, best = Tokens(s).count, np.zeros(s.n)
                for i, _, segments in segments_of(s, m, table):
                    best[i] = max(x for _, _, x in segments)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), pa.array(tokens.astype(np.int64)), pa.array(best)], ["toxic", "tokens", "best"])

    table = rows.select("toxic", "text").mapInArrow(run, "toxic int, tokens bigint, best double").toArrow()
    label, length, score = (table.column(i).to_numpy().astype(float) for i in range(3))
    length = np.maximum(length, 1)
    none = label == 0
    # Maximum likelihood of K where a background text's best score has the distribution exp(-K n exp(-rate * s)).
    model.size = float(max(none.sum(), 1) / max((length[none] * np.exp(-model.rate * score[none])).sum(), 1e-9))
    evidence = np.array([log_evidence(s, int(n), model) if s > 0 else 0.0 for s, n in zip(score, length, strict=True)])
    x = np.stack([np.ones(len(evidence)), bent(evidence)], 1)
    w = np.zeros(2)
    for _ in range(50):  # Newton's method with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (label - q) - 1e-3 * w
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    model.intercept, model.slope = float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: Model, keep: list[str], level: float = 0.05, text: str = "text") -> DataFrame:
    """``keep`` columns, score and the significant passages (byte spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = tv.HashTable(m.words)
        for b in batches:
            for s in tv.slices(b.column("__text")):
                evidence, found = np.zeros(s.n), [[] for _ in range(s.n)]
                for i, n, segments in segments_of(s, m, table):
                    for a, z, x in segments:
                        e = log_evidence(x, n, m)
                        evidence[i] = max(evidence[i], e)
                        if math.exp(-e) <= level:
                            found[i].append({"start": a, "end": z, "score": x, "p_value": math.exp(-e)})
                out = [b.column(c).slice(s.first, s.n) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(m.probability(bent(evidence))), pa.array(found, passage)], [*keep, "score", "passages"])

    kept = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)
    return base.mapInArrow(run, f"{kept}, score double, passages array<struct<start: bigint, end: bigint, score: double, p_value: double>>")


def not_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the passages of every document; learns from the folds that aren't held out."""
    out = score(docs, learn(docs, labels, not_held_out()), ["doc_id"])
    return out.select("doc_id", F.coalesce(~not_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns."""
    model = learn(docs if learn_from is None else learn_from, labels, F.lit(True))
    cols = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    scored = score(renamed, model, renamed.columns, text=f"c{cols.index('text')}")
    return scored.filter(F.col("score") < 0.5).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
