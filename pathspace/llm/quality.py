"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains on a text. Only the counts of vote
patterns leave the executors (at most 3**rules of them, whatever the input
size); expectation-maximisation on those counts estimates the share of good
texts and how often each rule votes each way on good and on bad texts. A text is
kept if its posterior probability of being good reaches ``threshold``.

Defined results: a null or empty text has zero counts and fails the base rule;
empty tables give no rows; repeated rows are each scored; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .arrowmap import map_batches

# Frequent function words of the four languages.
STOP_WORDS = """a all an and are as at be by for from has have he in is it not of on or she that the they this to was with you
au aux ce dans de des du elle en est et il la le les par pour que qui sur un une
auf das dem den der des die ein eine es ich im ist mit nicht sich sie und von zu
con de del el en es la las lo los no para por que se su una y""".split()
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xF5] = True
# First bytes of code points beyond the Latin script.
_BEYOND = np.zeros(256, bool)
_BEYOND[0xCD:0xF5] = True
# First byte, and first and last second byte, of the Latin-1, Greek and Cyrillic capitals.
_CAPITALS = [(0xC3, 0x80, 0x9E), (0xCE, 0x91, 0xA9), (0xD0, 0x80, 0xAF)]
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_stop", "n_stutter", "n_beyond"]


def _hashes(words: list[str]) -> np.ndarray:
    s = next(tv.slices(pa.array(words)))
    return np.sort(np.unique(tv.Words(s, lower=True).hash))


def capitals(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each capital letter."""
    out = (data >= 65) & (data <= 90)
    for first, low, high in _CAPITALS:
        out[:-1] |= (data[:-1] == first) & (data[1:] >= low) & (data[1:] <= high)
    return out


def features(col: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """Counts of each text, by slices: first row, number of rows, a column for each of FEATURES."""
    stop = _hashes([x + mark for x in STOP_WORDS for mark in ("", ".", ",")])
    for s in tv.slices(col):
        w = tv.Words(s)
        low = tv.Words(s, lower=True).hash
        out = {"n_words": w.count}

        def per_row(flags: np.ndarray, s=s) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[s.off[1:]] - total[s.off[:-1]]

        def per_word(flags: np.ndarray, w=w) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[w.first[1:]] - total[w.first[:-1]]

        out["word_chars"] = per_row(w.inside & tv.code_points(s.data))
        for name, table in (("n_symbols", _SYMBOLS), ("n_letters", _LETTER), ("n_marks", _MARKS), ("n_beyond", _BEYOND)):
            out[name] = per_row(table[s.data])
        out["n_upper"] = per_row(capitals(s.data))
        a, b = tv.spans(s.data != 10, s.off)  # lines; empty ones have no word
        words_before = np.searchsorted(w.starts, a), np.searchsorted(w.starts, b)
        with_word = words_before[1] > words_before[0]
        a, b = a[with_word], b[with_word]
        row = np.searchsorted(s.off, a, "right") - 1
        _, later = tv.repeated(tv.span_hash(s.data, a, b), row)
        out["n_lines"] = np.bincount(row, minlength=s.n)
        out["n_dup_lines"] = np.bincount(row[later], minlength=s.n)
        h, row = tv.windows(w, 5)
        again, _ = tv.repeated(h, row)
        n = len(w.hash)
        inside = np.zeros(n + 1, np.int64)
        if n >= 5:
            at = np.flatnonzero(w.row[: n - 4] == w.row[4:])[again]
            inside[at] += 1
            np.subtract.at(inside, at + 5, 1)
        out["n_repeat_words"] = per_word(np.cumsum(inside[:n]) > 0)
        i = np.minimum(np.searchsorted(stop, low), len(stop) - 1)
        out["n_stop"] = per_word(stop[i] == low)
        same = np.zeros(n, bool)
        same[1:] = (low[1:] == low[:-1]) & (w.row[1:] == w.row[:-1])
        out["n_stutter"] = per_word(same)
        yield s.first, s.n, {k: out[k].astype(np.int64) for k in FEATURES}


def count_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and FEATURES of each row. Columns of ``docs`` named like a feature are left out unless kept."""
    base = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, n, cols in features(batch.column("__text")):
            yield {c: batch.column(c).slice(first, n) for c in keep} | cols

    kept = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(base, run, kept + ", " + ", ".join(f"{c} bigint" for c in FEATURES))


def base_failed() -> Column:
    """Texts too short, or with over a fifth of their words in repeated passages."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    out = F.when(bad, -1)
    return (out if good is None else out.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains. Thresholds are shares of words, letters or lines of the text.

    Lack of one kind of junk says little, so most rules abstain there; the two on
    function words and word lengths also vote good. A lack of function words, or an odd word length, says nothing
    about texts of which over a fifth of the letters are beyond the Latin script, whose function words aren't listed.
    """
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c, of=words: F.col(c) / of
    letters = F.greatest(F.col("n_letters"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    length = F.col("word_chars") / words
    latin = 5 * F.col("n_beyond") <= F.col("n_letters")
    long_enough = (F.col("n_words") >= 20) & latin
    return {
        "symbols": _vote(share("n_symbols") > 0.2),
        "upper": _vote(share("n_upper", letters) > 0.4),
        "marks": _vote(share("n_marks") > 0.5),
        "dup_lines": _vote(share("n_dup_lines", lines) > 0.35),
        "repeats": _vote(share("n_repeat_words") > 0.4),
        "stutter": _vote(share("n_stutter") > 0.3),
        "stop_words": _vote(long_enough & (share("n_stop") < 0.06), share("n_stop") >= 0.12),
        "word_length": _vote(latin & ((length < 2.5) | (length > 9.0)), length.between(3.5, 6.5)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, iterations: int = 200, prior: float = 0.85, strength: float = 20.0) -> dict:
    """EM for two classes with independent rules.

    patterns: one row of votes for each pattern, counts: how many texts have it.
    A rule starts out voting bad on 2 % of the good and 40 % of the bad texts;
    Dirichlet counts of ``strength`` votes keep that meaning, so the classes can't swap.
    """
    n = patterns.shape[1]
    start = np.tile([[0.02, 0.48, 0.50], [0.40, 0.40, 0.20]], (n, 1, 1))  # [rule, good or bad, vote + 1]
    theta, share = start.copy(), prior
    hot = (patterns[:, :, None] + 1 == np.arange(3)).astype(float)
    post = np.zeros(len(counts))
    for _ in range(iterations):
        lg = np.log(share) + np.einsum("pnv,nv->p", hot, np.log(theta[:, 0]))
        lb = np.log1p(-share) + np.einsum("pnv,nv->p", hot, np.log(theta[:, 1]))
        new = 1 / (1 + np.exp(np.clip(lb - lg, -700, 700)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
        weight = np.stack([counts * post, counts * (1 - post)])
        got = np.einsum("cp,pnv->ncv", weight, hot) + strength * start
        theta = got / got.sum(2, keepdims=True)
        share = (weight[0].sum() + strength * prior) / (counts.sum() + strength)
    return {"share_good": float(share), "theta": theta, "posterior": post}


def judge(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality_probability and kept to rows of ``count_features``.

    The posterior of each vote pattern is joined back by a number in base 3; the
    broadcast side has at most 3**8 rows.
    """
    votes = rules()
    pattern = sum(((c + 1) * 3**i for i, c in enumerate(votes.values())), F.lit(0)).cast("int")
    with_votes = counted.withColumn("__pattern", pattern).withColumn("base_failed", base_failed())
    seen = with_votes.groupBy("__pattern").agg(F.count("*").alias("n")).orderBy("__pattern").collect()
    codes = np.array([r[0] for r in seen], dtype=np.int64)
    digits = (codes[:, None] // 3 ** np.arange(len(votes))) % 3 - 1 if len(codes) else np.zeros((0, len(votes)), int)
    post = fit(digits, np.array([r[1] for r in seen], dtype=float))["posterior"] if len(codes) else []
    spark = counted.sparkSession
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, post, strict=True)], "__pattern int, quality_probability double")
    return (
        with_votes.join(F.broadcast(table), "__pattern", "left")
        .withColumn("quality_probability", F.coalesce("quality_probability", F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
        .drop("__pattern")
    )


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base counts, base verdict, posterior and final verdict for every document."""
    out = judge(count_features(docs, ["doc_id"]), threshold)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with their columns; rows are judged one by one, so ids may repeat or be null."""
    cols = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    text = f"c{cols.index('text')}"
    judged = judge(count_features(renamed, renamed.columns, text), threshold)
    return judged.filter("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
