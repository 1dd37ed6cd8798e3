"""Toxicity as an ordered severity, by cumulative-link regression on sparse word features.

P(grade <= k) is the logistic function of threshold k minus the score; all thresholds share the
weights of one score, a sum over the words of a text. The model is fitted on the driver from a
bounded sample of labelled texts (``sample_rows``) and applied to whole texts.

Labels say only whether a text is toxic, so grades are made from them: 0 for the rest, and for toxic
texts 1 or 2, by whether the amount of words that mark toxic texts is at most its median or above.
Features are lower-case words that, in the sample, stand in toxic texts more often or less often
than chance allows (a likelihood-ratio statistic of ``least_gain``), with the weight log2(1 + occurrences).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.words import LOWER, buffer_of, slices, word_edges, word_hashes
from tessera.plans.batches import bound_batches

GRADES = 3
_APART = np.ones(256, bool)  # everything in ASCII but letters and digits parts words
_APART[0x80:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _APART[_a:_b] = False


@dataclass
class SeverityModel:
    """Word hashes in ascending order, their weights, and the thresholds between grades."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, doc: np.ndarray, word: np.ndarray, times: np.ndarray, n_docs: int) -> np.ndarray:
        return np.bincount(doc, self.weights[word] * np.log2(1.0 + times), minlength=n_docs)

    def above(self, score: np.ndarray) -> np.ndarray:
        """Per text and threshold the probability of a grade above it."""
        return _logistic(score[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and per text the number of its first word."""
    buf, offs = buffer_of(texts)
    s, e, first = word_edges(buf, offs, _APART)
    return word_hashes(LOWER[buf], s, e), first


def _hits(h: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word number, occurrences) of each known word of each text."""
    if not len(words) or not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = np.flatnonzero(words[at] == h)
    doc = np.searchsorted(first, hit, side="right") - 1
    pair, times = np.unique(doc * len(words) + at[hit], return_counts=True)
    return pair // len(words), pair % len(words), times


def _surprise(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return seen * np.log(np.maximum(seen, 1) / expected)


def fit_severity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 6000, least_gain: float = 15.0, least_docs: int = 3
) -> SeverityModel:
    """Fit on the labelled texts whose identifiers have the ``sample_rows`` least hashes.

    Rows with a null identifier or label are left out; several labels of one text count as toxic if
    one is, and of several texts with one identifier the one with the least hash is read. An empty table of either kind counts as one without toxic labels. Without toxic labels, or without clean ones, the model gives every text grade 0.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    taken = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id")
    # one text a label, also where identifiers repeat
    texts = texts.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = _words(part.column(0))
                words, times = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    u, n = np.unique(h[a:b], return_counts=True)
                    words.append(u.tobytes())
                    times.append(n.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(words, pa.binary()), pa.array(times, pa.binary())], ["toxic", "words", "times"])

    rows = texts.mapInArrow(features, "toxic int, words binary, times binary").toArrow()
    toxic = np.asarray(rows["toxic"]).astype(np.int64)
    words = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["words"]]
    times = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["times"]]
    return _fit(toxic, words, times, least_gain, least_docs)


def _fit(toxic, words, times, least_gain, least_docs) -> SeverityModel:
    n, n1 = len(toxic), int(toxic.sum())
    never = SeverityModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 41.0]))
    if not n1 or n1 == n:
        return never
    doc = np.repeat(np.arange(n), [len(w) for w in words])
    vocabulary, word = np.unique(np.concatenate(words), return_inverse=True)
    in1 = np.bincount(word, toxic[doc], minlength=len(vocabulary))
    both = np.bincount(word, minlength=len(vocabulary))
    more = in1 / both > n1 / n
    gain = 2 * (_surprise(in1, both * n1 / n) + _surprise(both - in1, both * (n - n1) / n))  # the likelihood-ratio statistic
    keep = (both >= least_docs) & (gain >= least_gain)
    marks = keep & more
    if not marks.any():
        return never
    value = np.log2(1 + np.concatenate(times))
    amount = np.bincount(doc, value * marks[word], minlength=n)
    middle = np.median(amount[toxic == 1])
    grade = np.where(toxic == 0, 0, np.where(amount > middle, 2, 1))
    number = np.cumsum(keep) - 1
    some = keep[word]
    weights, thresholds = fit_cumulative_link(doc[some], number[word[some]], value[some], grade, n, int(keep.sum()))
    return SeverityModel(vocabulary[keep], weights, thresholds)


def fit_cumulative_link(doc, feature, value, grade, n, width, rounds: int = 600, ridge: float = 1e-5, rate: float = 0.1):
    """Weights and ordered thresholds that maximise the penalised likelihood, by Adam on all rows.

    Thresholds are a first one and exponentials of gaps, so their order holds throughout.
    """
    counts = np.bincount(grade, minlength=GRADES)
    first = np.log((counts[0] + 1) / (n - counts[0] + 1))
    params = np.concatenate([np.zeros(width), [first], np.zeros(GRADES - 2)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        w, gaps = params[:width], np.exp(params[width + 1 :])
        theta = params[width] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(doc, w[feature] * value, minlength=n)
        below = _logistic(theta[None, :] - score[:, None])
        padded = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        p = np.maximum(padded[rows, grade + 1] - padded[rows, grade], 1e-12)
        slope = padded * (1 - padded)
        up, low = slope[rows, grade + 1] / p, slope[rows, grade] / p
        d_score = up - low  # of minus the log-likelihood
        d_theta = np.array([np.sum(low[grade == k + 1]) - np.sum(up[grade == k]) for k in range(GRADES - 1)])
        grad = np.concatenate([np.bincount(feature, d_score[doc] * value, minlength=width) / n + ridge * w, [d_theta.sum() / n], np.cumsum(d_theta[::-1])[::-1][1:] * gaps / n])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:width], params[width] + np.concatenate([[0], np.cumsum(np.exp(params[width + 1 :]))])


_MADE = [("expected_severity", T.DoubleType()), ("grade", T.IntegerType()), ("p_toxic", T.DoubleType()), ("rejected", T.BooleanType())]


def score_severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_severity (0 to 2), grade, p_toxic, rejected.

    A text is rejected when a grade above 0 has a probability of ``reject_at`` or more. Null and
    empty texts have no words and the score 0. Each row is scored for itself, also one that repeats
    another's identifier; an empty table gives no rows, and further columns are not read.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(a, b) for a, b in _MADE]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *_scored(part.column(1), model, reject_at)], schema.names)

    return source.mapInArrow(run, schema)


def _scored(texts: pa.Array, model: SeverityModel, reject_at: float) -> list[pa.Array]:
    h, first = _words(texts)
    above = model.above(model.score(*_hits(h, first, model.words), len(texts)))
    edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
    grade = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
    return [pa.array(above.sum(axis=1)), pa.array(grade, pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= reject_at)]


def drop_toxic(docs: DataFrame, model: SeverityModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model rejects; same columns, whatever their names.

    Null and empty texts have no words and stay, as their score is 0, unless the model rejects every
    text. Each row is judged for itself; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                gone = _scored(part.column(names.index(text_col)), model, reject_at)[3]
                yield part.filter(pc.invert(gone))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["SeverityModel", "drop_toxic", "fit_cumulative_link", "fit_severity", "score_severity"]
