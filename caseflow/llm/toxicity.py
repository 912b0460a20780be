"""Toxic passages as maximum-scoring segments.

*Weights.* Words (lower-cased runs without ASCII punctuation, hashed into
``BUCKETS``) get the log-odds between toxic and other labelled documents under
an informative Dirichlet prior proportional to the overall counts (a document
counts a word once), shrunk by the evidence: a word whose spread over the labels
has the likelihood-ratio statistic g keeps the share 1 - ``CHANCE`` / g, and
nothing if g is less.  Every word also pays ``DRIFT``, so random text scores
negative.

*Segments.* One linear scan finds all maximal scoring segments of a text: each
positive word opens a segment, which merges back over a list of open ones.

*Calibration.* On ordinary text the best segment follows an extreme-value law.
Its decay ``rate`` solves sum(p * exp(rate * score)) = 1 over the words of
non-toxic documents, its constant is fitted to their segments.  A segment is
significant when its expected number in such a text is below ``EXPECT``.  A
document's statistic adds up the normalised scores of its segments as far as
each adds, and a logistic curve fitted on labelled documents turns it into the
score.

Learning takes at most ``TRAIN_DOCS`` labelled documents in expectation (chosen
by a hash of doc_id); their 12-byte labels are broadcast.  The model has
``BUCKETS`` cells.

A null or empty text has score 0 and no passages; with no toxic or no other
label every score is 0.  Repeated labels of one document count each.  Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

BUCKETS = 1 << 20
TRAIN_DOCS = 100_000
PRIOR = 0.01             # mass of the prior, as a share of all counts
CHANCE = 12.0            # at this statistic a word is put down to chance, exp(-6)
DRIFT = 0.05
EXPECT = 0.05
BIN = 0.1


@dataclass
class Model:
    weights: np.ndarray          # by bucket, drift included
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    empty: bool = False


def _buckets(w: C.Words) -> np.ndarray:
    return (w.hash >> np.uint64(44)).astype(np.int64)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments: score, first word, word after the last."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # neighbouring positive words form one step; what lies between them only lowers the sum
    head = np.concatenate([[True], np.diff(up) > 1])
    begin = up[head]
    end = up[np.concatenate([head[1:], [True]])] + 1
    open_: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    for a, b in zip(begin.tolist(), end.tolist()):
        left, right = total[a], total[b]
        while True:
            k = len(open_) - 1
            while k >= 0 and open_[k][0] >= left:
                k -= 1
            if k < 0 or open_[k][1] >= right:
                break
            left, a = open_[k][0], open_[k][2]
            del open_[k:]
        open_.append((left, right, a, b))
    return [(float(r - l), a, b) for l, r, a, b in open_]


def _statistic(found: list, n: int, rate: float) -> float:
    """Sum of normalised segment scores, largest first, as far as each adds (without log K)."""
    best = total = -math.log(max(n, 1))
    total = 0.0
    for r, s in enumerate(sorted((x[0] for x in found), reverse=True), 1):
        total += rate * s - math.log(n) + math.log(r)
        best = max(best, total)
    return best


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label and bucket: its words, and the documents that have it."""
    total, docs = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for rows, texts in C.text_chunks(batches, "text"):
        w = C.Words(texts, C.PLAIN)
        toxic = rows.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        of, bucket = w.of(), _buckets(w)
        total += np.bincount(toxic[of] * BUCKETS + bucket, minlength=2 * BUCKETS)
        once = np.unique(of * BUCKETS + bucket)
        docs += np.bincount(toxic[once // BUCKETS] * BUCKETS + once % BUCKETS, minlength=2 * BUCKETS)
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell]), pa.array(docs[cell])], names=["cell", "n", "d"])


def _evidence(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of each word's counts against equal shares; zero counts are exact."""
    share = toxic.sum() / (toxic.sum() + other.sum())
    both = np.maximum(toxic + other, 1)

    def part(x, expected):
        return x * np.log(np.where(x > 0, x, 1) / np.where(x > 0, expected, 1))
    return 2 * (part(toxic, both * share) + part(other, both * (1 - share)))


def _train_statistics(model, what: str):
    """Histograms over the training documents: of segment scores, or of the statistic."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        seen: dict = {}
        for rows, texts in C.text_chunks(batches, "text"):
            w = C.Words(texts, C.PLAIN)
            scores = m.weights[_buckets(w)]
            for i, toxic in enumerate(rows.column("toxic").to_pylist()):
                n = int(w.count[i])
                if not n:
                    continue
                found = segments(scores[w.first[i]:w.first[i + 1]])
                if what == "segments":
                    for s, _, _ in found:
                        seen[toxic, round(s / BIN)] = seen.get((toxic, round(s / BIN)), 0) + 1
                else:
                    key = toxic, round(_statistic(found, n, m.rate) / BIN)
                    seen[key] = seen.get(key, 0) + 1
        t, b = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(b, pa.int64()), pa.array(seen.values(), pa.int64())],
                                         names=["toxic", "bin", "n"])
    return fn


def _decay(scores: np.ndarray, p: np.ndarray) -> float:
    """Positive root of sum(p * exp(x * score)) = 1."""
    if not (scores[p > 0] > 0).any():
        return 1.0
    lo, hi = 0.0, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * scores, 700.0))).sum())
    while value(hi) < 1 and hi < 1e3:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return max(lo, 1e-3)


def _logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with a slight ridge."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = np.array([((y - p) * n * x).sum() - 1e-2 * a, ((y - p) * n).sum() - 1e-4 * b])
        q = p * (1 - p) * n
        h = np.array([[(q * x * x).sum() + 1e-2, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-4]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on ``labels(doc_id, toxic)`` of ``docs(doc_id, text)``; pass only rows to learn from."""
    sc = docs.sparkSession.sparkContext
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    some = F.broadcast(C.share_of(known, train_docs, "doc_id"))
    rows = docs.where("text is not null").select("doc_id", "text").join(some, "doc_id").select("text", "toxic")
    cells = (rows.mapInArrow(_word_counts, "cell bigint, n bigint, d bigint").groupBy("cell")
             .agg(F.sum("n").alias("n"), F.sum("d").alias("d")).toArrow())  # at most 2 * BUCKETS rows
    tokens, counts = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    tokens[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    counts[cells.column("cell").to_numpy()] = cells.column("d").to_numpy()
    other, toxic = counts[:BUCKETS], counts[BUCKETS:]
    n0, n1 = other.sum(), toxic.sum()
    if not n0 or not n1:
        return Model(np.full(BUCKETS, -DRIFT), empty=True)
    prior = PRIOR * (other + toxic) + 1e-6
    mass = prior.sum()
    ratio = (np.log((toxic + prior) / (n1 + mass - toxic - prior)) - np.log((other + prior) / (n0 + mass - other - prior)))
    weights = ratio * np.maximum(0.0, 1 - CHANCE / np.maximum(_evidence(toxic, other), 1e-9)) - DRIFT
    model = Model(weights)
    ordinary_words = tokens[:BUCKETS].sum()
    model.rate = _decay(weights, tokens[:BUCKETS] / ordinary_words)

    def histogram(what):
        shared = sc.broadcast(model)
        return rows.mapInArrow(_train_statistics(shared, what), "toxic int, bin bigint, n bigint").groupBy(
            "toxic", "bin").agg(F.sum("n").alias("n")).collect()  # a few hundred rows: bins of a bounded range

    ordinary = [(r["bin"] * BIN, r["n"]) for r in histogram("segments") if r["toxic"] == 0 and r["bin"] > 0]
    if ordinary:
        # segments above the median: expected K * words * exp(-rate * score)
        ordinary.sort()
        half, seen = sum(n for _, n in ordinary) / 2, 0
        for level, n in reversed(ordinary):
            seen += n
            if seen >= half:
                break
        model.log_k = math.log(seen / ordinary_words) + model.rate * level
    bins = histogram("statistic")
    x, y, n = (np.array([f(r) for r in bins], float) for f in
               (lambda r: r["bin"] * BIN, lambda r: r["toxic"], lambda r: r["n"]))
    model.slope, model.offset = _logistic(x, n, y)
    return model


PASSAGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])


def _score(model):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, texts in C.text_chunks(batches, "text"):
            w = C.Words(texts, C.PLAIN)
            weights = m.weights[_buckets(w)]
            score, passages = [], []
            for i in range(len(texts)):
                n = int(w.count[i])
                if not n or m.empty:
                    score.append(0.0)
                    passages.append([])
                    continue
                first = int(w.first[i])
                found = segments(weights[first:first + n])
                x = m.slope * _statistic(found, n, m.rate) + m.offset
                score.append(1 / (1 + math.exp(-max(-60.0, min(60.0, x)))))
                hits = []
                for s, a, b in found:
                    expected = math.exp(min(60.0, m.log_k + math.log(n) - m.rate * s))
                    if expected < EXPECT:
                        base = int(w.text_start[i])
                        hits.append({"start": int(w.start[first + a]) - base, "end": int(w.end[first + b - 1]) - base,
                                     "score": s, "expected": expected})
                passages.append(hits)
            keep = [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(score, pa.float64()),
                                              pa.array(passages, pa.list_(PASSAGE))], names=[*keep, "score", "passages"])
    return fn


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns with ``score`` and the significant ``passages`` (byte offsets in the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(
        _score(shared), f"{kept}, score double, passages array<struct<start: bigint, end: bigint, score: double, expected: double>>")
