"""Language identification by multilingual mixture inference.

A model holds, for each language, the log-probability of hashed character
trigrams of its words.  A document is a mixture: each word comes from one of
its languages.  Expectation-maximisation estimates the proportions from the
words' trigram likelihoods; the set of languages is grown in the order of their
proportions while the likelihood penalised by ``PENALTY * log(words)`` a
language improves.

Learning takes at most ``TRAIN_DOCS`` labelled documents in expectation (chosen
by a hash of the text).  The model has ``BUCKETS`` cells a language; more than
``MAX_LANGS`` languages raise an error.

A text that is null or has no letter is ``und`` with score 0; so is every text
if nothing could be learned.  Repeated rows get the same answer.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm import common as C

BUCKETS = 1 << 16
TRAIN_DOCS = 50_000
MAX_LANGS = 512
SMOOTHING = 0.2
PENALTY = 2.0
ROUNDS = 10
UNKNOWN = "und"

_LETTER: list = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words (a word is a run of letters), the start of each
    word among them, and the text of each word."""
    lowered = [t.lower() for t in texts]
    joined = " ".join(lowered) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    begin, end = edge[0::2], edge[1::2]
    # the trigram centred on each letter; anything but a letter reads as a boundary
    c = np.where(letter, cp, 0).astype(np.uint64)
    left, right = np.concatenate([[0], c[:-1]]), np.concatenate([c[1:], [0]])
    at = np.flatnonzero(letter)
    key = (left[at].astype(np.uint64) << np.uint64(42)) ^ (c[at] << np.uint64(21)) ^ right[at].astype(np.uint64)
    bucket = (C.mix64(key) >> np.uint64(48)).astype(np.int64)
    word_start = np.concatenate([[0], np.cumsum(end - begin)])[:-1] if len(begin) else begin
    lengths = np.fromiter((len(t) for t in lowered), np.int64, len(lowered))
    text_end = np.cumsum(lengths + 1)
    return bucket, word_start, np.searchsorted(text_end, begin, side="right")


def _count(langs: list[str]):
    code = {x: i for i, x in enumerate(langs)}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * BUCKETS, np.int64)
        for rows, texts in C.text_chunks(batches, "text"):
            lang = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
            bucket, start, of = trigrams([t.decode() for t in texts])
            sizes = np.diff(np.append(start, len(bucket)))
            total += np.bincount(np.repeat(lang[of], sizes) * BUCKETS + bucket, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])
    return fn


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages (in order) and their table ``[bucket, language]`` of log-probabilities.

    ``docs`` has ``text, lang`` and only rows to learn from.
    """
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    langs = [r[0] for r in known.select("lang").distinct().limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are labelled")
    langs = sorted(langs)
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        some = C.share_of(known, train_docs, "text")
        cells = (some.mapInArrow(_count(langs), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
                 .toArrow())  # at most BUCKETS rows a language
        counts.ravel()[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    table = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    return langs, np.ascontiguousarray(table.T.astype(np.float32))


def _em(e: np.ndarray, of: np.ndarray, start: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood (up to the words' scaling) of several documents."""
    n = np.diff(np.append(start, len(e)))[:, None]
    for _ in range(ROUNDS):
        r = e * theta[of]
        r /= r.sum(1, keepdims=True)
        theta = np.add.reduceat(r, start) / n
    return theta, np.add.reduceat(np.log((e * theta[of]).sum(1)), start)


def infer(loglik: np.ndarray, of: np.ndarray, n_docs: int) -> np.ndarray:
    """Proportions ``[document, language]`` from word log-likelihoods ``[word, language]``.

    A document without words gets zeros.
    """
    n_lang = loglik.shape[1]
    out = np.zeros((n_docs, n_lang), np.float32)
    docs, start = np.unique(of, return_index=True)
    if not len(docs):
        return out
    top = loglik.max(1, keepdims=True)
    single = np.add.reduceat(loglik - top, start)
    best = single.argmax(1)
    out[docs, best] = 1.0
    cost = PENALTY * np.log(np.diff(np.append(start, len(of))) + 1.0)
    # no mixture gains more than the sum of each word's best language does
    unsure = np.flatnonzero(-single.max(1) > cost)
    if not len(unsure) or n_lang == 1:
        return out
    keep = np.zeros(n_docs, bool)
    keep[docs[unsure]] = True
    words = keep[of]
    e = np.maximum(np.exp(loglik[words] - top[words]), 1e-30)
    ids, start, local = np.unique(of[words], return_index=True, return_inverse=True)
    theta, _ = _em(e, local, start, np.full((len(ids), n_lang), 1.0 / n_lang, np.float32))
    rank = np.argsort(-theta, axis=1, kind="stable")
    held, value = out[ids], single.max(1)[unsure]
    cost = cost[unsure]
    live = np.arange(len(ids))
    for size in range(2, n_lang + 1):
        inside = np.zeros((len(ids), n_lang), bool)
        np.put_along_axis(inside, rank[:, :size], True, axis=1)
        some = np.isin(local, live)
        sub, first, where = np.unique(local[some], return_index=True, return_inverse=True)
        begin = np.where(inside[sub], np.maximum(theta[sub], 1e-3), 0).astype(np.float32)
        found, ll = _em(e[some], where, first, begin / begin.sum(1, keepdims=True))
        gain = ll - cost[sub] * (size - 1)
        better = gain > value[sub]
        held[sub[better]], value[sub[better]] = found[better], gain[better]
        live = sub[better]
        if not len(live):
            break
    out[ids] = held
    return out


def _predict(langs: list[str], table, text: str, keep: list[str]):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        for rows, texts in C.text_chunks(batches, text, 1 << 18):
            bucket, start, of = trigrams([t.decode() for t in texts])
            share = np.zeros((len(texts), max(1, len(langs))), np.float32)
            if len(start) and langs:
                share = infer(np.add.reduceat(model[bucket], start), of, len(texts))
            best = share.argmax(1)
            score = share.max(1).astype(float)
            pred = [langs[b] if s > 0 else UNKNOWN for b, s in zip(best, score)]
            mix = [[{"lang": langs[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0]
                   for row in share] if langs else [[]] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in keep], pa.array(pred), pa.array(np.clip(score, 0, 1)),
                 pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=[*keep, "lang_pred", "score", "languages"])
    return fn


def _run(df: DataFrame, model: tuple[list[str], np.ndarray], text: str, keep: list[str]) -> DataFrame:
    langs, table = model
    shared = df.sparkSession.sparkContext.broadcast(table)  # BUCKETS x languages floats
    schema = T.StructType([df.schema[c] for c in keep])
    mixture = T.ArrayType(T.StructType().add("lang", "string").add("share", "double"))
    schema = schema.add("lang_pred", "string").add("score", "double").add("languages", mixture)
    return df.mapInArrow(_predict(langs, shared, text, keep), schema)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str) -> DataFrame:
    """``keep`` columns with ``lang_pred, score`` (its share) and ``languages`` (lang, share)."""
    return _run(docs.select(*keep, "text"), model, "text", list(keep))


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """``docs`` without those of no known language or of which no language has the share ``least``."""
    rows = docs.select(F.struct("*").alias("row"))
    return _run(rows, model, "row.text", ["row"]).where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
