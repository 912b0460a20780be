"""Resampling towards a target distribution by importance weights.

*Weights.* Words (lower-cased runs of ASCII letters, digits and characters
beyond ASCII) form runs of 1 to ``ngrams`` words; the CRC-32 of a run names its
bucket.  A bucket's gain is the logarithm of its smoothed share of the target's
runs over its share of the corpus's, in whole thousandths.  The gains are one
array of ``BUCKETS`` numbers; a text's weight is the floored mean of the gains
its runs point at.  The score adds Gumbel noise, drawn from a hash of the id, so
the highest scores are a sample without replacement by the weights' exponential.

*Selection.* The documents drawn are cut off at one exact key (score descending,
id ascending), found without a sort of all rows.  Each round takes the median
key of every group of remaining rows; the median of these medians, weighted by
the groups' remaining sizes, has at least a quarter of the remaining rows on
either side, so the side that cannot hold the cutoff goes.  The same pass counts
both sides and takes the medians of both for the next round.  Remaining rows are
written anew when they have shrunk eightfold, so all rounds together read little
more than the first one.  Only the winners are sorted.

A group is at most ``GROUP`` rows of one task; a row of about 60 bytes a group
reaches the driver in each round, that is a 17,000th of the keys.

Null and empty texts have no runs and weight 0.  A null id hashes as the empty
string and sorts last among equal scores.  Repeated rows are rows of their own;
among rows equal in score and id those with fewer features are drawn first.
With an empty target every gain follows from the smoothing alone.  An empty
table gives an empty result.  Columns not named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.ranges import number_rows
from caseflow.llm import common as C

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
GROUP = 1 << 20
SHRINK = 8
LAST = np.iinfo(np.int64).max

# lower-cases A-Z and turns every other ASCII character but letters and digits into a space
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def word_array(w: C.Words) -> pa.LargeBinaryArray:
    """The words as an Arrow array (their bytes moved together)."""
    buf = np.frombuffer(w.joined, np.uint8)
    size = w.end - w.start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[w.start] = 1
    inside[w.end] -= 1
    data = buf[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def run_buckets(w: C.Words, ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of every run of 1 to ``ngrams`` words."""
    words, of = word_array(w), w.of()
    texts, found = [], []
    runs = words
    for k in range(1, ngrams + 1):
        if k > 1:
            runs = pc.binary_join_element_wise(runs.slice(0, max(0, len(words) - k + 1)), words.slice(k - 1),
                                               pa.scalar(b" ", pa.large_binary()))
        within = of[:len(runs)] == of[k - 1:]
        coded = runs.dictionary_encode()  # a run's checksum is taken once a piece
        sums = np.fromiter((zlib.crc32(x) % buckets for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        texts.append(of[:len(runs)][within])
        found.append(sums[coded.indices.to_numpy()][within] if len(runs) else np.zeros(0, np.int64))
    return np.concatenate(texts), np.concatenate(found)


def _count(ngrams: int, buckets: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for _, texts in C.text_chunks(batches, "text"):
            seen += np.bincount(run_buckets(C.Words(texts, TERMS, hashed=False), ngrams, buckets)[1], minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])
    return fn


def bucket_counts(texts: DataFrame, text: str = "text", ngrams: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Runs of all texts by bucket: an array of ``buckets`` numbers."""
    rows = texts.select(F.col(text).alias("text")).mapInArrow(_count(ngrams, buckets), "bucket bigint, n bigint") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row a bucket
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of log((t + 1) / (T + n)) - log((s + 1) / (S + n)) for each of the n buckets."""
    n, all_s, all_t = len(corpus), float(sum(corpus)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
                     for s, t in zip(corpus, target)], np.int64)


def _weigh(gains, ngrams: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.value
        for rows, texts in C.text_chunks(batches, "text"):
            w = C.Words(texts, TERMS, hashed=False)
            of, bucket = run_buckets(w, ngrams, len(table))
            n = np.bincount(of, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, of, table[bucket])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])
    return fn


def gumbel(doc_id: Column, seed: str) -> Column:
    """Floored thousandths of standard Gumbel noise, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def scored(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs(doc_id, text)``."""
    gains = bucket_gains(bucket_counts(docs, "text", ngrams, buckets), bucket_counts(target, "text", ngrams, buckets))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = slim.mapInArrow(_weigh(docs.sparkSession.sparkContext.broadcast(gains), ngrams),
                          "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


# ---------------------------------------------------------------- selection

def _medians(pivot, group: int):
    """Per group of keys: how many lie before, at and after the pivot, and the median of either side."""
    def summary(a: np.ndarray, b: np.ndarray):
        if pivot is None:
            before, at = np.zeros(len(a), bool), np.zeros(len(a), bool)
        else:
            before = (a < pivot[0]) | ((a == pivot[0]) & (b < pivot[1]))
            at = (a == pivot[0]) & (b == pivot[1])
        row = [int(at.sum())]
        for side in (before, ~before & ~at):
            x, y = a[side], b[side]
            n, m = len(x), (None, None)
            if n:
                mid = (n - 1) // 2
                high = np.partition(x, mid)[mid]
                tied = x == high
                m = int(high), int(np.sort(y[tied])[mid - int((x < high).sum())])
            row += [n, *m]
        return row

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held, rows = [], [], 0, []
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            held += batch.num_rows
            if held >= group:
                rows.append(summary(np.concatenate(a), np.concatenate(b)))
                a, b, held = [], [], 0
        if held:
            rows.append(summary(np.concatenate(a), np.concatenate(b)))
        cols = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["at", "n0", "a0", "b0", "n1", "a1", "b1"])
    return fn


def _weighted_median(medians: list) -> tuple[int, int]:
    """The median key of ``(key, rows)``, each key counted as often as its group has rows."""
    half, run = (sum(n for _, n in medians) + 1) // 2, 0
    for key, n in sorted(medians):
        run += n
        if run >= half:
            return key
    raise ValueError("no rows remain")


def cutoff(keys: DataFrame, k: int, scratch: C.Scratch, group: int = GROUP) -> tuple[tuple[int, int] | None, list[dict]]:
    """The k-th smallest of ``keys(a, b)`` (not null), and what each round kept.

    ``None`` if k is 0 or more than there are rows.
    """
    remaining, rounds, step = keys, [], 0
    pivot, want, written = None, k, None
    low = high = None
    while True:
        rows = remaining.mapInArrow(
            _medians(pivot, group), "at bigint, n0 bigint, a0 bigint, b0 bigint, n1 bigint, a1 bigint, b1 bigint").collect()
        before, at, after = (sum(r[c] for r in rows) for c in ("n0", "at", "n1"))
        total = before + at + after
        if pivot is None:
            if not 0 < k <= total:
                return None, rounds
            written = total
        elif want <= before:
            high = pivot
        elif want <= before + at:
            return pivot, rounds
        else:
            want, low = want - before - at, pivot
        side = 0 if high is not None and high == pivot else 1
        pivot_next = _weighted_median([((r[f"a{side}"], r[f"b{side}"]), r[f"n{side}"]) for r in rows if r[f"n{side}"]])
        left = before if side == 0 else after
        rounds.append({"rows": total, "left": left})
        if pivot is not None:
            a, b = F.col("a"), F.col("b")
            smaller = (a < pivot[0]) | ((a == pivot[0]) & (b < pivot[1]))
            larger = (a > pivot[0]) | ((a == pivot[0]) & (b > pivot[1]))
            remaining = remaining.where(smaller if side == 0 else larger)
            if left * SHRINK <= written:
                step += 1
                remaining, written = scratch.write(remaining, f"remaining{step}"), left
                if step > 1:
                    scratch.drop(f"remaining{step - 1}")
        pivot = pivot_next


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             ngrams: int = 1, buckets: int = BUCKETS, seed: str = SEED, group: int = GROUP) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100)
    are drawn and ranked from 1; ``rank`` is null for all others.
    """
    scratch = C.Scratch(docs.sparkSession, "resample")
    rows = scratch.write(scored(docs, target, ngrams, buckets, seed), "scored")
    fit = F.col("n_words") >= least_words
    a, b = (-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(int(LAST))).alias("b")
    k = percent * rows.where(fit).count() // 100
    key, _ = cutoff(rows.where(fit).select(a, b), k, scratch, group)
    no_rank = F.lit(None).cast("bigint")
    if key is None:
        return rows.withColumn("rank", no_rank)
    wins = fit & ((a < key[0]) | ((a == key[0]) & (b <= key[1])))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = number_rows(rows.where(wins), order, scratch.path("winners"), "rank")
    # rows tied with the last one drawn may go beyond the number to draw
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(rows.where(~wins).withColumn("rank", no_rank))
