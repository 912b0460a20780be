"""Removal of repeated word windows through difference-cover anchors.

A window is ``width`` consecutive words.  Anchors are the hashes of ``width -
period + 1`` words, taken only at positions whose remainder modulo ``period``
lies in a difference cover.  For any two positions i and j some shift below
``period`` carries both onto the cover, so two equal windows share an aligned
anchor.  Repeated anchors are then extended: the windows around them, and only
those, are hashed whole (96 bits) and counted.  A word goes when a window that
occurs more than once covers it; windows are judged on the input.

Null and empty texts have no words and keep nothing.  Repeated rows count as
documents of their own, so they repeat each other's windows.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

# Perfect difference sets (period: residues).
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """Largest period that leaves anchors of at least two fifths of the window."""
    period = max(p for p in COVERS if width - p + 1 >= max(1, 2 * width // 5))
    return period, COVERS[period]


def _cover_positions(count: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and word index (in its text) of every anchor of several texts."""
    period, residues = cover_for(width)
    size = width - period + 1
    last = np.where(count >= width, count - size, -1)  # a shorter text has no window
    n = np.zeros(len(count), np.int64)
    blocks = (last + period) // period
    doc = np.repeat(np.arange(len(count)), np.maximum(blocks, 0))
    n = np.maximum(blocks, 0)
    block = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    pos = (block[:, None] * period + np.array(residues)[None, :]).ravel()
    doc = np.repeat(doc, len(residues))
    ok = pos <= last[doc]
    return doc[ok], pos[ok]


def _lists(values: np.ndarray, doc: np.ndarray, n: int, kind=None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), C.signed(values) if kind is None else pa.array(values, kind))


def _anchor_hashes(width: int):
    size = width - cover_for(width)[0] + 1

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text"):
            w = C.Words(texts)
            doc, pos = _cover_positions(w.count, w.first, width)
            begin = w.first[:-1][doc] + pos
            h = C.mix64(C.BASE_A.span(C.BASE_A.prefix(w.hash), begin, begin + size))
            yield pa.RecordBatch.from_arrays([rows.column("rid"), _lists(h, doc, len(texts))], names=["rid", "h"])
    return fn


def _extended(width: int):
    """Whole-window hashes around the repeated anchors listed in ``hits``."""
    period = cover_for(width)[0]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text"):
            w = C.Words(texts)
            doc, pos = _cover_positions(w.count, w.first, width)
            starts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
            hits = rows.column("hits")
            picked = np.concatenate([starts[i] + hits[i].values.to_numpy() for i in range(len(texts))])
            anchor = w.first[:-1][doc[picked]] + pos[picked]
            around = C.cover(len(w.hash) + 1, np.maximum(anchor - period + 1, w.first[:-1][doc[picked]]), anchor + 1)
            of = w.of()
            at = np.flatnonzero(around[:-1])
            at = at[at + width <= w.first[of[at] + 1]]
            one = C.mix64(C.BASE_A.span(C.BASE_A.prefix(w.hash), at, at + width))
            two = (C.mix64(C.BASE_B.span(C.BASE_B.prefix(w.hash), at, at + width)) >> np.uint64(32)).astype(np.uint32)
            d = of[at]
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid"), _lists((at - w.first[:-1][d]).astype(np.int32), d, len(texts), pa.int32()),
                 _lists(one, d, len(texts)), _lists(two.view(np.int32), d, len(texts), pa.int32())], names=["rid", "at", "w1", "w2"])
    return fn


def _kept(width: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text"):
            hits = rows.column("starts")
            n, removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = text.split()  # bytes: splits at \x20 and \x09-\x0D only
                gone = 0
                if hits[i].is_valid:
                    s = hits[i].values.to_numpy()
                    mask = C.cover(len(words), s, s + width)
                    gone = int(mask.sum())
                    a, b = C.runs(~mask)
                    out = b" ".join(b" ".join(words[x:y]) for x, y in zip(a.tolist(), b.tolist()))
                else:
                    out = b" ".join(words)
                n.append(len(words))
                removed.append(gone)
                kept.append(out)
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid"), rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["rid", "doc_id", "n_words", "n_removed", "kept"])
    return fn


def repeated_windows(docs: DataFrame, width: int, scratch: C.Scratch) -> DataFrame:
    """``rid, starts`` (word positions, ascending) of the windows that occur more than once.

    ``docs`` has ``rid`` and ``text``.  Anchors and windows are counted with
    partial aggregation and joined back on the hash; no group of equal windows
    is ever gathered.
    """
    src = docs.select("rid", "text")
    anchors = scratch.write(src.mapInArrow(_anchor_hashes(width), "rid bigint, h array<bigint>"), "anchors")
    often = scratch.write(anchors.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
                          .where("n > 1").select("h"), "often")
    hits = scratch.write(
        anchors.select("rid", F.posexplode("h").alias("k", "h")).join(often, "h").groupBy("rid")
        .agg(F.sort_array(F.collect_set("k")).alias("hits")), "hits")
    scratch.drop("anchors", "often")
    wide = scratch.write(src.join(hits, "rid").select("rid", "text", "hits")
                         .mapInArrow(_extended(width), "rid bigint, at array<int>, w1 array<bigint>, w2 array<int>"),
                         "wide")
    flat = wide.select("rid", F.explode(F.arrays_zip("at", "w1", "w2")).alias("x")).select("rid", "x.at", "x.w1", "x.w2")
    twice = scratch.write(flat.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    found = scratch.write(flat.join(twice, ["w1", "w2"]).groupBy("rid")
                          .agg(F.sort_array(F.collect_set("at")).alias("starts")), "found")
    scratch.drop("hits", "wide", "twice")
    return found


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """``rid, doc_id, n_words, n_removed, kept`` of every row of ``docs(doc_id, text)``.

    ``kept`` is the words left, joined by one space.
    """
    scratch = C.Scratch(docs.sparkSession, "anchors")
    src = docs.select(C.row_key("doc_id", "text").alias("rid"), "doc_id", "text")
    found = repeated_windows(src, width, scratch)
    return src.join(found, "rid", "left").select("rid", "doc_id", "text", "starts").mapInArrow(
        _kept(width), "rid bigint, doc_id bigint, n_words bigint, n_removed bigint, kept string")
