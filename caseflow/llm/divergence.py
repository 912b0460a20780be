"""Source divergence audit over a K-squared quadtree of the group-term counts.

A group is a (lang, source) pair; its language keeps the terms found in at least
``least_docs`` of its documents.  Each group, and each language, gives every
kept term the share ``p = 1 + floor(SCALE * (n + 2) / (N + 2 * V))``, n being its
count there, N the sum of its counts and V the number of kept terms.  Two shares
diverge by ``f = floor((p - q)^2 / (p + q))``.

Per language the counts form a matrix, groups by terms, the terms that most
groups use first.  It is a quadtree with four (K = 2) quadrants a node; only
quadrants with a count that is not 0 exist.  A pair of groups walks the tree
jointly: where both are in an empty quadrant every term there costs the same
``f`` of the two shares of count 0, so the quadrant is priced as its width times
that.  Only leaves that one of the two occupies are computed term by term.

The matrix is dealt out in tiles of ``ROWS`` groups and ``COLS`` terms, the nodes
of one level.  One task walks a pair of row tiles over one span of terms (memory:
two tiles).  A row tile goes to as many tasks as there are row tiles, as every
pair of groups has a row in the result.

Counts are combined in every task and before each shuffle, so a frequent term or
a large source costs a row a task.  All arithmetic is on integers and decimals.

Null text, lang and source count as empty strings.  Repeated rows are documents
of their own.  A language without kept terms has V = 0 and pairs of value 0; a
lone source has no pairs.  An empty table gives an empty result.  Columns not
named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.ranges import number_rows
from caseflow.llm import common as C
from caseflow.llm.resample import word_array

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP = 10
ROWS, COLS = 64, 4096   # of a tile; powers of two
LEAF = 4                # side of a leaf quadrant
BATCH_BYTES = 2 << 20   # text whose counts one task combines at a time

# lower-cases A-Z and turns every ASCII character that is no letter into a space
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


# ---------------------------------------------------------------- counts

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and term of a piece of the table: occurrences and documents."""
    def pieces():
        held, rows, size = [], [], 0
        for part, texts in C.text_chunks(batches, "text"):
            held += texts
            rows += zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
            size += sum(map(len, texts))
            if size >= BATCH_BYTES:
                yield rows, held
                held, rows, size = [], [], 0
        if held:
            yield rows, held

    for rows, texts in pieces():
        w = C.Words(texts, LETTERS, hashed=False)
        coded = word_array(w).dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        names = {g: i for i, g in enumerate(dict.fromkeys(rows))}
        group = np.array([names[g] for g in rows], np.int64)
        of, width = w.of(), max(1, len(terms))
        key, n = np.unique(group[of] * width + code, return_counts=True)
        once = np.unique(of * width + code)  # a document and its term
        docs = np.unique(group[once // width] * width + once % width, return_counts=True)[1]
        lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        at = pa.array(key // width)
        yield pa.RecordBatch.from_arrays(
            [lang.take(at), source.take(at), terms.take(pa.array(key % width)).cast(pa.string()), pa.array(n), pa.array(docs)],
            names=["lang", "source", "term", "n", "docs"])


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n`` of kept terms, with ``lang_n``, ``spread`` (groups that use it) and ``first``.

    ``first`` marks one row a term.
    """
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # at most a row a source
    return counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("_d"), F.sum("n").over(term).alias("lang_n"),
        F.count("*").over(term).alias("spread"), (F.min("source").over(term) == F.col("source")).alias("first")) \
        .where(F.col("_d") >= least_docs).drop("_d")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * terms))`` in exact decimals; null without terms."""
    scaled = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    size = F.nullif(total + 2 * terms, F.lit(0))
    return (div(scaled, size.cast("decimal(20,0)")) + 1).cast("bigint")


def divergence(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


# ---------------------------------------------------------------- the tree

def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Tile:
    """Shares of a tile (``shape``: groups by terms), and which quadrants of each side hold a count.

    Cells beyond the groups are never visited, those beyond the terms hold 1 and so cost nothing.
    """

    def __init__(self, shape: tuple, groups: np.ndarray, zero: np.ndarray, width: int, r: np.ndarray, c: np.ndarray, p: np.ndarray):
        self.shape, self.n = shape, len(groups)
        rows, cols = shape
        self.zero = np.ones(rows, np.int64)
        self.zero[groups] = zero
        shares = np.repeat(self.zero[:, None], cols, axis=1)
        shares[:, width:] = 1
        shares[r, c] = p
        self.leaves = shares.reshape(rows // LEAF, LEAF, cols // LEAF, LEAF).swapaxes(1, 2)
        used = np.zeros(shape, bool)
        used[r, c] = True
        used = used.reshape(rows // LEAF, LEAF, cols // LEAF, LEAF).any(axis=(1, 3))
        self.used = {LEAF: used}
        side = LEAF
        while side < cols:
            used = used.reshape(used.shape[0], used.shape[1] // 2, 2).any(axis=2)
            if side < rows:
                used = used.reshape(used.shape[0] // 2, 2, used.shape[1]).any(axis=1)
            side *= 2
            self.used[side] = used


def walk(x: Tile, y: Tile, width: int, same: bool) -> tuple[np.ndarray, int, int]:
    """Sums of ``f`` between the groups of two tiles, leaves computed and quadrants priced whole.

    With ``same`` (a tile with itself) only sums of a group with a later one count.
    """
    n, side = x.shape
    total = np.zeros((n, n), np.int64)
    empty = np.zeros((n, n), np.int64)     # terms priced at count 0
    a = b = c = np.zeros(1, np.int64)
    priced = 0
    while True:
        high = min(side, n)
        occupied = x.used[side][a, c] | y.used[side][b, c]
        free = ~occupied
        priced += int(free.sum())
        blocks = np.zeros((n // high, n // high), np.int64)
        np.add.at(blocks, (a[free], b[free]), np.clip(width - c[free] * side, 0, side))
        empty += np.kron(blocks, np.ones((high, high), np.int64))
        a, b, c = a[occupied], b[occupied], c[occupied]
        if side == LEAF or not len(a):
            break
        side //= 2
        split = (0, 1) if side < n else (0,)
        a, b, c = (np.concatenate(v) for v in zip(*[
            (a * len(split) + i, b * len(split) + j, c * 2 + k) for i in split for j in split for k in (0, 1)]))
        high = min(side, n)
        real = (a * high < x.n) & (b * high < y.n) & (c * side < width)
        if same:
            real &= a <= b
        a, b, c = a[real], b[real], c[real]
    for at in range(0, len(a), 1 << 14):
        i, j, k = a[at:at + (1 << 14)], b[at:at + (1 << 14)], c[at:at + (1 << 14)]
        part = _f(x.leaves[i, k][:, :, None, :], y.leaves[j, k][:, None, :, :]).sum(axis=3)
        rows = i[:, None, None] * LEAF + np.arange(LEAF)[None, :, None]
        cols = j[:, None, None] * LEAF + np.arange(LEAF)[None, None, :]
        np.add.at(total, (rows, cols), part)
    return total + empty * _f(x.zero[:, None], y.zero[None, :]), len(a), priced


def _pairs(shape: tuple):
    def fn(key: tuple, table: pa.Table) -> pa.Table:
        """Partial sums of one pair of row tiles over one span of terms."""
        lang, ra, rb, _ = (k.as_py() for k in key)
        r, c, p, width = (table.column(n).to_numpy() for n in ("r", "c", "p", "width"))
        rows, width = shape[0], int(width[0])

        def tile(block):
            mine = r // rows == block
            names, cells = mine & (c < 0), mine & (c >= 0)
            return Tile(shape, r[names] % rows, p[names], width, r[cells] % rows, c[cells], p[cells])
        x = tile(ra)
        y = x if ra == rb else tile(rb)
        sums = walk(x, y, width, ra == rb)[0]
        i, j = np.meshgrid(np.arange(x.n), np.arange(y.n), indexing="ij")
        take = i < j if ra == rb else np.ones_like(i, bool)
        i, j = i[take], j[take]
        return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": ra * rows + i, "j": rb * rows + j,
                         "value": sums[i, j]})
    return fn


def pair_sums(cells: DataFrame, groups: DataFrame, shape: tuple = (ROWS, COLS)) -> DataFrame:
    """``lang, i, j, value`` for the pairs i < j of a language's groups."""
    rows, cols = shape
    blocks = F.ceil(F.col("n_groups") / rows).cast("bigint")
    spans = F.greatest(F.lit(1), F.ceil(F.col("v") / cols)).cast("bigint")
    names = groups.select(
        "lang", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), spans - 1)).alias("span"), F.lit(-1).cast("bigint").alias("c"),
        F.coalesce("p0", F.lit(1)).alias("p"), "v", blocks.alias("blocks"))
    counts = cells.select("lang", "r", F.floor(F.col("c") / cols).alias("span"), (F.col("c") % cols).alias("c"), "p", "v",
                          blocks.alias("blocks"))
    both = names.unionByName(counts).withColumn("rb", F.floor(F.col("r") / rows))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = both.select("lang", F.least("rb", "other").alias("ra"), F.greatest("rb", "other").alias("rb"), "span", "r", "c", "p",
                        F.greatest(F.lit(0), F.least(F.lit(cols), F.col("v") - F.col("span") * cols)).alias("width"))
    return dealt.groupBy("lang", "ra", "rb", "span").applyInArrow(_pairs(shape), "lang string, i bigint, j bigint, value bigint") \
        .groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, shape: tuple = (ROWS, COLS)) -> DataFrame:
    """``lang, source, part, item, value, rank`` from ``docs(text, lang, source)``.

    Part ``pair``: every other source of the language and the divergence summed
    over all kept terms.  Part ``term``: the ``top`` kept terms of the group
    whose share exceeds the language's.  Ranks by value, largest first, then item.
    ``shape`` is that of a tile, two powers of two from ``LEAF`` on, groups no more than terms.
    """
    scratch = C.Scratch(docs.sparkSession, "divergence")
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = scratch.write(kept_counts(named, least_docs), "kept")
    terms = number_rows(kept.where("first").select("lang", "spread", "term"),
                        [F.col("lang"), F.col("spread").desc(), F.col("term")], scratch.path("terms"), "no")
    spans = terms.groupBy("lang").agg(F.min("no").alias("lo"), F.count("*").alias("v"))
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_words"))
    lang = Window.partitionBy("lang")  # a row a source
    groups = named.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(spans, "lang", "left") \
        .withColumn("n_words", F.coalesce("n_words", F.lit(0))).withColumn("v", F.coalesce("v", F.lit(0))) \
        .select("lang", "source", "n_words", "v", "lo", (F.row_number().over(lang.orderBy("source")) - 1).cast("bigint").alias("r"),
                F.count("*").over(lang).alias("n_groups"), F.sum("n_words").over(lang).alias("lang_words"),
                share(F.lit(0).cast("bigint"), F.col("n_words"), F.col("v")).alias("p0"))
    groups = scratch.write(groups, "groups")
    cells = kept.join(terms.select("lang", "term", "no"), ["lang", "term"]).join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "r", "v", "n_groups", (F.col("no") - F.col("lo")).alias("c"),
        share(F.col("n"), F.col("n_words"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_words"), F.col("v")).alias("q"))
    cells = scratch.write(cells, "cells")

    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    over = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       divergence(F.col("p"), F.col("q")).alias("value")) \
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    sums = scratch.write(pair_sums(cells, groups, shape), "sums")
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    pairs = both.join(groups.select("lang", F.col("r").alias("i"), "source"), ["lang", "i"]) \
        .join(groups.select("lang", F.col("r").alias("j"), F.col("source").alias("item")), ["lang", "j"]) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value") \
        .withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(over)
