"""Benchmark decontamination.

Seeds are word n-grams of the benchmark items, by their rarity over all
documents.  Of trigrams, every stretch of ``STRETCH`` consecutive ones of an item
keeps the one found in the fewest documents, so every part of an item has a seed,
however common its words are.  Of bigrams, all count that are at most ``USUAL``
likely to turn up in a passage by chance.  A document's hits of one item are
gathered into passages.  A passage with two different trigrams (or with all the
item has), or with bigrams that are together at most ``CHANCE`` likely, is aligned
with the item by Smith-Waterman over words (match 2, mismatch and gap -1).  So one
rare pair of words left of a paraphrase is enough, and the number of alignments is
bounded by the rarity of what led to them.  The
score is the best local alignment over that of a full copy; paraphrased and
edited copies keep a high one.  A passage counts from the threshold on, or from
the alignment of ``ENOUGH`` exact words on, however long the item is.

Items come to the documents, in blocks of at most ``BLOCK_GRAMS`` trigrams; each
block is two passes over the documents, and texts are never shuffled.  Words are
lower-cased runs without ASCII punctuation; in scripts that put no spaces between
words (Han, kana, Thai, Lao, Khmer, Burmese) every character is one.  ``ENOUGH``
and ``MIN_WORDS`` take two Han or kana characters for a word, four of the others.

Items of under ``MIN_WORDS`` words are found as exact copies of the whole.  Null
and empty texts match nothing, repeated rows are reported each.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

GRAM = 3
STRETCH = 4
MIN_WORDS = 8
BLOCK_GRAMS = 1 << 20
THRESHOLD = 0.5
ENOUGH = 13             # exact words that are a copy by themselves
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 22
USUAL, CHANCE = 1e-2, 1e-4  # of a bigram, and of all bigrams of a passage
# UTF-8 characters of scripts without spaces, and their punctuation
HAN = rb"\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}"
LETTERS = rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]"
MARKS = re.compile(rb"\xe3\x80[\x80-\x83\x88-\x9f]|\xef\xbc[\x81-\x8f\x9a-\xa0]|\xef\xbd[\x9b-\xa5]")
SINGLE = re.compile(HAN + b"|" + LETTERS)
HAN, LETTERS = re.compile(HAN), re.compile(LETTERS)
WIDE = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")


def words_of(texts: list[bytes]) -> C.Words:
    """Words of texts; characters of scripts without spaces are words."""
    return C.Words([SINGLE.sub(rb" \g<0> ", MARKS.sub(b" ", t)) if WIDE.search(t) else t for t in texts], C.PLAIN)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score, and the passage words where it begins and ends."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        above = row[1:] + GAP
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(diagonal, above), 0)
        source = np.arange(n + 1)
        source[1:] = np.where(new[1:] == 0, source[1:], np.where(diagonal >= above, begin[:-1], begin[1:]))
        # a gap along the passage: the running best of what stands to the left
        lifted = new + ramp
        reach = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        row, begin = reach - ramp, source[origin]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), int(begin[top]), top)
    return best


def _bound(item: np.ndarray, passage: np.ndarray) -> int:
    """No local alignment scores more: an item's word not in the passage costs one, wherever it stands."""
    total = np.concatenate([[0], np.cumsum(np.where(np.isin(item, passage), MATCH, max(MISMATCH, GAP)))])
    return int((total - np.minimum.accumulate(total)).max())


class _Block:
    """Items of one block with the places of their trigrams."""

    def __init__(self, ids: list, texts: list[bytes]):
        w = words_of(texts)
        han = np.array([len(HAN.findall(t)) for t in texts], float)
        letters = np.array([len(LETTERS.findall(t)) for t in texts], float)
        size = w.count - han / 2 - letters * 3 / 4  # as spaced words
        long_enough = np.flatnonzero(size >= MIN_WORDS)
        self.ids = [ids[i] for i in long_enough]
        self.words = [w.hash[w.first[i]:w.first[i + 1]] for i in long_enough]
        self.enough = ENOUGH * MATCH * w.count[long_enough] / size[long_enough]
        self.short: dict[int, tuple[np.ndarray, list]] = {}  # by word count: hashes of the whole, and item ids
        for n in np.unique(w.count[(size < MIN_WORDS) & (w.count > 0)]).tolist():
            some = np.flatnonzero((size < MIN_WORDS) & (w.count == n))
            whole = np.array([C.windows(w.hash[w.first[i]:w.first[i + 1]], n)[0] for i in some], np.uint64)
            values = np.unique(whole)
            self.short[n] = values, [[ids[i] for i in some[whole == v]] for v in values]
        self.grams = {n: self._places(n) for n in (2, GRAM)}

    def _places(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items' n-grams: hash, item and place."""
        grams = [C.windows(x, n) for x in self.words]
        if not grams:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return (np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams]),
                np.concatenate([np.arange(len(g)) for g in grams]))

    def rarest(self, frequency: dict[int, int], total_words: int) -> "_Block":
        """Keeps the seeds only, ordered by hash: trigrams weigh nothing, bigrams by how unlikely they are."""
        gram, item, pos = self.grams[GRAM]
        df = np.array([frequency.get(int(g), 0) for g in gram.view(np.int64)], np.int64)
        keep = np.zeros(len(gram), bool)
        for k in range(len(self.words)):
            at = np.arange(*np.searchsorted(item, [k, k + 1]))
            for s in range(0, max(1, len(at) - STRETCH + 1)):
                part = at[s:s + STRETCH]
                keep[part[np.lexsort((gram[part], df[part]))[0]]] = True
        self.seeds = np.bincount(item[keep], minlength=len(self.words))
        pair, pair_item, pair_pos = self.grams[2]
        seen = np.array([frequency.get(int(g), 0) for g in pair.view(np.int64)], float)
        span = 2.0 * np.array([len(x) for x in self.words])[pair_item] if len(pair) else np.zeros(0)
        chance = np.maximum(seen, 0.5) * span / max(1, total_words)
        rare = chance <= USUAL
        self.grams = {}
        for n, parts in ((GRAM, (gram[keep], item[keep], pos[keep], np.zeros(int(keep.sum())))),
                         (2, (pair[rare], pair_item[rare], pair_pos[rare], -np.log(chance[rare])))):
            order = np.argsort(parts[0], kind="stable")
            self.grams[n] = tuple(x[order] for x in parts)
        return self


class _Finder:
    """Membership of many hashes in a small sorted table, through a bitmap."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.map = np.zeros(1 << FILTER_BITS, bool)
        self.map[self._slot(self.values)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``x`` that are in the table, and where in the table."""
        at = np.flatnonzero(self.map[self._slot(x)])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spot = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[spot] == x[at]
        return at[ok], spot[ok]


def _frequency(shared):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {n: _Finder(values) for n, values in shared.value.items()}
        total, words = {n: np.zeros(len(f.values), np.int64) for n, f in finders.items()}, 0
        for _, texts in C.text_chunks(batches, "text"):
            w = words_of(texts)
            of = w.of()
            words += len(of)
            for n, finder in finders.items():
                at, spot = finder.hits(C.windows(w.hash, n))
                inside = of[at] == of[at + n - 1]
                pairs = np.unique(of[at][inside] * len(finder.values) + spot[inside])
                if len(pairs):
                    total[n] += np.bincount(pairs % len(finder.values), minlength=len(finder.values))
        for n, finder in finders.items():
            seen = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([C.signed(finder.values[seen]), pa.array(total[n][seen])], names=["gram", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([words], pa.int64())], names=["gram", "n"])
    return fn


def _passages(block: _Block, hits: tuple):
    """Passages worth an alignment: text, item, first and last word around which a copy may lie.

    Hits of a text and item belong together unless no copy could span the gap.
    """
    doc, where, it, ip, weight = hits
    if not len(doc):
        return
    length = np.array([len(x) for x in block.words])[it]
    slack = length // 2
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (it[1:] != it[:-1]) | (np.diff(where) > (length + slack)[1:])
    passage, first = np.cumsum(head) - 1, np.flatnonzero(head)
    n, pair = len(first), weight > 0
    width = int(ip.max()) + 1
    # each place of the item counts once
    _, once = np.unique(passage[pair] * width + ip[pair], return_index=True)
    rare = np.bincount(passage[pair][once], weight[pair][once], minlength=n)
    seeds = np.bincount(np.unique(passage[~pair] * width + ip[~pair]) // width, minlength=n)
    good = (rare >= -np.log(CHANCE)) | (seeds >= np.clip(block.seeds[it[first]], 1, 2))
    lo = np.minimum.reduceat(where - ip, first) - slack[first]
    hi = np.maximum.reduceat(where - ip, first) + (length + slack)[first]
    for k in np.flatnonzero(good):
        yield int(doc[first[k]]), int(it[first[k]]), int(lo[k]), int(hi[k])


def _hits(block: _Block, finders: dict, w: C.Words):
    """A line per hit and item that has the seed: text, place in it, item, place in that, weight; in order."""
    of, parts = w.of(), []
    for n, (gram, item, pos, weight) in block.grams.items():
        finder, first = finders[n]
        at, spot = finder.hits(C.windows(w.hash, n))
        ok = of[at] == of[at + n - 1] if len(at) else np.zeros(0, bool)
        at, spot = at[ok], spot[ok]
        many = np.diff(np.append(first, len(gram)))[spot]
        line = np.repeat(np.arange(len(at)), many)
        place = first[spot][line] + np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
        parts.append((of[at][line], at[line] - w.first[:-1][of[at][line]], item[place], pos[place], weight[place]))
    doc, where, it, ip, weight = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((ip, where, it, doc))
    return doc[by], where[by], it[by], ip[by], weight[by]


def _whole(block: _Block, finders: dict, w: C.Words):
    """First exact copy of each short item in each text: text, item id, first word, word after."""
    of = w.of()
    for n, finder in finders.items():
        at, spot = finder.hits(C.windows(w.hash, n))
        ok = of[at] == of[at + n - 1] if len(at) else np.zeros(0, bool)
        at, spot = at[ok], spot[ok]
        _, first = np.unique(of[at] * len(finder.values) + spot, return_index=True)
        for a, k in zip(at[first], spot[first]):
            begin = int(a - w.first[of[a]])
            for item in block.short[n][1][k]:
                yield int(of[a]), item, 1.0, begin, begin + n


def _align(shared, threshold: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        finders = {n: (f := _Finder(x[0]), np.searchsorted(x[0], f.values)) for n, x in block.grams.items()}
        whole = {n: _Finder(values) for n, (values, _) in block.short.items()}
        for rows, texts in C.text_chunks(batches, "text"):
            w = words_of(texts)
            best: dict = {}
            for d, k, lo, hi in _passages(block, _hits(block, finders, w)):
                words = block.words[k]
                lo, hi = max(lo, 0), min(hi, int(w.count[d]))
                passage = w.hash[w.first[d] + lo:w.first[d] + hi]
                least = min(threshold * MATCH * len(words), block.enough[k])
                if _bound(words, passage) < least:
                    continue
                score, x, y = smith_waterman(words, passage)
                if score >= least and score > best.get((d, k), (0,))[0]:
                    best[d, k] = score, lo + x, lo + y
            out = list(_whole(block, whole, w))
            out += [(d, block.ids[k], score / (MATCH * len(block.words[k])), x, y) for (d, k), (score, x, y) in best.items()]
            if out:
                d, ids, score, x, y = zip(*out)
                ids_of = rows.column("doc_id").take(pa.array(d))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("rid").take(pa.array(d)), ids_of, pa.array(ids, pa.int64()), pa.array(score, pa.float64()),
                     pa.array(x, pa.int64()), pa.array(y, pa.int64())],
                    names=["rid", "doc_id", "item_id", "score", "word_start", "word_end"])
    return fn


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rid, doc_id, item_id, score, word_start, word_end``: copies of items in documents.

    One row per document row and item, its best passage.  ``rid`` is a hash of
    (doc_id, text).
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "decontam")
    src = docs.select(C.row_key("doc_id", "text").alias("rid"), "doc_id", "text").where("text is not null")
    items = benchmark.where("text is not null").select("item_id", "text")
    # a word takes two bytes at least, so this bounds the trigrams of all items
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_GRAMS)))
    kind = "rid bigint, doc_id bigint, item_id bigint, score double, word_start bigint, word_end bigint"
    found = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.collect()  # one block: BLOCK_GRAMS trigrams at most on average
        block = _Block([r["item_id"] for r in rows], [r["text"].encode() for r in rows])
        grams = spark.sparkContext.broadcast({n: np.unique(x[0]) for n, x in block.grams.items()})
        counted = src.select("text").mapInArrow(_frequency(grams), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        frequency = {r["gram"]: r["n"] for r in counted.collect()}  # rows: the block's n-grams, and one for all words
        seeds = spark.sparkContext.broadcast(block.rarest(frequency, frequency.pop(None, 0)))
        one = scratch.write(src.mapInArrow(_align(seeds, threshold), kind), f"block{k}")
        found = one if found is None else found.unionByName(one)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a copy of a benchmark item."""
    bad = contaminated(docs, benchmark, threshold).select("rid").distinct()
    keyed = docs.select(C.row_key("doc_id", "text").alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return keyed.join(bad, "rid", "left_anti").select("row.*")
