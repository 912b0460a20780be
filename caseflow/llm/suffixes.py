"""Removal of repeated byte strings through suffix arrays.

A byte goes when a ``length``-byte string covers it that also starts earlier
(in a smaller doc_id, or earlier in the same document).

*Segments.*  Each window of ``length`` bytes is named by the smallest hash among
its ``GRAM``-byte substrings: equal windows have equal names, and neighbouring
windows mostly share theirs.  A maximal run of windows with one name is a
segment, a few dozen windows and their bytes.  Copies of one segment are
pre-aggregated to its first document, so a hot passage is settled by a partial
aggregation.

*Suffix arrays.*  What remains are different segments with the same name: the
rims of shared passages (and segments that may repeat themselves).  They are dealt out by name, packed into blocks, and a
after
cutting each to what it may share (see :func:`trimmed`) a suffix array of each
block is built by grouping suffixes by Lyndon prefix:
groups are processed in descending order, each extends the prefixes of its
members' previous smaller positions, and a final pass emits the order inside
each group by following those pointers, with no recursion and no renaming.
Equal windows are neighbours in that order.

A name whose different segments hold more than ``BLOCK_LIMIT`` bytes is not
gathered: its windows are hashed one by one (128 bits) and settled by a grouped
minimum, with the same result.

Null and empty texts have no bytes.  Rows with one doc_id are documents of which
neither precedes the other.  A null doc_id comes last.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

GRAM = 20
LONGEST_RUN = 4096      # windows in one segment; longer runs are cut, which changes no result
BLOCK_BYTES = 1 << 15   # a block is closed beyond this
BLOCK_LIMIT = 1 << 21   # a single name beyond this takes the grouped minimum
LAST_ID = (1 << 63) - 1


def lyndon_suffix_array(values: list[int]) -> list[int]:
    """Suffix array of a list whose last value is smaller than all others.

    Suffixes are kept in groups, contiguous in ``order`` and sorted among each
    other; a group holds suffixes that start with one Lyndon word.
    """
    n = len(values)
    order = sorted(range(n), key=values.__getitem__)
    place = [0] * n
    group = [0] * n          # start of the suffix's group in `order`
    size = [0] * n           # by group start
    last = None
    for k, i in enumerate(order):
        if values[i] != last:
            last, begin = values[i], k
        place[i], group[i] = k, begin
        size[begin] += 1
    previous = [-1] * n
    end = n
    while end > 0:
        begin = group[order[end - 1]]
        members = sorted(order[begin:end])
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            # more copies of the group's word make a larger prefix, so those leave to the top first
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                touched: dict[int, int] = {}
                for p in by_times[k]:
                    g = group[p]
                    size[g] -= 1
                    top = g + size[g]
                    other = order[top]
                    at = place[p]
                    order[at], order[top] = other, p
                    place[other], place[p] = at, top
                    touched[g] = touched.get(g, 0) + 1
                for g, moved in touched.items():
                    fresh = g + size[g]
                    size[fresh] = moved
                    for at in range(fresh, fresh + moved):
                        group[order[at]] = fresh
        end = begin
    following = list(range(n))   # next free place of each group
    result = [-1] * n
    placed = bytearray(n)
    result[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = result[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[following[g]] = j
            following[g] += 1
            placed[j] = 1
            j = previous[j]
    return result


def repeated_in_block(segments: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """Windows of a block that start earlier elsewhere in it, as ``rid, start, end`` byte spans.

    A segment is ``ord, rid, offset, bytes``.
    """
    text: list[int] = []
    where, own = [], []
    for k, (_, _, _, data) in enumerate(segments):
        where.append(len(text))
        text.extend(x + 2 for x in data)
        text.append(1)
        own.append(len(data))
    text.append(0)
    raw = bytes(x - 2 if x > 1 else 0 for x in text)
    usable = np.full(len(text), -1, np.int64)
    for k, (at, n) in enumerate(zip(where, own)):
        usable[at:at + n - length + 1] = k
    usable = usable.tolist()
    found: dict[int, list[int]] = {}
    chain: list[int] = []

    def settle():
        if len(chain) < 2:
            return
        first = min(segments[usable[i]][0] for i in chain)
        starts: dict[int, int] = {}
        for i in chain:
            o, r, a, _ = segments[usable[i]]
            if o == first:
                pos = a + i - where[usable[i]]
                starts[r] = min(starts.get(r, pos), pos)
        for i in chain:
            k = usable[i]
            o, r, a, _ = segments[k]
            pos = a + i - where[k]
            if o > first or pos > starts[r]:
                found.setdefault(r, []).append(pos)

    for i in lyndon_suffix_array(text):
        if usable[i] < 0:
            continue
        if chain and raw[chain[-1]:chain[-1] + length] == raw[i:i + length]:
            chain.append(i)
        else:
            settle()
            chain = [i]
    settle()
    out = []
    for r, starts in found.items():
        starts = np.unique(np.array(starts, np.int64))
        cut = np.flatnonzero(np.diff(starts) > 1)
        lo = starts[np.concatenate([[0], cut + 1])]
        hi = starts[np.concatenate([cut, [len(starts) - 1]])]
        out += [(r, int(a), int(b) + length) for a, b in zip(lo, hi)]
    return out


_BYTE = C.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _window_names(g: np.ndarray, length: int) -> np.ndarray:
    """Smallest of the gram hashes ``g`` inside each window of ``length`` bytes."""
    width = length - GRAM + 1
    have = 1
    while have * 2 <= width:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    rest = width - have
    return np.minimum(g[:-rest], g[rest:]) if rest else g


def segment_table(texts: list[bytes], length: int):
    """Segments of several texts: text index, offset, windows, name, two content hashes,
    and the naming gram's offset, or -1 if it occurs twice (only then can the segment repeat itself)."""
    joined = b" ".join(texts) + b" "
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64), z.view(np.uint64), z
    x = _BYTE[np.frombuffer(joined, np.uint8)]
    grams = C.windows(x, GRAM)
    name = _window_names(grams, length)
    doc = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    name = name[start[doc] + at]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    head = np.flatnonzero(fresh)
    inside = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc))))
    head = np.flatnonzero(inside % LONGEST_RUN == 0)
    count = np.diff(np.append(head, len(doc)))
    doc, at, name = doc[head], at[head], name[head]
    a = start[doc] + at
    b = a + count + length - 1
    one = C.mix64(C.BASE_A.span(C.BASE_A.prefix(x), a, b) + count.astype(np.uint64))
    two = C.mix64(C.BASE_B.span(C.BASE_B.prefix(x), a, b) + count.astype(np.uint64))
    reach = np.arange(length - GRAM + 1)
    anchor = np.zeros(len(a), np.int64)
    for k in range(0, len(a), 1 << 13):
        p, q = a[k:k + (1 << 13)], (a + count)[k:k + (1 << 13)] + length - GRAM - 1
        left, right = grams[p[:, None] + reach].argmin(1), q - grams[q[:, None] - reach].argmin(1)
        anchor[k:k + (1 << 13)] = np.where(p + left == right, left, -1)
    return doc, at, count, name, one, two, anchor


def _segments(length: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text"):
            doc, at, count, name, one, two, anchor = segment_table(texts, length)
            order = np.lexsort((at, one, doc))
            again = np.zeros(len(doc), bool)
            d, o = doc[order], one[order]
            again[order[1:]] = (d[1:] == d[:-1]) & (o[1:] == o[:-1])
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid").take(take), rows.column("ord").take(take), pa.array(at.astype(np.int32)),
                 pa.array(count.astype(np.int32)), C.signed(name), C.signed(one), C.signed(two), pa.array(again),
                 pa.array(anchor.astype(np.int32))],
                names=["rid", "ord", "at", "n", "name", "s1", "s2", "again", "anchor"])
    return fn


def _cut_out(length: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text"):
            ids, ords, parts = rows.column("rid").to_pylist(), rows.column("ord").to_pylist(), rows.column("parts").to_pylist()
            out = [(p["name"], o, r, p["at"], p["anchor"], t[p["at"]:p["at"] + p["n"] + length - 1])
                   for r, o, ps, t in zip(ids, ords, parts, texts) for p in ps]
            names, os_, rs, ats, anchors, data = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(os_, pa.int64()), pa.array(rs, pa.int64()), pa.array(ats, pa.int32()),
                 pa.array(anchors, pa.int32()), pa.array(data, pa.binary())],
                names=["name", "ord", "rid", "at", "anchor", "data"])
    return fn


def _spans_batch(spans) -> pa.RecordBatch:
    r, a, b = zip(*spans)
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                      names=["rid", "a", "b"])


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _longest_shared(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix it shares with another one: with a neighbour in sorted order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for x, y in zip(order, order[1:]):
        k = _shared(parts[x], parts[y])
        out[x], out[y] = max(out[x], k), max(out[y], k)
    return out


def trimmed(group: list[tuple], length: int) -> list[tuple[int, int, int, bytes]]:
    """Segments ``ord, rid, at, anchor, bytes`` of one name, cut to what another one may share.

    Equal windows are aligned at the naming gram, so they lie within the longest
    match to its left and to its right.  Segments that hold the gram twice have
    no single alignment; with one of those in the group all stay whole.
    """
    if any(anchor < 0 for _, _, _, anchor, _ in group):
        return [(o, r, a, data) for o, r, a, _, data in group]
    left = _longest_shared([data[:p][::-1] for _, _, _, p, data in group])
    right = _longest_shared([data[p:] for _, _, _, p, data in group])
    return [(o, r, a + p - x, data[p - x:p + y]) for (o, r, a, p, data), x, y in zip(group, left, right) if x + y >= length]


def _blocks(length: int):
    """Pack rows that arrive sorted by name into blocks that never part a name."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, group, last = [], 0, [], None

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("name", "ord", "rid", "at", "anchor", "data")))
            yield (None,) * 6

        for name, *segment in rows():
            if name != last and group:
                some = trimmed(group, length)
                block += some
                held += sum(len(x[3]) for x in some)
                group = []
            if block and (held >= BLOCK_BYTES or name is None):
                spans = repeated_in_block(block, length)
                if spans:
                    yield _spans_batch(spans)
                block, held = [], 0
            group.append(segment)
            last = name
    return fn


def _single_windows(length: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                x = _BYTE[np.frombuffer(data, np.uint8)]
                one, two = C.windows(x, length, C.BASE_A), C.windows(x, length, C.BASE_B)
                n = len(one)
                pos = batch.column("at")[i].as_py() + np.arange(n)
                fill = [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64)) for c in ("ord", "rid")]
                yield pa.RecordBatch.from_arrays([C.signed(one), C.signed(two), *fill, pa.array(pos)],
                                                 names=["w1", "w2", "ord", "rid", "pos"])
    return fn


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in C.text_chunks(batches, "text"):
        spans = rows.column("spans")
        out = []
        for i, text in enumerate(texts):
            if not spans[i].is_valid:
                out.append((len(text), 0, [], text))
                continue
            v = spans[i].values
            mask = C.cover(len(text), v.field("a").to_numpy(), v.field("b").to_numpy())
            a, b = C.runs(mask)
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            out.append((len(text), int(mask.sum()), [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())], kept))
        n, gone, cut, kept = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [rows.column("rid"), rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(cut, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["rid", "doc_id", "n_bytes", "n_removed", "removed", "kept"])


def remove_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """``rid, doc_id, n_bytes, n_removed, removed, kept`` of every row of ``docs(doc_id, text)``.

    ``removed`` lists the maximal removed byte spans, ``kept`` is what remains
    (binary, as a cut can fall inside a character).
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "suffixes")
    src = docs.select(C.row_key("doc_id", "text").alias("rid"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("ord"),
                      "doc_id", "text")
    seg = scratch.write(src.select("rid", "ord", "text").mapInArrow(
        _segments(length), "rid bigint, ord bigint, at int, n int, name bigint, s1 bigint, s2 bigint, again boolean, anchor int"), "segments")
    end = (F.col("at") + F.col("n") + F.lit(length - 1)).cast("bigint")
    span = ["rid", F.col("at").cast("bigint").alias("a"), end.alias("b")]
    first = seg.where("not again")

    copied = scratch.write(first.groupBy("s1", "s2").agg(F.min("ord").alias("o1"), F.max("ord").alias("o2"))
                           .where("o1 < o2").select("s1", "s2", "o1"), "copied")
    copies = scratch.write(first.join(copied, ["s1", "s2"]).where("ord > o1").select(*span)
                           .unionByName(seg.where("again").select(*span)), "copies")
    mixed = scratch.write(first.groupBy("name").agg(F.min("s1").alias("x"), F.max("s1").alias("y"),
                                                    F.min("anchor").alias("low"))
                          .where("x <> y or low < 0").select("name"), "mixed")
    rims = scratch.write(first.join(mixed, "name").join(copied, ["s1", "s2"], "left")
                         .where("o1 is null or ord = o1").select("rid", "ord", "at", "n", "name", "anchor"), "rims")
    large = scratch.write(rims.groupBy("name").agg(F.sum(F.col("n") + F.lit(length - 1)).alias("w"))
                          .where(F.col("w") > BLOCK_LIMIT).select("name", F.lit(True).alias("large")), "large")
    lists = rims.distinct().groupBy("rid").agg(F.collect_list(F.struct("name", "at", "n", "anchor")).alias("parts"))
    pieces = src.select("rid", "ord", "text").join(lists, "rid").select("rid", "ord", "text", "parts").mapInArrow(
        _cut_out(length), "name bigint, ord bigint, rid bigint, at int, anchor int, data binary")
    pieces = scratch.write(pieces.join(large, "name", "left"), "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_blocks = (pieces.where("large is null").drop("large").repartition(parts, "name").sortWithinPartitions("name")
                 .mapInArrow(_blocks(length), "rid bigint, a bigint, b bigint"))
    single = scratch.write(pieces.where("large").drop("large").mapInArrow(
        _single_windows(length), "w1 bigint, w2 bigint, ord bigint, rid bigint, pos bigint"), "single")
    low = scratch.write(single.groupBy("w1", "w2").agg(F.min("ord").alias("o1"), F.count("*").alias("k"))
                        .where("k > 1").drop("k"), "low")
    both = single.join(low, ["w1", "w2"])
    early = both.where("ord = o1").groupBy("w1", "w2", "rid").agg(F.min("pos").alias("p"), F.max("pos").alias("q")).where("p < q")
    own = single.join(early.drop("q"), ["w1", "w2", "rid"]).where("pos > p")
    later = both.where("ord > o1").select("rid", "pos").unionByName(own.select("rid", "pos"))
    later = later.select("rid", F.col("pos").alias("a"), (F.col("pos") + length).alias("b"))
    gone = copies.unionByName(in_blocks).unionByName(later)
    gone = scratch.write(gone.groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "gone")
    scratch.drop("segments", "copied", "copies", "mixed", "rims", "large", "pieces", "single", "low")
    return src.select("rid", "doc_id", "text").join(gone, "rid", "left").select("rid", "doc_id", "text", "spans").mapInArrow(
        _cleaned, "rid bigint, doc_id bigint, n_bytes bigint, n_removed bigint, "
                  "removed array<struct<a: bigint, b: bigint>>, kept binary")
