"""N-gram Jaccard join by universe partition.

A document's set holds the hashes of its distinct word n-grams.  Two sets link
when ``100 * |intersection| >= percent * |union|``.

*Partition.* Sizes fall into bands, each ``100 / percent`` times the one below,
so a linked pair lies in one band or in two neighbours.  For the band of the
larger set the symmetric difference is at most ``H``; the universe is hashed
into ``H + 1`` segments.  By the pigeonhole on a ring some segment differs in no
element while it and the next one differ in at most one together.

*Allocation.* A segment holding more elements than its band's :func:`weak_size`
is selective: its subset alone is the signature (one key).  A weak segment would
collide with many sets, so its signature also takes the next segment, as itself
and as its one-deletion neighbourhood.  Neighbourhoods cost as many keys as the
next segment has elements, so a band calls weak what it can pay for.  Both
members of a linked pair hold the same subset of the matching segment, hence
take the same choice.  The pigeonhole goes on along the ring: from some segment on
the next ``k`` segments differ in fewer than ``k`` elements together, for every
``k``.  So each key carries the parity sketch of its ``WINDOW`` segments, and two
sets meet by a key only if these differ in fewer than ``WINDOW`` places, however
large the sets are.

*Verification* counts the intersection of whole sets, of pairs that pass a
parity sketch (see :func:`_may_link`), then one as long as the sets ask for;
neither rejects a linked pair.  Equal sets
form one class beforehand (named by a 64-bit hash of the set).  Each class first
meets the greatest of its groups' hubs, the class with most shared keys; then
the pairs across components that still share a group are tested, each of them,
so no pair of a group is skipped unless its members are connected already.

Nulls and empty texts have the empty set, which links with nothing.  Repeated
rows share a class.  A null ``doc_id`` takes part; it is never a component's
name unless no member has an id.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import common as C

EXTRA_KEYS = 0.5        # most keys a segment that neighbourhoods may add on average
SKETCH_BITS = 1024
PIECE_BYTES = 256 << 10  # text that a task holds sets of at a time
WINDOW = 8              # segments of a key's window
PARTS = 3               # of the key space, shuffled one after the other: all keys take several times the texts' size
SEEN = 1 << 16          # names of classes that a task remembers to have signed


def band_limits(top: int, percent: int) -> list[int]:
    """Largest size of each band, up to the band that holds ``top``."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return out


def difference_bound(size: int, percent: int) -> int:
    """Most elements in which two linked sets of at most ``size`` elements differ."""
    return (100 - percent) * 2 * size // (100 + percent)


def weak_size(size: int, percent: int) -> int:
    """Most elements of a weak segment: the largest number whose share of the
    segments, times the mean load, adds at most ``EXTRA_KEYS`` keys a segment."""
    load = 0.92 * size / (difference_bound(size, percent) + 1)
    level, share, term = -1, 0.0, math.exp(-load)
    while (share + term) * load <= EXTRA_KEYS and level < load:
        level, share = level + 1, share + term
        term *= load / (level + 1)
    return max(level, 0)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: the text's index and the hash, sorted by both."""
    w = C.Words(texts, C.LOWER)
    n = w.count
    own = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), own)
    begin = w.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
    take = np.minimum(n[doc], width)
    p = C.BASE_A.prefix(w.hash)
    h = C.mix64(C.BASE_A.span(p, begin, begin + take) + take.astype(np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[fresh], h[fresh]


def signatures(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature keys of several sets: the set's index and the key."""
    return windowed_signatures(doc, h, sizes, percent)[:2]


def windowed_signatures(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray,
                        percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set's index, the key, and the parity sketch of the key's window."""
    limits = np.array(band_limits(int(sizes.max(initial=1)) * 100 // percent + 1, percent))
    band = np.searchsorted(limits, sizes)
    found = []
    for step in (0, 1):
        scheme = np.minimum(band + step, len(limits) - 1)
        bound = np.array([difference_bound(int(x), percent) for x in limits])[scheme]
        use = (bound > 0) & (sizes > 0)
        if step:  # is there a partner in the next band at all?
            use &= sizes * 100 // percent > limits[band]
        m = np.where(use, bound + 1, 0)
        offset = np.concatenate([[0], np.cumsum(m)])
        keep = use[doc]
        d, x = doc[keep], h[keep]
        salt = scheme.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
        spot = C.mix64(x + salt[d])
        seg = ((spot >> np.uint64(32)) * m[d].astype(np.uint64)) >> np.uint64(32)
        gid = offset[:-1][d] + seg.astype(np.int64)
        value = C.mix64(x ^ np.uint64(0xA0761D6478BD642F))
        total = np.zeros(offset[-1], np.uint64)
        np.add.at(total, gid, value)
        odd = np.zeros(offset[-1], np.uint64)
        np.bitwise_xor.at(odd, gid, np.uint64(1) << (value >> np.uint64(58)))
        count = np.bincount(gid, minlength=offset[-1])
        owner = np.repeat(np.arange(len(sizes)), m)
        local = np.arange(offset[-1]) - np.repeat(offset[:-1], m)
        following = np.where(local + 1 == m[owner], offset[:-1][owner], np.arange(offset[-1]) + 1)
        name = C.mix64(salt[owner] + local.astype(np.uint64))
        window = odd
        for reach in (1, 2, 4):  # WINDOW segments from each one on
            window = window ^ window[offset[:-1][owner] + (local + reach) % m[owner]]
        if (m < WINDOW).any():  # rings that a window would go round: all of the set
            whole = np.zeros(len(sizes), np.uint64)
            np.bitwise_xor.at(whole, owner, odd)
            window = np.where(m[owner] < WINDOW, whole[owner], window)
        weak = count <= np.array([weak_size(int(x), percent) for x in limits])[scheme][owner]
        strong_key = C.mix64(total + name)
        pair_name = C.mix64(total * np.uint64(0x9E3779B97F4A7C15) + name + np.uint64(1))
        pair_key = C.mix64(pair_name + total[following])
        found += [(owner, np.where(weak, pair_key, strong_key), window)]
        before = np.empty(offset[-1], np.int64)
        before[following] = np.arange(offset[-1])
        drop = weak[before[gid]]
        g = gid[drop]
        found += [(d[drop], C.mix64(pair_name[before[g]] + total[g] - value[drop]), window[before[g]])]
    return tuple(np.concatenate(x) for x in zip(*found))


def _class_name(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every set."""
    lo = np.zeros(len(sizes), np.uint64)
    np.add.at(lo, doc, C.mix64(h))
    return C.mix64(lo + sizes.astype(np.uint64))


def _profile(width: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text", PIECE_BYTES):
            doc, h = shingles(texts, width)
            sizes = np.bincount(doc, minlength=len(texts))
            bits = np.zeros(len(texts) * SKETCH_BITS, np.uint8)
            np.add.at(bits, doc * SKETCH_BITS + (C.mix64(h + np.uint64(7)) % np.uint64(SKETCH_BITS)).astype(np.int64), 1)
            sketch = np.packbits(bits & 1).view(np.int64)
            ends = pa.array(np.arange(len(texts) + 1) * (SKETCH_BITS // 64), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid"), rows.column("doc_id"), pa.array(sizes, pa.int64()), C.signed(_class_name(doc, h, sizes)),
                 pa.ListArray.from_arrays(ends, pa.array(sketch))],
                names=["rid", "doc_id", "n", "lo", "sketch"])
    return fn


def _signed_sets(width: int, percent: int, part: int = 0):
    """Name, key and window of each set's signatures whose keys are of one part of the key space."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in C.text_chunks(batches, "text", PIECE_BYTES):
            doc, h = shingles(texts, width)
            sizes = np.bincount(doc, minlength=len(texts))
            name = _class_name(doc, h, sizes)
            fresh = np.zeros(len(texts), bool)
            for i, x in enumerate(name.tolist()):  # a copy repeats its class's signatures
                fresh[i] = x not in seen
                if len(seen) < SEEN:
                    seen.add(x)
            keep = fresh[doc]
            owner, key, window = windowed_signatures(doc[keep], h[keep], np.where(fresh, sizes, 0), percent)
            mine = key % np.uint64(PARTS) == part
            yield pa.RecordBatch.from_arrays([C.signed(name[owner[mine]]), C.signed(key[mine]), C.signed(window[mine])],
                                             names=["lo", "key", "window"])
    return fn


def _sets(width: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text", PIECE_BYTES):
            doc, h = shingles(texts, width)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])
            yield pa.RecordBatch.from_arrays(
                [rows.column("lo"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), C.signed(h))],
                names=["lo", "grams"])
    return fn


def _sketches(width: int):
    """Each set's size and a parity sketch of 4 to 8 bits an element, in the column of sets."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in C.text_chunks(batches, "text", PIECE_BYTES):
            doc, h = shingles(texts, width)
            spot = C.mix64(h + np.uint64(11))
            found = []
            for k, n in enumerate(np.bincount(doc, minlength=len(texts)).tolist()):
                bits = 1 << max(10, (4 * n - 1).bit_length())
                at = spot[doc == k] if len(texts) < 2 else spot[slice(*np.searchsorted(doc, [k, k + 1]))]
                odd = np.bincount((at & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
                found.append(np.concatenate([[n], np.packbits(odd).view(np.int64)]))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            yield pa.RecordBatch.from_arrays(
                [rows.column("lo"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int64()))],
                names=["lo", "grams"])
    return fn


def _sieved(percent: int):
    """Keeps the pairs whose sketches differ in no more bits than linked sets in elements."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = int(x[0] + y[0])
                x, y = x[1:], y[1:]
                while len(x) > len(y):  # a place is the low bits of a hash, so halves fold onto each other
                    x = x[:len(x) // 2] ^ x[len(x) // 2:]
                while len(y) > len(x):
                    y = y[:len(y) // 2] ^ y[len(y) // 2:]
                apart = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
                keep[i] = apart <= (100 - percent) * both // (100 + percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return fn


def _verified(percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = len(x) + len(y)
                shared = both - len(np.unique(np.concatenate([x, y])))
                keep[i] = 100 * shared >= percent * (both - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return fn


def _may_link(percent: int) -> str:
    """Whether sets ``x`` and ``y`` can link, by their parity sketches.

    A sketch holds for each bucket of the universe whether the set has an odd
    number of elements in it, so sketches differ in no more buckets than the sets
    in elements; that number is bounded for linked sets.
    """
    apart = " + ".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(SKETCH_BITS // 64))
    return f"{apart} <= ({100 - percent} * (x.n + y.n)) div {100 + percent}"


def _tested(pairs: DataFrame, fetch, test, scratch: C.Scratch, tag: str) -> DataFrame:
    """Those of ``pairs(a, b)`` that pass a test of what ``fetch`` gives for their classes.

    All pairs are tested, in as many blocks as keep what travels with a block's
    pairs within the size of the table fetched.
    """
    both = pairs.select(F.explode(F.array("a", "b")).alias("lo")).distinct()
    sets = scratch.write(fetch(both), f"{tag}_sets")
    left = sets.select(F.col("lo").alias("a"), F.col("grams").alias("sa"))
    right = sets.select(F.col("lo").alias("b"), F.col("grams").alias("sb"))
    size = sets.select("lo", F.size("grams").cast("bigint").alias("m"))
    moved = pairs.join(size.withColumnRenamed("lo", "a"), "a").agg(F.sum("m")).first()[0] or 0
    held = size.agg(F.sum("m")).first()[0] or 1
    found = None
    blocks = max(1, -(-moved // held))
    for k in range(blocks):
        some = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)) == k)
        one = scratch.write(some.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
                            .mapInArrow(test, "a bigint, b bigint"), f"{tag}{k}")
        found = one if found is None else found.unionByName(one)
    scratch.drop(f"{tag}_sets")
    return found


def _links(pairs: DataFrame, fetch, width: int, percent: int, scratch: C.Scratch, tag: str) -> DataFrame:
    """Those of ``pairs(a, b)`` that link: long sketches sort most others out, whole sets decide."""
    near = _tested(pairs, lambda c: fetch(c, _sketches(width)), _sieved(percent), scratch, f"{tag}_near")
    return _tested(near, lambda c: fetch(c, _sets(width)), _verified(percent), scratch, tag)


def _fetch(docs: DataFrame, profile: DataFrame, wanted: DataFrame, made) -> DataFrame:
    """What ``made`` makes of the classes in ``wanted(lo)``, one text of each class read again."""
    one = profile.groupBy("lo").agg(F.min("rid").alias("rid")).join(wanted, "lo")
    return (docs.select("rid", "text").join(one, "rid").select("lo", "text")
            .mapInArrow(made, "lo bigint, grams array<bigint>"))


def _same_window(x: str, y: str) -> str:
    """Whether two windows of one key differ in fewer elements than they have segments, as some of any linked pair do."""
    return f"bit_count({x} ^ {y}) < {WINDOW}"


def _shared(rows: DataFrame) -> DataFrame:
    """Those of ``rows(lo, key, window)`` whose key has several classes, unless these are two whose windows differ."""
    group = Window.partitionBy("key")
    several = rows.select("*", F.min("lo").over(group).alias("low"), F.max("lo").over(group).alias("high")).where("low <> high")
    there = several.select("*", *(F.max(F.when(F.expr(when), F.col("window"))).over(group).alias(name) for name, when in
                                  (("wl", "lo = low"), ("wh", "lo = high"), ("between", "lo <> low and lo <> high"))))
    return there.where(f"between is not null or {_same_window('wl', 'wh')}").select("key", "lo", "window")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``rid, doc_id, n_shingles, component, component_id`` of every row of ``docs(doc_id, text)``.

    ``rid`` is a hash of (doc_id, text), ``component`` a hash that names the
    component even where no member has an id.
    """
    scratch = C.Scratch(docs.sparkSession, "jaccard")
    src = docs.select(C.row_key("doc_id", "text").alias("rid"), "doc_id", "text")
    profile = scratch.write(src.mapInArrow(
        _profile(width), "rid bigint, doc_id bigint, n bigint, lo bigint, sketch array<bigint>"), "profile")
    slim = profile.select("rid", "doc_id", "n", "lo")

    # keys are larger than the texts: computed again for each part of them rather than kept
    star = None
    for part in range(PARTS):
        rows = src.select("text").mapInArrow(_signed_sets(width, percent, part), "lo bigint, key bigint, window bigint")
        one = scratch.write(_shared(rows), f"star{part}")
        star = one if star is None else star.unionByName(one)
    # the hub of a group: the class with most shared signatures, as the original of edited copies is
    degree = scratch.write(star.groupBy("lo").agg(F.count("*").alias("degree")), "degree")
    led = star.join(degree, "lo")
    hub = scratch.write(led.groupBy("key").agg(F.max_by("lo", "degree").alias("hub"), F.max("degree").alias("top")), "hub")
    # each class first meets the greatest of its groups' hubs only
    first = star.join(hub, "key").where("lo <> hub").groupBy("lo").agg(F.max_by("hub", "top").alias("hub"))
    known = scratch.write(profile.select("lo", "n", "sketch").join(degree.select("lo"), "lo").dropDuplicates(["lo"]), "known")

    def sketched(pairs):
        x = known.select(F.col("lo").alias("a"), F.struct("n", "sketch").alias("x"))
        y = known.select(F.col("lo").alias("b"), F.struct("n", "sketch").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(_may_link(percent)).select("a", "b")
    tested = scratch.write(sketched(_pairs(first, "lo", "hub")), "tested")

    def fetch(classes, made):
        return _fetch(src, slim, classes, made)
    scratch.drop("hub")
    links = _links(tested, fetch, width, percent, scratch, "links")
    comp = scratch.write(C.components(links, scratch, "cc1"), "comp1")

    # pairs that share a group but are in different components so far
    label = star.join(comp.withColumnRenamed("node", "lo"), "lo", "left").select(
        "key", "lo", "window", F.coalesce("component", "lo").alias("c"))
    label = scratch.write(label.distinct(), "label")
    parts = label.groupBy("key", "c").agg(F.count("*").alias("m"))
    open_keys = scratch.write(
        parts.groupBy("key").agg(F.max(F.struct("m", "c")).alias("major"), F.count("*").alias("k"))
        .where("k > 1").select("key", F.col("major.c").alias("major")), "open")
    rest = scratch.write(label.join(open_keys, "key"), "rest")
    member = rest.select("key", F.struct("lo", "c", "window").alias("x"))
    minor = rest.where("c <> major").select("key", F.struct("lo", "c", "window").alias("y"))
    more = _pairs(member.join(minor, "key").where(f"x.c <> y.c and {_same_window('x.window', 'y.window')}")
                  .select(F.col("x.lo").alias("lo"), F.col("y.lo").alias("lo2")), "lo", "lo2")
    more = scratch.write(sketched(more.join(tested, ["a", "b"], "left_anti")), "more")
    comp2 = C.components(links.unionByName(_links(more, fetch, width, percent, scratch, "more_links")), scratch, "cc2")

    named = scratch.write(slim.join(comp2.withColumnRenamed("node", "lo"), "lo", "left")
                          .select("rid", "doc_id", "n", F.coalesce("component", "lo").alias("c")), "named")
    names = scratch.write(named.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("name")), "names")
    scratch.drop("profile", *(f"star{part}" for part in range(PARTS)), "degree", "known", "tested", "label", "open", "rest", "more")
    return named.join(names, "c", "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id.

    Documents without words stay.
    """
    scratch = C.Scratch(docs.sparkSession, "one")
    found = scratch.write(jaccard_components(docs, width, percent), "found")
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy(
        "component").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("one"))
    stay = chosen.unionByName(found.where("n_shingles = 0").select("rid", F.lit(False).alias("one")).distinct())
    rows = docs.select(C.row_key("doc_id", "text").alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # equal rows share a rid; one of them stays
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.lit(1)))
    return rows.join(scratch.write(stay, "stay"), "rid").withColumn("k", rank).where("k = 1 or not one").select("row.*")
