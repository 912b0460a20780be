"""Embedding near-duplicates over one small-world graph per shard.

Equal vectors form one class.  Classes are dealt to shards by hash, at most
``SHARD_ROWS`` on average.  Every shard gets a hierarchical navigable small-world
graph: each layer holds a random part of the one below, and is built from the
top, in batches that are searched in lockstep.  Every shard's vectors then query
every shard, and links that either side finds count.

*Beams.* A query whose beam is full of hits repeats with twice the beam, and
beyond ``WIDEST`` is compared with the whole shard.  A fixed part of each shard
(``AUDIT``) is also compared with the whole other shard, and so are as many
planted near copies of the other shard's vectors; while the graph finds less
than ``RECALL`` of the links of either, averaged over the queries that have any,
all beams of the pair of shards double.  If the audited vectors of all pairs of
shards together had found less at the first beam, everything repeats with twice
that beam.

*Results.* A candidate within rounding of the threshold is verified by cosine in
double precision.  A task counts links and unites them part by part and returns
the counts and a spanning forest, never all pairs; the forests are united into
components.

A vector that is null, empty, all zero or holds a null or non-finite component
links with nothing; vectors of different lengths are not compared.  A null
vec_id takes part and names a component only if no member has an id.  Repeated
rows are vectors of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import common as C

SHARDS = 8              # at least, for parallel work
SHARD_ROWS = 1 << 16
NEIGHBOURS = 12         # twice as many on the lowest layer
BUILD_BEAM = 32
FIRST_BEAM = 64
BATCH = 256
AUDIT = 0.02            # share of a shard that is audited, at least AUDIT_LEAST vectors
AUDIT_LEAST = 64
RECALL = 0.98
WIDEST = 256            # a wider beam is replaced by comparing with the whole shard
PART = 1 << 20          # comparisons at a time


class Graph:
    """Small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        n = len(vectors)
        self.vectors = vectors
        draw = np.random.default_rng(seed).random(n)
        height = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members, neighbour table (by vector, -1: none)
        top = int(height.max(initial=0))
        entry = np.flatnonzero(height == top)[:1]
        for level in range(top, -1, -1):
            members = np.flatnonzero(height >= level)
            width = NEIGHBOURS * (1 if level else 2)
            table = np.full((n, width), -1, np.int32)
            order = members[np.argsort(-height[members], kind="stable")]
            self._fill(order, table, entry)
            self.layers.append((members, table))

    def _entry(self, queries: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Start of each query on the next layer: greedy descent through the finished ones."""
        at = np.full(len(queries), first[0])
        for _, table in self.layers:
            at = self._beam(queries, at[:, None], table, 1)[0][:, 0]
        return at

    def _beam(self, queries: np.ndarray, start: np.ndarray, table: np.ndarray, width: int):
        """Lockstep beam search: ids and similarities (descending, -1 and -2 where there is none)."""
        q, n = len(queries), len(self.vectors)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -2.0, np.float32)
        done = np.ones((q, width), bool)
        k = min(width, start.shape[1])
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.einsum("qd,qkd->qk", queries, self.vectors[start[:, :k]])
        done[:, :k] = False
        seen = np.zeros((q, n), bool)
        seen[np.arange(q)[:, None], start] = True
        live = np.arange(q)
        while len(live):
            open_ = np.where(done[live], -3.0, sims[live])
            pick = open_.argmax(1)
            go = open_[np.arange(len(live)), pick] > -3.0
            live, pick = live[go], pick[go]
            if not len(live):
                break
            done[live, pick] = True
            near = table[ids[live, pick]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(near >= 0, near, ids[live, pick][:, None])] = True
            s = np.where(fresh, np.einsum("qd,qkd->qk", queries[live], self.vectors[near]), np.float32(-2.0))
            all_s = np.concatenate([sims[live], s], 1)
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
            all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_d = np.concatenate([done[live], ~fresh], 1)
            sims[live] = np.take_along_axis(all_s, best, 1)
            ids[live] = np.take_along_axis(all_i, best, 1)
            done[live] = np.take_along_axis(all_d, best, 1)
        return ids, sims

    def _choose(self, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Diverse neighbours: a candidate nearer to a chosen one than to the base waits to the end."""
        q, k = ids.shape
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        vec = self.vectors[np.maximum(ids, 0)]
        among = np.einsum("qkd,qjd->qkj", vec, vec)
        chosen = np.zeros((q, k), bool)
        for j in range(k):
            rival = np.where(chosen, among[:, j, :], -2.0).max(1)
            chosen[:, j] = (ids[:, j] >= 0) & (rival <= sims[:, j]) & (chosen.sum(1) < width)
        rank = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :width]
        out = np.full((q, width), -1, np.int32)
        out[:, :rank.shape[1]] = np.take_along_axis(ids, rank, 1)
        return out

    def _link_back(self, table: np.ndarray, new: np.ndarray) -> None:
        """Adds the reverse of new links; tables that overflow are chosen anew."""
        width = table.shape[1]
        src = np.repeat(new, width)
        dst = table[new].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(nodes), BATCH):
            node, f, c = nodes[a:a + BATCH], first[a:a + BATCH], count[a:a + BATCH]
            more = np.full((len(node), int(c.max())), -1, np.int64)
            slot = np.arange(more.shape[1])[None, :] < c[:, None]
            more[slot] = src[np.repeat(f, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            both = np.concatenate([table[node].astype(np.int64), more], 1)
            s = np.einsum("qd,qkd->qk", self.vectors[node], self.vectors[np.maximum(both, 0)])
            both_sorted = np.sort(both, axis=1)
            twice = np.zeros_like(both, bool)
            twice[:, 1:] = both_sorted[:, 1:] == both_sorted[:, :-1]
            at = np.argsort(both, axis=1, kind="stable")
            dup = np.zeros_like(twice)
            np.put_along_axis(dup, at, twice, axis=1)
            both = np.where(dup, -1, both)
            table[node] = self._choose(node, both, np.where(both >= 0, s, np.float32(-2.0)), width)

    def _fill(self, order: np.ndarray, table: np.ndarray, entry: np.ndarray) -> None:
        width = table.shape[1]
        placed = 1
        while placed < len(order):
            new = order[placed:placed + min(BATCH, placed)]
            q = self.vectors[new]
            start = self._entry(q, entry) if self.layers else np.full(len(new), order[0])
            ids, sims = self._beam(q, start[:, None], table, BUILD_BEAM)
            own = (q @ q.T).astype(np.float32)
            np.fill_diagonal(own, -2.0)
            k = min(len(new) - 1, BUILD_BEAM)
            near = np.argsort(-own, axis=1, kind="stable")[:, :k]
            ids = np.concatenate([ids, new[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], 1)
            table[new] = self._choose(new, ids, sims, width)
            self._link_back(table, new)
            placed += len(new)

    def parts(self, queries: np.ndarray, width: int, threshold: float):
        """Pairs of at least ``threshold`` in parts of bounded size.

        Each part has query numbers, vector numbers, similarities and the queries
        it compared with every vector (none if it followed the graph).
        """
        n = len(self.vectors)
        todo = np.arange(len(queries))
        if width < n and width <= WIDEST:
            upper = Graph.__new__(Graph)
            upper.vectors, upper.layers = self.vectors, self.layers[:-1]
            at = upper._entry(queries, self.layers[0][0][:1])
        while len(todo) and width < n and width <= WIDEST:
            ids, sims = self._beam(queries[todo], at[todo][:, None], self.layers[-1][1], width)
            hit = sims >= threshold
            full = hit[:, -1]
            a, b = np.nonzero(hit & ~full[:, None])
            yield todo[a], ids[a, b], sims[a, b], todo[:0]
            todo, width = todo[full], width * 2
        step = max(1, PART // max(1, n))
        for x in range(0, len(todo), step):
            some = todo[x:x + step]
            sims = queries[some] @ self.vectors.T
            a, b = np.nonzero(sims >= threshold)
            yield some[a], b, sims[a, b], some

    def search(self, queries: np.ndarray, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector numbers of the found pairs of at least ``threshold``."""
        found = [(q, v) for q, v, _, _ in self.parts(queries, width, threshold)]
        return np.concatenate([q for q, _ in found]), np.concatenate([v for _, v in found])


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(1, keepdims=True)
    b = b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class _Forest:
    """Spanning forest of the links seen so far."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x in range(0, len(a), 1 << 15):
            self._add(a[x:x + (1 << 15)], b[x:x + (1 << 15)])

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        while (self.parent != self.parent[self.parent]).any():
            self.parent = self.parent[self.parent]
        ra, rb = self.parent[a], self.parent[b]
        open_ = np.flatnonzero(ra != rb)
        if len(open_):  # one link for each pair of trees
            open_ = open_[np.unique(ra[open_] * len(self.parent) + rb[open_], return_index=True)[1]]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            rx, ry = self.root(x), self.root(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)
                self.edges.append((x, y))


def planted(vectors: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Unit vectors with a cosine of ``threshold`` to 1 to ``n`` of the given ones, in random directions."""
    r = np.random.default_rng(13)
    base = vectors[r.integers(0, len(vectors), n)].astype(np.float64)
    away = r.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    t = r.uniform(threshold, 1, (n, 1))
    return unit(t * base + np.sqrt(1 - t * t) * away)


def _found(graph: Graph, queries: np.ndarray, own: np.ndarray, beam: int, near: float) -> np.ndarray:
    """Vectors found by each query, without itself (``own``, -1 if it isn't there)."""
    n = np.zeros(len(queries), np.int64)
    for x in range(0, len(queries), BATCH):
        for q, v, _, _ in graph.parts(queries[x:x + BATCH], beam, near):
            n += np.bincount((q + x)[v != own[q + x]], minlength=len(queries))
    return n


def audit(queries: np.ndarray, graph: Graph, same: bool, threshold: float, near: float, beam: int):
    """The beam that finds enough, and of the audited queries at the first beam: their number, their found shares' sum."""
    least = max(AUDIT, AUDIT_LEAST / len(queries))
    some = np.flatnonzero(np.random.default_rng(11).random(len(queries)) < least)
    made = planted(graph.vectors, max(1, len(some)), threshold)
    probes = [(queries[some], some if same else np.full(len(some), -1)), (made, np.full(len(made), -1))]
    truth = [_found(graph, q, own, len(graph.vectors), near) for q, own in probes]
    first = None
    while True:
        shares = [(_found(graph, q, own, beam, near) / np.maximum(t, 1))[t > 0] for (q, own), t in zip(probes, truth)]
        first = first or (len(shares[0]), float(shares[0].sum()))
        recall = min((float(x.mean()) for x in shares if len(x)), default=1.0)
        if recall >= RECALL or beam >= len(graph.vectors) or beam > WIDEST:
            return beam, recall, first
        beam *= 2


def match_shards(left: dict, right: dict, same: bool, threshold: float, beam: int = FIRST_BEAM):
    """Links between two shards: neighbour counts of both sides, forest edges, recall, beam and audited queries.

    Both sides search the other's graph.  Links are counted and united part by
    part; kept are only those of queries that followed the graph, under
    ``WIDEST`` each, to tell which links the other side found as well.
    """
    a, b = left["vectors"], right["vectors"]
    margin = max(1e-4, 2e-7 * a.shape[1])
    near, sure = threshold - margin, threshold + margin
    shift = 0 if same else len(a)
    count_a, count_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    forest = _Forest(len(a) + (0 if same else len(b)))
    whole = np.zeros(len(a), bool)
    kept: list[np.ndarray] = []

    def links(x, vectors, others, graph, units, width):
        """Verified links of queries ``x``, and the queries that were compared with all."""
        for q, v, s, all_of in graph.parts(units[x], width, near):
            q = x[q]
            ok = s >= sure
            doubt = np.flatnonzero(~ok)
            for y in range(0, len(doubt), 1 << 16):
                some = doubt[y:y + (1 << 16)]
                ok[some] = cosine(vectors[q[some]], others[v[some]]) >= threshold
            if same:
                ok &= q != v
            yield q[ok], v[ok], x[all_of], len(all_of) > 0

    def count(q, v):
        np.add.at(count_a, q, right["copies"][v])
        if not same:
            np.add.at(count_b, v, left["copies"][q])
        forest.add(q, v + shift)

    ua = left["graph"].vectors
    width, recall, audited = audit(ua, right["graph"], same, threshold, near, beam)
    for x in range(0, len(a), BATCH):
        for q, v, all_of, exact in links(np.arange(x, min(x + BATCH, len(a))), a, b, right["graph"], ua, width):
            count(q, v)
            whole[all_of] = True
            if not exact:
                kept.append(q * len(b) + v)
    known = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    kept.clear()
    known.sort()

    def count_new(q, v):
        """Links of a's vectors that only the other side found."""
        code = (q * len(b) + v)[~whole[q]]
        if len(known):
            spot = np.minimum(np.searchsorted(known, code), len(known) - 1)
            code = code[known[spot] != code]
        count(code // len(b), code % len(b))

    if same:
        for x in range(0, len(known), 1 << 20):
            count_new(known[x:x + (1 << 20)] % len(b), known[x:x + (1 << 20)] // len(b))
        again = np.flatnonzero(whole) if not whole.all() else np.zeros(0, np.int64)
        for x in range(0, len(again), BATCH):
            for q, v, _, _ in links(again[x:x + BATCH], a, b, right["graph"], ua, len(b)):
                count_new(v, q)
        return left["keys"], count_a, forest.edges, recall, width, audited
    if not whole.all():
        ub = right["graph"].vectors
        back, recall_b, audited_b = audit(ub, left["graph"], same, threshold, near, beam)
        for x in range(0, len(b), BATCH):
            for v, q, _, _ in links(np.arange(x, min(x + BATCH, len(b))), b, a, left["graph"], ub, back):
                count_new(q, v)
        recall, width = min(recall, recall_b), max(width, back)
        audited = audited[0] + audited_b[0], audited[1] + audited_b[1]
    return (np.concatenate([left["keys"], right["keys"]]), np.concatenate([count_a, count_b]), forest.edges,
            recall, width, audited)


def _build(table: pa.Table) -> pa.Table:
    vectors = np.array(table.column("embedding").to_pylist(), np.float64)
    keys, copies = table.column("key").to_numpy(), table.column("copies").to_numpy()
    order = np.argsort(keys, kind="stable")
    vectors, keys, copies = vectors[order], keys[order], copies[order]
    if np.array_equal(vectors.astype(np.float32), vectors):
        vectors = vectors.astype(np.float32)
    graph = Graph(unit(vectors.astype(np.float64)))
    blob = pickle.dumps({"vectors": vectors, "keys": keys, "copies": copies, "layers": graph.layers}, protocol=5)
    return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "shard": table.column("shard").slice(0, 1),
                     "graph": pa.array([blob], pa.binary())})


def _load(blob: bytes) -> dict:
    d = pickle.loads(blob)
    d["vectors"] = d["vectors"].astype(np.float64)
    g = Graph.__new__(Graph)
    g.vectors, g.layers = unit(d["vectors"]), d["layers"]
    d["graph"] = g
    return d


def _query(threshold: float, first_beam: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                left = _load(batch.column("ga")[i].as_py())
                right = left if a == b else _load(batch.column("gb")[i].as_py())
                names, counts, edges, recall, beam, audited = match_shards(left, right, a == b, threshold, first_beam)
                some = np.flatnonzero(counts)
                none = [None] * len(some)
                x, y = zip(*edges) if edges else ((), ())
                rest = [None] * (len(some) + len(edges))
                yield pa.RecordBatch.from_arrays(  # the last row tells of the audit
                    [pa.array(names[some].tolist() + (names[list(x)].tolist() if x else []) + [None], pa.int64()),
                     pa.array(none + (names[list(y)].tolist() if y else []) + [None], pa.int64()),
                     pa.array(counts[some].tolist() + [None] * (len(edges) + 1), pa.int64()),
                     pa.array([recall] * (len(rest) + 1), pa.float64()), pa.array([beam] * (len(rest) + 1), pa.int64()),
                     pa.array(rest + [audited[0]], pa.int64()), pa.array(rest + [audited[1]], pa.float64())],
                    names=["u", "v", "n", "recall", "beam", "audited", "shares"])
    return fn


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id`` of every row of ``vectors(vec_id, embedding)``."""
    scratch = C.Scratch(vectors.sparkSession, "hnsw")
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("key", F.when(F.col("fine"), F.xxhash64("embedding")))
    classes = scratch.write(rows.where("fine").groupBy("key").agg(
        F.first("embedding").alias("embedding"), F.count("*").alias("copies")), "classes")
    total = classes.count()
    shards = max(SHARDS, -(-total // SHARD_ROWS))
    dealt = classes.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards)).cast("int")
                           .alias("shard"), "key", F.col("embedding").cast("array<double>").alias("embedding"), "copies")
    graphs = scratch.write(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, graph binary"), "graphs")
    ids = graphs.select("dim", F.col("shard").alias("a"))
    pairs = ids.select("dim", "a", F.explode(F.sequence("a", F.lit(shards - 1))).alias("b"))
    loaded = (pairs.join(graphs.select("dim", F.col("shard").alias("a"), F.col("graph").alias("ga")), ["dim", "a"])
              .join(graphs.select("dim", F.col("shard").alias("b"), F.col("graph").alias("gb")), ["dim", "b"]))
    dealt_pairs = loaded.repartition(max(1, shards * (shards + 1) // 2), "a", "b").select("a", "b", "ga", "gb")
    beam = FIRST_BEAM
    while True:
        found = scratch.write(dealt_pairs.mapInArrow(
            _query(threshold, beam), "u bigint, v bigint, n bigint, recall double, beam bigint, audited bigint, shares double"), "found")
        pooled = found.agg(F.sum("audited").alias("n"), F.sum("shares").alias("shares")).first()
        if beam > WIDEST or (pooled["shares"] or 0) >= RECALL * (pooled["n"] or 0):
            break
        beam *= 2
    comp = scratch.write(C.components(found.where("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b")), scratch),
                         "components")
    links = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("n"))
    named = (classes.select("key", "copies").join(links.withColumnRenamed("u", "key"), "key", "left")
             .join(comp.withColumnRenamed("node", "key"), "key", "left")
             .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "key").alias("c")))
    named = scratch.write(named, "named")
    whole = scratch.write(rows.select("vec_id", "key").join(named, "key", "left"), "whole")
    names = scratch.write(whole.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("name")), "names")
    scratch.drop("graphs", "found", "components")
    return whole.join(names, "c", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("c").isNotNull(), F.col("name")).otherwise(F.col("vec_id")).alias("component_id"))
