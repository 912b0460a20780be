"""Boosted trees over many rows: ``GBTClassifier``'s trees, grown from binned cells.

``GBTClassifier`` updates every slot of a vector for every row at every level of
every tree.  Here rows that fall in the same bins with the same label are one cell
with a count, a cell keeps only the bins in which it differs from an all-zero
vector, and a level of a tree is one job that adds up histograms:

* split points: at most ``BINS`` bins a slot by the rule of Spark's trees, but from
  the counts of all rows instead of a sample;
* cells: a ``groupBy`` on the bin codes, written once and packed in blocks of
  ``CELLS`` cells (numpy arrays), which the tasks keep;
* blocks hold the first unlike bin of every cell, then the second of the cells that
  have two, and so on, cells with most of them in front: each run covers the first cells;
* a round: residuals of the logistic loss, a job per level, splits picked from the
  histograms, which the driver adds up (a block sends the size of the model's level);
  of two sibling nodes the smaller one is counted, the other is the rest of its parent;
* residuals are whole multiples of a power of two, so sums are the same in any order
  and do not depend on partitions; row samples of a round are binomial draws per cell.

The trees are stored in the format of ``GBTClassificationModel`` and loaded as one,
so scoring, importance, SHAP and saving are Spark's.
"""

from __future__ import annotations

import json
import math
import pickle
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F

from caseflow.session import scratch_path

BINS = 32           # as GBTClassifier's maxBins
CELLS = 200_000     # cells of one block at most
LEAST = 30_000      # and about as many at least: small blocks cost more time than they save
ALONE = 7             # so many blocks' cells at most are one block, whose trees are all grown in one task
FEW = 3               # fewer rounds are grown by a job a level in any case
CUT_EVERY = 50        # rounds after which the blocks are written to the checkpoint folder, which ends their lineage


# ---------------------------------------------------------------- bins and cells

def split_points(rows: DataFrame, features: str) -> list[np.ndarray]:
    """Split points of each slot: all midpoints of at most ``BINS`` values, else about equal shares of the rows.

    The share rule is that of Spark's trees: a midpoint is taken when the running
    count gets further from the next multiple of n / ``BINS`` by the next value.  A
    value can only be chosen among the first ``BINS`` after each multiple, so that
    many reach the driver, whatever the number of values.
    """
    spark = rows.sparkSession
    n, width = rows.select(F.count(F.lit(1)), F.max(F.size(vector_to_array(features)))).first()
    long = rows.select(F.posexplode(vector_to_array(features)).alias("slot", "v")).where("v != 0")
    counts = long.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("c"))
    ranged = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "slot", "v") \
        .withColumn("p", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    zeros = {r["slot"]: n - r["s"] for r in ranged.groupBy("slot").agg(F.sum("c").alias("s")).collect()}  # one row a slot
    zero = spark.createDataFrame([(f, 0.0, zeros.get(f, n)) for f in range(width)], "slot int, v double, c bigint").where("c > 0")
    # zeros sort between the negative and the positive values of their slot: they form parts of their own
    signed = ranged.withColumn("g", F.signum("v").cast("int")).unionByName(
        zero.withColumns({"p": F.lit(0), "g": F.lit(0)}))
    chunks = signed.groupBy("slot", "g", "p").agg(F.sum("c").alias("s"), F.max("v").alias("last"), F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("slot").orderBy("g", "p")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("slot", "g", "p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"),
                           F.lag("last").over(order).alias("prior"), F.sum("k").over(Window.partitionBy("slot")).alias("values"))
    run = Window.partitionBy("slot", "g", "p").orderBy("v")
    cum = signed.withColumns({"cum": F.sum("c").over(run.rowsBetween(Window.unboundedPreceding, 0)), "lag": F.lag("v").over(run)}) \
        .join(F.broadcast(chunks), ["slot", "g", "p"]) \
        .select("slot", "v", "values", F.coalesce("lag", "prior").alias("prev"),
                (F.ceil((2 * (F.col("cum") + F.col("off")) - F.col("c")) * BINS / F.lit(2.0 * max(n, 1))) - 1).alias("share"))
    first = F.row_number().over(Window.partitionBy("slot", "share").orderBy("v"))
    kept = cum.withColumn("nth", first).where(F.col("nth") <= BINS).orderBy("slot", "v").collect()
    ranged.unpersist()
    points = [[] for _ in range(width)]
    for r in kept:
        mine = points[r["slot"]]
        if r["prev"] is not None and (r["values"] <= BINS or r["share"] > len(mine)):
            mine.append((r["prev"] + r["v"]) / 2.0)
    return [np.array(p) for p in points]


@dataclass
class Binned:
    """Cells below ``path`` (code, y, val, n), the split points, and the train rows they stand for."""

    path: str
    points: list
    n_train: int
    n_cells: int
    packed: dict = field(default_factory=dict)  # (with val?, parts) → where the blocks lie
    lock: object = field(default_factory=Lock)


def bin_rows(rows: DataFrame, label: str, features: str, val=None) -> Binned:
    """Count the rows of each cell; ``val`` marks rows that only tell when to stop and set no split points."""
    spark = rows.sparkSession
    val = F.lit(False) if val is None else val
    points = split_points(rows.where(~val), features)

    def code(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, len(points)).T.copy()
            codes = np.empty((b.num_rows, len(points)), np.uint8)
            for f, p in enumerate(points):
                codes[:, f] = x[f] > p[0] if len(p) == 1 else np.searchsorted(p, x[f], "left")
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(points)
            text = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([text, b.column(1), b.column(2)], names=["code", "y", "val"])

    path = scratch_path(spark, "cells")
    y = F.col(label).cast("double")
    y = F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit(f"labels in {label} must be 0 or 1")).cast("double"))
    coded = rows.select(vector_to_array(features).alias("x"), y.alias("y"), val.alias("val")) \
        .mapInArrow(code, "code binary, y double, val boolean")
    coded.groupBy("code", "y", "val").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    n_cells, n_train = spark.read.parquet(path).select(F.count(F.lit(1)), F.sum(F.when(~F.col("val"), F.col("n")))).first()
    return Binned(path, points, n_train or 0, n_cells)


def _packed(spark, binned: Binned, with_val: bool, parts: int | None = None) -> DataFrame:
    """The cells as pickled blocks, one a row; the blocks of a number of parts are packed and written once."""
    cells = spark.read.parquet(binned.path)
    cells = cells if with_val else cells.where("not val")
    cores = spark.sparkContext.defaultParallelism
    parts = parts or max(-(-binned.n_cells // CELLS), min(cores, -(-binned.n_cells // LEAST)), 1)
    off, zero, bins = _layout(binned.points)
    kind = np.int16 if bins < 1 << 15 else np.int32

    def pack(batches):
        flat, row, y, n, val, done = [], [], [], [], [], 0
        for b in batches:
            codes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, len(zero))
            r, f = np.nonzero(codes != zero)
            flat.append((off[f] + codes[r, f]).astype(kind))
            row.append((r + done).astype(np.int32))
            y.append((2.0 * b.column(1).to_numpy() - 1.0).astype(np.int8))
            val.append(b.column(2).to_numpy(zero_copy_only=False))
            n.append(b.column(3).to_numpy())
            done += b.num_rows
        if done:
            row, n = np.concatenate(row), np.concatenate(n)
            unlike = np.bincount(row, minlength=done)
            order = np.argsort(-unlike, kind="stable").astype(np.int32)
            rank = np.argsort(order, kind="stable")
            nth = np.arange(len(row)) - (np.cumsum(unlike) - unlike)[row]
            n = n.astype(np.int32) if n.max() < 1 << 31 else n
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(
                {"flat": np.concatenate(flat)[np.lexsort((rank[row], nth))], "runs": np.bincount(nth), "order": order,
                 "y": np.concatenate(y)[order], "n": n[order], "val": np.concatenate(val)[order],
                 "part": TaskContext.get().partitionId()})], pa.binary())], names=["block"])

    with binned.lock:
        if (with_val, parts) not in binned.packed:
            path = scratch_path(spark, "blocks")
            cells.repartition(parts, "code", "y", "val").sortWithinPartitions("code", "y", "val") \
                .mapInArrow(pack, "block binary").write.parquet(path)
            binned.packed[with_val, parts] = path
    return spark.read.parquet(binned.packed[with_val, parts])


def _blocks(spark, binned: Binned, with_val: bool, parts: int | None = None):
    """The cells as an RDD of numpy blocks: runs of bins unlike those of zero, label ±1, counts, places before sorting."""
    return _packed(spark, binned, with_val, parts).rdd.map(lambda r: pickle.loads(r[0]))


def _layout(points):
    """First flat bin and bin of zero of each slot, and the number of bins in all."""
    sizes = np.array([len(p) + 1 for p in points])
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array([np.searchsorted(p, 0.0, "left") for p in points]), int(sizes.sum())


# ---------------------------------------------------------------- inside the tasks

def _runs(b):
    """Each run of bins; the k-th bin of a run is that of cell k."""
    return np.split(b["flat"], np.cumsum(b["runs"])[:-1]) if len(b["runs"]) else []


def _step(b, tree, node):
    """Nodes of the cells of a block one level further down; leaves lead to themselves."""
    kind = b["flat"].dtype
    go = tree["zero_left"].take(node)
    lo, to = tree["lo"].astype(kind).take(node), (tree["cut"] - tree["lo"]).astype(kind).take(node)
    span = (tree["hi"] - tree["lo"]).astype(f"u{kind.itemsize}").take(node)
    for run in _runs(b):
        k = len(run)
        at = run - lo[:k]  # bins of other slots wrap around or lie beyond
        go[:k] ^= (at.view(span.dtype) < span[:k]) & (go[:k] ^ (at <= to[:k]))
    return tree["left"].take(node) + ~go  # the right child follows the left one


def _walk(b, tree, levels):
    """Node that each cell of a block reaches after ``levels`` steps."""
    node = np.zeros(len(b["y"]), np.intp)
    for _ in range(levels):
        node = _step(b, tree, node)
    return node


def _start(b, margin, m, scale, rate, seed):
    """State of a block before round ``m``: counts drawn, residuals in units of 1/scale."""
    y = b["y"].astype(float)
    r = y if m == 0 else 4.0 * y / (1.0 + np.exp(np.minimum(2.0 * y * margin, 700.0)))
    w = np.where(b["val"], 0, b["n"])
    if rate < 1.0:  # drawn in the order of the cells' codes
        coded = np.empty(len(w), np.int64)
        coded[b["order"]] = w
        w = np.random.default_rng([seed, m, b["part"]]).binomial(coded, rate)[b["order"]].astype(w.dtype)
    q = np.rint(r * scale)
    return {**b, "margin": margin, "w": w.astype(float), "wq": w * q, "q": q}


def _margin(b, trees, depth):
    """Margins of a block with the ``trees`` added."""
    margin = b.get("margin", np.zeros(len(b["y"])))
    for tree, weight in trees:
        margin = margin + weight * tree["value"][_walk(b, tree, depth)]
    return margin


def _histogram(b, node, level, slot, bins):
    """Sums of counts and residuals by (counted node, bin) and by counted node, then the loss on val."""
    k = int(slot.max()) + 1
    at = slot.take(node)
    cells = np.flatnonzero((at >= 0) & (b["w"] > 0))
    at, sums = at[cells], (b["w"][cells], b["wq"][cells])
    by_bin = np.zeros((2, k * bins))
    key = at * bins
    for run in _runs(b):
        inside = np.searchsorted(cells, len(run))
        where = key[:inside] + run[cells[:inside]]
        for i, x in enumerate(sums):
            by_bin[i] += np.bincount(where, x[:inside], k * bins)
    out = [part for h, x in zip(by_bin, sums) for part in (h, np.bincount(at, x, k))]
    loss = [0.0, 0.0]
    if level == 0 and b["val"].any():
        held = (b["n"] * b["val"]).astype(float)
        loss = [float(held @ (2.0 * np.logaddexp(0.0, -2.0 * b["y"] * b["margin"]))), float(held.sum())]
    return np.concatenate([*out, loss])


def _squares(b, node, k):
    """Sums of squared residuals by node."""
    return np.bincount(node, b["wq"] * b["q"], k)


class _Alone:
    """Sums over the one block there is: a fit is one task, which keeps the node of every cell from level to level."""

    def __init__(self, block, p):
        self.b, self.p, self.node = block, p, None

    def begin(self, m, trees):
        if self.node is None:
            margin = _margin(self.b, [(_arrays(t), w) for t, w in trees], self.p["depth"])
        else:
            (nodes, weight), = trees
            margin = self.b["margin"] + weight * np.array([x["value"] for x in nodes]).take(self.node)
        self.b = _start(self.b, margin, m, self.p["scale"], self.p["rate"], self.p["seed"])
        self.node = np.zeros(len(margin), np.intp)

    def sums(self, tree, level, slot):
        if level:
            self.node = _step(self.b, tree, self.node)
        return _histogram(self.b, self.node, level, slot, self.p["bins"])

    def squares(self, tree):
        self.node = _step(self.b, tree, self.node)
        return _squares(self.b, self.node, len(tree["left"]))


# ---------------------------------------------------------------- on the driver

def _best_splits(h, tot, off, zero, least, subset, scale):
    """Best split of each open node: gain by variance (0: none), flat bin of the cut, and the left sums."""
    k, bins = h.shape[1:]
    inside = np.add.reduceat(h, off, axis=2)
    h[:, :, off + zero] += tot[:, :, None] - inside
    c = np.cumsum(h, axis=2)
    slot_of = np.repeat(np.arange(len(off)), np.diff(np.append(off, bins)))
    left = c - (c - h)[:, :, off][:, :, slot_of]
    n, s = tot[0][:, None], tot[1][:, None] / scale
    nl, sl = left[0], left[1] / scale
    nr, sr = n - nl, s - sl
    ok = (nl >= least) & (nr >= least) & subset[:, slot_of]
    ok[:, np.append(off[1:], bins) - 1] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (sl * sl / nl + sr * sr / nr - s * s / n) / n, 0.0)
    best = gain.argmax(axis=1)
    at = np.arange(k)
    return gain[at, best], best, slot_of[best], left[:, at, best]


def _arrays(nodes):
    """The growing tree as arrays; a leaf's children are itself and its range of bins is empty."""
    col = lambda name, kind: np.array([x[name] for x in nodes], kind)
    return {"left": col("left", np.int32), "right": col("right", np.int32), "lo": col("lo", np.int32), "hi": col("hi", np.int32),
            "cut": col("cut", np.int32), "zero_left": col("zero_left", bool), "value": col("value", float)}


def _leaf(i, stats, scale):
    return {"left": i, "right": i, "lo": 0, "hi": 0, "cut": 0, "zero_left": True, "value": float(stats[1]) / scale / float(stats[0]) if stats[0] else 0.0,
            "stats": [float(stats[0]), float(stats[1]) / scale, 0.0], "gain": -1.0, "slot": -1}


class _Jobs:
    """Sums over many blocks: a job a level."""

    def __init__(self, base, p):
        self.base = self.state = base.persist(StorageLevel.MEMORY_AND_DISK)
        self.old, self.p = None, p

    def begin(self, m, trees):
        p, news = self.p, [(_arrays(t), w) for t, w in trees]
        self.old, self.state = self.state, self.state.map(lambda b: _start(
            b, _margin(b, news, p["depth"]), m, p["scale"], p["rate"], p["seed"])).persist(StorageLevel.MEMORY_AND_DISK)
        if m and m % CUT_EVERY == 0:
            self.state.checkpoint()

    def sums(self, tree, level, slot):
        bins = self.p["bins"]
        out = sum(self.state.map(lambda b: _histogram(b, _walk(b, tree, level), level, slot, bins)).collect())
        if level == 0 and self.old is not self.base:
            self.old.unpersist()
        return out

    def squares(self, tree):
        depth, k = self.p["depth"], len(tree["left"])
        return sum(self.state.map(lambda b: _squares(b, _walk(b, tree, depth), k)).collect())

    def close(self):
        self.state.unpersist()
        self.base.unpersist()


def _grow(p, over, growth=None):
    """Trees of all rounds from the sums ``over`` all cells; ``growth``: what an earlier call with fewer rounds returned."""
    depth, rounds, least, stop, scale = p["depth"], p["rounds"], p["least"], p["stop"], p["scale"]
    off, zero, bins, share = p["off"], p["zero"], p["bins"], p["share"]
    ends, width = np.append(off[1:], bins), len(off)
    rng = np.random.default_rng(p["seed"])
    forest, best_loss, best_m = [], None, 0
    if growth:
        forest, best_loss, best_m = list(growth["forest"]), growth["loss"], growth["best"]
        rng.bit_generator.state = growth["rng"]
    first = len(forest)

    def worse(tail):
        nonlocal best_loss, best_m
        loss = tail[0] / tail[1] if tail[1] else 0.0
        if best_loss is not None and best_loss < loss:
            return True
        if best_loss is None or loss < best_loss:
            best_loss, best_m = loss, len(forest)
        return False

    for m in range(first, rounds + bool(stop)):
        over.begin(m, forest if m == first else forest[-1:])
        nodes, open_, counted, kin, above = [], [0], [0], None, None
        for level in range(max(depth, 1)):
            tree = _arrays(nodes or [_leaf(0, (0, 0), scale)])
            slot = np.full(max(len(nodes), 1), -1, np.intp)
            slot[counted] = np.arange(len(counted))
            sums = over.sums(tree, level, slot)
            k = len(counted)
            parts = sums[:-2].reshape(2, k * (bins + 1))
            h, tot = parts[:, :k * bins].reshape(2, k, bins), parts[:, k * bins:]
            if kin:
                own, nth, parent = (np.array(x) for x in zip(*kin))
                h = np.where(own[:, None], h[:, nth], above[0][:, parent] - h[:, nth])
                tot = np.where(own, tot[:, nth], above[1][:, parent] - tot[:, nth])
            k = len(open_)
            if level == 0:
                if stop and m > 0 and worse(sums[-2:]) or m == rounds:
                    break
                nodes = [_leaf(0, tot[:, 0], scale)]
            if depth == 0:
                break
            subset = np.ones((k, width), bool)
            if share < width:
                subset = np.argsort(rng.random((k, width)), axis=1).argsort(axis=1) < share
            gain, cut, slots, left = _best_splits(h.copy(), tot, off, zero, least, subset, scale)
            tried, open_, counted, kin, above = open_, [], [], [], (h, tot)
            for j, i in enumerate(tried):
                if gain[j] <= 1e-15:
                    continue
                f, a = int(slots[j]), len(nodes)
                nodes[i].update(left=a, right=a + 1, lo=int(off[f]), hi=int(ends[f]), cut=int(cut[j]), slot=f, gain=float(gain[j]),
                                zero_left=bool(off[f] + zero[f] <= cut[j]))
                nodes += [_leaf(a, left[:, j], scale), _leaf(a + 1, tot[:, j] - left[:, j], scale)]
                more = [x for x in (a, a + 1) if nodes[x]["stats"][0] >= 2 * least]
                if more:
                    small = a if left[0, j] <= tot[0, j] - left[0, j] else a + 1
                    open_ += more
                    kin += [(x == small, len(counted), j) for x in more]  # counted itself?, the sibling that is, the parent
                    counted.append(small)
            if not open_:
                break
        if not nodes:  # val got worse, or the rounds are over
            break
        for i, sq in reversed(list(enumerate(over.squares(_arrays(nodes))))):
            x = nodes[i]
            x["stats"][2] = float(sq) / scale / scale + sum(nodes[j]["stats"][2] for j in {x["left"], x["right"]} - {i})
        forest.append((nodes, 1.0 if m == 0 else p["step"]))
    return {"forest": forest, "loss": best_loss, "best": best_m, "rng": rng.bit_generator.state}


def grow(spark, binned: Binned, est, stop: bool = False, growth=None):
    """Grow the estimator's boosted trees from the cells; ``stop``: end before the first round that does worse on val.

    Returns the trees and what is needed to go on with more rounds, which is then given as ``growth``.
    """
    off, zero, bins = _layout(binned.points)
    p = {"depth": est.getMaxDepth(), "rounds": est.getMaxIter(), "seed": est.getSeed(), "least": max(est.getMinInstancesPerNode(), 1),
         "step": est.getStepSize(), "rate": est.getSubsamplingRate(), "off": off, "zero": zero, "bins": bins, "stop": stop,
         "share": _subset_size(est.getFeatureSubsetStrategy(), len(off)),
         "scale": 2.0 ** math.floor(51 - math.log2(max(binned.n_train, 2)))}  # sums of residuals stay below 2^53
    if 0 < binned.n_cells <= ALONE * CELLS and p["rounds"] >= FEW:
        return _blocks(spark, binned, stop, 1).map(lambda b: _grow(p, _Alone(b, p), growth)).collect()[0]
    jobs = _Jobs(_blocks(spark, binned, stop), p)
    try:
        return _grow(p, jobs, growth)
    finally:
        jobs.close()


def boost(spark, binned: Binned, est, stop: bool = False):
    """Fit the estimator's boosted trees to the cells."""
    return as_model(spark, est, binned, grow(spark, binned, est, stop), stop)


def _subset_size(strategy: str, width: int) -> int:
    if strategy in ("all", "auto"):
        return width
    if strategy == "sqrt":
        return math.ceil(math.sqrt(width))
    return max(1, math.ceil(float(strategy) * width))


class _Blank:
    """Metadata of a one-tree model in Spark's format, to which other trees and the settings of another fit are given."""

    def __init__(self, spark, est, kind):
        row = [(Vectors.sparse(1, []), 0), (Vectors.sparse(1, []), 1)]
        small, path = est.copy({getattr(est, "maxIter", None) or est.numTrees: 1}), scratch_path(spark, "blank-model")
        small.clear(small.getParam("validationIndicatorCol")) if small.hasParam("validationIndicatorCol") else None
        small.fit(spark.createDataFrame(row, [est.getFeaturesCol(), est.getLabelCol()])).write().save(path)
        trees = spark.read.parquet(f"{path}/treesMetadata")
        self.kind, self.trees, self.tree = kind, trees.schema, json.loads(trees.first()[1])
        self.meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        self.nodes = spark.read.parquet(f"{path}/data").schema

    def load(self, spark, est, path, weights, width):
        """The model whose nodes lie below ``path``."""
        settings = {x.name: v for x, v in est.extractParamMap().items() if est.isSet(x) and x.name != "validationIndicatorCol"}
        own = {k: settings.get(k, v) for k, v in self.tree["paramMap"].items()}
        tree = json.dumps({**self.tree, "paramMap": own, "numFeatures": width})
        meta = {**self.meta, "uid": est.uid, "paramMap": settings, "numTrees": len(weights), "numFeatures": width}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        rows = [(t, tree, float(w)) for t, w in enumerate(weights)]
        spark.createDataFrame(rows, self.trees).coalesce(1).write.parquet(f"{path}/treesMetadata")
        return self.kind.load(path)


_BLANKS: dict = {}  # application and kind of model → its blank
_BLANKS_LOCK = Lock()


def _blank(spark, est, kind) -> _Blank:
    with _BLANKS_LOCK:
        key = spark.sparkContext.applicationId, kind
        if key not in _BLANKS:
            _BLANKS[key] = _Blank(spark, est, kind)
        return _BLANKS[key]


def as_model(spark, est, binned: Binned, growth, stop: bool = False):
    """The trees as a ``GBTClassificationModel``."""
    forest, points, off = growth["forest"][:growth["best"]] if stop else growth["forest"], binned.points, _layout(binned.points)[0]
    blank, path = _blank(spark, est, GBTClassificationModel), scratch_path(spark, "boosted")
    rows = []
    for t, (nodes, _) in enumerate(forest):
        for i, x in enumerate(nodes):
            n, s, sq = x["stats"]
            inner = x["slot"] >= 0
            split = (x["slot"], [float(points[x["slot"]][x["cut"] - off[x["slot"]]])], -1) if inner else (-1, [], -1)
            rows.append((t, (i, x["value"], max(sq / n - (s / n) ** 2, 0.0) if n else 0.0, [n, s, sq], int(n), x["gain"],
                             x["left"] if inner else -1, x["right"] if inner else -1, split)))
    spark.createDataFrame(rows, blank.nodes).write.parquet(f"{path}/data")
    return blank.load(spark, est, path, [w for _, w in forest], len(points))
