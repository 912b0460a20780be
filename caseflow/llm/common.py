"""Helpers shared by the corpus operators.

* :class:`Scratch` – named intermediate tables in the shared checkpoint folder.
* ``components`` – connected components of an edge table, distributed.
* vectorised word splitting and polynomial hashing over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import scratch_path

# Settings while a table is written: shuffle files go with it, and batches for Python stay small (texts are long).
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                 "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


class Scratch:
    """Intermediate tables below ``spark.checkpoint.dir``.

    Writing a table cuts its lineage, so a lost executor costs at most the step
    being computed.  Shuffle files of a step go once its table is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in WHILE_WRITING}
        try:
            for k, v in WHILE_WRITING.items():
                conf.set(k, v)
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols) -> F.Column:
    """A key of the row's own content: equal rows share it, and so share their result."""
    return F.xxhash64(*cols)


# ---------------------------------------------------------------- components

def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component = smallest node.

    Alternating large-star / small-star rounds: each hooks nodes to the smallest
    neighbour they know, until every component is a star.  Minima are combined
    before the shuffle, and written before they are joined back, so the join can
    be split when one node has very many neighbours.
    """
    step = 0
    e = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), f"{tag}_e0")
    state = _fingerprint(e)
    while state[0]:
        step += 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m"))
                            .select("u", F.least("u", "m").alias("m")), f"{tag}_l{step}")
        large = scratch.write(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .distinct(), f"{tag}_g{step}")
        # every pair of `large` points from a node to a smaller one
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}_m{step}")
        e2 = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
              .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        e2 = scratch.write(e2, f"{tag}_e{step}")
        now = _fingerprint(e2)
        scratch.drop(f"{tag}_e{step - 1}", f"{tag}_l{step}", f"{tag}_g{step}", f"{tag}_m{step}")
        e = e2
        if now == state:
            break
        state = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ---------------------------------------------------------------- batches of text

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK_BYTES = 1 << 20


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES):
    """``(rows, texts)`` pieces of Arrow batches: texts as bytes, about ``limit`` bytes a piece.

    A text is never cut; one longer than the limit forms a piece of its own.
    ``column`` may name a field inside a struct, as ``row.text``.
    """
    outer, _, inner = column.partition(".")
    for batch in batches:
        values = batch.column(outer)
        if inner:
            values = values.field(inner)
        values = values.cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(ends, done + limit)) + 1)
            yield batch.slice(start, stop - start), [x or b"" for x in values.slice(start, stop - start).to_pylist()]
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base = np.uint64(base | 1)
        self.inverse = np.uint64(pow(base | 1, -1, 1 << 64))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))

        def powers(b):
            return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
        with np.errstate(over="ignore"):
            self.up, self.down = powers(self.base), powers(self.inverse)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """Prefix sums with which :meth:`span` gives the hash of any span of x."""
        self.grow(len(x) + 1)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[:len(x)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


BASE_A = Powers(0x9E3779B97F4A7C15)
BASE_B = Powers(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# lower-cases A-Z and turns every ASCII character but letters and digits into a space
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts, with a 64-bit hash each (unless ``hashed=False``).

    ``start``/``end`` are byte offsets in ``buf``; words of text k are
    ``first[k]:first[k + 1]``.
    """

    def __init__(self, texts: list[bytes], table: bytes | None = None, hashed: bool = True):
        joined = b" ".join(texts) + b" "
        if table:
            joined = joined.translate(table)
        self.joined = joined
        buf = np.frombuffer(joined, np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        if hashed:
            p = BASE_A.prefix(buf.astype(np.uint64) + np.uint64(1))
            h = BASE_A.span(p, self.start, self.end)
            self.hash = mix64(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(40)))

    def of(self) -> np.ndarray:
        """The text's index of every word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(hashes: np.ndarray, width: int, powers: Powers = BASE_A) -> np.ndarray:
    """Hash of each run of ``width`` consecutive items (over the whole array)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    p = powers.prefix(hashes)
    at = np.arange(len(hashes) - width + 1)
    return mix64(powers.span(p, at, at + width))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def cover(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions below ``length`` covered by the given spans."""
    d = np.zeros(length + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents that no model learns from; a null id is 0's."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def share_of(df: DataFrame, bound: int, *key: str) -> DataFrame:
    """About ``bound`` rows of ``df`` by a hash of ``key``, or all if there are no more."""
    share = int(min(1.0, bound / max(1, df.count())) * 1_000_000)
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < share)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2]
