"""Mixing sources to target weights by pivotal dependent rounding.

Sources get targets by weight, none above ``cap`` times its size.  A source's
documents share one rate, its target over its size; each takes the whole part
of the rate in full copies, and the fraction is a copy probability ``p``.

The fractions of two documents meet in a pivotal step: words move from one to
the other, in a direction drawn so that both expectations stand, until one
document's fraction is 0 or 1.  That one is settled, the other goes on.  Blocks
of about ``BLOCK`` documents run such a chain each, their residuals form the
blocks of the next level, and so on up the tree to one residual a source.  The
source's words stay equal to its target throughout; only the last residual is
rounded, to whole words of a partial copy or (``whole=True``) to a copy or none.

Only DataFrame functions run on the executors; a block is an array inside one
row.  Draws hash the row's content, level and seed, so reruns agree.  A null
text has no words, a null source is one source that sorts last, a source
without words has target 0.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import common as C

BLOCK = 128
WORD = r"[^\x20\x09-\x0D]+"
ITEM = "struct<h: bigint, key: bigint, doc_id: bigint, size: bigint, base: bigint, p: double, u: double>"
DONE = "struct<key: bigint, doc_id: bigint, size: bigint, copies: bigint, part: bigint>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, scratch: C.Scratch, budget: float, weights: tuple, cap: float) -> DataFrame:
    """``source, source_size, n, target`` from ``source, size`` rows.

    Sources are numbered by range partition and running offsets.  The water
    level is found by resharing the excess in rounds, each one aggregate over
    the sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch.write(by.repartitionByRange(parts, F.col("source").asc_nulls_last())
                           .withColumn("pid", F.spark_partition_id()), "sources")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("pid").agg(F.count("*").alias("m")).select(
        "pid", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("offset") + rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = scratch.write(ranged.join(offsets, "pid").select(
        "source", "source_size", "n", weight.alias("w"), (F.col("source_size") * cap).alias("top")), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while level != last:
        last = level
        full = F.col("top") < F.col("w") * F.lit(level)
        r = weighed.agg(F.sum(F.when(full, F.col("top")).otherwise(0.0)).alias("used"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if not r["open"]:
            break
        level = (budget * total - r["used"]) / r["open"]
    target = F.least(F.col("top"), F.col("w") * F.lit(level))
    return scratch.write(weighed.select("source", "source_size", "n", target.alias("target")), "targets")


def _draw(key: str, level: int, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(level), F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _chain(items: Column) -> Column:
    """Pivotal steps along an array of items: ``cur`` is the residual, ``out`` what is settled."""
    def settled(x, extra):
        return F.struct(x["key"], x["doc_id"], x["size"], (x["base"] + extra.cast("bigint")).alias("copies"),
                        F.lit(0).cast("bigint").alias("part")).cast(DONE)

    def at(x, p):
        return F.struct(x["h"], x["key"], x["doc_id"], x["size"], x["base"], p.alias("p"), x["u"]).cast(ITEM)

    def step(acc, x):
        c = acc["cur"]
        c_up, x_down = c["size"] * (1 - c["p"]), x["size"] * x["p"]
        c_down, x_up = c["size"] * c["p"], x["size"] * (1 - x["p"])
        gain, loss = F.least(c_up, x_down), F.least(c_down, x_up)
        rises = x["u"] * (gain + loss) < loss
        whole = (c["p"] <= 0) | (c["p"] >= 1)
        # the document whose limit was met is settled, the other one goes on
        c_done = F.when(rises, c_up <= x_down).otherwise(c_down <= x_up)
        moved = F.when(rises, gain).otherwise(-loss)
        c_next = at(c, c["p"] + moved / c["size"])
        x_next = at(x, x["p"] - moved / x["size"])
        return F.struct(
            F.when(whole, at(x, x["p"])).when(c_done, x_next).otherwise(c_next).alias("cur"),
            F.concat(acc["out"], F.array(
                F.when(whole, settled(c, c["p"]))
                .when(c_done, settled(c, F.when(rises, 1).otherwise(0)))
                .otherwise(settled(x, F.when(rises, 0).otherwise(1))))).alias("out"))

    start = F.struct(F.element_at(items, 1).cast(ITEM).alias("cur"), F.array().cast(f"array<{DONE}>").alias("out"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def round_copies(items: DataFrame, scratch: C.Scratch, seed: int, whole: bool) -> DataFrame:
    """``source`` and a settled document a row, from ``source, n`` and the fields of an item.

    ``n`` is the number of the source's items, which sets its number of blocks.
    """
    level, done = 0, []
    while True:
        fields = [F.xxhash64("key", F.lit(seed), F.lit(level)).alias("h"), "key", "doc_id", "size", "base", "p",
                  _draw("key", level, seed).alias("u")]
        blocks = F.ceil(F.col("n") / BLOCK)
        dealt = items.select("source", "n", F.pmod(F.xxhash64("key", F.lit(seed + 1)), blocks).alias("block"),
                             F.struct(*fields).alias("item"))
        chained = dealt.groupBy("source", "n", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
        table = scratch.write(chained.select("source", "n", _chain(F.col("items")).alias("c"))
                              .select("source", "n", "c.cur", "c.out"), f"level{level}")
        done.append(table.select("source", F.explode("out").alias("d")))
        # a source's residuals: one a block that had documents
        left = scratch.write(table.groupBy("source").agg(F.count("*").alias("n")), f"left{level}")
        most = left.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            last = table.select("source", "cur.*")
            if whole:
                copies = F.col("base") + F.when(F.col("u") < F.col("p"), 1).otherwise(0)
                part = F.lit(0)
            else:
                copies = F.col("base") + F.when(F.col("p") >= 1, 1).otherwise(0)
                part = F.when(F.col("p") < 1, F.round(F.col("p") * F.col("size"))).otherwise(0)
            done.append(last.select("source", F.struct(
                "key", "doc_id", "size", copies.cast("bigint").alias("copies"), part.cast("bigint").alias("part"))
                .cast(DONE).alias("d")))
            break
        items = table.select("source", "cur.*").drop("h", "u").join(left, "source")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("source", "d.*")


def mix(docs: DataFrame, budget: float = 1.5, weights: tuple = (3, 1, 2), cap: float = 2.0, seed: int = 17,
        whole: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``.

    ``key`` (hash of doc_id, text and source), ``doc_id, source, size,
    source_size, target, copies`` (whole ones), ``part`` (words of a partial
    copy) and ``taken`` (words in all).
    """
    scratch = C.Scratch(docs.sparkSession, "mixing")
    slim = scratch.write(docs.select(F.xxhash64("doc_id", "text", "source").alias("key"), "doc_id", "source",
                                     words(F.col("text")).alias("size")), "slim")
    targets = source_targets(slim, scratch, budget, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = slim.join(targets.withColumn("rate", rate).withColumnRenamed("source", "_s"),
                      F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    base = F.floor("rate").cast("bigint")
    rated = rated.withColumn("base", base).withColumn("p", F.col("rate") - base)
    moving = rated.where("p > 0 and size > 0").select("source", "n", "key", "doc_id", "size", "base", "p")
    still = rated.where("not (p > 0 and size > 0)").select(
        "source", "key", "doc_id", "size", F.col("base").alias("copies"), F.lit(0).cast("bigint").alias("part"))
    settled = still.unionByName(round_copies(moving, scratch, seed, whole))
    out = settled.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("key", "doc_id", "source", "size", "source_size", "target", "copies", "part",
                      (F.col("size") * F.col("copies") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as it was taken, with ``copy`` counting from 1.

    All columns of ``docs`` stay; where one is called ``copy`` the count gets underscores added.
    Only whole copies are taken.
    """
    counter = "copy"
    while counter in docs.columns:
        counter += "_"
    # documents of one key share their rate, so their copies differ by one at most
    plan = mix(docs, whole=True, **options).groupBy("key").agg(F.sum("copies").alias("all"), F.count("*").alias("m")).where(F.col("all") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.xxhash64("doc_id", "text", "source").alias("key"))
    # texts are shuffled once: equal rows are numbered where the join has put them
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    n = F.expr("all div m") + F.when(nth <= F.expr("all % m"), 1).otherwise(0)
    dealt = rows.join(plan, "key").withColumn("n", n)
    return dealt.where("n > 0").select("row.*", F.explode(F.expr("sequence(1L, n)")).alias(counter))
