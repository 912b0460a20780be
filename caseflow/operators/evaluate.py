"""Binary-classifier evaluation (E1–E6) on a ``(id, y, score)`` frame.

Rank statistics (AUC, ROC) need, for each distinct score, the number of
negatives and positives below it.  Scores are probabilities in [0, 1]: the
distinct scores are bucketed by value (a monotone key), bucket totals
(≤ ``n_buckets`` rows, broadcast) give the offsets, and the running sums run
per bucket — no single-task window over all distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: probability clip for the log loss (float64 machine epsilon).
LOGLOSS_EPS = 2.220446049250313e-16


def score_table(df: DataFrame, y: str = "y", score: str = "score", n_buckets: int = 1 << 16,
                keys: list[str] | None = None) -> DataFrame:
    """Per (keys, distinct score): ``pos, neg, neg_below, pos_below`` plus totals ``P, N``."""
    keys = list(keys or [])
    s = F.col(score).cast("double")
    per = df.groupBy(*keys, s.alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"),
                                                  F.count_if(F.col(y) != 1).alias("neg"))
    b = F.least(F.greatest(F.floor(F.col("score") * n_buckets), F.lit(-1)), F.lit(n_buckets)).cast("int")
    per = per.withColumn("_b", b)
    tot = per.groupBy(*keys, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    grp = Window.partitionBy(*keys)
    run = grp.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumns({"_op": F.coalesce(F.sum("_bp").over(run), F.lit(0)),
                           "_on": F.coalesce(F.sum("_bn").over(run), F.lit(0)),
                           "P": F.sum("_bp").over(grp), "N": F.sum("_bn").over(grp)})
    tot = tot.select(*keys, "_b", "_op", "_on", "P", "N")
    # without keys: at most n_buckets + 2 rows, a proven bound for the broadcast
    per = per.join(F.broadcast(tot) if not keys else tot, keys + ["_b"])
    w = Window.partitionBy(*keys, "_b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, "score", "pos", "neg",
                      (F.col("_on") + F.coalesce(F.sum("neg").over(w), F.lit(0))).alias("neg_below"),
                      (F.col("_op") + F.coalesce(F.sum("pos").over(w), F.lit(0))).alias("pos_below"),
                      "P", "N")


def auc(df: DataFrame, y: str = "y", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """ROC AUC = Σ pos·(neg_below + neg/2) / (P·N); null with one class.  One row per key group."""
    keys = list(keys or [])
    t = score_table(df, y, score, keys=keys)
    return t.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_s"),
                                F.max("P").alias("P"), F.max("N").alias("N")) \
        .select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_s") / (F.col("P") * F.col("N")))
                .alias("auc"))


def roc_points(df: DataFrame, y: str = "y", score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """E5: one point per distinct threshold t: rates of scores ≥ t; the curve starts at (0, 0), t = ∞."""
    keys = list(keys or [])
    t = score_table(df, y, score, keys=keys)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    points = t.select(*keys, F.col("score").alias("threshold"),
                      F.when(F.col("N") > 0, fp / F.col("N")).alias("fpr"),
                      F.when(F.col("P") > 0, tp / F.col("P")).alias("tpr"))
    start = t.groupBy(*keys).agg(F.max("P").alias("P"), F.max("N").alias("N")).where("P is not null").select(
        *keys, F.lit(float("inf")).alias("threshold"), F.when(F.col("N") > 0, 0.0).alias("fpr"),
        F.when(F.col("P") > 0, 0.0).alias("tpr"))
    return points.unionByName(start)


def predictions(df: DataFrame, score: str = "score", threshold: float = 0.5, pred: str = "pred") -> DataFrame:
    """M8: class 1 iff score ≥ threshold."""
    return df.withColumn(pred, (F.col(score) >= F.lit(threshold)).cast("int"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    """Counts for every (y, pred) cell, empty cells 0 (per key group)."""
    keys = keys or []
    counts = df.groupBy(*keys, F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")) \
        .agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "y int, pred int")
    if keys:
        cells = counts.select(*keys).distinct().crossJoin(F.broadcast(cells))
    return cells.join(counts, keys + ["y", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _report_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    g = cells.groupBy(*keys).agg(
        F.sum(F.when((F.col("y") == 1) & (F.col("pred") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") == 0) & (F.col("pred") == 1), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == 1) & (F.col("pred") == 0), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when((F.col("y") == 0) & (F.col("pred") == 0), F.col("n")).otherwise(0)).alias("tn"))

    def prf(tp, fp, fn):
        p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return p, r, f

    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    tot = s1 + s0

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.cast("bigint").alias("support"))
    wavg = lambda a, b: (a * s0 + b * s1) / tot
    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"),
            (F.col("tp") + F.col("tn")) / tot, tot),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), tot))
    return g.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred", keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    Zero division gives 0 (as the reference's report).  ``keys`` (e.g. model,
    split) produce the long per-group report from one aggregation.
    """
    keys = keys or []
    return _report_from_cells(confusion(df, y, pred, keys), keys)


def log_loss(df: DataFrame, y: str = "y", score: str = "score", eps: float = LOGLOSS_EPS,
             keys: list[str] | None = None) -> DataFrame:
    """Mean negative log-likelihood with probabilities clipped to [eps, 1 − eps]."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    ll = -F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1.0 - p))
    return df.groupBy(*(keys or [])).agg(F.avg(ll).alias("log_loss"))


Column = Column
