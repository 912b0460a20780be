"""Dataset preparation (D1–D9): exact stratified split, imputation, encoding.

Everything is fitted on ``split = 'train'`` rows only and applied to all rows.
Fitted values (medians, modes, category lists) are one-row or vocabulary-sized
frames joined back; only ``prepare_vectors`` (a ``pyspark.ml`` pipeline)
brings the category lists to the driver, as StringIndexer does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from caseflow.functions.quantiles import exact_quantiles

SPLIT = "split"
DOUBLE_MAX = 1.7976931348623157e308


def _hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def split_counts(n: Column, test_size: float, val_size: float) -> tuple[Column, Column]:
    """Per-class sizes: test = ceil(n·test); val = ceil((n − test)·val)."""
    n_test = F.ceil(n * F.lit(test_size))
    n_val = F.ceil((n - n_test) * F.lit(val_size))
    return n_test, n_val


def stratified_split(cases: DataFrame, label: str, id_col: str = "case_id", test_size: float = 0.2,
                     val_size: float = 0.25, seed: int = 42, n_buckets: int = 4096) -> DataFrame:
    """Add ``split`` ∈ {train, val, test} with exact per-class counts.

    Rows without a label form a class of their own, so no row is lost.

    Within each class, cases are ranked by ``md5('<seed>:<id>')`` (then id).
    The rank is computed without a per-class single task: cases are bucketed
    by the first hex digits of the hash (a monotone function of the sort key),
    bucket sizes are counted (a table of at most classes × ``n_buckets`` rows,
    broadcast), and ``row_number`` runs per (class, bucket).  Rank = bucket
    offset + row number, identical to a global per-class ranking.
    """
    digits = max(1, (n_buckets - 1).bit_length() // 4)
    h = _hash_key(id_col, seed)
    keyed = cases.withColumns({"_h": h, "_b": F.conv(F.substring(h, 1, digits), 16, 10).cast("int")})
    sizes = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    cls = Window.partitionBy(label)
    sizes = sizes.withColumns({
        "_off": F.sum("_nb").over(cls.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        "_n": F.sum("_nb").over(cls),
    }).withColumn("_off", F.coalesce("_off", F.lit(0)))
    # bounded: (#classes × 16^digits) rows
    sizes = sizes.select(F.col(label).alias("_l"), F.col("_b").alias("_sb"), "_off", "_n")
    same = F.col(label).eqNullSafe(F.col("_l")) & F.col("_b").eqNullSafe(F.col("_sb"))
    keyed = keyed.join(F.broadcast(sizes), same).drop("_l", "_sb")
    rn = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col))
    ranked = keyed.withColumn("_r", F.col("_off") + rn - 1)
    n_test, n_val = split_counts(F.col("_n"), test_size, val_size)
    split = F.when(F.col("_r") < n_test, "test").when(F.col("_r") < n_test + n_val, "val").otherwise("train")
    return ranked.withColumn(SPLIT, split).drop("_h", "_b", "_off", "_n", "_r")


def feature_types(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    """Numeric vs categorical feature columns (id, label, split excluded)."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude or f.name == SPLIT:
            continue
        (num if isinstance(f.dataType, NumericType) else cat).append(f.name)
    return num, cat


def split_summary(df: DataFrame, label: str) -> DataFrame:
    """D3: rows, positives and positive rate (3 dp) per split."""
    return df.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("rows"),
                                 F.sum(F.col(label).cast("bigint")).alias("positives"),
                                 F.round(F.avg(F.col(label).cast("double")), 3).alias("rate")).orderBy(SPLIT)


def nan_to_null(column: str) -> Column:
    """The column as a double; a NaN counts as missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def train_medians(df: DataFrame, numeric: list[str]) -> DataFrame:
    """One row: the train median of each numeric column (null if all null)."""
    train = df.where(F.col(SPLIT) == "train").select(*[nan_to_null(c).alias(c) for c in numeric])
    long = train.unpivot([], numeric, "column_name", "value")
    med = exact_quantiles(long, "value", [0.5], ["column_name"], ["m"])
    # pivot over the known column list: one row, a column per feature (null if all null)
    return med.groupBy().pivot("column_name", numeric).agg(F.first("m"))


def impute_numeric(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Null or NaN → train median, then → 0 (all-null column).  One-row broadcast."""
    med = train_medians(df, numeric).select(*[F.col(c).alias(f"_m_{c}") for c in numeric])
    out = df.crossJoin(F.broadcast(med))
    return out.withColumns({c: F.coalesce(nan_to_null(c), F.col(f"_m_{c}"), F.lit(0.0))
                            for c in numeric}).drop(*[f"_m_{c}" for c in numeric])


def train_modes(df: DataFrame, categorical: list[str]) -> DataFrame:
    """One row: most frequent train value per column (as text), smallest on ties.

    Values are counted over all tasks first; the maximum of the counts combines
    map-side, so no task holds a column's vocabulary.
    """
    train = df.where(F.col(SPLIT) == "train").select(*[F.col(c).cast("string").alias(c) for c in categorical])
    counts = (train.unpivot([], categorical, "column_name", "value").where("value is not null")
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    top = counts.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("rank"), "value"))["value"].alias("m"))
    return top.groupBy().pivot("column_name", categorical).agg(F.first("m"))


def impute_categorical(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Null → train mode, then → ``'missing'``."""
    mode = train_modes(df, categorical).select(*[F.col(c).alias(f"_m_{c}") for c in categorical])
    out = df.crossJoin(F.broadcast(mode))
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.col(f"_m_{c}"), F.lit("missing"))
                            for c in categorical}).drop(*[f"_m_{c}" for c in categorical])


def category_slots(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Train categories per column, sorted, with their one-hot slot (0-based)."""
    train = df.where(F.col(SPLIT) == "train")
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                     F.col(c).cast("string").alias("category"))
                                            for c in categorical])).alias("p")).select("p.*")
    long = long.where("category is not null").distinct()  # a missing value has no slot
    return long.withColumn("slot", (F.row_number().over(
        Window.partitionBy("column_name").orderBy("category")) - 1).cast("int"))


def one_hot_long(df: DataFrame, categorical: list[str], id_col: str = "case_id") -> DataFrame:
    """D6 in relational form: ``(id, column, category, slot)``; unseen → slot null.

    The category table is vocabulary-sized; the join strategy is left to the
    optimizer (broadcast only when its measured size is under the threshold).
    """
    slots = category_slots(df, categorical)
    long = df.select(id_col, SPLIT, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                                 F.col(c).cast("string").alias("category"))
                                                        for c in categorical])).alias("p")).select(id_col, SPLIT, "p.*")
    return long.join(slots, ["column_name", "category"], "left")


def feature_names(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Vector slot → readable name; numeric first, then ``column=value``."""
    spark = df.sparkSession
    num = spark.createDataFrame([(i, c) for i, c in enumerate(numeric)], "slot int, name string")
    if not categorical:
        return num
    slots = category_slots(df, categorical)
    order = spark.createDataFrame([(i, c) for i, c in enumerate(categorical)], "col_pos int, column_name string")
    widths = slots.groupBy("column_name").agg(F.count(F.lit(1)).alias("w")).join(order, "column_name")
    widths = widths.withColumn("base", F.coalesce(F.sum("w").over(
        Window.orderBy("col_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(len(numeric)))
    cat = slots.join(widths, "column_name").select(
        (F.col("base") + F.col("slot")).cast("int").alias("slot"),
        F.concat(F.col("column_name"), F.lit("="), F.col("category")).alias("name"))
    return num.unionByName(cat)


def sanitise(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN → 0, +∞ → largest double, −∞ → lowest double (nulls kept)."""
    def fix(c):
        x = F.col(c).cast("double")
        return (F.when(F.isnan(x), F.lit(0.0))
                 .when(x == F.lit(float("inf")), F.lit(DOUBLE_MAX))
                 .when(x == F.lit(float("-inf")), F.lit(-DOUBLE_MAX)).otherwise(x))
    return df.withColumns({c: fix(c) for c in columns})


def build_prep_pipeline(numeric: list[str], categorical: list[str], features_col: str = "features"):
    """Impute (done relationally before) → index → one-hot → assemble.

    ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast=True)``
    gives one slot per train category and an all-zero vector for unseen ones.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    stages = []
    if categorical:
        idx = [f"{c}__idx" for c in categorical]
        ohe = [f"{c}__ohe" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # the indexer already maps unseen values to the extra last index, which
        # dropLast removes: one slot per train category, unseen → all zeros
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error"))
    else:
        ohe = []
    stages.append(VectorAssembler(inputCols=list(numeric) + ohe, outputCol=features_col, handleInvalid="keep"))
    return Pipeline(stages=stages)


def prepare_vectors(df: DataFrame, numeric: list[str], categorical: list[str],
                    features_col: str = "features"):
    """Impute, sanitise and fit the encoding pipeline on train; return (model, frame)."""
    prepared = sanitise(impute_categorical(impute_numeric(df, numeric), categorical), numeric)
    model = build_prep_pipeline(numeric, categorical, features_col).fit(prepared.where(F.col(SPLIT) == "train"))
    return model, model.transform(prepared)


def class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """M6: balanced weights n / (k · n_class), joined as a column (k classes: tiny)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight_col))
    return df.join(F.broadcast(w), label, "left")
