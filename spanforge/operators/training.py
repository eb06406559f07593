"""Training tables with an audit of every row, feature vectors and the box regressor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from spanforge.functions import constants as K
from spanforge.functions import text as T

#: Reasons to leave a row out, in the order in which they are looked at.
REASONS = ("job_type_mismatch", "prediction_job_not_trainable", "missing_combined_features", "missing_ground_truth", "ground_truth_incomplete", "missing_ai2_features", "missing_group_composition", "object_unavailable", "geometry_untrusted", "invalid_actual_box")


def valid_label(box: Column) -> Column:
    ok = F.lit(True)
    for f in K.LABEL_FIELDS:
        ok &= T.positive(box[f]).isNotNull()
    return F.coalesce(ok, F.lit(False))


def skip_reason(conditions: dict[str, Column]) -> Column:
    """First reason that holds, in the fixed order; null admits the row."""
    return T.first_match([(F.coalesce(conditions[r], F.lit(False)), F.lit(r)) for r in REASONS if r in conditions])


def assemble(jobs: DataFrame, features: DataFrame, truth: DataFrame, job_type: str | None = None, *, job: str = "job_id") -> DataFrame:
    """Every job with its features and label and the reason that keeps it out of training, if any.

    ``jobs``: job_type, is_prediction. ``features``: has_features, object_available,
    geometry_trusted, has_composition. ``truth``: completed, actual_box.
    """
    marked = jobs.join(features.withColumn("_f", F.lit(True)), job, "left").join(truth.withColumn("_t", F.lit(True)), job, "left")
    true = lambda c: F.coalesce(F.col(c) == F.lit(True), F.lit(False))
    rules = {
        "missing_combined_features": F.col("_f").isNull(),
        "missing_ground_truth": F.col("_t").isNull(),
        "ground_truth_incomplete": ~true("completed"),
        "missing_ai2_features": ~true("has_features"),
        "missing_group_composition": (F.col("job_type") == "group") & ~true("has_composition"),
        "object_unavailable": ~true("object_available"),
        "geometry_untrusted": ~true("geometry_trusted"),
        "invalid_actual_box": ~valid_label(F.col("actual_box")),
    }
    if job_type is not None:
        rules |= {"job_type_mismatch": ~F.col("job_type").eqNullSafe(job_type), "prediction_job_not_trainable": true("is_prediction")}
    return marked.withColumn("skip_reason", skip_reason(rules)).drop("_f", "_t")


def audit(assembled: DataFrame) -> DataFrame:
    """Rows per reason; admitted rows have none."""
    return assembled.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n_jobs"))


def safe_columns(schema: S.StructType) -> list[str]:
    """Names that a model may see: five texts, and numbers whose name holds no banned part."""
    out = []
    for f in schema.fields:
        if f.name in K.SOURCE_ONLY_FEATURES:
            continue
        if f.name in K.SAFE_TEXT_FEATURES:
            if isinstance(f.dataType, S.StringType):
                out.append(f.name)
        elif isinstance(f.dataType, S.NumericType) and not any(p in f.name.lower() for p in K.BANNED_PARTS):
            out.append(f.name)
    return sorted(out)


def leaked_columns(schema: S.StructType) -> list[str]:
    """Names in any depth that would leak debug or label fields to a model."""

    def walk(s: S.StructType, path: str):
        for f in s.fields:
            here = f"{path}{f.name}"
            if any(p in f.name.lower() for p in K.BANNED_PARTS):
                yield here
            if isinstance(f.dataType, S.StructType):
                yield from walk(f.dataType, f"{here}.")

    return sorted(walk(schema, ""))


def vectorise(df: DataFrame, keep: list[str], bins: int = K.PROFILE_BINS) -> DataFrame:
    """Keys and model columns, sorted by name: safe ones, ten of each bin array, flags as 1 and 0. All always present; non-finite is null."""
    columns: dict[str, Column] = {}
    for c in safe_columns(df.schema):
        if c not in keep:
            columns[c] = F.col(c) if c in K.SAFE_TEXT_FEATURES else T.finite(F.col(c))
    for c in K.BIN_FEATURES:
        for i in range(bins):
            columns[f"{c}_{i:02d}"] = T.finite(F.get(F.col(c), F.lit(i))) if c in df.columns else F.lit(None).cast("double")
    for c in K.FLAG_FEATURES:
        columns[c] = F.col(c).cast("boolean").cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.select(*keep, *[columns[c].alias(c) for c in sorted(columns)])


def impute(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Exact medians for numbers, ``__missing__`` for texts; a column without values stays null."""
    medians = df.agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in numeric])
    out = df.crossJoin(F.broadcast(medians))  # one row
    out = out.withColumns({c: F.coalesce(c, f"m_{c}") for c in numeric} | {c: F.coalesce(F.col(c), F.lit("__missing__")) for c in text})
    return out.drop(*[f"m_{c}" for c in numeric])


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A 0/1 column for each known value; unknown ones give zeros."""
    return df.withColumns({f"{column}={v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values})


def label_summary(df: DataFrame, labels: tuple[str, ...] = K.LABEL_FIELDS) -> DataFrame:
    """Least, greatest and mean of each label, a row each."""
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in labels for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"min_{c}").cast("double").alias("least"), F.col(f"max_{c}").cast("double").alias("greatest"), F.col(f"mean_{c}").alias("mean")) for c in labels])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def train_boxes(table: DataFrame, numeric: list[str], labels: tuple[str, ...] = K.LABEL_FIELDS):
    """A random forest per label, or None with fewer than two rows. Returns models by label and the rows used."""
    n = table.count()
    if n < K.LEAST_SAMPLES:
        return None, n
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    ready = impute(table, numeric, [])
    ready = ready.fillna(0.0, subset=numeric)  # columns without any value
    models = {}
    for label in labels:
        forest = RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol=f"predicted_{label}", numTrees=K.TREES, seed=K.FOREST_SEED, featureSubsetStrategy="all")
        models[label] = Pipeline(stages=[VectorAssembler(inputCols=numeric, outputCol="features", handleInvalid="keep"), forest]).fit(ready)
    return models, n


def predict_boxes(models, rows: DataFrame, numeric: list[str], medians: DataFrame | None = None) -> DataFrame:
    """Predicted labels beside each row; null numbers count as 0 where no median fills them."""
    out = impute(rows, numeric, []).fillna(0.0, subset=numeric)
    for model in models.values():
        out = model.transform(out).drop("features")
    return out


def compare_boxes(predicted: Column, actual: Column, tolerance: float = K.MATCH_IN) -> Column:
    """Differences per label and whether all are within the tolerance; null without both boxes."""
    diffs = [predicted[f] - actual[f] for f in K.LABEL_FIELDS]
    ok = F.greatest(*[F.abs(d) for d in diffs]) <= tolerance
    known = diffs[0].isNotNull() & diffs[1].isNotNull() & diffs[2].isNotNull()
    return F.when(known, F.struct(*[d.alias(f) for d, f in zip(diffs, K.LABEL_FIELDS, strict=True)], ok.alias("match")))


def save_models(models, path: str, report: DataFrame) -> None:
    """Models by label, and a report table, under one path."""
    for label, model in models.items():
        model.write().overwrite().save(f"{path}/{label}")
    report.write.mode("overwrite").parquet(f"{path}/report")


def load_models(path: str, labels: tuple[str, ...] = K.LABEL_FIELDS) -> dict:
    from pyspark.ml import PipelineModel

    return {label: PipelineModel.load(f"{path}/{label}") for label in labels}
