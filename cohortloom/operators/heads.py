"""Model heads on Spark MLlib: weighted classifiers, cascades, isotonic calibration, gain shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .isotonic import IsotonicMap, fit_blocks, fit_map
from .metrics import LIVE_THRESHOLD
from .retrieval import rank_within


def assemble_vector(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def text_vectors(weights: DataFrame, vocabulary: DataFrame, key: str, size: int, out: str = "text_features") -> DataFrame:
    """Long TF-IDF rows -> one sparse MLlib vector per key. The vocabulary is limited by its fit and a
    row holds at most that many terms, so the collected list per key is bounded."""
    w = Window.partitionBy().orderBy(F.desc("cf"), F.asc("term"))
    index = vocabulary.withColumn("idx", F.row_number().over(w) - 1).select("term", "idx")
    packed = weights.join(index, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("__e"))
    # the vector type has no SQL constructor; its stored form is read back through JSON
    stored = F.to_json(F.struct(F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), F.transform("__e", lambda e: e["idx"]).alias("indices"),
        F.transform("__e", lambda e: e["w"]).alias("values")).alias("v")))
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return packed.select(key, F.from_json(stored, schema).getField("v").alias(out))


def fit_multiclass(df: DataFrame, features: str, label: str, weight: str | None = None, kind: str = "logistic", **params):
    """Weighted multiclass head: multinomial logistic regression or a random forest."""
    if kind == "logistic":
        est = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", **params)
    else:
        est = RandomForestClassifier(featuresCol=features, labelCol=label, **params)
    model = (est.setWeightCol(weight) if weight else est).fit(df)
    if kind == "logistic":
        # the training summary holds the session, which cannot be shipped once observe() was used in it
        model._java_obj.setSummary(df.sparkSession._jvm.scala.Option.empty())
    return model


def fit_binary(df: DataFrame, features: str, label: str, weight: str | None = None, **params):
    """Weighted binary head: gradient-boosted trees."""
    est = GBTClassifier(featuresCol=features, labelCol=label, **params)
    return (est.setWeightCol(weight) if weight else est).fit(df)


_MODEL_COLS = ("prediction", "probability", "rawPrediction")


def hard_cascade(df: DataFrame, model, name: str) -> DataFrame:
    """Predicted class of an earlier head as a feature column."""
    scored = model.transform(df)
    return scored.withColumn(name, F.col("prediction")).drop(*_MODEL_COLS)


def soft_cascade(df: DataFrame, model, names: Sequence[str]) -> DataFrame:
    """Class probabilities of an earlier head as feature columns."""
    scored = model.transform(df).withColumn("__p", vector_to_array("probability"))
    return scored.withColumns({n: F.get("__p", F.lit(i)) for i, n in enumerate(names)}).drop("__p", *_MODEL_COLS)


def calibrate_isotonic(holdout: DataFrame, score: str, label: str, max_rows: int | None = None, seed: int = 42,
                       key: str | None = None) -> IsotonicMap:
    """Isotonic map from score to observed rate, fitted on the scores of a holdout as they are, range by range.

    ``max_rows`` fits it on about so many holdout rows, chosen by hash of their ``key``, so the same ones whatever the
    partitioning (off by default)."""
    if max_rows is not None:
        if key is None:
            raise ValueError("max_rows needs the key by whose hash rows are chosen")
        share = min(1.0, max_rows / max(1, holdout.count()))
        holdout = holdout.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return fit_map(holdout, score, label)


def apply_isotonic(df: DataFrame, model: IsotonicMap, score: str, out: str) -> DataFrame:
    return model.apply(df, score, out)


def calibrate_ovr(holdout: DataFrame, scores: str, label: str, n_classes: int) -> list[IsotonicMap]:
    """One isotonic map per class, one-vs-rest, fitted together."""
    rows = holdout.select(F.col(label).alias("__label"), F.posexplode(F.slice(scores, 1, n_classes)).alias("class", "s"))
    blocks = durable(fit_blocks(rows.withColumn("y", (F.col("__label") == F.col("class")).cast("int")), "s", "y", by=["class"]))
    return [IsotonicMap(blocks.where(F.col("class") == k)) for k in range(n_classes)]


def apply_ovr(df: DataFrame, models: Sequence, scores: str, out: str) -> DataFrame:
    """Calibrated class probabilities, rescaled to sum to 1 (uniform if all are 0)."""
    res = df
    for k, model in enumerate(models):
        res = apply_isotonic(res.withColumn("__s", F.get(scores, F.lit(k))), model, "__s", f"__c{k}").drop("__s")
    cols = [F.col(f"__c{k}") for k in range(len(models))]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    arr = F.array(*[F.when(total > 0, c / total).otherwise(F.lit(1.0 / len(models))) for c in cols])
    return res.withColumn(out, arr).drop(*[f"__c{k}" for k in range(len(models))])


def gate(df: DataFrame, score: str, threshold: float = LIVE_THRESHOLD) -> DataFrame:
    """Only rows at or above the live threshold go on to the diagnosis stage."""
    return df.filter(F.col(score) >= threshold)


def gated_value(df: DataFrame, score: str, value: Column, name: str, threshold: float = LIVE_THRESHOLD) -> DataFrame:
    return df.withColumn(name, F.when(F.col(score) >= threshold, value))


def importance_table(spark, model, cols: Sequence[str], groups: Mapping[str, str], default: str = "structured") -> DataFrame:
    """``(column, group, gain)`` of a fitted tree model."""
    gains = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(c, groups.get(c, default), float(g)) for c, g in zip(cols, gains)],
                                 "column string, grp string, gain double")


def importance_by_group(importance: DataFrame) -> DataFrame:
    """Gain, its percentage and the number of columns with gain per feature group."""
    total = F.sum(F.sum("gain")).over(Window.partitionBy())
    return importance.groupBy("grp").agg(
        F.sum("gain").alias("gain"), (100.0 * F.sum("gain") / total).alias("pct"),
        F.count_if(F.col("gain") > 0).alias("cols_with_gain"), F.count("*").alias("n_cols"))


def top_features(importance: DataFrame, n: int = 25) -> DataFrame:
    return rank_within(importance.orderBy(F.desc("gain"), F.asc("column")).limit(n), [], "gain", ["column"])
