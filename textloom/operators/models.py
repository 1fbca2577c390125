"""Dense logistic regression and calibration on MLlib, and scoring by any model in batches."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.metrics import class_weights


def style_matrix(df: DataFrame, columns: list[str], into: str, scales: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """The columns over their population deviations as one vector, without centring; and the deviations, which scoring takes."""
    if scales is None:
        row = df.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
        scales = {c: row[c] or 1.0 for c in columns}
    return df.withColumn(into, array_to_vector(F.array(*(F.col(c).cast("double") / F.lit(scales[c]) for c in columns)))), scales


def logistic(df: DataFrame, features: list[str], label: str = "label", c: float = 1.0, balanced: bool = True, weight: str | None = None, iterations: int = 100) -> PipelineModel:
    """A ridge logistic regression over vector and numeric columns; balanced weighs classes alike."""
    own = df.where(F.col(label).isin(0, 1))
    w = F.col(weight) if weight else F.lit(1.0)
    if balanced:
        own = own.join(F.broadcast(class_weights(own, label).withColumnRenamed("weight", "cw_")), label)
        w = w * F.col("cw_")
    own = own.withColumn("w_", w)
    total = own.agg(F.sum("w_")).first()[0] or 1.0
    steps = [VectorAssembler(inputCols=features, outputCol="x_"), LogisticRegression(featuresCol="x_", labelCol=label, weightCol="w_", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=iterations)]
    return Pipeline(stages=steps).fit(own)


def scored(model: PipelineModel, df: DataFrame, into: str = "p") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(into, vector_to_array("probability")[1]).select(*df.columns, into)


def calibrated(train: DataFrame, df: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """df with p_platt and p_isotonic, fitted on train."""
    platt = logistic(train, [p], label, balanced=False)
    iso = IsotonicRegression(featuresCol="v_", labelCol="y_").fit(VectorAssembler(inputCols=[p], outputCol="v_").transform(train.withColumn("y_", F.col(label).cast("double"))))
    out = scored(platt, df, "p_platt")
    return iso.transform(VectorAssembler(inputCols=[p], outputCol="v_").transform(out)).withColumnRenamed("prediction", "p_isotonic").drop("v_")


def batch_scorer(make, texts: str = "text", into: str = "p"):
    """A transformer of DataFrames around any model: make() gives, once for each worker, a function from a list of texts to probabilities."""
    from collections.abc import Iterator

    import pandas as pd

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for b in batches:
            yield pd.Series(f(b.fillna("").tolist()), dtype="float64")

    return lambda df: df.withColumn(into, run(texts))
