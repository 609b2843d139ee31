"""Trees on all rows: the same model as Spark ML's trainer gives, however the rows lie."""
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from coterie.operators import boosting, models
from coterie.plans import queries
from coterie.schema import FEATURE_CONTRACT


def _few_values(spark, n=3_000):
    rng = random.Random(4)
    rows = [(k, float(rng.randrange(9)), float(rng.randrange(3)), rng.randrange(20) / 4, 1.0, rng.random()) for k in range(n)]
    df = spark.createDataFrame(rows, "order_id long, a double, b double, c double, same double, u double")
    chance = F.when((F.col("a") > 4) & (F.col("c") < 3), 0.8).when(F.col("b") == 1, 0.5).otherwise(0.1)
    return df.withColumn("y", (F.col("u") < chance).cast("int")).cache()


COLUMNS = ["a", "b", "c", "same"]


def test_trees_are_those_of_spark_ml(spark):
    df = _few_values(spark)
    p = {"maxIter": 12, "stepSize": 0.3, "maxDepth": 3}
    stages = [VectorAssembler(inputCols=COLUMNS, outputCol="features"), GBTClassifier(labelCol="y", featuresCol="features", **p)]
    want = models.RiskModel(Pipeline(stages=stages).fit(df.coalesce(1)), COLUMNS)
    scores = [{r["order_id"]: r["predicted_score"] for r in models.predict_scores(m, df).collect()} for m in (want, models.fit_model(df, COLUMNS, p))]
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-5


def test_partitions_do_not_change_the_trees(spark):
    df = _few_values(spark).withColumn("c", F.col("c") + F.col("u"))
    p = models.DEFAULTS | {"maxIter": 23}
    one, layout = boosting.fit_trees(df, COLUMNS, p)
    many, other = boosting.fit_trees(df.repartition(5), COLUMNS, p, one_task=10, rows_a_task=400)
    assert [(t.splits, t.sums) for t in one] == [(t.splits, t.sums) for t in many]
    assert all(np.array_equal(x, y) for x, y in zip(layout.cuts, other.cuts, strict=True))
    assert {t.sums[1][0] for t in one} == {3_000.0}


def test_a_column_without_spread_a_missing_value_and_no_rows(spark):
    df = _few_values(spark, 200)
    flat = models.fit_model(df, ["same"], {"maxIter": 60, "stepSize": 0.3})
    rate = df.agg(F.avg("y")).first()[0]
    assert abs(models.predict_scores(flat, df).first()["predicted_score"] - rate) < 1e-3
    with pytest.raises(Exception, match="missing values in b"):
        models.fit_model(df.withColumn("b", F.when(F.col("a") > 1, F.col("b"))), COLUMNS)
    with pytest.raises(ValueError, match="no rows"):
        models.fit_model(df.filter("a < 0"), COLUMNS)


def test_long_columns_are_cut_at_their_quantiles(spark):
    n = 40_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(0).cast("double").alias("z"))
    rows, layout = boosting.find_cuts(df.repartition(6), ["x", "z"], 32)
    assert rows == n and len(layout.cuts[0]) == 31 and layout.cuts[1][0] == 0.0
    assert np.diff([0, *layout.cuts[0], n]).max() < n / 24


def test_registered_models_are_fitted_on_all_training_rows(spark, monkeypatch, tmp_path):
    """F12 to F14: 4,000 rows were picked by a hash."""
    n, used = 9_000, []
    x = F.col("order_id") % 97
    frame = spark.range(n).select(F.col("id").alias("order_id"), F.expr("if(id % 6 < 4, 'train', if(id % 6 = 4, 'validation', 'test'))").alias("split"),
                                  F.timestamp_seconds(F.col("id")).alias("event_time"), F.lit(1.0).alias("amount"), ((F.col("id") * 31 % 100) < (F.col("id") % 97)).cast("int").alias("is_abuse"),
                                  F.lit("R").alias("ring_id"), F.lit("mixed").alias("abuse_type"), F.lit(1.0).alias("loss_amount"))
    frame = frame.select("*", *[(x if c == FEATURE_CONTRACT[0] else F.lit(0)).cast("double").alias(c) for c in FEATURE_CONTRACT if c not in frame.columns])
    frame.write.parquet(f"{tmp_path}/matrix")
    monkeypatch.setattr(queries, "_matrix", lambda *_: spark.read.parquet(f"{tmp_path}/matrix"))
    monkeypatch.setattr(models, "DEFAULTS", models.DEFAULTS | {"maxIter": 3})
    fit = models.fit_model

    def counted(*args, **kwargs):
        made = fit(*args, **kwargs)
        used.append(made.pipeline.stages[-1]._java_obj.trees()[0].rootNode().impurityStats().count())
        return made

    monkeypatch.setattr(models, "fit_model", counted)
    models.StoredModel.load(queries._stored.__wrapped__("app", "nowhere", "model"))
    queries.REGISTRY["m6_ablation"][0](spark, "nowhere").collect()
    assert used == [6_000.0] * 7
