"""Anomaly scores by a random forest that tells real objects from synthetic ones (Shi and Horvath, 2006).

What the forest takes for synthetic looks least like the real objects: the score is 1 - P(real).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vec: str):
    """Vectors without nulls, NaN or infinities."""
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def fit(real: DataFrame, synthetic: DataFrame, vec: str = "vec", trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassificationModel:
    """Class 1 for real, 0 for synthetic objects; split statistics are gathered by Spark over all rows of both."""
    of = lambda df, y: df.filter(usable(vec)).select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.lit(float(y)).alias("y"))
    return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False).fit(of(real, 1).unionByName(of(synthetic, 0)))


def shuffled_columns(real: DataFrame, key: str = "filename", vec: str = "vec", seed: int = 42) -> DataFrame:
    """A synthetic class with the marginals of the real one: within buckets of about 10,000 rows, each component of a
    vector comes from a row of its own choice by hash, so that dependences between components are gone."""
    rows = real.filter(usable(vec)).select(F.col(key).alias("_k"), F.posexplode(vec).alias("j", "x"))
    # two orders a component within buckets of a bounded size: no window over all rows
    bucket = F.pmod(F.xxhash64("_k", F.lit(seed)), F.lit(-(-real.count() // 10_000) or 1))
    a = Window.partitionBy("j", "b").orderBy(F.xxhash64("_k", F.col("j"), F.lit(seed + 1)), "_k")
    b = Window.partitionBy("j", "b").orderBy("_k")
    ranked = rows.withColumn("b", bucket).withColumn("ra", F.row_number().over(a)).withColumn("rb", F.row_number().over(b))
    mixed = ranked.select("_k", "j", "b", F.col("rb").alias("r")).join(ranked.select("j", "b", F.col("ra").alias("r"), "x"), ["j", "b", "r"])
    out = mixed.groupBy(F.col("_k").alias(key)).agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("p"))
    return out.select(key, F.col("p.x").alias(vec))


def save(model: RandomForestClassificationModel, path: str) -> None:
    """Over what ``path`` held before."""
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def score(features: DataFrame, model: RandomForestClassificationModel, key: str = "filename", vec: str = "vec", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns to keep, anomaly_score) of every row; null where the vector is null, not finite or of another length."""
    ok = usable(vec) & (F.size(vec) == model.numFeatures)
    filled = F.when(ok, F.col(vec).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), model.numFeatures))
    rows = features.select(key, *keep, F.coalesce(ok, F.lit(False)).alias("_ok"), array_to_vector(filled).alias("features"))
    real = F.element_at(vector_to_array("probability"), 2)
    return model.transform(rows).select(key, *keep, F.when(F.col("_ok"), 1 - real).alias("anomaly_score"))


def score_sets(sets: DataFrame, model: RandomForestClassificationModel, positive_flag: str, key: str = "filename", vec: str = "vec") -> DataFrame:
    """(set_id, n, positives, scored, mean_positive, mean_other) of repeated test sets (set_id, key, vec, flag), all scored in one pass."""
    flag = F.coalesce(F.col(positive_flag).cast("boolean"), F.lit(False))
    rows = score(sets.select("set_id", key, vec, flag.alias("_flag")), model, key, vec, ("set_id", "_flag"))
    mean = lambda c: F.avg(F.when(c, F.col("anomaly_score")))
    return rows.groupBy("set_id").agg(
        F.count("*").alias("n"), F.count_if("_flag").alias("positives"), F.count("anomaly_score").alias("scored"), mean(F.col("_flag")).alias("mean_positive"), mean(~F.col("_flag")).alias("mean_other")
    )
