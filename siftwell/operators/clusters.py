"""How samples or groups mix within clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mixing(cells: DataFrame, cluster: str, label: str) -> DataFrame:
    """One row: cluster_count, and entropy and dominant fraction averaged over clusters by size.

    Entropy is over the logarithm of the labels that the cluster holds; 0 with one label.
    """
    counts = cells.groupBy(F.col(cluster).alias("k"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("k"))
    by = counts.withColumn("p", share).groupBy("k").agg(F.sum("n").alias("size"), F.count("*").alias("labels"), -F.sum(F.col("p") * F.log("p")), F.max("p").alias("top"))
    by = by.toDF("k", "size", "labels", "h", "top").withColumn("entropy", F.when(F.col("labels") <= 1, 0.0).otherwise(F.col("h") / F.log(F.col("labels"))))
    mean = lambda c: F.sum(F.col(c) * F.col("size")) / F.sum("size")
    return by.agg(F.count("*").alias("cluster_count"), mean("entropy").alias("entropy_weighted"), mean("top").alias("dominant_fraction"))


def kmeans(cells: DataFrame, features: list[str], k: int = 8, dims: int = 20, seed: int = 123) -> DataFrame:
    """cells with an approximate `cluster` label: principal components, then k-means. Labels match no other tool's."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="__std", withMean=True)]
    stages += [PCA(k=min(dims, len(features)), inputCol="__std", outputCol="__pca"), KMeans(k=k, seed=seed, featuresCol="__pca", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(cells).transform(cells).drop("__raw", "__std", "__pca")
