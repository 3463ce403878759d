"""Learned summaries with spark.ml: time patterns, cluster numbers, components, topics."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.lineage import cut


def time_patterns(profiles: DataFrame, key: str, bins: int, k: int = 5, runs: int = 7) -> tuple[DataFrame, list]:
    """((key, pattern), centres): k-means of share profiles (key, bin, share), the best of several seeds.

    Centres are sorted, and patterns numbered in their order.
    """
    wide = profiles.groupBy(key).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("share"))), F.lit(0.0)) for b in range(bins)]).alias("v"))
    data = wide.select(key, array_to_vector("v").alias("features")).persist()
    models = [KMeans(k=k, seed=s, maxIter=30).fit(data) for s in range(1, runs + 1)]
    best = min(models, key=lambda m: (m.summary.trainingCost, m.uid))
    centres = [c.tolist() for c in best.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    rank = F.array(*[F.lit(order.index(i)) for i in range(len(centres))])
    out = cut(best.transform(data).select(key, F.get(rank, F.col("prediction")).alias("pattern")))
    data.unpersist()
    return out, sorted(centres)


def cluster_numbers(data: DataFrame, vector: str, numbers: range, seed: int = 1) -> list[tuple[int, float, float]]:
    """(k, cost, silhouette) of k-means for each number of clusters."""
    x = data.select(array_to_vector(vector).alias("features")).persist()
    out = []
    for k in numbers:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(x)
        quality = ClusteringEvaluator().evaluate(model.transform(x)) if model.summary.k > 1 else 0.0
        out.append((k, float(model.summary.trainingCost), float(quality)))
    x.unpersist()
    return out


def components(data: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, p): the first k principal components."""
    x = data.select(key, array_to_vector(vector).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="p").fit(x)
    return model.transform(x).select(key, vector_to_array("p").alias("p"))


def topics(records: DataFrame, tags: str, k: int = 80, least: float = 30, most: float = 0.4, passes: int = 5, seed: int = 1, words: int = 10) -> DataFrame:
    """(topic, word, weight, rank) of a topic model over the tags of records; words on fewer than ``least`` or more than the share ``most`` are left out; without any other the result is empty."""
    upper = max(least, most * records.count())
    held = records.select(F.explode(F.array_distinct(tags)).alias("t")).groupBy("t").count().where(F.col("count").between(least, upper))
    if not held.limit(1).count():
        return records.sparkSession.createDataFrame([], "topic int, word string, weight double, rank int")
    counter = CountVectorizer(inputCol=tags, outputCol="features", minDF=least, maxDF=upper).fit(records)
    data = counter.transform(records).select("features")
    model = LDA(k=k, maxIter=passes, seed=seed, optimizer="online").fit(data)
    top = model.describeTopics(words)
    vocabulary = records.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "term int, word string")
    rows = top.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "x"))
    rows = rows.select("topic", F.col("x.termIndices").alias("term"), F.col("x.termWeights").alias("weight"), (F.col("pos") + 1).alias("rank"))
    return rows.join(vocabulary, "term").select("topic", "word", "weight", "rank")
