"""Model queries; invariants rather than SQL hold their results."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marginalia.functions.vectors import calibrated, dot
from marginalia.operators import learn
from marginalia.plans.registry import query
from marginalia.plans.retrieval import items
from marginalia.runtime import ship_package
from marginalia.streaming import hits
from marginalia.runtime import table


@query()
def m01_kmeans(spark, sf_dir):
    rows = items(spark, sf_dir)
    return learn.kmeans(rows, "v", 10).transform(learn.with_vector(rows, "v")).groupBy("prediction").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@query()
def m02_pca(spark, sf_dir):
    return learn.pca(items(spark, sf_dir), "v", 8).select("item", "projected")


@query()
def m03_gaussian_mixture(spark, sf_dir):
    rows = items(spark, sf_dir)
    low = learn.pca(rows, "v", 4)
    m = learn.gaussian_mixtures(low, "projected", 4)
    return m.transform(learn.with_vector(low, "projected")).select("item", "prediction", F.array_max(vector_to_array("probability")).alias("sure"))


@query()
def m04_svm_bags(spark, sf_dir):
    return learn.svm_bags(items(spark, sf_dir), "v", "label", bags=2)


@query()
def m05_platt(spark, sf_dir):
    every = items(spark, sf_dir)
    first = every.orderBy("item").limit(1).select(F.col("v").alias("qv"), F.col("label").alias("ql"))
    s = every.join(F.broadcast(first)).select("item", dot(F.col("v"), F.col("qv")).alias("score"), (F.col("label") == F.col("ql")).cast("int").alias("y"))
    a, b = learn.platt(s, "score", "y")
    return s.select("item", calibrated(F.col("score"), a, b).alias("p"), "y")


@query()
def m06_ridge(spark, sf_dir):
    ship_package(spark)
    rows = items(spark, sf_dir).withColumn("y", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double")))
    w = learn.ridge(rows, "v", "y", 0.1)
    return learn.spread(rows, "v", w).select("item", "label", "projected")


@query()
def m07_cca(spark, sf_dir):
    ship_package(spark)
    rows = items(spark, sf_dir).withColumn("a", F.slice("v", 1, 32)).withColumn("b", F.slice("v", 33, 32))
    wa, wb, s = learn.cca(rows, "a", "b", 4)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(s)], "axis int, correlation double")


@query()
def m08_random_features(spark, sf_dir):
    ship_package(spark)
    return learn.random_features(items(spark, sf_dir), "v", 32).select("item", "fourier")


@query()
def m09_self_organising_map(spark, sf_dir):
    ship_package(spark)
    nodes = learn.self_organising_map(items(spark, sf_dir), "v", 4)
    return spark.createDataFrame([(i, n.tolist()) for i, n in enumerate(nodes)], "node int, center array<double>")


@query()
def m10_hmm(spark, sf_dir):
    ship_package(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 12, 2).when(F.col("value") > 5, 1).otherwise(0).alias("o"))
    start, move = np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]])
    return learn.viterbi(events, "user_id", "event_id", "o", start, move, np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]))


@query()
def m11_lsh_neighbours(spark, sf_dir):
    every = items(spark, sf_dir).select("item", "v")
    return learn.lsh_neighbours(every, every.where("item % 100 = 0"), "item", "v", 5)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def x01_windowed_counts(spark, sf_dir):
    return hits.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 2))


@query("""WITH g AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def x02_sessions(spark, sf_dir):
    return hits.sessions(table(spark, sf_dir, "events"), "ts", "user_id")
