"""Queries written in SQL over the registered functions, features visited window by window, and the binary formats."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from marginalia.functions import sql
from marginalia.operators import blocks, keyword, tables, visitor
from marginalia.plans.registry import query
from marginalia.plans.retrieval import PLACED, by_example
from marginalia.plans.text import CHARS, NAMES
from marginalia.runtime import materialise, scratch_dir, table
from marginalia.sources import binary


def views(spark, sf_dir, *names: str) -> None:
    sql.register(spark)
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"u_{name}")


@query(f"WITH {CHARS} SELECT word, level::INT AS level, CAST(region AS INT) AS region, symbol, round(max(share), 6) AS value FROM share WHERE share > 0 GROUP BY ALL")
def u01_histogram_function(spark, sf_dir):
    """Position histograms of the distinct words of the part names, in SQL."""
    views(spark, sf_dir, "part")
    return spark.sql("SELECT word, h.* FROM (SELECT DISTINCT explode(split(lower(p_name), ' ')) AS word FROM u_part), LATERAL position_histogram(word, array(2, 3, 4, 5)) AS h")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS total, value FROM events),
    w AS (SELECT user_id, unnest(range(0, greatest(1, ceil((any_value(total) - (10 - 1)) / 4.0)::BIGINT))) * 4 AS start FROM e GROUP BY user_id)
    SELECT w.user_id AS user_id, start, count(*)::INT AS n, round(avg(value), 6) AS mean FROM w JOIN e ON e.user_id = w.user_id AND pos >= start AND pos < start + 10 GROUP BY w.user_id, start""")
def u02_window_function(spark, sf_dir):
    """Windows of ten events, every four of a user's, in SQL."""
    views(spark, sf_dir, "events")
    return spark.sql("SELECT user_id, start, n, round(mean, 6) AS mean FROM sliding_windows(TABLE(u_events) PARTITION BY (user_id) ORDER BY (event_id), 'user_id', 10, 4, 'value')")


@query(f"WITH {PLACED} SELECT query, round(avg(hits / place), 6) AS ap, round(1 / (1 + exp(-3 * avg(hits / place) + 1)), 6) AS p FROM placed WHERE relevant GROUP BY query")
def u03_precision_function(spark, sf_dir):
    """Precision of every hundredth vector, and its logistic curve in SQL. A vector's ranking is one of all others, too many rows for the
    aggregate ``average_precision``, so it is ranked in blocks."""
    sql.register(spark)
    asked, every = by_example(spark, sf_dir)
    blocks.ranked(asked, every.where("item IS NOT NULL"), blocks.in_order, "ap double").createOrReplaceTempView("u_precision")
    return spark.sql("SELECT query, round(ap, 6) AS ap, round(platt(ap, -3D, 1D), 6) AS p FROM u_precision")


@query(f"WITH {NAMES} SELECT a.word AS a, b.word AS b, round(levenshtein(a.word, b.word) / greatest(len(a.word), len(b.word)), 6) AS distance FROM names a JOIN names b ON len(a.word) = len(b.word) AND a.word < b.word AND a.word[1] = b.word[1]")
def u04_distance_function(spark, sf_dir):
    """Words of one length and first letter and their edit distances, in SQL."""
    views(spark, sf_dir, "part")
    return spark.sql("""WITH names AS (SELECT DISTINCT explode(split(lower(p_name), ' ')) AS word FROM u_part)
        SELECT a.word AS a, b.word AS b, round(normalised_levenshtein(a.word, b.word), 6) AS distance FROM names a JOIN names b ON char_length(a.word) = char_length(b.word) AND substr(a.word, 1, 1) = substr(b.word, 1, 1) AND a.word < b.word""")


CODES = 8
POINTS = f"pts AS (SELECT p_partkey AS pid, p_size * 1.0::DOUBLE AS px, p_retailprice / 30 AS py, (p_partkey % {CODES})::INT AS f FROM part), boxes AS (SELECT p_partkey AS box, px AS x, py AS y FROM pts JOIN part ON p_partkey = pid WHERE p_partkey % 100 = 0)"


@query(f"""WITH {POINTS}, idf AS (SELECT f, ln((SELECT count(*) FROM pts) / count(*)) + 1 AS w FROM pts GROUP BY f),
    model AS (SELECT f, w * n / sqrt(sum(w * n * w * n) OVER ()) AS m FROM (SELECT f, count(*) AS n FROM pts WHERE px < 10 GROUP BY f) RIGHT JOIN idf USING (f)),
    here AS (SELECT box, f, count(*) AS n FROM boxes JOIN pts ON px BETWEEN x AND x + 5 AND py BETWEEN y AND y + 4 GROUP BY box, f),
    t AS (SELECT box, f, w * n / sqrt(sum(w * n * w * n) OVER (PARTITION BY box)) AS v FROM here JOIN idf USING (f))
    SELECT box, round(sum((coalesce(m, 0) - coalesce(v, 0)) * (coalesce(m, 0) - coalesce(v, 0))), 6) AS score FROM (SELECT box, f FROM boxes CROSS JOIN idf) LEFT JOIN t USING (box, f) LEFT JOIN model USING (f) GROUP BY box""")
def u05_bag_detection(spark, sf_dir):
    """Windows over a page of coded points, scored by how far the weighed codes seen in them are from a learnt bag."""
    part = table(spark, sf_dir, "part")
    points = part.select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("px"), (F.col("p_retailprice") / 30).alias("py"), (F.col("p_partkey") % CODES).cast("int").alias("f"))
    boxes = points.where("pid % 100 = 0").select(F.col("pid").alias("box"), F.col("px").alias("x"), F.col("py").alias("y"))
    counted = points.groupBy("f").agg(F.count("*").alias("n"), F.count(F.when(F.col("px") < 10, 1)).alias("seen")).collect()
    total, n, seen = sum(r.n for r in counted), np.ones(CODES), np.zeros(CODES)
    weights = np.zeros(CODES)
    for r in counted:
        n[r.f], seen[r.f], weights[r.f] = r.n, r.seen, np.log(total / r.n) + 1
    bag = visitor.Bag(weights, visitor.unit_bag(seen, weights))
    # points at one place, and boxes at one place, meet once
    every, firsts = tables.one_of_each(boxes)
    found = visitor.visited(points.groupBy("px", "py", "f").agg(F.count("*").alias("k")), firsts, 5.0, 4.0, bag, ("f", "k")).withColumnRenamed("box", "first")
    return every.join(found, "first").select("box", F.round("value", 6).alias("score"))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings WHERE vec_id BETWEEN 40 AND 299")
def u06_matrix_format(spark, sf_dir):
    """The vectors through the binary matrix format, part by part, and some of its columns read back by their numbers."""
    binary.register(spark)
    rows = materialise(table(spark, sf_dir, "embeddings"), "matrix-rows")
    path = f"{scratch_dir(spark)}/marginalia/matrix-{uuid.uuid4().hex}"
    rows.select(F.col("vec_id").alias("number"), F.col("embedding").alias("v")).repartitionByRange(4, "number").sortWithinPartitions("number").write.format("matrix").mode("append").save(path)
    back = spark.read.format("matrix").option("columns_per_task", 50).load(path).where("number BETWEEN 40 AND 299")
    return back.join(rows.select("vec_id", "label"), F.col("number") == F.col("vec_id")).select("vec_id", "label", F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT vec_id AS number, 8 AS height, 8 AS width, list_sum(list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 100)))::BIGINT AS ink FROM embeddings WHERE vec_id % 7 = 3")
def u07_image_container(spark, sf_dir):
    """Small images in a container with a table of contents; some are read back by number."""
    binary.register(spark)
    grey = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor((x + 1) * 100).cast("int"))
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("number"), F.lit(8).alias("height"), F.lit(8).alias("width"), grey.alias("grey"))
    path = f"{scratch_dir(spark)}/marginalia/images-{uuid.uuid4().hex}"
    packed = images.select("number", "height", "width", F.unhex(F.array_join(F.transform("grey", lambda g: F.lpad(F.hex(g), 2, "0")), "")).alias("pixels"))
    packed.repartitionByRange(3, "number").sortWithinPartitions("number").write.format("images").mode("append").save(path)
    back = spark.read.format("images").option("columns_per_task", 40).load(path).where("number % 7 = 3")
    ink = F.expr("aggregate(transform(sequence(1, 64), i -> cast(conv(hex(substring(pixels, i, 1)), 16, 10) AS BIGINT)), 0L, (a, x) -> a + x)")
    return back.select("number", "height", "width", ink.alias("ink"))


KEYWORD = f"""{POINTS}, shown AS (SELECT pid AS box, px AS x, py AS y FROM pts WHERE pid % 100 = 50),
    cut AS (SELECT f, floor(trunc(px - (x + 6)))::INT AS gx, floor(trunc(py - (y + 5)))::INT AS gy FROM shown JOIN pts ON px BETWEEN x AND x + 12 AND py BETWEEN y AND y + 10),
    model AS (SELECT f, gx, gy, count(*) / (SELECT count(*) FROM shown) AS value FROM cut GROUP BY f, gx, gy),
    tries AS (SELECT box, k, round(1.0::DOUBLE + k * 0.1::DOUBLE, 9) AS s, x + 6 AS mx, y + 5 AS my FROM boxes CROSS JOIN range(-4, 5) t(k)),
    seen AS (SELECT box, k, f, floor(round(trunc(px - mx) * s, 9))::INT AS gx, floor(round(trunc(py - my) * s, 9))::INT AS gy FROM tries JOIN pts ON px BETWEEN mx - 12 * s / 2 AND mx - 12 * s / 2 + 12 * s AND py BETWEEN my - 10 * s / 2 AND my - 10 * s / 2 + 10 * s),
    score AS (SELECT box, k, round(coalesce(v, 0), 9) AS v FROM tries LEFT JOIN (SELECT box, k, avg(coalesce(value, 0)) AS v FROM seen LEFT JOIN model USING (f, gx, gy) GROUP BY box, k) USING (box, k)),
    row_ AS (SELECT box, list(v ORDER BY k) AS v FROM score GROUP BY box)"""
#: The list's places 1 to 9 are the steps -4 to 4. A climb ends at the first step that doesn't gain, at the third at the latest.
@query(f"""WITH {KEYWORD}, way AS (SELECT *, CASE WHEN v[5] >= v[4] AND v[5] >= v[6] THEN 0 WHEN v[4] > v[6] THEN -1 ELSE 1 END AS d FROM row_),
    stop AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v[5 + 2 * d] <= v[5 + d] THEN d WHEN v[5 + 3 * d] <= v[5 + 2 * d] THEN 2 * d ELSE 3 * d END AS k FROM way)
    SELECT box, round(1.0::DOUBLE + k * 0.1::DOUBLE, 9) AS scale, round(v[5 + k], 6) AS score FROM stop""")
def u08_keyword_climb(spark, sf_dir):
    """Windows over a page of coded points, each at the scale to which it climbs under a model learnt from other windows."""
    part = table(spark, sf_dir, "part")
    points = part.select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("px"), (F.col("p_retailprice") / 30).alias("py"), (F.col("p_partkey") % CODES).cast("int").alias("f"))
    at = lambda rest: points.where(F.col("pid") % 100 == rest).select(F.col("pid").alias("box"), F.col("px").alias("x"), F.col("py").alias("y"))
    model = keyword.learnt(points, at(50), 12.0, 10.0)
    return keyword.climbed(points, at(0), model, 12.0, 10.0).withColumn("score", F.round("score", 6))
