"""Fisher vectors and spatial pyramids over the vectors, cut into local features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.vectors import dot
from marginalia.operators import encoding, ranking
from marginalia.plans.registry import query
from marginalia.runtime import materialise, table

#: A vector is a 4 by 4 grid of features of four numbers; a feature also has its place. Bins are 2 by 2.
SIDE = 4
FEATURES = """feature AS (SELECT vec_id AS item, label, p, [embedding[4 * p + 1], embedding[4 * p + 2], embedding[4 * p + 3], embedding[4 * p + 4], (p % 4 + 0.5) / 4 - 0.5, (p // 4 + 0.5) / 4 - 0.5]::DOUBLE[] AS v FROM embeddings CROSS JOIN range(0, 16) t(p))"""


def features(spark, sf_dir) -> DataFrame:
    """item, label, features: sixteen arrays of four numbers and the place of each."""
    here = lambda p: F.concat(F.slice("embedding", 4 * p + 1, 4).cast("array<double>"), F.array((p % 4 + 0.5) / 4 - 0.5, (F.floor(p / 4) + 0.5) / 4 - 0.5))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label", F.transform(F.sequence(F.lit(0), F.lit(15)), here).alias("features"))


def by_class(rows: DataFrame) -> encoding.Mixture:
    """Each label's features as one component; a model with a row per label."""
    each = rows.select("label", F.explode("features").alias("v")).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s")).orderBy("label", "i").collect()
    d = max(r.i for r in each) + 1
    shape = lambda c: np.array([r[c] for r in each], dtype=np.float64).reshape(-1, d)
    n = shape("n")[:, 0]
    return encoding.Mixture(n / n.sum(), shape("m"), np.maximum(shape("s"), 1e-4))


@query(f"""WITH {FEATURES}, flat AS (SELECT item, label, p, unnest(range(1, 7)) AS i, unnest(v) AS x FROM feature),
    model AS (SELECT label AS k, i, avg(x) AS m, greatest(var_pop(x), 1e-4::DOUBLE) AS s FROM flat GROUP BY label, i), prior AS (SELECT label AS k, count(*) / sum(count(*)) OVER () AS w FROM feature GROUP BY label),
    logs AS (SELECT item, p, k, ln(any_value(w)) - 0.5::DOUBLE * sum((x - m) * (x - m) / s + ln(2 * pi() * s)) AS l FROM flat JOIN model USING (i) JOIN prior USING (k) GROUP BY item, p, k),
    top AS (SELECT *, max(l) OVER (PARTITION BY item, p) AS t FROM logs), post AS (SELECT item, p, k, exp(l - t) / sum(exp(l - t)) OVER (PARTITION BY item, p) AS q FROM top),
    raw AS (SELECT item, k, i, sum(q * (x - m) / sqrt(s)) / (16 * sqrt(any_value(w))) AS u, sum(q * ((x - m) * (x - m) / s - 1)) / (16 * sqrt(2 * any_value(w))) AS v FROM post JOIN flat USING (item, p) JOIN model USING (k, i) JOIN prior USING (k) GROUP BY item, k, i),
    rooted AS (SELECT item, k, i, sign(u) * sqrt(abs(u)) AS u, sign(v) * sqrt(abs(v)) AS v FROM raw)
    SELECT item, k AS component, i::INT AS place, round(u / sqrt(sum(u * u + v * v) OVER (PARTITION BY item)), 5) + 0.0 AS first_order, round(v / sqrt(sum(u * u + v * v) OVER (PARTITION BY item)), 5) + 0.0 AS second_order FROM rooted""")
def e01_fisher_by_class(spark, sf_dir):
    """Fisher vectors over a mixture that has a component per label."""
    rows = features(spark, sf_dir)
    model = by_class(rows)
    k, d = model.means.shape
    v = encoding.fisher_vectors(rows, model)
    at = F.explode(F.sequence(F.lit(0), F.lit(k * d - 1)))
    flat = v.select("item", "fisher", at.alias("j"))
    part = lambda more: F.round(F.get("fisher", F.col("j") + more), 5) + 0.0
    return flat.select("item", F.floor(F.col("j") / d).cast("int").alias("component"), (F.col("j") % d + 1).cast("int").alias("place"), part(0).alias("first_order"), part(k * d).alias("second_order"))


def binned(rows: DataFrame) -> DataFrame:
    """(bin, v) of the features, by their quarter of the grid."""
    each = rows.select(F.posexplode("features").alias("p", "v"))
    return each.select((F.floor(F.col("p") % SIDE / 2) * 2 + F.floor(F.col("p") / (2 * SIDE))).cast("int").alias("bin"), "v")


@query()
def e02_fisher_retrieval(spark, sf_dir):
    """Mixtures fitted per quarter by expectation-maximisation, Fisher vectors, and the precision of every hundredth against all others."""
    rows = features(spark, sf_dir)
    parts, _ = encoding.fit_mixtures(binned(rows), 4, 3, rounds=8)
    v = materialise(encoding.fisher_vectors(rows, encoding.Mixture.joined(parts)).join(rows.select("item", "label"), "item"), "fisher")
    asked = v.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("fisher").alias("qv"), F.col("label").alias("qlabel"))
    return ranking.searched_ap(asked, v.withColumnRenamed("fisher", "v")).select("query", "n_relevant", F.round("ap", 6).alias("ap"))


#: A vector is an 8 by 8 grid of codes; a code stands for five by five places.
SKIP, CODES, LEVELS = 5, 4, ((1, 1), (2, 1), (4, 2))
GRID = "cell AS (SELECT vec_id AS item, label, (n - 1) // 8 AS x, (n - 1) % 8 AS y, greatest(0, least(3, floor((e::DOUBLE + 0.2::DOUBLE) / 0.1::DOUBLE)))::INT AS code FROM (SELECT vec_id, label, unnest(range(1, 65)) AS n, unnest(embedding) AS e FROM embeddings))"


def pooled_sql(windows: str) -> str:
    """SQL for the pooled counts, by summing the cells of each part. A place is cut to whole numbers, then to whole cells, toward 0."""
    cell = lambda place: f"trunc(trunc({place}) / {SKIP})::INT"
    parts = " UNION ALL ".join(f"SELECT {n} AS level, {c} AS weight, {a} AS across, {d} AS down, i, j FROM range(0, {a}) r(i) CROSS JOIN range(0, {d}) q(j)" for n, ((a, d), c) in enumerate(zip(LEVELS, (1, 2, 8), strict=True)))
    return f"""{GRID}, windows AS ({windows}), parts AS ({parts}),
    boxes AS (SELECT win, level, weight, i, j, greatest(0, {cell('wx + i * (ww::DOUBLE / across)')}) AS x0, greatest(0, {cell('wy + j * (wh::DOUBLE / down)')}) AS y0, {cell('wx + (i + 1) * (ww::DOUBLE / across)')} AS x1, {cell('wy + (j + 1) * (wh::DOUBLE / down)')} AS y1 FROM windows CROSS JOIN parts),
    pooled AS (SELECT item, win, level, i, j, code, sum(weight)::DOUBLE AS n FROM boxes JOIN cell ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL)"""


SCAN = "SELECT (row_number() OVER (ORDER BY c, s DESC) - 1)::INT AS win, c - s // 2 AS wx, 0 AS wy, s AS ww, 40 AS wh FROM range(16 // 3, 40 - 16 // 3, 8) t(c) CROSS JOIN (VALUES (24), (20), (16)) u(s)"


def grids(spark, sf_dir) -> DataFrame:
    """item, label, grid of codes: each number of a vector in one of four steps."""
    code = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.greatest(F.lit(0), F.least(F.lit(CODES - 1), F.floor((e + 0.2) / 0.1))).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.slice(code, 8 * x + 1, 8)).alias("grid"))


@query(f"""WITH {pooled_sql(SCAN)} SELECT item, win AS "window", sum(n) AS total, sum(n * (1 + code + 4 * (level * 100 + j + i * 10))) AS checked FROM pooled GROUP BY item, win""")
def e03_pyramid_windows(spark, sf_dir):
    """Windows of three widths over every image, pooled in parts; the counts as two sums, the second of which tells the parts apart."""
    pooled = encoding.pyramids(grids(spark, sf_dir), CODES, LEVELS, SKIP, encoding.scan_widths(20, 8), normalised=False)
    marks = [1 + code + 4 * (level * 100 + j + i * 10) for level, (a, d) in enumerate(LEVELS) for i in range(a) for j in range(d) for code in range(CODES)]
    return pooled.select("item", "window", F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x).alias("total"), dot(F.col("pooled"), F.array(*map(F.lit, marks))).alias("checked"))


@query(f"""WITH {pooled_sql('SELECT 0 AS win, 0 AS wx, 0 AS wy, 40 AS ww, 40 AS wh')}, rooted AS (SELECT *, pow(n, 0.35::DOUBLE) AS r FROM pooled), u AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY item)) AS z FROM rooted),
    s AS (SELECT a.item AS query, b.item AS item, round(-sum(a.z * b.z), 6) AS score FROM u a JOIN u b ON a.level = b.level AND a.i = b.i AND a.j = b.j AND a.code = b.code WHERE a.item % 100 = 0 AND a.item <> b.item GROUP BY ALL),
    r AS (SELECT query, s.item, score, a.label = b.label AS relevant FROM s JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = s.item),
    mid AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY score) - 1 + floor((count(*) OVER (PARTITION BY query, score) - 1) / 2) AS rk FROM r),
    rel AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY rk) / (rk + 1) AS part FROM mid WHERE relevant) SELECT query, count(*) AS n_relevant, round(avg(part), 6) AS ap FROM rel GROUP BY query""")
def e04_word_bags(spark, sf_dir):
    """Whole images compared by their pyramids, every hundredth against all others; the score is the negated product."""
    rows = grids(spark, sf_dir)
    v = materialise(encoding.pyramids(rows, CODES, LEVELS, SKIP, lambda w, h: np.array([(0, 0, w, h)])).drop("window").join(rows.select("item", "label"), "item"), "pyramids")
    asked = v.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("pooled").alias("qv"), F.col("label").alias("qlabel"))
    return ranking.searched_ap(asked, v.withColumnRenamed("pooled", "v")).select("query", "n_relevant", F.round("ap", 6).alias("ap"))
