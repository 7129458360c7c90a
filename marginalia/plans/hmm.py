"""Hidden Markov models over the events of each user."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import hmm
from marginalia.plans.registry import query
from marginalia.runtime import table

KINDS = ("click", "view", "purchase", "signup", "error")
MODEL = hmm.Model(np.array([0.7, 0.3]), np.array([[0.8, 0.2], [0.4, 0.6]]), np.ones((2, 1)), np.array([[[0.5, 0.4]], [[1.5, 0.6]]]), np.array([[[[0.3, 0.02], [0.02, 0.1]]], [[[0.5, -0.03], [-0.03, 0.08]]]]))


def normal_sql(x: str, y: str, mean: np.ndarray, c: np.ndarray) -> str:
    """SQL for the logarithm of a two-dimensional Gaussian density with numbers for its parameters."""
    det = float(c[0, 0] * c[1, 1] - c[0, 1] ** 2)
    dx, dy = f"({x} - {mean[0]}::DOUBLE)", f"({y} - {mean[1]}::DOUBLE)"
    return f"(-0.5::DOUBLE * ({c[1, 1]}::DOUBLE * {dx} * {dx} - {2 * c[0, 1]}::DOUBLE * {dx} * {dy} + {c[0, 0]}::DOUBLE * {dy} * {dy}) / {det!r}::DOUBLE - {math.log(2 * math.pi) + 0.5 * math.log(det)!r}::DOUBLE)"


OBSERVED = f"o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value / 10 AS x, coalesce(list_position([{', '.join(repr(k) for k in KINDS)}], event_type), 0) / 5 AS y FROM events)"
EMIT = f"e AS (SELECT user_id, pos, {normal_sql('x', 'y', MODEL.means[0, 0], MODEL.covariances[0, 0])} AS b0, {normal_sql('x', 'y', MODEL.means[1, 0], MODEL.covariances[1, 0])} AS b1 FROM o)"


@query(f"""WITH RECURSIVE {OBSERVED}, {EMIT}, w AS (SELECT user_id, unnest(range(0, (count(*) - 8) // 4 + 1)) AS stretch FROM o GROUP BY user_id HAVING count(*) >= 8),
    walk AS (SELECT user_id, stretch, 0 AS t, {math.log(0.7)!r}::DOUBLE + b0 AS v0, {math.log(0.3)!r}::DOUBLE + b1 AS v1 FROM w JOIN e USING (user_id) WHERE pos = 4 * stretch
        UNION ALL SELECT user_id, stretch, t + 1, b0 + greatest(v0 + {math.log(0.8)!r}::DOUBLE, v1 + {math.log(0.4)!r}::DOUBLE), b1 + greatest(v0 + {math.log(0.2)!r}::DOUBLE, v1 + {math.log(0.6)!r}::DOUBLE) FROM walk JOIN e USING (user_id) WHERE pos = 4 * stretch + t + 1 AND t < 7)
    SELECT user_id, stretch, round(greatest(v0, v1), 6) AS log_p FROM walk WHERE t = 7""")
def h01_heat_map(spark, sf_dir):
    """Stretches of eight events, every four of a user's, each scored by its likeliest path under a fixed model."""
    cut = hmm.segments(table(spark, sf_dir, "events"), "user_id", "event_id", seen(), 8, 4)
    return hmm.scores(cut, MODEL, ("user_id", "stretch")).withColumn("log_p", F.round("log_p", 6))


def seen() -> Column:
    """An event as its value and its kind's number."""
    return F.array(F.col("value") / 10, F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")), F.lit(0)) / 5.0)


def trained(spark, sf_dir) -> tuple[hmm.Model, list[float], DataFrame]:
    cut = hmm.segments(table(spark, sf_dir, "events"), "user_id", "event_id", seen(), 32, 32, whole=False)
    return *hmm.baum_welch(cut, hmm.first_model(cut, 3, 2), rounds=6, least=0.05), cut


@query()
def h02_baum_welch(spark, sf_dir):
    """Three states of two components trained on all users' events, and every stretch of 32 scored by the trained model."""
    model, _, cut = trained(spark, sf_dir)
    return hmm.scores(cut, model, ("user_id", "stretch"))


@query("""WITH m AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) AS cx, var_pop(y) AS cy, covar_pop(x, y) AS cxy FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label),
    d AS (SELECT vec_id, embedding[1] - mx AS dx, embedding[2] - my AS dy, cx, cy, cxy, cx * cy - cxy * cxy AS det FROM embeddings JOIN m USING (label))
    SELECT vec_id, round(-0.5::DOUBLE * (cy * dx * dx - 2 * cxy * dx * dy + cx * dy * dy) / det - ln(2 * pi()) - 0.5::DOUBLE * ln(det), 6) AS log_density FROM d""")
def h03_full_densities(spark, sf_dir):
    """The density of each vector's first two numbers under its label's full covariance."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    model = rows.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("cx"), F.var_pop("y").alias("cy"), F.covar_pop("x", "y").alias("cxy")).orderBy("label").collect()
    means, covariances = {r.label: np.array([r.mx, r.my]) for r in model}, {r.label: np.array([[r.cx, r.cxy], [r.cxy, r.cy]]) for r in model}
    return hmm.densities(rows.select("vec_id", "label", F.array("x", "y").alias("v")), means, covariances, "vec_id", "label").withColumn("log_density", F.round("log_density", 6))
