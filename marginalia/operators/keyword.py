"""A keyword model of where codes stand around its middle, averaged over exemplars, and windows scored by it at the best scale.

The scale of each window is found by climbing: all windows take their steps together, as rows of a frontier, and those that no longer
gain leave it; the search ends when a count finds none left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.tables import one_of_each
from marginalia.runtime import materialise, small


def gathered(points: DataFrame) -> DataFrame:
    """px, py, f and k, the number of equal points: they meet windows as one row."""
    return points if "k" in points.columns else materialise(points.groupBy("px", "py", "f").agg(F.count("*").alias("k")), "points")


def points_in_windows(points: DataFrame, windows: DataFrame, cell_w: float, cell_h: float) -> DataFrame:
    """Rows of ``windows`` (box, x, y, w, h, ..) with px, py, f, k of each point (``gathered``) inside, edges included.

    Both go to cells; a window to each that it touches, so cells should be about as large as windows are. The join is on equality."""
    at = points.select("px", "py", "f", "k", F.floor(F.col("px") / cell_w).alias("cx"), F.floor(F.col("py") / cell_h).alias("cy"))
    touched = lambda low, size, cell: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(low) + F.col(size)) / cell)))
    spread = windows.withColumn("cx", touched("x", "w", cell_w)).withColumn("cy", touched("y", "h", cell_h))
    inside = F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h"))
    return at.join(spread, ["cx", "cy"]).where(inside).drop("cx", "cy")


def _cell(offset: Column, scale: Column, step: float) -> Column:
    """The model's cell of an offset from the middle, cut to whole places and scaled."""
    whole = F.when(offset < 0, F.ceil(offset)).otherwise(F.floor(offset))
    return F.floor(F.round(whole * scale / step, 9)).cast("int")


def learnt(points: DataFrame, exemplars: DataFrame, w: float, h: float, step: float = 1.0) -> DataFrame:
    """f, gx, gy, value: how often a code stands in a cell of ``step`` places around the middle, per exemplar (box, x, y)."""
    n = exemplars.count()
    windows = exemplars.groupBy("x", "y").agg(F.count("*").alias("m")).select("x", "y", "m", F.lit(w).alias("w"), F.lit(h).alias("h"))
    seen = points_in_windows(gathered(points), windows, w, h)
    one = F.lit(1.0)
    cells = seen.select("f", (F.col("k") * F.col("m")).alias("n"), _cell(F.col("px") - (F.col("x") + w / 2), one, step).alias("gx"), _cell(F.col("py") - (F.col("y") + h / 2), one, step).alias("gy"))
    return cells.groupBy("f", "gx", "gy").agg((F.sum("n") / F.lit(max(n, 1))).alias("value"))


def scored(points: DataFrame, tries: DataFrame, model: DataFrame, w: float, h: float, step: float = 1.0) -> DataFrame:
    """box, scale, score of the tries (box, x, y, scale): the mean of the model's values over the codes in the window, which keeps its
    middle and is ``scale`` times as wide and high. A window without codes has 0."""
    placed = tries.select("box", "scale", (F.col("x") + w / 2).alias("mx"), (F.col("y") + h / 2).alias("my"), (F.lit(w) * F.col("scale")).alias("w"), (F.lit(h) * F.col("scale")).alias("h"))
    placed = placed.withColumns({"x": F.col("mx") - F.col("w") / 2, "y": F.col("my") - F.col("h") / 2})
    seen = points_in_windows(gathered(points), placed, w, h)
    cells = seen.select("box", "scale", "f", "k", _cell(F.col("px") - F.col("mx"), F.col("scale"), step).alias("gx"), _cell(F.col("py") - F.col("my"), F.col("scale"), step).alias("gy"))
    counted = cells.groupBy("box", "scale", "f", "gx", "gy").agg(F.sum("k").alias("n")).join(small(model), ["f", "gx", "gy"], "left")
    found = counted.groupBy("box", "scale").agg((F.sum(F.col("n") * F.coalesce("value", F.lit(0.0))) / F.sum("n")).alias("score"))
    return tries.select("box", "scale").join(found, ["box", "scale"], "left").select("box", "scale", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))


def climbed(points: DataFrame, boxes: DataFrame, model: DataFrame, w: float, h: float, *, start: float = 1.0, by: float = 0.1, reach: float = 0.3, step: float = 1.0) -> DataFrame:
    """box, scale, score: each window (box, x, y) at the scale where climbing ends.

    A window that scores at its starting scale at least as well as a step to either side stays there. Otherwise it goes the better way (ties:
    larger), a step at a time, while it gains and is within ``reach`` of the start.
    """
    points = gathered(points)
    every, boxes = one_of_each(boxes)
    model = materialise(model, "keyword-model")
    scale = lambda k: F.round(F.lit(start) + k * by, 9)
    first = boxes.withColumn("k", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1)))).withColumn("scale", scale(F.col("k")))
    began = first.select("box", "k", "scale").join(scored(points, first, model, w, h, step), ["box", "scale"])
    sides = began.groupBy("box").agg(*[F.max(F.when(F.col("k") == k, F.col("score"))).alias(name) for k, name in ((0, "here"), (-1, "less"), (1, "more"))])
    way = F.when((F.col("here") >= F.col("less")) & (F.col("here") >= F.col("more")), 0).when(F.col("less") > F.col("more"), -1).otherwise(1)
    state = sides.select("box", way.alias("way")).join(began, "box").where("k = way").select("box", "way", "k", "score")
    frontier = materialise(state, "climb")
    done = frontier.where("way = 0")
    frontier = frontier.where("way <> 0")
    while not frontier.isEmpty():
        within = F.abs(F.col("k")) * by < reach - 1e-9
        going = frontier.where(within).withColumn("next", F.col("k") + F.col("way"))
        tries = boxes.join(going.select("box", "next"), "box").withColumn("scale", scale(F.col("next")))
        found = scored(points, tries, model, w, h, step).withColumnRenamed("score", "new").drop("scale")
        moved = materialise(frontier.join(found, "box", "left").withColumn("gains", F.coalesce(F.col("new") > F.col("score"), F.lit(False))), "climb")
        done = done.unionByName(moved.where("NOT gains").select("box", "way", "k", "score"))
        frontier = moved.where("gains").select("box", "way", (F.col("k") + F.col("way")).alias("k"), F.col("new").alias("score"))
    found = done.select(F.col("box").alias("first"), scale(F.col("k")).alias("scale"), "score")
    return every.join(found, "first").select("box", "scale", "score")
