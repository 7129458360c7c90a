"""Windows along an axis, runs, intervals and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import interval_iou


def sliding_windows(items: DataFrame, size: Column, width: int, stride: int) -> DataFrame:
    """The items with w, x0, x1 of each window: at least one, and the last cut at the item's end."""
    count = F.greatest(F.lit(1), F.ceil((size - (width - 1)) / stride)).cast("int")
    each = items.withColumn("__size", size).withColumn("w", F.explode(F.sequence(F.lit(0), count - 1)))
    return each.withColumn("x0", F.col("w") * stride).withColumn("x1", F.least(F.col("w") * stride + width, F.col("__size")) - 1).drop("__size")


def best_and_second(windows: DataFrame, by: tuple[str, ...], at: str, exclusion: float, *, higher_is_better: bool = True) -> DataFrame:
    """``by``, choice (1, 2), ``at``, score: the best window and the best of those farther off than ``exclusion``."""
    order = [F.desc("score") if higher_is_better else F.asc("score"), F.asc(at)]
    w = Window.partitionBy(*by).orderBy(*order)
    # the best place reaches every window as a running value, so that one sort serves
    marked = windows.withColumn("rn", F.row_number().over(w)).withColumn("best", F.first(at).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = marked.where("rn = 1").select(*by, F.lit(1).alias("choice"), at, "score")
    far = marked.where(F.abs(F.col(at) - F.col("best")) > exclusion).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.unionByName(far.select(*by, F.lit(2).alias("choice"), at, "score"))


def refined_edges(hits: DataFrame, step: int, score: Column) -> DataFrame:
    """id, x0, x1, score after moving one edge, or both, by ``step``: the better single move of each edge is tried and then
    both together. ``score`` reads x0 and x1; the best of the five or fewer wins, ties to the smaller move."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (-step, 0), (step, 0), (0, -step), (0, step))])
    single = hits.withColumn("m", F.explode(moves)).withColumn("x0", F.col("x0") + F.col("m.a")).withColumn("x1", F.col("x1") + F.col("m.b")).where("x1 > x0 AND x0 >= 0").withColumn("score", score)
    rank = lambda cond: F.max(F.when(cond, F.struct("score", (-F.abs(F.col("m.a")) - F.abs(F.col("m.b"))).alias("small"), (-F.col("m.a") - F.col("m.b")).alias("low"), "m")))
    best = single.groupBy("id").agg(rank(F.lit(True)).alias("one"), rank(F.col("m.b") == 0).alias("left"), rank(F.col("m.a") == 0).alias("right"))
    back = hits.select("id", F.col("x0").alias("o0"), F.col("x1").alias("o1")).join(best, "id")
    both = back.withColumn("x0", F.col("o0") + F.col("left.m.a")).withColumn("x1", F.col("o1") + F.col("right.m.b")).withColumn("both", score)
    use = (F.col("both") > F.col("one.score")) & (F.col("x1") > F.col("x0"))
    return both.select("id", F.when(use, F.col("x0")).otherwise(F.col("o0") + F.col("one.m.a")).alias("x0"), F.when(use, F.col("x1")).otherwise(F.col("o1") + F.col("one.m.b")).alias("x1"), F.when(use, F.col("both")).otherwise(F.col("one.score")).alias("score"))


def run_ids(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """The rows with run: how often ``value`` has changed so far, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")
    return rows.withColumn("run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def squared_runs(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """``by``, squared: the sum of squared lengths of runs where ``value`` is true; a run that reaches the end isn't counted."""
    marked = run_ids(rows, by, order, value)
    last = marked.withColumn("last", F.max("run").over(Window.partitionBy(*by)))
    runs = last.groupBy(*by, "run", value, "last").agg(F.count("*").alias("n"))
    counted = F.when(F.col(value) & (F.col("run") < F.col("last")), F.col("n") * F.col("n")).otherwise(0)
    return runs.groupBy(*by).agg(F.sum(counted).alias("squared"))


def local_minima(profile: DataFrame, by: tuple[str, ...], at: str, value: str) -> DataFrame:
    """``by``, ``at`` where a low-pass derivative goes from below zero to zero or above.

    The frame is four values before against four from here on, weights 1, 1, 1, 2 and 2, 1, 1, 1, over 11. Places whose frame
    or whose predecessor's leaves the profile have no answer.
    """
    w = Window.partitionBy(*by).orderBy(at)
    value_at = lambda k: F.lag(value, -k).over(w)
    behind = value_at(-4) + value_at(-3) + value_at(-2) + 2 * value_at(-1)
    ahead = 2 * value_at(0) + value_at(1) + value_at(2) + value_at(3)
    slope = profile.withColumn("slope", F.round((ahead - behind) / 11, 9))
    return slope.withColumn("before", F.lag("slope").over(w)).where("before < 0 AND slope >= 0").select(*by, at)


def moving_average(profile: DataFrame, by: tuple[str, ...], at: str, value: str, radius: int) -> DataFrame:
    """``by``, ``at``, smooth: the mean over at most ``radius`` neighbours on either side."""
    return profile.select(*by, at, F.avg(value).over(Window.partitionBy(*by).orderBy(at).rowsBetween(-radius, radius)).alias("smooth"))


def overlapping_pairs(spans: DataFrame, by: str, cell: int, least: float) -> DataFrame:
    """``by``, a, b, iou of the pairs of spans (id, s, e) of one ``by`` whose ratio of overlap to joint extent is over ``least``.

    Spans meet in the cells of the axis that both touch, and a pair is given in the first cell they share.
    """
    each = spans.select(by, "id", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / cell).cast("long"), F.floor(F.col("e") / cell).cast("long"))).alias("c"))
    x, y = each.alias("x"), each.alias("y")
    met = x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.id") < F.col("y.id")))
    iou = interval_iou(F.col("x.s"), F.col("x.e"), F.col("y.s"), F.col("y.e"))
    first = F.col("x.c") == F.floor(F.greatest(F.col("x.s"), F.col("y.s")) / cell)
    return met.where(first & (iou > least)).select(F.col(f"x.{by}").alias(by), F.col("x.id").alias("a"), F.col("y.id").alias("b"), iou.alias("iou"))


def merged_hits(hits: DataFrame, by: str, least: float = 0.55) -> DataFrame:
    """``by``, s, e, score, n after folding hits (id, s, e, score) in order of id: a hit that overlaps a kept one by more
    than ``least`` joins the first such, keeping the better box and averaging the two scores.

    The order matters, so a ``by`` is one fold, in one task; a hit is held against all kept ones at once, in numpy columns. As in
    SQL, extremes pass over nulls, and a score that is null or was averaged with one stays null.
    """
    one = hits.select(by, "id", *[F.col(c).cast("double").alias(c) for c in ("s", "e", "score")])

    def folded(key, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("id", "s", "e", "score")], null_placement="at_start"))
        starts, ends = (table.column(c).to_numpy() for c in ("s", "e"))
        box, scores, best, n = np.zeros((2, 64)), [], [], []
        # NaN is the largest number to Spark
        larger = lambda x, y: x is not None and y is not None and (x > y or (x != x and y == y))
        for s, e, score in zip(starts, ends, table.column("score").to_pylist(), strict=True):
            k = box[:, : len(n)]
            joint = np.fmax(k[1], e) - np.fmin(k[0], s)
            over = np.divide(np.fmin(k[1], e) - np.fmax(k[0], s), joint, out=np.zeros(len(n)), where=joint != 0) > least
            at = int(over.argmax()) if len(n) else 0
            if len(n) and over[at]:
                if larger(score, best[at]):
                    box[:, at] = s, e
                if best[at] is None or larger(score, best[at]):
                    best[at] = score
                scores[at] = None if score is None or scores[at] is None else (scores[at] + score) / 2
                n[at] += 1
            else:
                if len(n) == box.shape[1]:
                    box = np.concatenate([box, np.zeros_like(box)], axis=1)
                box[:, len(n)] = s, e
                scores.append(score), best.append(score), n.append(1)
        kept = [pa.array(box[j, : len(n)], pa.float64(), from_pandas=True) for j in (0, 1)]
        names = pa.array([key[0].as_py()] * len(n), table.schema.field(by).type)
        return pa.table([names, *kept, pa.array(scores, pa.float64()), pa.array(n, pa.int32())], names=[by, "s", "e", "score", "n"])

    # by number, as little data would be few tasks, which is much to work on
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.repartition(parts, by).groupBy(by).applyInArrow(folded, f"`{by}` {one.schema[by].dataType.simpleString()}, s double, e double, score double, n int")


def smallest_interval(mass: DataFrame, by: str, at: str, weight: str, share: float) -> DataFrame:
    """``by``, lo, hi: the shortest stretch of places whose weight is over ``share`` of all, the first of equals.

    For every start the end is the first place where the cumulative weight is over what the start needs. Cumulative sums only
    rise, so starts and ends are put in one order, by need and by sum, and each start takes the next end. Weights are not negative.
    """
    w = Window.partitionBy(by).orderBy(at)
    sums = mass.groupBy(by, at).agg(F.sum(weight).alias("m"))
    sums = sums.withColumn("upto", F.sum("m").over(w)).withColumn("all", F.sum("m").over(Window.partitionBy(by)))
    sides = F.explode(F.array(
        F.struct(F.round("upto", 6).alias("value"), F.lit(0).alias("kind"), F.lit(None).cast(sums.schema[at].dataType).alias("lo"), F.col(at).alias("hi")),
        F.struct(F.round(F.col("upto") - F.col("m") + share * F.col("all"), 6).alias("value"), F.lit(1).alias("kind"), F.col(at).alias("lo"), F.lit(None).cast(sums.schema[at].dataType).alias("hi")),
    ))
    order = Window.partitionBy(by).orderBy("value", "kind", F.coalesce("hi", "lo")).rowsBetween(0, Window.unboundedFollowing)
    met = sums.select(by, sides.alias("s")).select(by, "s.*").withColumn("hi", F.first("hi", ignorenulls=True).over(order)).where("lo IS NOT NULL AND hi IS NOT NULL")
    best = met.groupBy(by).agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("d"), "lo", "hi")).alias("b"))
    return best.select(by, "b.lo", "b.hi")


def folds(rows: DataFrame, by: str, order: str, k: int, turn: int) -> DataFrame:
    """The rows with fold: ``ntile`` within each ``by``, shifted by ``turn``; fold 0 is the test part."""
    part = F.ntile(k).over(Window.partitionBy(by).orderBy(F.md5(F.col(order).cast("string")), order)) - 1
    return rows.withColumn("fold", ((part + turn) % k).cast("int"))
