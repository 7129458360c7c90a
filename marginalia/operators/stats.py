"""Distribution statistics, weights and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(rows: DataFrame, value: Column) -> DataFrame:
    """n, low, high, mean and the population's standard deviation."""
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("sd"))


def pooled_sd(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """The square root of the mean of two population variances."""
    va, vb = (d.agg(F.var_pop(value).alias("v")) for d in (a, b))
    return va.join(vb.withColumnRenamed("v", "u")).select(F.round(F.sqrt((F.col("v") + F.col("u")) / 2), 6).alias("sd"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n: ``int((bins - 1) * (v - low) / (high - low))``; all values equal fall in bin 0."""
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = F.col("high") - F.col("low")
    place = F.when(width > 0, F.floor((bins - 1) * (F.col(value) - F.col("low")) / width)).otherwise(0)
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(ends)).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, *, last: bool = True) -> DataFrame:
    """threshold, between: the bin that best splits the histogram (bin, n) in two, the last of equals or the first.

    Splits are judged by the variance between classes: both sides' weights times the squared gap of their means.
    """
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    s = hist.withColumn("w0", F.sum("n").over(up)).withColumn("m0", F.sum(F.col("n") * F.col("bin")).over(up))
    s = s.withColumn("w", F.sum("n").over(everything)).withColumn("m", F.sum(F.col("n") * F.col("bin")).over(everything)).where("w0 < w")
    gap = F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / (F.col("w") - F.col("w0"))
    s = s.withColumn("between", F.round(F.col("w0").cast("double") / F.col("w") * (F.col("w") - F.col("w0")) / F.col("w") * gap * gap, 6))
    order = F.struct("between", F.col("bin") if last else -F.col("bin"))
    return s.agg(F.max_by("bin", order).alias("threshold"), F.max("between").alias("between"))


def otsu_span(hist: DataFrame) -> DataFrame:
    """first, last, middle: the first and last bins of the largest variance between classes whose means are cut to whole bins,
    and the place half-way."""
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    s = hist.withColumn("w0", F.sum("n").over(up)).withColumn("m0", F.sum(F.col("n") * F.col("bin")).over(up))
    s = s.withColumn("w", F.sum("n").over(everything)).withColumn("m", F.sum(F.col("n") * F.col("bin")).over(everything)).where("w0 < w")
    gap = F.floor(F.col("m0") / F.col("w0")) - F.floor((F.col("m") - F.col("m0")) / (F.col("w") - F.col("w0")))
    s = s.withColumn("between", F.round(F.col("w0").cast("double") / F.col("w") * (F.col("w") - F.col("w0")) / F.col("w") * gap * gap, 6))
    ends = s.agg(F.min_by("bin", F.struct(-F.col("between"), F.col("bin"))).alias("first"), F.max_by("bin", F.struct("between", "bin")).alias("last"))
    return ends.select("first", "last", ((F.col("first") + F.col("last")) / 2.0).alias("middle"))


def scaled(rows: DataFrame, keys: tuple[str, ...], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """keys, scaled (min-max into [low, high]), z (n - 1 in the deviation) and squashed, the logistic of z;
    null where all values are equal."""
    s = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"), F.avg(value).alias("m"), F.stddev_samp(value).alias("d"))
    met = rows.join(F.broadcast(s))
    z = (F.col(value) - F.col("m")) / F.nullif(F.col("d"), F.lit(0.0))
    return met.select(*keys, F.round(low + (high - low) * (F.col(value) - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)), 6).alias("scaled"), F.round(z, 6).alias("z"), F.round(1 / (1 + F.exp(-z)), 6).alias("squashed"))


def idf(terms: DataFrame) -> DataFrame:
    """term, idf: log of all occurrences over the term's."""
    c = terms.groupBy("term").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("all")))).select("term", F.round(F.log(F.col("all") / F.col("n")), 6).alias("idf"))


def tfidf(terms: DataFrame, doc: str) -> DataFrame:
    """doc, term, weight: share of the document times idf, each document's vector at unit length. A document whose terms
    all weigh nothing keeps zeros."""
    counts = terms.groupBy(doc, "term").agg(F.count("*").alias("tf"))
    every = counts.agg(F.sum("tf").alias("all"))
    weights = counts.groupBy("term").agg(F.sum("tf").alias("n")).join(F.broadcast(every)).select("term", F.log(F.col("all") / F.col("n")).alias("idf"))
    size = F.sum("tf").over(Window.partitionBy(doc))
    raw = counts.withColumn("size", size).join(weights, "term").withColumn("raw", F.col("tf") / F.col("size") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.withColumn("length", length).select(doc, "term", F.round(F.when(F.col("length") > 0, F.col("raw") / F.col("length")).otherwise(0.0), 6).alias("weight"))


def mean_vector(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """``by``, mean: the elementwise mean, as an array."""
    each = rows.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(by, F.transform("s", lambda s: s["x"]).alias("mean"))


def linear_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def quadratic_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """c0, c1, c2 of the least-squares parabola, from the sums of powers by Cramer's rule about the mean of x."""
    centre = rows.agg(F.avg(x).alias("mx"))
    p = rows.join(F.broadcast(centre)).withColumn("u", F.col(x) - F.col("mx"))
    u, v = F.col("u"), F.col(y)
    s = p.agg(F.first("mx").alias("mx"), F.count("*").alias("n"), *[F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(v * F.pow(u, F.lit(k))).alias(f"t{k}") for k in (0, 1, 2)])
    det = "(n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2))"
    a = f"((t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2))/{det})"
    b = f"((n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2))/{det})"
    c = f"((n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2))/{det})"
    return s.select(F.expr(f"round({a} - {b}*mx + {c}*mx*mx, 2)").alias("c0"), F.expr(f"round({b} - 2*{c}*mx, 4)").alias("c1"), F.expr(f"round({c}, 5)").alias("c2"))


def ink_spread(profiles: DataFrame, word: list[str], at: str, ink: str) -> DataFrame:
    """``word``, centre, spread: the centre of mass of each word's profile (rows ``at`` with their ``ink``) and the ink's standard deviation
    around it. Sums of ink, ink times place and ink times its square are added before the shuffle; words without ink are left out."""
    p, w = F.col(at).cast("double"), F.col(ink).cast("double")
    sums = profiles.groupBy(*word).agg(F.sum(w).alias("__w"), F.sum(w * p).alias("__wp"), F.sum(w * p * p).alias("__wpp")).where("__w > 0")
    centre = F.col("__wp") / F.col("__w")
    return sums.select(*word, centre.alias("centre"), F.sqrt(F.greatest(F.col("__wpp") / F.col("__w") - centre * centre, F.lit(0.0))).alias("spread"))


def page_spread(profiles: DataFrame, page: str, word: str, at: str, ink: str) -> DataFrame:
    """``page``, n_words, mean_spread: the mean over a page's words of their inks' spreads."""
    return ink_spread(profiles, [page, word], at, ink).groupBy(page).agg(F.count("*").alias("n_words"), F.avg("spread").alias("mean_spread"))
