"""Attribute models, common subspaces and the six scoring front-ends over the vectors; a label's text is a short code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import attributes, frontends, subspace
from marginalia.plans.registry import query
from marginalia.runtime import table

#: A label's text: which label it is, and its four bits.
CODE = 14


def coded(spark, sf_dir) -> DataFrame:
    """item, label, v, y, and part: 0 to 2 to learn from, 3 to choose by, 4 to test on."""
    spelt = F.concat(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double")), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.expr("label").cast("int").bitwiseAND(F.pow(F.lit(2), b).cast("int")).cast("boolean").cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label", F.col("embedding").cast("array<double>").alias("v"), spelt.alias("y"), F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(5)).alias("part"))


@query()
def m12_attribute_models(spark, sf_dir):
    """Ten bags for each attribute; in each the regularisation of the best precision over the rows left out."""
    _, choice, _ = attributes.bagged(coded(spark, sf_dir), "item", "v", "y", rounds=15)
    return choice


@query()
def m13_out_of_bag(spark, sf_dir):
    """Each vector's attributes as scored by the bags that didn't hold it."""
    return attributes.bagged(coded(spark, sf_dir), "item", "v", "y", rounds=15)[2]


GRID = {"widths": (0.5, 1.0), "ms": (16, 32), "regs": (1e-2, 1e-3), "ks": (4, 8)}


@query()
def m14_kernel_subspace(spark, sf_dir):
    """Settings of a common subspace of vectors and texts, valued by retrieval by example and by text."""
    rows = coded(spark, sf_dir)
    return subspace.chosen(rows.where("part < 3"), rows.where("part = 3"), "item", "v", "y", "label", **GRID)[1]


@query()
def f01_front_ends(spark, sf_dir):
    """Six ways to compare every hundredth vector, and every label's text, with the vectors held back for testing; the mean precision of each."""
    rows = coded(spark, sf_dir)
    models = frontends.learnt(rows.where("part < 3"), rows.where("part = 3"), "item", "v", "y", "label", rounds=15, **GRID)
    test = rows.where("part = 4")
    asked = rows.where("item % 100 = 0").select("item", "label", "v")
    texts = rows.groupBy("label").agg(F.min("y").alias("y"))
    return frontends.evaluated(test, asked, texts, models, "item", "v", "label")
