"""Data sets: splits put together, a cache of read sets, stores with random access, and tables of results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def appended(train: DataFrame, test: DataFrame) -> DataFrame:
    """The rows of both with split, train or test; a column that one of them lacks is null there."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def load(spark: SparkSession, name: str, readers: Mapping[str, Callable[[SparkSession], DataFrame]], cache: str) -> DataFrame:
    """The set of that name, read once: later calls take the Parquet copy under ``cache``. An unknown name is an error."""
    if name not in readers:
        raise ValueError(f"no data set {name}; there are {sorted(readers)}")
    path = f"{cache}/{name}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        readers[name](spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_store(rows: DataFrame, key: str, path: str) -> None:
    """A store with random access: rows in order of the key, so that a key's row group is found by its bounds."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, key: str, wanted: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The wanted keys and columns of a store; both reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows if wanted is None else rows.where(F.col(key).isin(*wanted))
    return rows if columns is None else rows.select(key, *columns)


def matrix_columns(rows: DataFrame, vector: str, places: Sequence[int]) -> DataFrame:
    """The rows with ``vector`` cut down to some of its places (from 0), in that order."""
    return rows.withColumn(vector, F.array(*[F.get(vector, F.lit(p)) for p in places]))


def write_spottings(results: DataFrame, path: str) -> None:
    """Rows (query, item, x0, x1, score, relevant) as comma separated lines with a header, the best of a query first."""
    results.select("query", "item", "x0", "x1", "score", "relevant").repartitionByRange("query", "score").sortWithinPartitions("query", "score").write.mode("overwrite").option("header", True).csv(path)


def read_spottings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("query string, item long, x0 long, x1 long, score double, relevant boolean").csv(path)


def append_log(step: DataFrame, turn: int, path: str) -> None:
    """One turn of a simulation added to its log, with its number."""
    step.withColumn("turn", F.lit(turn)).write.mode("append").parquet(path)


def pointers(spark: SparkSession, path: str, ending: str = ".png") -> DataFrame:
    """label_file, image: each label file under ``path`` with the image of its name."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("label_file"))
    return files.withColumn("image", F.concat(F.regexp_replace("label_file", r"\.[^./]+$", ""), F.lit(ending)))
