"""Readers and writers of the text formats: box annotations, postings, bounds, segments, pages, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.text import clean_words
from marginalia.operators.tables import positions

#: The annotation line, as the strict and the lenient scan read it.
LENIENT = r"^(.+\.\S+) ([-\d]+) ([-\d]+) ([-\d]+) ([-\d]+) (\w+)"
STRICT = r"^(.*\.\w+) (\d+) (\d+) (\d+) (\d+) (.*)$"
#: A whole file's text without the blanks and line ends around it.
TRIM = r"^\s+|\s+$"
MODES = ("lenient", "failfast", "dropmalformed")


def read_boxes(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    """page, x1, y1, x2, y2, label of ``page x1 y1 x2 y2 label`` lines; blank lines are skipped.

    ``lenient`` takes signed numbers and cuts a label at its first non-word character, a line that doesn't fit giving
    nulls; ``failfast`` takes labels with blanks and raises on any other line; ``dropmalformed`` leaves such lines out.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    pattern = LENIENT if mode == "lenient" else STRICT
    lines = spark.read.text(path).where("trim(value) <> ''")
    fits = F.regexp_like("value", F.lit(pattern))
    if mode == "dropmalformed":
        lines = lines.where(fits)
    elif mode == "failfast":
        lines = lines.where(F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit("malformed annotation: "), "value")).cast("boolean")))
    part = lambda i: F.when(fits, F.regexp_extract("value", pattern, i))
    return lines.select(part(1).alias("page"), *[part(i).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 2)], part(6).alias("label"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """image, label of two-column lines."""
    p = r"^(\S+) (\w+)"
    return spark.read.text(path).where("trim(value) <> ''").select(F.regexp_extract("value", p, 1).alias("image"), F.regexp_extract("value", p, 2).alias("label"))


def expand_boxes(boxes: DataFrame, margin: int, width: Column, height: Column) -> DataFrame:
    """1-based boxes grown by a margin and clipped to the page, as 0-based ones."""
    low = lambda c: F.greatest(F.lit(1), F.col(c) - margin) - 1
    high = lambda c, most: F.least(most, F.col(c) + margin) - 1
    return boxes.withColumns({"x1": low("x1"), "y1": low("y1"), "x2": high("x2", width), "y2": high("y2", height)})


def bounded_heights(boxes: DataFrame, least: int, most: int) -> DataFrame:
    """Boxes padded to a least height about their middle, with the scale that brings them under the greatest."""
    h = F.col("y2") - F.col("y1") + 1
    pad = F.greatest(F.lit(0), least - h)
    grown = boxes.withColumn("__pad", pad).withColumn("y1", F.col("y1") - F.floor(F.col("__pad") / 2).cast("int")).withColumn("y2", F.col("y2") + F.ceil(F.col("__pad") / 2).cast("int")).drop("__pad")
    return grown.withColumn("scale", F.least(F.lit(1.0), most / (F.col("y2") - F.col("y1") + 1)))


def centred_heights(boxes: DataFrame) -> DataFrame:
    """Boxes re-centred to one height: the mean plus one and a half standard deviations."""
    h = F.col("y2") - F.col("y1") + 1
    common = boxes.agg(F.round(F.avg(h) + 1.5 * F.stddev_pop(h)).cast("int").alias("__h"))
    middle = F.floor((F.col("y1") + F.col("y2")) / 2).cast("int")
    return boxes.join(F.broadcast(common)).withColumn("__m", middle).withColumn("y1", F.col("__m") - F.floor(F.col("__h") / 2).cast("int")).withColumn("y2", F.col("y1") + F.col("__h") - 1).drop("__h", "__m")


def write_boxes(boxes: DataFrame, path: str) -> None:
    """Annotation lines; labels that are empty or begin with ``&``, ``(`` or ``)`` are not words and are left out."""
    words = boxes.where("label <> ''").where(~F.substring("label", 1, 1).isin("&", "(", ")"))
    words.select(F.concat_ws(" ", "page", "x1", "y1", "x2", "y2", "label").alias("value")).write.text(path)


def write_json_split(boxes: DataFrame, path: str, share: float = 0.85) -> None:
    """h, w, gt as JSON lines in ``train`` and ``valid``, by the hash of the box."""
    part = F.when(F.pmod(F.xxhash64("page", "x1", "y1", "x2", "y2"), F.lit(100)) < 100 * share, "train").otherwise("valid")
    rows = boxes.select(part.alias("part"), F.to_json(F.struct((F.col("y2") - F.col("y1") + 1).alias("h"), (F.col("x2") - F.col("x1") + 1).alias("w"), F.col("label").alias("gt"))).alias("value"))
    rows.write.partitionBy("part").text(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """ngram, ids: pairs of lines, a key and a comma-separated list whose numbers are the ids. One file is one list, so
    its lines are numbered in it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", TRIM, ""), r"\r?\n")).alias("i", "line"))
    key = lines.where("i % 2 = 0").select((F.col("i") / 2).cast("int").alias("k"), F.trim("line").alias("ngram"))
    ids = lines.where("i % 2 = 1").select(F.floor(F.col("i") / 2).cast("int").alias("k"), F.regexp_extract_all("line", F.lit(r"\d+"), F.lit(0)).cast("array<bigint>").alias("ids"))
    return key.join(ids, "k").drop("k")


def write_postings(posts: DataFrame, path: str, id_col: str, k: int | None = None) -> None:
    """(ngram, id) rows as pairs of lines, ids in order, all of them or the first k."""
    ids = F.array_sort(F.collect_list(id_col))
    ids = F.slice(ids, 1, k) if k else ids
    lines = posts.groupBy("ngram").agg(ids.alias("ids")).select(F.concat("ngram", F.lit("\n"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("wordimg_"), i.cast("string"))), ",")).alias("value"))
    lines.coalesce(1).write.text(path)


def read_bounds(spark: SparkSession, path: str, *, confidence: bool = False) -> DataFrame:
    """word, page, x1..y2, chars of ragged lines ``word,page,x1,y1,x2,y2,(start,end)*``, with a confidence after each end if asked."""
    step = 3 if confidence else 2
    f = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", ",").alias("f"))
    rest = F.slice("f", 7, 100_000)
    field = lambda i, kind: F.element_at(rest, (i * step + 1).cast("int")).cast(kind)
    char = lambda i: F.struct(field(i, "int").alias("start"), F.element_at(rest, (i * step + 2).cast("int")).cast("int").alias("end"), *([F.element_at(rest, (i * step + 3).cast("int")).cast("double").alias("conf")] if confidence else []))
    count = F.floor(F.size(rest) / step).cast("int")
    chars = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), char)).otherwise(F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), lambda i: F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), *([F.lit(None).cast("double").alias("conf")] if confidence else []))), 2, 1))
    return f.select(F.element_at("f", 1).alias("word"), F.element_at("f", 2).alias("page"), *[F.element_at("f", i).cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 3)], chars.alias("chars"))


def write_bounds(rows: DataFrame, path: str) -> None:
    """The reader's lines, with confidences where the characters have them."""
    fields = [f.name for f in rows.schema["chars"].dataType.elementType]
    flat = F.flatten(F.transform("chars", lambda c: F.array(*[c[n].cast("string") for n in fields])))
    rows.select(F.concat_ws(",", "word", "page", "x1", "y1", "x2", "y2", flat).alias("value")).write.text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """page, x1..y2, label, chars: JSON instances, whose aligned starts and ends are mapped back by the scale to the page."""
    kind = "ori_image string, org_bbox array<int>, scale_factor double, gt string, alignment array<array<array<double>>>"
    j = spark.read.schema(kind).json(path)
    back = lambda v: F.floor(F.element_at("org_bbox", 1) + v / F.col("scale_factor")).cast("int")
    chars = F.transform(F.flatten("alignment"), lambda a: F.struct(back(a[0]).alias("start"), back(a[1]).alias("end")))
    return j.select(F.col("ori_image").alias("page"), *[F.element_at("org_bbox", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 1)], F.col("gt").alias("label"), chars.alias("chars"))


def align_segments(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments with the annotation of their page and box; the first of equals."""
    keys = ["page", "x1", "y1", "x2", "y2"]
    return segments.join(words.dropDuplicates(keys).select(*keys, F.col("label").alias("annotated")), keys)


def align_bounds(bounds: DataFrame, words: DataFrame, order: str) -> DataFrame:
    """The i-th bounds with the i-th word; a pair whose labels differ is an error."""
    met = positions(words, order).join(positions(bounds, order).select("rn", F.col("word").alias("bound_word"), "chars"), "rn")
    same = F.when(F.lower("label") == F.lower("bound_word"), True).otherwise(F.raise_error(F.concat(F.lit("bounds don't fit word "), "label")).cast("boolean"))
    return met.where(same).drop("rn", "bound_word")


def read_page_xml(spark: SparkSession, path: str) -> DataFrame:
    """page, line, word, label, x1..y2 of Page, TextLine, Word and Point elements: a word's box holds its points."""
    point = "array<struct<_x:int,_y:int>>"
    word = f"array<struct<Coords:struct<Point:{point}>,TextEquiv:struct<Unicode:string>>>"
    page = spark.read.format("xml").option("rowTag", "Page").option("ignoreNamespace", True).schema(f"_imageFilename string, TextLine array<struct<Word:{word}>>").load(path)
    line = page.select(F.col("_imageFilename").alias("page"), F.posexplode("TextLine").alias("line", "l"))
    each = line.select("page", "line", F.posexplode("l.Word").alias("word", "w"))
    box = lambda f, c: f(F.transform("w.Coords.Point", lambda p: p[c]))
    out = each.select("page", "line", "word", F.col("w.TextEquiv.Unicode").alias("label"), box(F.array_min, "_x").alias("x1"), box(F.array_min, "_y").alias("y1"), box(F.array_max, "_x").alias("x2"), box(F.array_max, "_y").alias("y2"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("page", "line").orderBy("x1", "word")))


def page_words(pages: DataFrame) -> DataFrame:
    """The rows with tokens, the cleaned words of each label."""
    return pages.withColumn("tokens", clean_words(F.col("label")))


def read_lines(spark: SparkSession, path: str, *, ranked: bool = False) -> DataFrame:
    """word of every line; with ``ranked``, rank from 1 within the file, which is read whole."""
    if not ranked:
        return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", TRIM, ""), r"\r?\n")).alias("i", "line"))
    return lines.select((F.col("i") + 1).alias("rank"), F.lower(F.trim("line")).alias("word"))


def read_frequencies(spark: SparkSession, path: str, least: int) -> DataFrame:
    """name, freq of comma-separated rows (second and sixth field) from ``least`` on."""
    f = F.split("value", ",")
    return spark.read.text(path).select(F.trim(F.element_at(f, 2)).alias("name"), F.try_element_at(f, F.lit(6)).try_cast("long").alias("freq")).where(F.col("freq") >= least)


def read_registrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("state string, file string, dx int, dy int, rot double, w int, h int, conf int").option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """name, row, values of ``[ rows cols ] v v ...`` files, one matrix each."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.split(F.trim(F.regexp_replace(F.regexp_replace("value", TRIM, ""), r"[\[\]]", " ")), r"\s+").alias("f"))
    t = t.select("name", F.element_at("f", 1).cast("int").alias("r"), F.element_at("f", 2).cast("int").alias("c"), F.slice("f", 3, 2_000_000_000).cast("array<double>").alias("v"))
    return t.select("name", "c", "v", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("row")).select("name", "row", F.expr("slice(v, row * c + 1, c)").alias("values"))


def write_matrix(rows: DataFrame, path: str) -> None:
    """(row, values) as one such file; nine significant digits are kept."""
    all_ = rows.agg(F.array_sort(F.collect_list(F.struct("row", "values"))).alias("m"))
    digits = lambda x: F.format_string("%.9g", x)
    body = F.array_join(F.flatten(F.transform("m", lambda r: F.transform(r["values"], digits))), " ")
    all_.select(F.concat(F.lit("[ "), F.size("m"), F.lit(" "), F.size(F.element_at("m", 1)["values"]), F.lit(" ] "), body).alias("value")).coalesce(1).write.text(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """code, center: a count, a depth and one value per line."""
    t = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", TRIM, ""), r"\s+").cast("array<double>").alias("v"))
    t = t.select(F.element_at("v", 2).cast("int").alias("d"), "v", F.explode(F.sequence(F.lit(0), F.element_at("v", 1).cast("int") - 1)).alias("code"))
    return t.select("code", F.expr("slice(v, code * d + 3, d)").alias("center"))


def read_weighted_codebook(spark: SparkSession, path: str) -> DataFrame:
    """code, center, idf of comma-separated rows whose last field is the weight."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", TRIM, ""), r"\r?\n")).alias("code", "line"))
    v = F.split("line", ",").cast("array<double>")
    return t.select("code", F.slice(v, 1, F.size(v) - 1).alias("center"), F.element_at(v, -1).alias("idf"))


def write_rankings(ranked: DataFrame, path: str) -> None:
    """``query{item,item,...}`` lines in rank order."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item")))
    lines = ranked.groupBy("query").agg(order.alias("o")).select(F.concat(F.col("query").cast("string"), F.lit("{"), F.array_join(F.transform("o", lambda x: x["item"].cast("string")), ","), F.lit("}")).alias("value"))
    lines.write.text(path)


def zero_runs(codes: Column) -> Column:
    """A sparse code sequence as text, ``:n`` standing for n zeros in a row."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("zeros"))
    flush = lambda s: F.when(s["zeros"] > 0, F.concat(s["out"], F.array(F.concat(F.lit(":"), s["zeros"].cast("string"))))).otherwise(s["out"])
    step = lambda s, x: F.when(x == 0, F.struct(s["out"].alias("out"), (s["zeros"] + 1).alias("zeros"))).otherwise(F.struct(F.concat(flush(s), F.array(x.cast("string"))).alias("out"), F.lit(0).alias("zeros")))
    return F.aggregate(codes, start, step, lambda s: F.array_join(flush(s), " "))


def from_zero_runs(text: Column) -> Column:
    part = lambda t: F.when(F.startswith(t, F.lit(":")), F.array_repeat(F.lit(0.0), F.regexp_replace(t, ":", "").try_cast("int"))).otherwise(F.array(t.try_cast("double")))
    return F.flatten(F.transform(F.split(text, " "), part))


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of image files whose name fits."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
