"""Selections, guards, grids and figures as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import ngrams
from marginalia.operators import blocks, ranking, selection, tables, text_ops
from marginalia.plans.registry import query
from marginalia.plans.retrieval import BENCH_WORDS, PLACED, RANKED, by_example, items, mid_tie
from marginalia.runtime import table

LINES = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
CELLS = "cells AS (SELECT (p_partkey % 40)::INT AS x, p_size AS y, round(avg(p_retailprice), 4) AS v FROM part GROUP BY ALL)"
AROUND = f"""{CELLS}, sides AS (SELECT unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy),
    met AS (SELECT c.x + dx AS x, c.y + dy AS y, sum(v) AS around, min(v) AS lowest FROM cells c CROSS JOIN sides GROUP BY ALL)"""


def draw(*parts: str) -> str:
    return f"('0x' || md5(concat_ws('|', {', '.join(parts)}))[1:7])::BIGINT::DOUBLE / 268435456.0"


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT vec_id AS item, n - 1 AS others, n >= 2 AS by_example, n >= 1 AS by_text FROM embeddings JOIN c USING (label) WHERE vec_id % 100 = 0")
def p01_eligible(spark, sf_dir):
    """Which of the stated queries have relevant items at all."""
    return selection.eligible(items(spark, sf_dir), "label").where("item % 100 = 0").select("item", "others", "by_example", "by_text")


@query("SELECT CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 8 THEN 'val' ELSE 'test' END AS split, label, count(*) AS n FROM embeddings GROUP BY ALL")
def p02_split_masks(spark, sf_dir):
    part = F.when(F.col("item") % 10 < 7, "train").when(F.col("item") % 10 < 8, "val").otherwise("test")
    return items(spark, sf_dir).groupBy(part.alias("split"), "label").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS item, label FROM embeddings WHERE vec_id IN (SELECT item_id * 3 FROM benchmark)")
def p03_rows_by_id(spark, sf_dir):
    wanted = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("item"))
    return items(spark, sf_dir).join(wanted, "item", "left_semi").select("item", "label")


@query(f"WITH {PLACED}, t AS (SELECT query, item, place, score FROM placed WHERE place <= 10) SELECT query, item, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE 1 - (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS shown FROM t WINDOW w AS (PARTITION BY query)")
def p04_rescaled_top(spark, sf_dir):
    """The ten best of each query with scores for display."""
    top = ranking.searched_places(*by_example(spark, sf_dir), 10)
    return selection.rescaled(top, ["query"], "score").select("query", "item", F.round("shown", 6).alias("shown"))


@query("""WITH l AS (SELECT r_regionkey AS i, n_nationkey AS j, -5.0::DOUBLE * r_regionkey AS a1, 1000.0::DOUBLE AS b1, -(100.0::DOUBLE * r_regionkey) * 1000.0 AS c1, -1000.0::DOUBLE AS a2, n_nationkey::DOUBLE AS b2, 40.0::DOUBLE * n_nationkey * 1000.0 AS c2 FROM region CROSS JOIN nation)
    SELECT i, j, round((b1 * c2 - c1 * b2) / (a1 * b2 - b1 * a2), 6) AS x, round((c1 * a2 - a1 * c2) / (a1 * b2 - b1 * a2), 6) AS y FROM l""")
def p05_line_grid(spark, sf_dir):
    """Where slanting rows and columns of a form cross: a line for each region and one for each nation."""
    d = lambda c: F.col(c).cast("double")
    met = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")))
    i, j, zero, far = d("r_regionkey"), d("n_nationkey"), F.lit(0.0), F.lit(1000.0)
    x, y = selection.crossing(selection.line_through(zero, 100 * i, far, 105 * i), selection.line_through(40 * j, zero, 41 * j, far))
    return met.select(F.col("r_regionkey").alias("i"), F.col("n_nationkey").alias("j"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT p_partkey AS item, CASE WHEN p_size * 12 BETWEEN len(p_name) * 5.0 AND len(p_name) * 20.0 THEN round(p_retailprice / 1000, 6) ELSE 1e10 END AS score FROM part")
def p06_width_guard(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("item"), selection.guarded(F.round(F.col("p_retailprice") / 1000, 6), F.col("p_size") * 12, F.char_length("p_name"), 5.0, 20.0, 1e10).alias("score"))


@query("SELECT p_partkey AS item, strpos(p_name, 'an') - 1 AS place, strpos(p_name, 'an') > 0 AND strpos(p_name, 'an') - 1 BETWEEN 4 - 2 - 1 AND 12 + 1 AS inside FROM part")
def p07_in_window(spark, sf_dir):
    place = F.expr("instr(p_name, 'an') - 1")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), place.cast("long").alias("place"), ((place >= 0) & selection.in_window(place, F.lit(2), F.lit(4), F.lit(12))).alias("inside"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE NOT isnan(l_extendedprice)")
def p08_no_nan(spark, sf_dir):
    return selection.no_nan(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(r"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) SELECT count(*) AS n_words, CAST(sum((regexp_matches(lower(word), '[a-z0-9]'))::INT) AS BIGINT) AS n_kept FROM w WHERE word <> ''")
def p09_not_all_zero(spark, sf_dir):
    """Words whose position histogram would be all zero, as they have no character of its alphabet, are left out of training."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    return w.agg(F.count("*").alias("n_words"), F.sum(F.lower("word").rlike("[a-z0-9]").cast("int")).alias("n_kept"))


@query(f"""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
    p AS (SELECT source, n, pick, CASE WHEN pick = 0 THEN 1 WHEN pick = 4 THEN n WHEN n > 2 THEN 2 + floor({draw("'pages'", 'source', 'pick')} * (n - 2)) END AS pos FROM (SELECT DISTINCT source, n FROM n) CROSS JOIN range(0, 5) t(pick))
    SELECT source, pick::INT AS pick, doc_id FROM p JOIN n USING (source, pos)""")
def p11_sampled(spark, sf_dir):
    """The first document of each source, three drawn ones and the last."""
    return selection.sampled(table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id"), "source", "doc_id", 3, "pages")


@query(f"SELECT label, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY {draw(chr(39) + 'mix' + chr(39), 'vec_id')}, vec_id) AS place FROM embeddings")
def p12_shuffled(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy(selection.draw(F.lit("mix"), F.col("item").cast("string")), "item"))
    return items(spark, sf_dir).select("label", "item", place.cast("long").alias("place"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10000")
def p13_capped(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(10_000).select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 3")
def p14_third_best(spark, sf_dir):
    return selection.rth(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 3 = 1)
    SELECT c AS custkey, 'both' AS part FROM (SELECT c FROM a INTERSECT SELECT c FROM b) UNION ALL SELECT c, 'first' FROM (SELECT c FROM a EXCEPT SELECT c FROM b) UNION ALL SELECT c, 'second' FROM (SELECT c FROM b EXCEPT SELECT c FROM a)""")
def p15_sets(spark, sf_dir):
    """Two candidate sets: what they share and what either has alone."""
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(f"o_orderkey % 3 = {k}").select(F.col("o_custkey").alias("custkey")) for k in (0, 1))
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.subtract(b).withColumn("part", F.lit("first"))).union(b.subtract(a).withColumn("part", F.lit("second")))


@query(r"""WITH w AS (SELECT item_id * 1000 + i AS pos, ws[i] AS word FROM (SELECT item_id, string_split(lower(text), ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM benchmark) WHERE item_id % 2 = 0),
    u AS (SELECT item_id * 1000 + i AS pos, ws[i] AS word FROM (SELECT item_id, string_split(lower(text), ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM benchmark) WHERE item_id % 2 = 1)
    SELECT word, ia, ib FROM (SELECT word, min(pos) AS ia FROM w GROUP BY word) JOIN (SELECT word, min(pos) AS ib FROM u GROUP BY word) USING (word)""")
def p16_stable_intersect(spark, sf_dir):
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), " ")).alias("i", "word")).select("item_id", (F.col("item_id") * 1000 + F.col("i") + 1).alias("at"), "word")
    return selection.stable_intersect(each.where("item_id % 2 = 0"), each.where("item_id % 2 = 1"), "word")


@query(f"""WITH {LINES}, flat AS (SELECT vec_id, label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM flat GROUP BY i)
    SELECT label, round(avg(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END), 6) AS scaled FROM flat JOIN b USING (i) GROUP BY label""")
def p17_min_max_scaled(spark, sf_dir):
    """Each dimension scaled by its least and largest value over all vectors; the mean by class."""
    flat = items(spark, sf_dir).select("label", F.posexplode(F.transform("v", lambda x: x.cast("double"))).alias("i", "x"))
    b = flat.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return flat.join(b, "i").groupBy("label").agg(F.round(F.avg(scaled), 6).alias("scaled"))


@query(f"WITH {RANKED}, {mid_tie('r', 'query')} SELECT label, round(avg(ap), 6) AS ap FROM aps JOIN embeddings ON vec_id = query GROUP BY label")
def p18_ap_by_column(spark, sf_dir):
    """One precision for each class: the mean of its queries'."""
    aps = ranking.searched_ap(*by_example(spark, sf_dir))
    return aps.join(items(spark, sf_dir).select(F.col("item").alias("query"), "label"), "query").groupBy("label").agg(F.round(F.avg("ap"), 6).alias("ap"))


@query("SELECT c_nationkey AS class, string_agg(c_custkey, ',' ORDER BY c_custkey) AS ids, max(c_nationkey) OVER () + 1 AS n_classes FROM (SELECT c_nationkey, c_custkey FROM customer) GROUP BY c_nationkey")
def p19_ids_by_class(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = c.agg((F.max("c_nationkey") + 1).alias("n_classes"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda i: i.cast("string")), ",")
    return c.groupBy(F.col("c_nationkey").alias("class")).agg(ids.alias("ids")).join(F.broadcast(n)).select("class", "ids", "n_classes")


@query(f"WITH {PLACED}, won AS (SELECT q.label, b.label AS winner FROM placed JOIN embeddings q ON query = q.vec_id JOIN embeddings b ON item = b.vec_id WHERE place = 1) SELECT label, winner, count(*) AS wins, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM won GROUP BY label, winner")
def p20_winners(spark, sf_dir):
    """Of each class's queries, which classes win how often."""
    from pyspark.sql import Window

    each = items(spark, sf_dir)
    won = ranking.searched_places(*by_example(spark, sf_dir), 1).select("query", F.col("item").alias("best")).join(each.select(F.col("item").alias("query"), "label"), "query").join(each.select(F.col("item").alias("best"), F.col("label").alias("winner")), "best")
    n = won.groupBy("label", "winner").agg(F.count("*").alias("wins"))
    return n.withColumn("share", F.round(F.col("wins") / F.sum("wins").over(Window.partitionBy("label")), 6))


@query(f"WITH {AROUND} SELECT x, y, round(v / 2 + coalesce(around, 0) / 8, 4) AS p FROM cells LEFT JOIN met USING (x, y)")
def p21_neighbour_mean(spark, sf_dir):
    """Half of a cell and an eighth of each of its neighbours."""
    return selection.neighbours(cells(spark, sf_dir), "v").select("x", "y", F.round(F.col("v") / 2 + F.coalesce("around", F.lit(0.0)) / 8, 4).alias("p"))


def cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).cast("int").alias("x"), F.col("p_size").alias("y")).agg(F.round(F.avg("p_retailprice"), 4).alias("v"))


@query(f"WITH {AROUND} SELECT x, y, v FROM cells LEFT JOIN met USING (x, y) WHERE v < 1.5::DOUBLE * (SELECT min(v) FROM cells) AND (lowest IS NULL OR v <= lowest)")
def p22_minima_2d(spark, sf_dir):
    """Cells no higher than their neighbours and below one and a half times the least of all."""
    every = cells(spark, sf_dir)
    least = every.agg(F.min("v").alias("least"))
    return selection.neighbours(every, "v").join(F.broadcast(least)).where((F.col("v") < 1.5 * F.col("least")) & (F.col("lowest").isNull() | (F.col("v") <= F.col("lowest")))).select("x", "y", "v")


@query("WITH n AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part), g AS (SELECT unnest(list_transform(range(1, len(word)), lambda i: substr(word, i, 2))) AS g FROM n) SELECT g AS ngram, count(*) AS n, round(count(*) / 20, 6) AS by_20, round(count(*) / (SELECT count(*) FROM n), 6) AS by_words FROM g GROUP BY g")
def p23_ngram_averages(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    g = w.select(F.explode(ngrams(F.col("word"), 2)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(w.agg(F.count("*").alias("all")))).select("ngram", "n", F.round(F.col("n") / 20, 6).alias("by_20"), F.round(F.col("n") / F.col("all"), 6).alias("by_words"))


@query(f"WITH {LINES} SELECT vec_id AS item, round(atan2(e[2], e[1]), 6) AS angle, round(sqrt(e[1] * e[1] + e[2] * e[2]), 6) AS length FROM v")
def p24_angles(spark, sf_dir):
    a, b = F.get("v", F.lit(0)).cast("double"), F.get("v", F.lit(1)).cast("double")
    return items(spark, sf_dir).select("item", F.round(F.atan2(b, a), 6).alias("angle"), F.round(F.sqrt(a * a + b * b), 6).alias("length"))


@query("SELECT p_partkey AS item, 'page_' || lpad(p_partkey::VARCHAR, 8, '0') || '.png' AS name FROM part")
def p25_padded(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.format_string("page_%08d.png", "p_partkey").alias("name"))


@query(f"""WITH {BENCH_WORDS}, l AS (SELECT DISTINCT word AS truth, CASE WHEN len(word) > 3 THEN substr(word, 2) ELSE word END AS label FROM lex),
    m AS (SELECT truth, word, round(levenshtein(label, word) / greatest(len(label), len(word)), 9) AS d FROM l CROSS JOIN lex), b AS (SELECT truth, min(struct_pack(d := d, word := word)).word AS guess FROM m GROUP BY truth)
    SELECT count(*) AS n, round(avg((guess = truth)::INT), 6) AS accuracy, round(avg(CASE WHEN guess = truth THEN 0 ELSE levenshtein(guess, truth) / greatest(len(guess), len(truth)) END), 6) AS cer FROM b""")
def p26_recognition(spark, sf_dir):
    """Lexicon words that lost their first letter are read back: accuracy, and normalised character errors, 0 when correct."""
    lex = text_ops.lexicon(table(spark, sf_dir, "benchmark"), "text")
    labels = lex.select(F.col("word").alias("truth"), F.when(F.char_length("word") > 3, F.expr("substr(word, 2)")).otherwise(F.col("word")).alias("label"))
    read = labels.join(text_ops.nearest_word(labels.select("label").distinct(), lex), "label")
    right = F.col("guess") == F.col("truth")
    error = F.when(right, 0.0).otherwise(F.levenshtein("guess", "truth") / F.greatest(F.char_length("guess"), F.char_length("truth")))
    return read.agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 6).alias("accuracy"), F.round(F.avg(error), 6).alias("cer"))


@query(f"WITH {RANKED}, s AS (SELECT relevant, avg(score) AS m, stddev_pop(score) AS sd FROM r GROUP BY relevant) SELECT relevant, round(m, 6) AS mean, round(sd, 6) AS sd FROM s")
def p27_two_score_sets(spark, sf_dir):
    """Mean and population deviation of the scores of right and of wrong items."""
    return blocks.score_sets(*by_example(spark, sf_dir)).select("relevant", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"WITH {LINES}, n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v) SELECT vec_id AS item, round(CASE WHEN n > 0 THEN e[1] / n ELSE 0 END, 6) AS x1, round(n, 6) AS energy FROM n")
def p28_energy_normalised(spark, sf_dir):
    e = F.transform("v", lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    rows = items(spark, sf_dir).select("item", F.get("v", F.lit(0)).cast("double").alias("first"), n.alias("n"))
    return rows.select("item", F.round(F.when(F.col("n") > 0, F.col("first") / F.col("n")).otherwise(0.0), 6).alias("x1"), F.round("n", 6).alias("energy"))


@query("SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS BIGINT) AS first, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS past FROM documents")
def p29_offsets(spark, sf_dir):
    """Where each document begins and ends if those of a source are laid end to end."""
    laid = tables.running_before(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ("source",), ("doc_id",), ("n_chars",))
    first = F.col("n_chars_before")
    return laid.select("source", "doc_id", first.cast("long").alias("first"), (first + F.col("n_chars")).cast("long").alias("past"))


@query(f"WITH {PLACED} SELECT query, place, item, score FROM placed WHERE place <= 5")
def p30_top_five(spark, sf_dir):
    return ranking.searched_places(*by_example(spark, sf_dir), 5).select("query", F.col("place").cast("long").alias("place"), "item", "score")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS e1, 10.0::DOUBLE AS s2, 10.0::DOUBLE + l_quantity AS e2, l_quantity::DOUBLE / 2 AS s1 FROM lineitem),
    o AS (SELECT *, greatest(least(e1, e2) - greatest(s1, s2), 0.0) AS inter, greatest(e1, e2) - least(s1, s2) AS span FROM b),
    u AS (SELECT *, inter / span AS iou, inter / least(e1 - s1, e2 - s2) AS loose FROM o)
    SELECT l_orderkey, l_linenumber, round(iou, 6) AS iou, round(loose, 6) AS loose, round(iou + loose, 6) AS both, round(CASE WHEN iou + loose > 0 THEN 2 * iou * loose / (iou + loose) ELSE 0 END, 6) AS harmonic, coalesce(CASE WHEN iou + loose > 0 THEN 2 * iou * loose / (iou + loose) END, 0) >= 0.8 AS success FROM u""")
def p31_overlaps(spark, sf_dir):
    """Overlap over span, over the shorter one, their sum and harmonic mean, and whether that makes a success."""
    q = F.col("l_quantity").cast("double")
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (q / 2).alias("s1"), (q * 2).alias("e1"), F.lit(10.0).alias("s2"), (q + 10.0).alias("e2"))
    inter = F.greatest(F.least("e1", "e2") - F.greatest("s1", "s2"), F.lit(0.0))
    u = b.select("l_orderkey", "l_linenumber", (inter / (F.greatest("e1", "e2") - F.least("s1", "s2"))).alias("iou"), (inter / F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"))).alias("loose"))
    total = F.col("iou") + F.col("loose")
    harmonic = F.when(total > 0, 2 * F.col("iou") * F.col("loose") / total).otherwise(0.0)
    return u.select("l_orderkey", "l_linenumber", F.round("iou", 6).alias("iou"), F.round("loose", 6).alias("loose"), F.round(total, 6).alias("both"), F.round(harmonic, 6).alias("harmonic"), (harmonic >= 0.8).alias("success"))
