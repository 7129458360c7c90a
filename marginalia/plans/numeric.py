"""Queries over numbers, spans and tables: statistics, windows, joins and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators import spans, stats, tables
from marginalia.plans.registry import query
from marginalia.runtime import table


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("SELECT count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events")
def s01_moments(spark, sf_dir):
    return stats.moments(events(spark, sf_dir), F.col("value"))


@query("SELECT round(sqrt(((SELECT var_pop(l_quantity) FROM lineitem WHERE l_returnflag = 'R') + (SELECT var_pop(l_quantity) FROM lineitem WHERE l_returnflag = 'N')) / 2), 6) AS sd")
def s02_pooled_sd(spark, sf_dir):
    d = lines(spark, sf_dir)
    return stats.pooled_sd(d.where("l_returnflag = 'R'"), d.where("l_returnflag = 'N'"), "l_quantity")


HIST = "e AS (SELECT min(value) AS low, max(value) AS high FROM events), h AS (SELECT CAST(floor({n} * (value - low) / (high - low)) AS INT) AS bin, count(*) AS n FROM events CROSS JOIN e GROUP BY bin)"


@query(f"WITH {HIST.format(n=4999)} SELECT bin, n FROM h")
def s03_histogram(spark, sf_dir):
    return stats.histogram(events(spark, sf_dir), "value", 5000)


@query(f"""WITH {HIST.format(n=255)}, c AS (SELECT bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS m0, sum(n) OVER () AS w, sum(n * bin) OVER () AS m FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT bin, round(w0::DOUBLE / w * (w - w0) / w * (m0 / w0 - (m - m0) / (w - w0)) * (m0 / w0 - (m - m0) / (w - w0)), 6) AS between_ FROM c WHERE w0 < w)
    SELECT bin AS threshold, between_ AS "between" FROM b ORDER BY between_ DESC, bin DESC LIMIT 1""")
def s04_otsu(spark, sf_dir):
    return stats.otsu(stats.histogram(events(spark, sf_dir), "value", 256))


@query(f"""WITH {HIST.format(n=4999)}, c AS (SELECT bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS m0, sum(n) OVER () AS w, sum(n * bin) OVER () AS m FROM h WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    b AS (SELECT bin, round(w0::DOUBLE / w * (w - w0) / w * (floor(m0 / w0) - floor((m - m0) / (w - w0))) * (floor(m0 / w0) - floor((m - m0) / (w - w0))), 6) AS between_ FROM c WHERE w0 < w), t AS (SELECT bin FROM b WHERE between_ = (SELECT max(between_) FROM b))
    SELECT min(bin) AS "first", max(bin) AS "last", (min(bin) + max(bin)) / 2 AS middle FROM t""")
def s14_otsu_span(spark, sf_dir):
    return stats.otsu_span(stats.histogram(events(spark, sf_dir), "value", 5000))


@query("""WITH s AS (SELECT min(value) AS a, max(value) AS b, avg(value) AS m, stddev_samp(value) AS d FROM events)
    SELECT event_id, round(0.1 + (0.9 - 0.1) * (value - a) / (b - a), 6) AS scaled, round((value - m) / d, 6) AS z, round(1 / (1 + exp(-(value - m) / d)), 6) AS squashed FROM events CROSS JOIN s""")
def s05_scaled(spark, sf_dir):
    return stats.scaled(events(spark, sf_dir), ("event_id",), "value")


@query("WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS rn FROM c) SELECT l_returnflag, l_quantity AS m FROM k WHERE rn = 1")
def s10_mode(spark, sf_dir):
    """The most frequent quantity, the smallest of equals."""
    c = lines(spark, sf_dir).groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return c.groupBy("l_returnflag").agg(F.max(F.struct("n", -F.col("l_quantity"))).alias("b")).select("l_returnflag", (-F.col("b.col2")).alias("m"))


@query("SELECT l_returnflag, round(avg(DISTINCT l_quantity), 6) AS mean_distinct FROM lineitem GROUP BY l_returnflag")
def s11_avg_distinct(spark, sf_dir):
    return lines(spark, sf_dir).select("l_returnflag", "l_quantity").distinct().groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_distinct"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def s12_linear_fit(spark, sf_dir):
    return stats.linear_fit(lines(spark, sf_dir), "l_quantity", "l_extendedprice")


@query("""WITH c AS (SELECT avg(l_quantity) AS mx FROM lineitem), p AS (SELECT l_quantity - mx AS u, l_extendedprice AS v, mx FROM lineitem CROSS JOIN c),
    s AS (SELECT any_value(mx) AS mx, count(*)::DOUBLE AS n, sum(u) AS s1, sum(u^2) AS s2, sum(u^3) AS s3, sum(u^4) AS s4, sum(v) AS t0, sum(v * u) AS t1, sum(v * u^2) AS t2 FROM p),
    d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM s),
    k AS (SELECT mx, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2))/det AS a, (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2))/det AS b, (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2))/det AS c FROM d)
    SELECT round(a - b*mx + c*mx*mx, 2) AS c0, round(b - 2*c*mx, 4) AS c1, round(c, 5) AS c2 FROM k""")
def s13_quadratic_fit(spark, sf_dir):
    return stats.quadratic_fit(lines(spark, sf_dir), "l_quantity", "l_extendedprice")


@query("""WITH c AS (SELECT conv_id, turn, coalesce((lag(role) OVER w IS DISTINCT FROM role)::INT, 1) AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
    SELECT conv_id, turn, count(*) AS n, CAST(max(run) AS BIGINT) AS run FROM (SELECT conv_id, turn, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run FROM c) GROUP BY conv_id, turn""")
def w01_runs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return spans.run_ids(c, ("conv_id",), ("turn", "role", "text"), "role").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max("run").alias("run"))


PROFILE = "prof AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events)"


def profile(spark, sf_dir) -> DataFrame:
    """A user's values in time order stand in for a profile along an axis."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("user_id", F.row_number().over(w).alias("pos"), "value")


@query(f"WITH {PROFILE} SELECT user_id, pos, round(sum((value > 10)::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / pos, 6) AS precision_ FROM prof")
def w02_running_precision(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return profile(spark, sf_dir).select("user_id", F.col("pos").cast("long").alias("pos"), F.round(F.sum((F.col("value") > 10).cast("int")).over(w) / F.col("pos"), 6).alias("precision_"))


@query(f"""WITH {PROFILE}, s AS (SELECT user_id, pos, round((2 * value + lead(value, 1) OVER w + lead(value, 2) OVER w + lead(value, 3) OVER w - (lag(value, 4) OVER w + lag(value, 3) OVER w + lag(value, 2) OVER w + 2 * lag(value, 1) OVER w)) / 11, 9) AS slope FROM prof WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    b AS (SELECT *, lag(slope) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM s) SELECT user_id, pos FROM b WHERE before < 0 AND slope >= 0""")
def w03_local_minima(spark, sf_dir):
    return spans.local_minima(profile(spark, sf_dir), ("user_id",), "pos", "value").withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {PROFILE} SELECT user_id, pos, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS smooth FROM prof")
def w04_moving_average(spark, sf_dir):
    return spans.moving_average(profile(spark, sf_dir), ("user_id",), "pos", "value", 3).select("user_id", F.col("pos").cast("long").alias("pos"), F.round("smooth", 5).alias("smooth"))


WINDOWS = "win AS (SELECT doc_id, n_chars, unnest(range(0, greatest(1, CAST(ceil((n_chars - 499) / 140) AS BIGINT)))) AS w FROM documents), cut AS (SELECT doc_id, w, w * 140 AS x0, least(w * 140 + 500, n_chars) - 1 AS x1 FROM win)"


@query(f"WITH {WINDOWS} SELECT doc_id, count(*) AS n, CAST(max(x0) AS BIGINT) AS last_start, CAST(max(x1) AS BIGINT) AS last_end FROM cut GROUP BY doc_id")
def w05_sliding_windows(spark, sf_dir):
    w = spans.sliding_windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 500, 140)
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("x0").cast("long").alias("last_start"), F.max("x1").alias("last_end"))


@query(f"""WITH {PROFILE}, m AS (SELECT *, row_number() OVER w AS rn, first_value(pos) OVER w AS best FROM prof WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, pos)),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, pos) AS r2 FROM m WHERE abs(pos - best) > 4)
    SELECT user_id, 1 AS choice, pos, value AS score FROM m WHERE rn = 1 UNION ALL SELECT user_id, 2, pos, value FROM f WHERE r2 = 1""")
def w06_best_and_second(spark, sf_dir):
    return spans.best_and_second(profile(spark, sf_dir).withColumnRenamed("value", "score"), ("user_id",), "pos", 4.0).withColumn("pos", F.col("pos").cast("long"))


@query()
def w07_refined_edges(spark, sf_dir):
    """Each long line of text around its middle, scored by how near an edge comes to a third of it."""
    hits = table(spark, sf_dir, "documents").where("n_chars >= 400").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"), F.floor(F.col("n_chars") / 3).alias("x0"), F.floor(F.col("n_chars") * 2 / 3).alias("x1"))
    score = -F.abs(F.col("x0") - 150) - F.abs(F.col("x1") - 380) + F.col("id") * 0
    return spans.refined_edges(hits, 35, score)


SPANS = "sp AS (SELECT user_id, event_id AS id, CAST(floor(value * 20) AS BIGINT) AS s, CAST(floor(value * 20) AS BIGINT) + 40 + event_id % 60 AS e FROM events)"


def hits(spark, sf_dir) -> DataFrame:
    s = F.floor(F.col("value") * 20)
    return events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), s.alias("s"), (s + 40 + F.col("event_id") % 60).alias("e"), F.col("value").alias("score"))


@query(f"WITH {SPANS} SELECT user_id, x.id AS a, y.id AS b, round((least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s)), 6) AS iou FROM sp x JOIN sp y USING (user_id) WHERE x.id < y.id AND (least(x.e, y.e) - greatest(x.s, y.s)) / (greatest(x.e, y.e) - least(x.s, y.s)) > 0.55")
def w08_iou_pairs(spark, sf_dir):
    return spans.overlapping_pairs(hits(spark, sf_dir), "user_id", 100, 0.55).withColumn("iou", F.round("iou", 6))


AT = "list_position(list_transform(acc, lambda k: coalesce((least(k.e, x[1].e) - greatest(k.s, x[1].s)) / nullif(greatest(k.e, x[1].e) - least(k.s, x[1].s), 0), 0) > 0.55::DOUBLE), true)"


@query(f"""WITH h AS (SELECT user_id, event_id AS id, floor(value * 20)::DOUBLE AS s, floor(value * 20)::DOUBLE + 40 + event_id % 60 AS e, value::DOUBLE AS score FROM events),
    one AS (SELECT user_id, list([struct_pack(s := s, e := e, score := score, best := score, n := 1)] ORDER BY id) AS hs FROM h GROUP BY user_id),
    kept AS (SELECT user_id, unnest(list_reduce(hs, lambda acc, x: CASE WHEN coalesce({AT}, 0) > 0 THEN list_transform(acc, lambda k, i: CASE WHEN i = {AT} THEN
        struct_pack(s := CASE WHEN x[1].score > k.best THEN x[1].s ELSE k.s END, e := CASE WHEN x[1].score > k.best THEN x[1].e ELSE k.e END, score := (k.score + x[1].score) / 2, best := greatest(k.best, x[1].score), n := k.n + 1) ELSE k END)
        ELSE list_concat(acc, x) END)) AS k FROM one)
    SELECT user_id, k.s AS s, k.e AS e, k.score AS score, k.n AS n FROM kept""")
def w09_merged_hits(spark, sf_dir):
    return spans.merged_hits(hits(spark, sf_dir), "user_id")


@query("""WITH m AS (SELECT o_orderpriority AS p, CAST(floor(o_totalprice / 1000) AS BIGINT) AS pos, count(*) AS m FROM orders GROUP BY ALL),
    c AS (SELECT *, sum(m) OVER (PARTITION BY p ORDER BY pos) AS upto, sum(m) OVER (PARTITION BY p) AS total FROM m),
    x AS (SELECT a.p, a.pos AS lo, b.pos AS hi, row_number() OVER (PARTITION BY a.p ORDER BY b.pos - a.pos, a.pos) AS rn FROM c a JOIN c b ON a.p = b.p AND b.pos >= a.pos AND b.upto > round(a.upto - a.m + 0.8 * a.total, 6))
    SELECT p, lo, hi FROM x WHERE rn = 1""")
def w10_smallest_interval(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.floor(F.col("o_totalprice") / 1000).alias("pos"), F.lit(1).alias("one"))
    return spans.smallest_interval(o, "p", "pos", "one", 0.8)


@query("WITH n AS (SELECT label, vec_id, ntile(5) OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS part FROM embeddings) SELECT vec_id, label, CAST((part + 2) % 5 AS INT) AS fold FROM n")
def w11_folds(spark, sf_dir):
    return spans.folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 5, 2)


@query("WITH b AS (SELECT o_orderkey, coalesce(sum(round(o_totalprice * 100)::BIGINT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders), n AS (SELECT CAST(floor(round(before::DOUBLE, 4) / 5e8) AS BIGINT) AS node FROM b) SELECT node, count(*) AS n FROM n GROUP BY node")
def w12_partition_by_size(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return tables.cut_by_size(o, "o_orderkey", "cents", 5e8).groupBy("node").agg(F.count("*").alias("n"))


@query(f"""WITH {PROFILE}, c AS (SELECT *, value > 8 AS up, (lag(value > 8) OVER w IS DISTINCT FROM (value > 8))::INT AS ch FROM prof WINDOW w AS (PARTITION BY user_id ORDER BY pos)), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM c),
    g AS (SELECT user_id, run, any_value(up) AS up, count(*) AS n, run = max(run) OVER (PARTITION BY user_id) AS last FROM r GROUP BY user_id, run) SELECT user_id, CAST(sum(CASE WHEN up AND NOT last THEN n * n ELSE 0 END) AS BIGINT) AS squared FROM g GROUP BY user_id""")
def w13_squared_runs(spark, sf_dir):
    p = profile(spark, sf_dir).withColumn("up", F.col("value") > 8)
    return spans.squared_runs(p, ("user_id",), ("pos",), "up")


@query("""WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem) SELECT a.l_returnflag, count(*) AS n, round(sum(k.l_quantity), 2) AS quantity FROM lineitem a JOIN k USING (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) GROUP BY a.l_returnflag""")
def j01_five_key_join(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    a = lines(spark, sf_dir)
    return tables.first_match(a.select(*keys, "l_returnflag"), a.select(*keys), keys).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer), b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) SELECT c_name, s_name FROM a JOIN b USING (rn)")
def j02_positional_zip(spark, sf_dir):
    return tables.zip_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("c_name", "s_name")


@query("""WITH q AS (SELECT p_partkey AS box, p_size * 1.0 AS x, p_retailprice / 30 AS y FROM part WHERE p_partkey % 100 = 0) SELECT box, count(*) AS n FROM q JOIN part ON p_size BETWEEN x AND x + 5 AND p_retailprice / 30 BETWEEN y AND y + 4 GROUP BY box""")
def j03_range_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    points = p.select(F.col("p_partkey").alias("pid"), F.col("p_size").cast("double").alias("px"), (F.col("p_retailprice") / 30).alias("py"))
    boxes = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("box"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 30).alias("y"))
    # points at one place, and boxes at one place, meet once
    every, firsts = tables.one_of_each(boxes)
    met = tables.points_in_boxes(points.groupBy("px", "py").agg(F.count("*").alias("k")), firsts, 5.0, 4.0, ("k",)).groupBy("box").agg(F.sum("k").alias("n"))
    return every.join(met.withColumnRenamed("box", "first"), "first").select("box", "n")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS x, l_linenumber AS y FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS x, l_linenumber AS y FROM lineitem WHERE l_quantity > 25)
    SELECT count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) AS common, count(*) AS joint, round(count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) / count(*), 6) AS iou FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y""")
def j04_mask_iou(spark, sf_dir):
    d = lines(spark, sf_dir).select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), "l_returnflag", "l_quantity")
    return tables.mask_iou(d.where("l_returnflag = 'R'"), d.where("l_quantity > 25"), ["x", "y"])


@query("""WITH big AS (SELECT o_custkey AS c, min(-o_totalprice) AS score FROM orders WHERE o_totalprice > 200000 GROUP BY c) SELECT c_custkey, coalesce(score, (SELECT max(score) FROM big)) AS score, score IS NULL AS missed FROM customer LEFT JOIN big ON c = c_custkey""")
def j05_anti_append(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(-F.col("o_totalprice")).alias("score"))
    return tables.append_missed(big, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "score")


@query("WITH s AS (SELECT o_orderkey, max((o_orderkey % 500 = 250)::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM orders) SELECT o_orderkey FROM s WHERE seen = 1")
def j06_resume(spark, sf_dir):
    return tables.resume_from(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", F.col("o_orderkey") % 500 == 250)


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey FROM n WHERE rn % 13 = 0 OR rn % 43 = 0")
def j07_thinning(spark, sf_dir):
    return tables.thinned(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", (13, 43))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang FROM pages""")
def j08_html(spark, sf_dir):
    h = F.col("html")
    count = lambda p: F.size(F.regexp_extract_all(h, F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), count(r'<a href="([^"]*)"').alias("n_links"), count("<p>").alias("n_paragraphs"), F.regexp_extract(h, r'lang="([a-z]*)"', 1).alias("lang"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS INT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def j09_json(spark, sf_dir):
    e = events(spark, sf_dir).select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def j10_lookup_counts(spark, sf_dir):
    """Counted before joining, so that customers don't meet suppliers."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("suppliers"))
    met = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return met.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""WITH w AS (SELECT l_suppkey, l_partkey, sum(l_quantity)::DOUBLE AS m, sum(l_quantity::DOUBLE * l_linenumber) / sum(l_quantity)::DOUBLE AS c FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0),
    s AS (SELECT l_suppkey, l_partkey, sqrt(sum(l_quantity::DOUBLE * (c - l_linenumber) * (c - l_linenumber)) / any_value(m)) AS spread FROM lineitem JOIN w USING (l_suppkey, l_partkey) GROUP BY ALL)
    SELECT l_suppkey, count(*) AS n_words, round(avg(spread), 5) AS mean_spread FROM s GROUP BY l_suppkey""")
def s15_ink_spread(spark, sf_dir):
    """Suppliers as pages, parts as words, quantities by line number as profiles of ink."""
    return stats.page_spread(lines(spark, sf_dir), "l_suppkey", "l_partkey", "l_linenumber", "l_quantity").withColumn("mean_spread", F.round("mean_spread", 5))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS x, l_linenumber AS y FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS x, l_linenumber AS y FROM lineitem WHERE l_quantity > 25),
    j AS (SELECT 'joined' AS kind, x, y FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'cleared', x, y FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
    SELECT kind, count(*) AS n, min(x) AS left_x, max(x) AS right_x, min(y) AS upper_y, max(y) AS lower_y FROM j GROUP BY kind""")
def j11_partitions(spark, sf_dir):
    """Two partitions of places put together, and one cleared of the other's."""
    d = lines(spark, sf_dir).select(F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), "l_returnflag", "l_quantity")
    a, b = d.where("l_returnflag = 'R'"), d.where("l_quantity > 25")
    both = [(kind, tables.place_bounds(f(a, b, ["x", "y"]), "x", "y")) for kind, f in (("joined", tables.joined_places), ("cleared", tables.cleared_places))]
    return both[0][1].withColumn("kind", F.lit(both[0][0])).unionByName(both[1][1].withColumn("kind", F.lit(both[1][0]))).select("kind", "n", "left_x", "right_x", "upper_y", "lower_y")
