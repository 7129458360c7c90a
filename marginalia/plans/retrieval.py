"""Retrieval queries: every vector whose id is divisible by 100 against all others, and prototypes against all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import ngrams
from marginalia.functions.vectors import blended, dot, doubles, l2_normalised, power_normalised
from marginalia.operators import blocks, codebook, ranking, stats, text_ops
from marginalia.plans.registry import query
from marginalia.runtime import table

RANKED = """
    q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv, label AS qlabel FROM embeddings WHERE vec_id % 100 = 0),
    r AS (SELECT query, vec_id AS item, round(list_dot_product(qv, embedding::DOUBLE[]), 6) AS score, qlabel = label AS relevant FROM q JOIN embeddings ON query <> vec_id)"""
PLACED = f"""{RANKED},
    placed AS (SELECT *, row_number() OVER w AS place, CAST(sum(relevant::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hits FROM r WINDOW w AS (PARTITION BY query ORDER BY score DESC, item))"""


def mid_tie(source: str, by: str) -> str:
    return f"""mid AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score DESC) - 1 + floor((count(*) OVER (PARTITION BY {by}, score) - 1) / 2) AS rk FROM {source}),
    rel AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY rk) / (rk + 1) AS part FROM mid WHERE relevant),
    aps AS (SELECT {by}, count(*) AS n_relevant, avg(part) AS ap FROM rel GROUP BY {by})"""


MEANS = """
    flat AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
    each AS (SELECT label, i, avg(x) AS x FROM flat GROUP BY label, i),
    means AS (SELECT label, list(x ORDER BY i) AS mean FROM each GROUP BY label)"""


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"), "label")


def by_example(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The queries (query, qv, qlabel) and all items."""
    every = items(spark, sf_dir)
    return every.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("v").alias("qv"), F.col("label").alias("qlabel")), every


@query(f"WITH {RANKED}, {mid_tie('r', 'query')} SELECT query, n_relevant, round(ap, 6) AS ap FROM aps")
def r01_qbe_ap(spark, sf_dir):
    return ranking.searched_ap(*by_example(spark, sf_dir)).select("query", "n_relevant", F.round("ap", 6).alias("ap"))


@query(f"WITH {RANKED}, {mid_tie('r', 'query')} SELECT count(*) AS n_queries, round(avg(ap), 6) AS map FROM aps")
def r01_qbe_map(spark, sf_dir):
    return ranking.searched_ap(*by_example(spark, sf_dir)).agg(F.count("*").alias("n_queries"), F.round(F.avg("ap"), 6).alias("map"))


@query(f"WITH {PLACED} SELECT query, item AS best, relevant::INT AS p_at_1 FROM placed WHERE place = 1")
def r02_p_at_1(spark, sf_dir):
    best = ranking.searched_places(*by_example(spark, sf_dir), 1)
    return best.select("query", F.col("item").alias("best"), F.col("relevant").cast("int").alias("p_at_1"))


@query(f"""WITH {MEANS}, r AS (SELECT means.label AS query, vec_id AS item, round(list_dot_product(mean, embedding::DOUBLE[]), 6) AS score, means.label = embeddings.label AS relevant FROM means CROSS JOIN embeddings),
    {mid_tie('r', 'query')} SELECT query, n_relevant, round(ap, 4) AS ap FROM aps""")
def r03_prototype_ap(spark, sf_dir):
    """One query per class, its mean standing in for a text query; nothing is left out of its ranking."""
    every = items(spark, sf_dir)
    means = stats.mean_vector(every, "label", "v").withColumnRenamed("label", "query")
    met = every.join(F.broadcast(means)).select("query", "item", F.round(dot(F.col("mean"), F.col("v")), 6).alias("score"), (F.col("query") == F.col("label")).alias("relevant"))
    return ranking.mid_tie_ap(met).select("query", "n_relevant", F.round("ap", 4).alias("ap"))


SWEEP = f"""{MEANS}, q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv, label AS qlabel, mean FROM embeddings JOIN means USING (label) WHERE vec_id % 100 = 0),
    two AS (SELECT query, vec_id AS item, list_dot_product(qv, embedding::DOUBLE[]) AS a, list_dot_product(mean, embedding::DOUBLE[]) AS b, qlabel = label AS relevant FROM q JOIN embeddings ON query <> vec_id),
    r AS (SELECT query, item, n AS tenths, round(n / 10 * a + (1 - n / 10) * b, 6) AS score, relevant FROM two CROSS JOIN range(0, 11) t(n)),
    {mid_tie('r', 'tenths, query')}, s AS (SELECT tenths, round(avg(ap), 4) AS value FROM aps GROUP BY tenths)"""


@query(f"WITH {SWEEP} SELECT CAST(tenths AS INT) AS tenths, value, row_number() OVER (ORDER BY value DESC, tenths) = 1 AS best FROM s")
def r04_hybrid_sweep(spark, sf_dir):
    """Queries blended from an example and its class mean, eleven weights. A blend's score is the blend of the scores,
    so both dot products are taken once."""
    every = items(spark, sf_dir)
    means = stats.mean_vector(every, "label", "v").withColumnRenamed("label", "l")
    q = every.where("item % 100 = 0").join(F.broadcast(means), F.col("label") == F.col("l")).select(F.col("item").alias("query"), F.col("v").alias("qv"), "mean", F.col("label").alias("qlabel"))
    aps = ranking.searched_ap(q, every, ("qv", "mean"), tuple((n / 10, 1 - n / 10) for n in range(11)))
    s = aps.groupBy(F.col("blend").alias("tenths")).agg(F.round(F.avg("ap"), 4).alias("value"))
    return ranking.best_setting(s, "tenths", F.col("value"))


@query(f"WITH {PLACED} SELECT query, round(avg(hits / place), 6) AS ap FROM placed WHERE relevant GROUP BY query")
def r05_sorted_ap(spark, sf_dir):
    return blocks.ranked(*by_example(spark, sf_dir), blocks.in_order, "ap double").select("query", F.round("ap", 6).alias("ap"))


def _at_k(k: int) -> str:
    return f"""WITH {PLACED}, a AS (SELECT query, coalesce(sum(CASE WHEN relevant AND place <= {k} THEN hits / place END), 0.0) / least({k}, sum(relevant::INT)) AS ap_at_k,
        coalesce(max_by(hits / place, place) FILTER (WHERE relevant AND place <= {k}), 0.0) AS p_at_k, max(hits) FILTER (WHERE place <= {k}) / sum(relevant::INT) AS recall_at_k FROM placed GROUP BY query) """


def _upto(spark, sf_dir, k: int) -> DataFrame:
    return blocks.ranked(*by_example(spark, sf_dir), blocks.upto(k), "ap_at_k double, p_at_k double, recall_at_k double")


@query(_at_k(50) + "SELECT query, round(recall_at_k, 6) AS recall_at_50 FROM a")
def r06_recall(spark, sf_dir):
    return _upto(spark, sf_dir, 50).select("query", F.round("recall_at_k", 6).alias("recall_at_50"))


@query(_at_k(10) + "SELECT query, round(ap_at_k, 6) AS ap_at_10 FROM a")
def r07_ap_at_10(spark, sf_dir):
    return _upto(spark, sf_dir, 10).select("query", F.round("ap_at_k", 6).alias("ap_at_10"))


@query(_at_k(10) + "SELECT query, round(p_at_k, 6) AS p_at_10 FROM a")
def r08_p_at_10(spark, sf_dir):
    return _upto(spark, sf_dir, 10).select("query", F.round("p_at_k", 6).alias("p_at_10"))


@query(f"""WITH {PLACED}, h AS (SELECT *, hits / place AS p, hits / sum(relevant::INT) OVER (PARTITION BY query) AS rec FROM placed),
    b AS (SELECT query, arg_min(score, round(abs(p - 0.5), 9) * 1e7 + place / 1e6) AS sp, arg_min(score, round(abs(rec - 0.5), 9) * 1e7 + place / 1e6) AS sr, arg_min(p, round(abs(rec - 0.5), 9) * 1e7 + place / 1e6) AS pr FROM h WHERE relevant GROUP BY query)
    SELECT count(*) AS n_queries, round(avg(sp), 6) AS score_at_precision, round(avg(sr), 6) AS score_at_recall, round(avg(pr), 6) AS precision_at_recall FROM b""")
def r09_thresholds(spark, sf_dir):
    t = blocks.ranked(*by_example(spark, sf_dir), blocks.targets(0.5, 0.5), "score_at_precision double, score_at_recall double, precision_at_recall double")
    return t.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("score_at_precision", "score_at_recall", "precision_at_recall")])


@query(f"""WITH names AS (SELECT p_partkey AS id, lower(p_name) AS word FROM part), grams AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(word)), lambda i: substr(word, i, 2)))) AS g FROM names),
    q AS (SELECT g AS query FROM grams GROUP BY g ORDER BY count(*) DESC, g LIMIT 10),
    lists AS (SELECT id, list(g) AS gs FROM grams GROUP BY id), r AS (SELECT query, id AS item, round(p_retailprice / 2000, 6) AS score, list_contains(gs, query) AS relevant FROM q CROSS JOIN lists JOIN part ON id = p_partkey),
    {mid_tie('r', 'query')} SELECT query, n_relevant, round(ap, 6) AS ap FROM aps""")
def r10_multilabel_ap(spark, sf_dir):
    """A word is relevant for each bigram in its list; items are ranked by price."""
    part = table(spark, sf_dir, "part")
    lists = part.select(F.col("p_partkey").alias("item"), F.array_distinct(ngrams(F.lower("p_name"), 2)).alias("gs"), F.round(F.col("p_retailprice") / 2000, 6).alias("score"))
    q = lists.select(F.explode("gs").alias("query")).groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(10).select("query")
    r = lists.join(F.broadcast(q)).select("query", "item", "score", F.array_contains("gs", F.col("query")).alias("relevant"))
    return ranking.mid_tie_ap(r).select("query", "n_relevant", F.round("ap", 6).alias("ap"))


BENCH_WORDS = r"""bw AS (SELECT DISTINCT lower(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')) AS word FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) WHERE w <> '-'), lex AS (SELECT word FROM bw WHERE word <> '')"""


@query(f"""WITH {BENCH_WORDS}, labels_ AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS label FROM part),
    m AS (SELECT label, word, round(levenshtein(label, word) / greatest(len(label), len(word)), 9) AS d FROM labels_ CROSS JOIN lex), b AS (SELECT label, min(struct_pack(d := d, word := word)) AS b FROM m GROUP BY label)
    SELECT label, b.word AS guess, round(b.d, 6) AS distance FROM b""")
def r11_recognise(spark, sf_dir):
    """Each distinct word of the part names gets the nearest word of the benchmark's lexicon."""
    labels = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("label")).distinct()
    return text_ops.nearest_word(labels, text_ops.lexicon(table(spark, sf_dir, "benchmark"), "text"))


@query(f"""WITH {BENCH_WORDS}, w AS (SELECT conv_id * 1000 + turn AS line, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations), n AS (SELECT line, lower(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')) AS word FROM w),
    c AS (SELECT line, lex.word IS NOT NULL AS correct FROM n LEFT JOIN lex USING (word) WHERE n.word <> ''), s AS (SELECT line, avg(correct::INT) AS share FROM c GROUP BY line)
    SELECT round(100 * (1 - avg(share)), 6) AS wer, count(*) AS n_lines FROM s""")
def r12_word_error_rate(spark, sf_dir):
    """A turn is a line; a word counts as read if the lexicon has it."""
    lex = text_ops.lexicon(table(spark, sf_dir, "benchmark"), "text").withColumn("known", F.lit(True))
    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), F.explode(F.split("text", r"\s+")).alias("w")).select("line", text_ops.bare_word(F.col("w")).alias("word")).where("word <> ''")
    return ranking.word_error_rate(words.join(lex, "word", "left").select("line", F.coalesce("known", F.lit(False)).alias("correct")))


BOOK = "book AS (SELECT vec_id AS code, embedding::DOUBLE[] AS center FROM embeddings WHERE vec_id < 16), d AS (SELECT vec_id AS item, code, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], center), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM embeddings CROSS JOIN book)"


def _book(spark, sf_dir) -> DataFrame:
    """A codebook is a model, not the data searched: the first sixteen vectors stand in for trained centres."""
    return items(spark, sf_dir).where("item < 16").select(F.col("item").alias("code"), F.col("v").alias("center"))


@query(f"WITH {BOOK}, b AS (SELECT item, min(struct_pack(d := d, code := code)) AS b FROM d GROUP BY item) SELECT item, b.code AS code, b.d AS d FROM b")
def v01_nearest_codeword(spark, sf_dir):
    return codebook.nearest(items(spark, sf_dir), _book(spark, sf_dir))


@query(f"WITH {BOOK}, n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY d, code) AS rn FROM d) SELECT item, code, round(1 / (0.0001 + d) / sum(1 / (0.0001 + d)) OVER (PARTITION BY item), 6) AS weight FROM n WHERE rn <= 3")
def v02_soft_assignment(spark, sf_dir):
    return codebook.soft_assignment(items(spark, sf_dir), _book(spark, sf_dir), 3)


@query("""WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: sign(x) * pow(abs(x), 0.35)) AS v FROM embeddings)
    SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(list_sum(v) / sqrt(list_dot_product(v, v)), 5) AS total FROM p""")
def v03_power_norm(spark, sf_dir):
    v = items(spark, sf_dir).select(F.col("item").alias("vec_id"), power_normalised(F.col("v")).alias("v"))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), m AS (SELECT query, vec_id AS item, a, embedding::DOUBLE[] AS b FROM q JOIN embeddings ON query <> vec_id)
    SELECT query, item, round(list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 5) AS squared, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 5) AS absolute,
        round(1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 5) AS angle FROM m""")
def v04_distances(spark, sf_dir):
    return blocks.distances(*by_example(spark, sf_dir))


@query(f"WITH {MEANS} SELECT vec_id, round(list_dot_product(list_transform(list_zip(embedding::DOUBLE[], mean), lambda p: 0.3 * p[1] + 0.7 * p[2]), mean), 5) AS score FROM embeddings JOIN means USING (label)")
def v05_blend(spark, sf_dir):
    every = items(spark, sf_dir)
    met = every.join(stats.mean_vector(every, "label", "v"), "label")
    return met.select(F.col("item").alias("vec_id"), F.round(dot(blended(F.col("v"), F.col("mean"), 0.3), F.col("mean")), 5).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS size, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def v06_l2_norm(spark, sf_dir):
    v = F.col("v")
    return items(spark, sf_dir).select(F.col("item").alias("vec_id"), F.round(F.sqrt(dot(v, v)), 5).alias("size"), F.round(F.element_at(l2_normalised(doubles(v)), 1), 6).alias("first"))


@query("""SELECT quality, toxic, count(*) AS n, count(*) FILTER (WHERE len(text) > 1000) AS n_long, round(avg((len(text) > 1000)::INT), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic""")
def p01_precision_by_label(spark, sf_dir):
    met = table(spark, sf_dir, "documents").select("doc_id", (F.char_length("text") > 1000).cast("int").alias("long")).join(table(spark, sf_dir, "labels"), "doc_id")
    return met.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("long").alias("n_long"), F.round(F.avg("long"), 6).alias("share"))
