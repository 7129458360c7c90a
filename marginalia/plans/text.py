"""Text queries: tokens, lexicons, n-grams, position histograms, edit distance and the simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import PHOC_BIGRAMS, clean_words, length_code, normalised_levenshtein
from marginalia.operators import stats, text_ops
from marginalia.plans.registry import query
from marginalia.plans.retrieval import BENCH_WORDS
from marginalia.runtime import table

TOKENS = r"""
    cleaned AS (SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[-_~\[\]]', ' ', 'g'), '[^A-Za-z0-9_\s&()]', '', 'g'), '([()])', ' \1 ', 'g'), '\s+', ' ', 'g'))), ' '), lambda w: w <> '') AS ws FROM documents),
    tok AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM cleaned)"""
NAMES = "names AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)"
GRAMS = f"{BENCH_WORDS}, cut AS (SELECT unnest(list_transform(range(1, len(word)), lambda i: substr(word, i, 2))) AS ngram FROM lex), grams AS (SELECT ngram, count(*) AS freq FROM cut GROUP BY ngram ORDER BY freq DESC, ngram LIMIT 20)"


def words(spark, sf_dir) -> DataFrame:
    return text_ops.tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


def lex(spark, sf_dir) -> DataFrame:
    return text_ops.lexicon(table(spark, sf_dir, "benchmark"), "text")


def grams(spark, sf_dir) -> DataFrame:
    return text_ops.top_ngrams(lex(spark, sf_dir), 2, 20)


def names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()


@query(f"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT word) AS n_distinct, max(len(word)) AS longest FROM tok GROUP BY doc_id")
def t01_tokens(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(clean_words(F.col("text")))).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.array_max(F.transform("w", F.char_length)).cast("long").alias("longest"))


@query(f"WITH {TOKENS}, {BENCH_WORDS} SELECT count(*) AS n, count(lex.word) AS n_in, count(*) - count(lex.word) AS n_out, round(100.0::DOUBLE * (count(*) - count(lex.word)) / count(*), 6) AS percent_out FROM tok LEFT JOIN lex USING (word)")
def t02_oov_rate(spark, sf_dir):
    return text_ops.vocabulary_rate(words(spark, sf_dir), lex(spark, sf_dir))


POSTS = f"{TOKENS}, {GRAMS}, w AS (SELECT DISTINCT doc_id, word FROM tok), posts AS (SELECT DISTINCT ngram, doc_id FROM w JOIN grams ON contains(word, ngram))"


@query(f"WITH {POSTS} SELECT ngram, count(*) AS n_docs, CAST(min(doc_id) AS BIGINT) AS first_doc FROM posts GROUP BY ngram")
def t03_ngram_postings(spark, sf_dir):
    posts = text_ops.document_postings(table(spark, sf_dir, "documents"), grams(spark, sf_dir), "doc_id", "text")
    return posts.groupBy("ngram").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {POSTS}, k AS (SELECT *, row_number() OVER (PARTITION BY ngram ORDER BY doc_id) AS rank FROM posts) SELECT ngram, rank, doc_id FROM k WHERE rank <= 5")
def t04_ngram_first_k(spark, sf_dir):
    return text_ops.first_k(text_ops.document_postings(table(spark, sf_dir, "documents"), grams(spark, sf_dir), "doc_id", "text"), 5, "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {BENCH_WORDS}, {NAMES} SELECT word FROM lex UNION SELECT word FROM names")
def t05_lexicon_union(spark, sf_dir):
    return lex(spark, sf_dir).union(names(spark, sf_dir)).distinct()


CHARS = f"""{NAMES}, ch AS (SELECT word, len(word) AS n, unnest(range(0, len(word))) AS i, unnest(string_split(word, '')) AS symbol FROM names),
    cell AS (SELECT level, unnest(range(0, level)) AS region FROM (SELECT unnest([2, 3, 4, 5]) AS level)),
    share AS (SELECT word, level, region, symbol, round((least((i + 1) / n, (region + 1) / level) - greatest(i / n, region / level)) * n, 9) AS share FROM ch CROSS JOIN cell WHERE contains('abcdefghijklmnopqrstuvwxyz0123456789', symbol))"""


@query(f"WITH {CHARS} SELECT word, level, CAST(region AS INT) AS region, symbol, round(max(share), 6) AS value FROM share WHERE share > 0 GROUP BY ALL")
def t06_phoc_soft(spark, sf_dir):
    return text_ops.phoc(names(spark, sf_dir))


@query(f"WITH {CHARS} SELECT word, level, CAST(region AS INT) AS region, symbol, count(*)::DOUBLE AS value FROM share WHERE share > 0.49 GROUP BY ALL")
def t07_phoc_hard(spark, sf_dir):
    return text_ops.phoc(names(spark, sf_dir), hard=True)


def _bigrams(levels: str, least: float) -> str:
    return f"""WITH {NAMES}, {GRAMS}, b AS (SELECT word, len(word) AS n, unnest(range(0, len(word) - 1)) AS i, unnest(list_transform(range(1, len(word)), lambda j: substr(word, j, 2))) AS ngram FROM names),
    cell AS (SELECT level, unnest(range(0, level)) AS region FROM (SELECT unnest({levels}) AS level))
    SELECT word, level, CAST(region AS INT) AS region, ngram, count(*) AS value FROM b JOIN grams USING (ngram) CROSS JOIN cell
    WHERE round((least((i + 2) / n, (region + 1) / level) - greatest(i / n, region / level)) * n / 2, 9) >= {least} GROUP BY ALL"""


@query(_bigrams("[2]", 0.48))
def t08_phoc_bigrams(spark, sf_dir):
    return text_ops.phoc_bigrams(names(spark, sf_dir), grams(spark, sf_dir))


@query(_bigrams("[2]", 0.48).replace(GRAMS, f"grams AS (SELECT unnest({PHOC_BIGRAMS}) AS ngram)"))
def t20_phoc_vocabulary(spark, sf_dir):
    """The bigram part over its own fixed vocabulary."""
    fixed = spark.createDataFrame([(g,) for g in PHOC_BIGRAMS], "ngram string")
    return text_ops.phoc_bigrams(names(spark, sf_dir), fixed)


@query(_bigrams("[2, 3, 4, 5]", 0.49))
def t09_phob(spark, sf_dir):
    return text_ops.phoc_bigrams(names(spark, sf_dir), grams(spark, sf_dir), levels=(2, 3, 4, 5), least=0.49)


@query(f"WITH {NAMES} SELECT word, array_to_string(list_transform(range(1, 11), lambda i: CASE WHEN i <= len(word) THEN i ELSE 0 END), ',') AS code FROM names")
def t10_length_code(spark, sf_dir):
    return names(spark, sf_dir).select("word", F.array_join(length_code(F.col("word"), 10).cast("array<string>"), ",").alias("code"))


@query(f"WITH {NAMES} SELECT a.word AS a, b.word AS b, levenshtein(a.word, b.word) AS distance, round(levenshtein(a.word, b.word) / greatest(len(a.word), len(b.word)), 6) AS share FROM names a JOIN names b ON a.word < b.word")
def t11_levenshtein_matrix(spark, sf_dir):
    a, b = names(spark, sf_dir).toDF("a"), names(spark, sf_dir).toDF("b")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(normalised_levenshtein(F.col("a"), F.col("b")), 6).alias("share"))


@query(f"WITH {NAMES}, m AS (SELECT a.word AS label, b.word AS other, round(levenshtein(a.word, b.word) / greatest(len(a.word), len(b.word)), 9) AS d FROM names a JOIN names b ON a.word <> b.word), b AS (SELECT label, min(struct_pack(d := d, other := other)) AS b FROM m GROUP BY label) SELECT label, b.other AS nearest, round(b.d, 6) AS distance FROM b")
def t12_nearest_name(spark, sf_dir):
    a, b = names(spark, sf_dir).toDF("label"), names(spark, sf_dir).toDF("other")
    d = F.struct(F.round(normalised_levenshtein(F.col("label"), F.col("other")), 9).alias("d"), "other")
    return a.join(b, F.col("label") != F.col("other")).groupBy("label").agg(F.min(d).alias("b")).select("label", F.col("b.other").alias("nearest"), F.round("b.d", 6).alias("distance"))


@query(f"""WITH {BENCH_WORDS}, w AS (SELECT word, substr(word, 2, 2) AS gram, '^[a-z]{{1,1}}' || substr(word, 2, 2) || '[a-z]{{' || (len(word) - 3) || ',' || (len(word) - 3) || '}}$' AS pattern FROM lex WHERE regexp_full_match(word, '[a-z]{{4,}}'))
    SELECT w.word, w.pattern, count(*) AS n_candidates FROM w JOIN lex ON len(lex.word) = len(w.word) AND regexp_matches(lex.word, w.pattern) GROUP BY w.word, w.pattern""")
def t13_partial_pattern(spark, sf_dir):
    """How many lexicon words fit what is left of a word when only its second and third letters are read."""
    every = lex(spark, sf_dir)
    w = every.where("regexp_like(word, '^[a-z]{4,}$')")
    hit = F.array(F.struct(F.lit(2).alias("at"), F.substr("word", F.lit(2), F.lit(2)).alias("gram")))
    p = w.select("word", text_ops.partial_pattern(hit, F.char_length("word")).alias("pattern"))
    met = p.join(every.toDF("other"), (F.char_length("word") == F.char_length("other")) & F.expr("regexp_like(other, pattern)"))
    return met.groupBy("word", "pattern").agg(F.count("*").alias("n_candidates"))


def _step(spark, sf_dir) -> DataFrame:
    known = words(spark, sf_dir).join(F.broadcast(lex(spark, sf_dir)), "word", "left_semi").where("regexp_like(word, '^[a-z]+$')")
    ids = known.select((F.col("doc_id") * 1000000 + F.col("at")).alias("word_id"), "word")
    return text_ops.simulate_step(ids, grams(spark, sf_dir), lex(spark, sf_dir), "word_id")


STEP = f"""WITH {TOKENS}, {GRAMS}, ids AS (SELECT doc_id * 1000000 + pos AS word_id, word FROM tok WHERE word IN (SELECT word FROM lex) AND regexp_full_match(word, '[a-z]+')),
    hit AS (SELECT word_id, word, ngram, unnest(list_filter(range(1, len(word)), lambda i: substr(word, i, 2) = ngram)) AS pos FROM ids JOIN grams ON contains(word, ngram)),
    apart AS (SELECT *, row_number() OVER (PARTITION BY word_id, ngram ORDER BY pos) AS k, lag(pos) OVER (PARTITION BY word_id, ngram ORDER BY pos) AS prev FROM hit),
    single AS (SELECT * FROM apart WHERE prev IS NULL OR pos - prev >= 2 OR (pos - prev = 1 AND k % 2 = 1)),
    seen AS (SELECT *, ('0x' || md5(concat_ws('|', 'spot', ngram, word_id::VARCHAR, pos::VARCHAR))[1:7])::BIGINT / 268435456.0::DOUBLE AS draw FROM single),
    got AS (SELECT word_id, word, pos, ngram FROM seen WHERE draw < 0.5),
    letters AS (SELECT word_id, count(DISTINCT l) AS n_spotted FROM (SELECT word_id, unnest([pos, pos + 1]) AS l FROM got) GROUP BY word_id)
    SELECT ids.word_id, len(word) AS n_letters, round(coalesce(n_spotted, 0) / len(word), 6) AS spotted_share FROM ids LEFT JOIN letters USING (word_id)"""


@query(STEP)
def t14_simulated_spotting(spark, sf_dir):
    return _step(spark, sf_dir).select("word_id", F.col("n_letters").cast("long").alias("n_letters"), "spotted_share")


@query()
def t15_progress_buckets(spark, sf_dir):
    return text_ops.progress_buckets(_step(spark, sf_dir))


@query(f"WITH s AS ({STEP}) SELECT CAST(count(*) FILTER (WHERE spotted_share < 0.2) AS BIGINT) AS b0, CAST(count(*) FILTER (WHERE spotted_share >= 0.2 AND spotted_share < 0.4) AS BIGINT) AS b1, CAST(count(*) FILTER (WHERE spotted_share >= 0.4 AND spotted_share < 0.6) AS BIGINT) AS b2, CAST(count(*) FILTER (WHERE spotted_share >= 0.6 AND spotted_share < 0.8) AS BIGINT) AS b3, CAST(count(*) FILTER (WHERE spotted_share >= 0.8) AS BIGINT) AS b4 FROM s")
def t19_spotted_buckets(spark, sf_dir):
    """The progress buckets alone, without the candidates."""
    return text_ops.progress_buckets(_step(spark, sf_dir).withColumn("transcribed", F.lit(False))).drop("n_transcribed")


@query(f"WITH {TOKENS}, f AS (SELECT word, min(doc_id * 1000000 + pos) AS first, count(*) AS n FROM tok GROUP BY word) SELECT word, first, n, row_number() OVER (ORDER BY first, word) AS class_id FROM f")
def t16_class_ids(spark, sf_dir):
    out = text_ops.class_ids(words(spark, sf_dir).select("word", (F.col("doc_id") * 1000000 + F.col("at")).alias("o")), "word", "o")
    return out.withColumn("class_id", F.col("class_id").cast("long"))


@query(f"WITH {TOKENS}, {NAMES}, stop AS (SELECT word FROM tok GROUP BY word ORDER BY count(*) DESC, word LIMIT 25) SELECT doc_id, count(*) AS n FROM tok WHERE word NOT IN (SELECT word FROM stop) GROUP BY doc_id")
def t17_stop_words(spark, sf_dir):
    every = words(spark, sf_dir)
    stop = every.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)
    return every.join(F.broadcast(stop.select("word")), "word", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY word HAVING count(*) >= 10")
def t18_min_frequency(spark, sf_dir):
    return words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")).where("n >= 10")


@query(f"WITH {TOKENS}, c AS (SELECT word, count(*) AS n FROM tok GROUP BY word) SELECT word AS term, round(ln((SELECT sum(n) FROM c) / n), 6) AS idf FROM c")
def s08_idf(spark, sf_dir):
    return stats.idf(words(spark, sf_dir).withColumnRenamed("word", "term"))


@query(f"""WITH {TOKENS}, c AS (SELECT doc_id, word, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT word, sum(tf) AS n FROM c GROUP BY word),
    raw AS (SELECT doc_id, word, tf / sum(tf) OVER (PARTITION BY doc_id) * ln((SELECT sum(tf) FROM c) / n) AS raw FROM c JOIN n USING (word)),
    w AS (SELECT doc_id, word, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, word) AS rn FROM w)
    SELECT doc_id, word AS term, round(weight, 6) AS weight FROM k WHERE rn <= 3""")
def s07_tfidf(spark, sf_dir):
    """The three heaviest terms of every document."""
    w = stats.tfidf(words(spark, sf_dir).withColumnRenamed("word", "term"), "doc_id")
    return w.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))).where("rn <= 3").drop("rn")


@query(f"""WITH {TOKENS}, c AS (SELECT unnest(string_split(word, '')) AS ch, unnest(range(0, len(word))) / len(word) AS p FROM tok) SELECT ch, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS sd FROM c GROUP BY ch""")
def s09_char_positions(spark, sf_dir):
    c = words(spark, sf_dir).select("word", F.posexplode(F.split("word", "")).alias("i", "ch")).where("ch <> ''").withColumn("p", F.col("i") / F.char_length("word"))
    return c.groupBy("ch").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("sd"))
