"""Lexicons, postings, position histograms, recognition and the transcription simulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import BIGRAM_SHARE, HARD_SHARE, PHOC_ALPHABET, PHOC_BIGRAM_LEVELS, PHOC_LEVELS, bare_word, clean_words, ngrams, normalised_levenshtein, partial_pattern, positions
from marginalia.operators.tables import running_before
from marginalia.runtime import materialise, small


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, at, word of every cleaned word."""
    return docs.select(id_col, F.posexplode(clean_words(F.col(text_col))).alias("at", "word"))


def lexicon(texts: DataFrame, text_col: str) -> DataFrame:
    """The distinct bare words; ``-`` and empty words are not usable labels."""
    words = texts.select(F.explode(F.split(text_col, r"\s+")).alias("w")).where("w <> '-'")
    return words.select(bare_word(F.col("w")).alias("word")).where("word <> ''").distinct()


def vocabulary_rate(words: DataFrame, known: DataFrame) -> DataFrame:
    """n, n_in, n_out, percent_out of the rows (word); the label ``-`` is not counted."""
    met = words.where("word <> '-'").join(known.select("word", F.lit(1).alias("k")), "word", "left")
    inside = F.coalesce(F.sum("k"), F.lit(0))
    return met.agg(F.count("*").alias("n"), inside.alias("n_in"), (F.count("*") - inside).alias("n_out"), F.round(100.0 * (F.count("*") - inside) / F.count("*"), 6).alias("percent_out"))


def top_ngrams(words: DataFrame, n: int, k: int) -> DataFrame:
    """ngram, freq, rank of the k most frequent n-grams, ties by n-gram."""
    counted = words.select(F.explode(ngrams(F.col("word"), n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "ngram").limit(k)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "ngram")))


def postings(words: DataFrame, grams: DataFrame, n: int, id_col: str) -> DataFrame:
    """(id, word), n-grams -> ngram, id of each word that contains the n-gram: words are cut into their n-grams, so the
    join is on equality and not on containment."""
    each = words.select(id_col, F.explode(F.array_distinct(ngrams(F.col("word"), n))).alias("ngram"))
    return each.join(grams.select("ngram"), "ngram").select("ngram", id_col)


def document_postings(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ngram, id of each document with a cleaned word that contains the n-gram. No n-gram has a space, so it is looked for in the
    cleaned words in a row: the few n-grams, a stated query set, go to the texts and no word is cut."""
    flat = docs.select(F.col(id_col), F.explode(F.array(F.array_join(clean_words(F.col(text_col)), " "))).alias("flat"))
    return flat.join(F.broadcast(grams.select("ngram")), F.col("flat").contains(F.col("ngram"))).select("ngram", id_col)


def first_k(posts: DataFrame, k: int, id_col: str) -> DataFrame:
    """ngram, rank, id of the first k ids of each n-gram."""
    w = Window.partitionBy("ngram").orderBy(id_col)
    return posts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("ngram", "rank", id_col)


def _regions(levels: Sequence[int]) -> Column:
    return F.array(*[F.struct(F.lit(v).alias("level"), F.lit(r).alias("region")) for v in levels for r in range(v)])


def phoc(words: DataFrame, *, levels: Sequence[int] = PHOC_LEVELS, hard: bool = False) -> DataFrame:
    """word, level, region, symbol, value of the position histogram, without its zeros.

    A character takes an equal share of the word. Soft: the largest share of a character's own width that
    lies in the region; hard: how many characters have more than ``HARD_SHARE`` of it there.
    """
    n = F.char_length("word")
    chars = words.where("word <> ''").select("word", n.alias("n"), F.posexplode(F.split("word", "")).alias("i", "symbol")).where("symbol <> ''").where(F.lit(PHOC_ALPHABET).contains(F.col("symbol")))
    each = chars.select("*", F.explode(_regions(levels)).alias("g")).select("*", "g.level", "g.region")
    inside = F.least((F.col("i") + 1) / F.col("n"), (F.col("region") + 1) / F.col("level")) - F.greatest(F.col("i") / F.col("n"), F.col("region") / F.col("level"))
    share = each.withColumn("share", F.round(inside * F.col("n"), 9)).where("share > 0")
    if hard:
        return share.where(F.col("share") > HARD_SHARE).groupBy("word", "level", "region", "symbol").agg(F.count("*").cast("double").alias("value"))
    return share.groupBy("word", "level", "region", "symbol").agg(F.round(F.max("share"), 6).alias("value"))


def phoc_bigrams(words: DataFrame, grams: DataFrame, *, levels: Sequence[int] = PHOC_BIGRAM_LEVELS, least: float = BIGRAM_SHARE) -> DataFrame:
    """word, level, region, ngram, value: in how many places a known bigram has its half overlap of ``least`` or more."""
    n = F.char_length("word")
    each = words.select("word", n.alias("n"), F.posexplode(ngrams(F.col("word"), 2)).alias("i", "ngram")).join(grams.select("ngram"), "ngram")
    each = each.select("*", F.explode(_regions(levels)).alias("g")).select("*", "g.level", "g.region")
    inside = F.least((F.col("i") + 2) / F.col("n"), (F.col("region") + 1) / F.col("level")) - F.greatest(F.col("i") / F.col("n"), F.col("region") / F.col("level"))
    return each.where(F.round(inside * F.col("n") / 2, 9) >= least).groupBy("word", "level", "region", "ngram").agg(F.count("*").alias("value"))


def nearest_word(labels: DataFrame, lex: DataFrame) -> DataFrame:
    """label -> guess, distance: the lexicon word of least normalised edit distance, ties by word.

    Words meet by their lengths, nearest first. A word that differs by k letters is at least k / longer away, so after the
    lengths within one, a label asks only for those lengths that its best distance so far leaves open. Exact, and an equality join.
    """
    sizes = lex.select(F.char_length("word").alias("size")).distinct()
    n = F.char_length("label")

    def best(asked: DataFrame) -> DataFrame:
        met = asked.join(lex.withColumn("size", F.char_length("word")), "size").withColumn("distance", F.round(normalised_levenshtein(F.col("label"), F.col("word")), 9))
        return met.groupBy("label").agg(F.min(F.struct("distance", "word")).alias("b"))

    labels = labels.select("label").distinct()
    close = best(labels.select("label", F.explode(F.array(n - 1, n, n + 1)).alias("size")))
    # a table of lengths has a row for each length there is
    far = labels.join(close, "label", "left").join(F.broadcast(sizes), F.abs(n - F.col("size")) > 1)
    least = F.abs(n - F.col("size")) / F.greatest(n, F.col("size"))
    rest = best(far.where(F.col("b").isNull() | (F.round(least, 9) <= F.col("b.distance"))).select("label", "size"))
    found = close.unionByName(rest).groupBy("label").agg(F.min("b").alias("b"))
    return found.select("label", F.col("b.word").alias("guess"), F.round("b.distance", 6).alias("distance"))


def class_ids(words: DataFrame, key: str, order: str) -> DataFrame:
    """``key``, first, class_id (from 1 in order of first appearance), n. The numbers come from a range sort, not from one task."""
    each = words.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    placed = running_before(each.withColumn("one", F.lit(1)), (), ("first", key), ("one",))
    return placed.select(key, "first", "n", (F.col("one_before") + 1).alias("class_id"))


def spotted(words: DataFrame, grams: DataFrame, id_col: str, recall: float, seed: str = "spot") -> DataFrame:
    """The words (id, word) with hits, the array of (at, gram) of the n-grams' occurrences that are found, by place.

    Each is found with probability ``recall``, drawn from a hash of (seed, n-gram, id, place), so that runs and engines agree. Where the
    n-grams stand is worked out once for words written alike; no row per occurrence is made.
    """
    met = words.select("word").distinct().join(F.broadcast(grams.select("ngram")), F.col("word").contains(F.col("ngram")))
    each = met.select("word", F.explode(positions(F.col("word"), F.col("ngram"), overlapping=False)).alias("at"), F.col("ngram").alias("gram"))
    places = each.groupBy("word").agg(F.array_sort(F.collect_set(F.struct("at", "gram"))).alias("all"))
    draw = lambda h: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), h["gram"], F.col(id_col).cast("string"), h["at"].cast("string"))), 1, 7), 16, 10).cast("double") / float(16**7)
    return words.join(small(places), "word", "left").select(*words.columns, F.filter("all", lambda h: draw(h) < recall).alias("hits"))


def simulate_step(words: DataFrame, grams: DataFrame, lex: DataFrame, id_col: str, *, recall: float = 0.5, few: int = 10, pad: int = 0) -> DataFrame:
    """id, n_letters, spotted_share, n_candidates, transcribed of each word after one pass over the n-grams.

    The candidates of a word are the lexicon words that fit the anchored pattern of what was spotted; up to ``few`` of
    them mean that it can be transcribed. Equal hits in words of equal length are worked out once, equal patterns are matched once.
    """
    words = materialise(words.select(id_col, "word"), "step-words")
    n_letters = F.char_length("word")
    each = materialise(spotted(words, grams, id_col, recall).select(id_col, n_letters.alias("n_letters"), F.when(F.size("hits") > 0, F.col("hits")).alias("hits")), "step-hits")
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + F.char_length(h["gram"]) - 1)))))
    # overlapping hits can't stand one after the other in a pattern: the leftmost ones are taken
    none = F.expr("cast(array() as array<struct<at:int,gram:string>>)")
    apart = F.aggregate("hits", none, lambda done, h: F.when((F.size(done) == 0) | (h["at"] >= F.try_element_at(done, F.lit(-1))["at"] + F.char_length(F.try_element_at(done, F.lit(-1))["gram"])), F.concat(done, F.array(h))).otherwise(done))
    kinds = each.where("hits IS NOT NULL").select("n_letters", "hits").distinct()
    kinds = materialise(kinds.select("n_letters", "hits", covered.alias("n_spotted"), partial_pattern(apart, F.col("n_letters"), pad).alias("pattern")), "step-kinds")
    patterns = kinds.select("pattern", "n_letters").distinct()
    # padding lets a word be longer or shorter: each pattern asks for every length it may have
    asked = patterns.withColumn("size", F.explode(F.sequence(F.col("n_letters") - 20 * pad, F.col("n_letters") + 20 * pad)))
    fits = asked.join(lex.withColumn("size", F.char_length("word")), "size").where(F.expr("regexp_like(word, pattern)"))
    counted = fits.groupBy("pattern", "n_letters").agg(F.count("*").alias("n_candidates"))
    known = materialise(kinds.join(counted, ["pattern", "n_letters"], "left"), "step-known")
    out = each.join(small(known, 500_000), ["n_letters", "hits"], "left")
    share = F.round(F.coalesce(F.col("n_spotted"), F.lit(0)) / F.col("n_letters"), 6)
    n = F.coalesce("n_candidates", F.lit(0))
    return out.select(id_col, "n_letters", share.alias("spotted_share"), n.alias("n_candidates"), (F.col("pattern").isNotNull() & (n <= few)).alias("transcribed"))


def progress_buckets(step: DataFrame) -> DataFrame:
    """Words by share spotted: below .2, .4, .6, .8 and the rest."""
    s = F.col("spotted_share")
    edge = lambda lo, hi: F.sum(((s >= lo) & (s < hi)).cast("int"))
    return step.agg(*[edge(lo, hi).alias(f"b{i}") for i, (lo, hi) in enumerate(((-1, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 9)))], F.sum(F.col("transcribed").cast("int")).alias("n_transcribed"))
