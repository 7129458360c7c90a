"""Label and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels of the position histogram, its alphabet, and those of its bigrams.
PHOC_LEVELS = (2, 3, 4, 5)
PHOC_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
PHOC_BIGRAM_LEVELS = (2,)
#: The bigrams of the position histogram's bigram part.
PHOC_BIGRAMS = "er in es ti te at on an en st al re is ed le ra ri li ar ng ne ic or nt ss ro la se de co ca ta io it si us ea ac el ma na ni tr ch di ia et to un ns".split()
#: Fixed value: the share of a unit that must lie in a region for a hard count.
HARD_SHARE, BIGRAM_SHARE = 0.49, 0.48


def clean_words(text: Column) -> Column:
    """Words of a transcription: dashes and brackets split, other marks but ``&()`` go, parentheses stand alone."""
    spaced = F.regexp_replace(text, r"[-_~\[\]]", " ")
    kept = F.regexp_replace(spaced, r"[^A-Za-z0-9_\s&()]", "")
    padded = F.regexp_replace(kept, r"([()])", " $1 ")
    flat = F.trim(F.regexp_replace(padded, r"\s+", " "))
    return F.array_remove(F.split(F.lower(flat), " "), "")


def bare_word(word: Column) -> Column:
    """A word without anything but letters, digits and underscore, in lower case."""
    return F.lower(F.regexp_replace(word, r"[^A-Za-z0-9_]", ""))


def ngrams(word: Column, n: int) -> Column:
    """All n-grams of a word in order; none if it is shorter."""
    count = F.char_length(word) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def positions(word: Column, gram: Column, *, overlapping: bool = True) -> Column:
    """1-based places of ``gram`` in ``word``; without overlap, a hit within the last taken one is passed over."""
    starts = F.when(
        F.char_length(word) >= F.char_length(gram), F.sequence(F.lit(1), F.greatest(F.char_length(word) - F.char_length(gram) + 1, F.lit(1)))
    ).otherwise(F.array().cast("array<int>"))
    every = F.filter(starts, lambda i: F.substr(word, i, F.char_length(gram)) == gram)
    if overlapping:
        return every
    none = F.array().cast("array<int>")
    return F.aggregate(every, none, lambda done, i: F.when((F.size(done) == 0) | (i >= F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.char_length(gram)), F.concat(done, F.array(i))).otherwise(done))


def normalised_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; null for two empty strings."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer > 0, F.levenshtein(a, b) / longer)


def length_code(word: Column, n: int) -> Column:
    """1, 2, ... up to the word's length, then zeros, ``n`` values in all."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= F.char_length(word), i).otherwise(0))


def partial_pattern(hits: Column, length: Column, pad: int = 0) -> Column:
    """An anchored pattern from the n-grams found in a word: ``hits`` are structs (at, gram), sorted, at from 1.

    The letters between hits may be any, as many as the places say, give or take ``pad``.
    """
    gap = lambda n: F.concat(F.lit("[a-z]{"), F.greatest(n - pad, F.lit(0)).cast("string"), F.lit(","), (n + pad).cast("string"), F.lit("}"))
    start = F.struct(F.lit("^").alias("p"), F.lit(1).alias("next"))
    walked = F.aggregate(hits, start, lambda s, h: F.struct(F.concat(s["p"], gap(h["at"] - s["next"]), h["gram"]).alias("p"), (h["at"] + F.char_length(h["gram"])).cast("int").alias("next")))
    return F.concat(walked["p"], gap(length + 1 - walked["next"]), F.lit("$"))
