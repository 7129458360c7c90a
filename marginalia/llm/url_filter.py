"""URL filters: host and path rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import UPPER, narrow
from marginalia.runtime import ship_package

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Words of the labelled table. A host is to block if it has a word of BLOCKED; WEAK words stand in both kinds of host, and
#: many of ALLOWED hold a blocked or weak word's letters.
BLOCKED = ("ads", "adult", "adserver", "banners", "bets", "betting", "bingo", "cams", "casino", "cialis", "escorts", "jackpot", "malware", "phishing", "pills", "poker", "popads", "popunder", "porn", "roulette", "slots", "spam", "viagra", "xxx")
WEAK = ("best", "bonus", "buy", "cheap", "claim", "click", "free", "hot", "live", "online", "play", "prize", "shop", "track", "win")
ALLOWED = (
    "address", "adulthood", "adventure", "alphabets", "archive", "beads", "bicycle", "bookclick", "broadsheet", "budget", "cambridge", "camera", "campus", "casing", "caterpillar", "chemistry", "clicker", "council", "daily", "essex",
    "essays", "forum", "freedom", "freelance", "garden", "hardware", "headlines", "health", "herald", "history", "hospital", "kitchen", "library", "liverpool", "manuscripts", "maps", "meadows", "middlesex", "museum", "music", "news", "nurses",
    "onlooker", "papers", "pillar", "pillow", "player", "pokemon", "poetry", "porcelain", "prizewinners", "railroads", "recipes", "records", "roads", "science", "school", "sextant", "shipping", "slotcar", "soundtrack", "spaniel", "sports", "station", "street", "sussex", "teachers",
    "theatre", "theory", "thermal", "threads", "trackandfield", "travel", "weather", "wildlife", "windows", "winter", "workshop",
)
#: Of these, words are made up that mean nothing.
SYLLABLES = ("a", "al", "an", "ar", "as", "be", "ble", "ca", "ed", "el", "en", "er", "es", "ha", "he", "her", "hon", "in", "ing", "is", "la", "le", "li", "ly", "ma", "nd", "ne", "nt", "on", "or", "ou", "ra", "re", "ri", "ro", "se", "sh", "st", "ta", "te", "th", "ti", "tion", "to", "un", "ve", "wh")


def labelled(parts: Sequence[int] = (0, 1, 2, 3)) -> list[tuple[str, str, int]]:
    """The small labelled table by rule: host, path and 1 for what is to block, in four parts told apart by a hash of the host.

    Blocked words go with weak ones; allowed and made-up words alone, in pairs and with weak ones. Subdomains, endings and
    paths are dealt by the hash, alike for both labels, so that they say nothing.
    """
    names: dict[str, int] = {}
    for b in BLOCKED:
        names |= {b: 1, f"my{b}": 1} | {f"{x}{dash}{y}": 1 for w in WEAK for x, y in ((w, b), (b, w)) for dash in ("-", "")}
    made = ["".join(SYLLABLES[zlib.crc32(f"{i}:{k}".encode()) % len(SYLLABLES)] for k in range(2 + i % 3)) for i in range(700)]
    plain = [*ALLOWED, *made]
    for i, g in enumerate(plain):
        other, w = plain[zlib.crc32(f"{g}:{i}".encode()) % len(plain)], WEAK[i % len(WEAK)]
        names |= {g: 0} | ({f"{g}-{other}": 0, f"{w}-{g}": 0, f"{g}-{w}": 0} if i < len(ALLOWED) or i % 4 == 0 else {})
    names |= {w: 0 for w in WEAK}
    out = []
    for name, y in names.items():
        h = zlib.crc32(name.encode())
        if (h >> 3) % 4 in parts:
            lead, end = ("", "www.", "m.", "blog.")[h % 4], ("example.com", "example.net", "example.org", "com", "net", "pages.example.com", "host.example.net")[h // 4 % 7]
            path = ("/", "/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/page/{}")[h // 32 % 6].format(h // 256 % 10_000)
            out.append((f"{lead}{name}.{end}", path, y))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty for null and where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    def fits(rule: str) -> Column:
        h, slash, p = rule.partition("/")
        return ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))

    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    pick = lambda value: reduce(lambda c, r: c.when(fits(r[1]), value(r)), ordered[1:], F.when(fits(ordered[0][1]), value(ordered[0])))
    return pick(lambda r: F.lit(r[1])), pick(lambda r: F.lit(r[0]))


@dataclass(frozen=True)
class UrlModel:
    """Weights by hashed n-gram; bounded by ``2 ** bits`` values whatever the corpus."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    bits: int

    def margin(self, host: str, path: str) -> float:
        at = features(host, path, self.sizes, self.bits)
        return float(self.weights[at].sum() / np.sqrt(max(len(at), 1)) + self.bias)


def features(host: str, path: str, sizes: Sequence[int], bits: int) -> np.ndarray:
    """Slots of the distinct n-grams of host and of path, which are told apart."""
    grams = set()
    for mark, s in ((b"h", host), (b"p", path)):
        b = b"^" + s.encode("utf-8", "surrogatepass") + b"$"
        for n in sizes:
            grams.update(mark + b[i : i + n] for i in range(len(b) - n + 1))
    return np.unique(np.fromiter((zlib.crc32(g) & ((1 << bits) - 1) for g in grams), dtype=np.int64, count=len(grams)))


def train(rows: Sequence[tuple[str, str, int]] | None = None, *, sizes: Sequence[int] = (3, 4), bits: int = 16, rounds: int = 600, rate: float = 2.0, l2: float = 1e-5) -> UrlModel:
    """Full-batch logistic regression over the (small) labelled table of host, path and label."""
    rows = labelled() if rows is None else rows
    slots = [features(host, path, sizes, bits) for host, path, _ in rows]
    y = np.array([v for *_, v in rows], dtype=float)
    used, place = np.unique(np.concatenate(slots), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in slots])
    value = 1 / np.sqrt(np.array([max(len(r), 1) for r in slots], dtype=float))[row]
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        gap = 1 / (1 + np.exp(-(np.bincount(row, value * w[place], len(rows)) + bias))) - y
        w -= rate * (np.bincount(place, value * gap[row], len(used)) / len(y) * 16 + l2 * w)
        bias -= rate * gap.mean()
    whole = np.zeros(1 << bits)
    whole[used] = w
    return UrlModel(whole, bias, tuple(sizes), bits)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, score.

    The longest fitting rule decides; where none fits, the model blocks urls whose probability
    reaches ``threshold``. score is that probability, given for every row. Null urls and urls without
    ``://`` have an empty host and path, which no rule fits; the model judges them like any other. Of equal rules the first
    counts, of rules of one length that fit the first in order. Urls are read whole, however long.
    Repeated rows are judged one by one, an empty table gives an empty result, and only the two
    named columns are read. The model (at most ``2 ** bits`` weights) travels with the task.
    """
    ship_package(pages.sparkSession)
    model = model or train()

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            margins = np.array([model.margin(h or "", p or "") for h, p in zip(hosts, paths, strict=True)], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-margins)))

    host, path = host_and_path(F.col("url"))
    rows = narrow(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    scored = rows.withColumn("score", F.pandas_udf(score, "double")("host", "path"))
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
