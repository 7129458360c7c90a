"""Fill-in-the-middle: a text is cut at two units into prefix, middle and suffix and put together in another order.

All in column expressions, by escaped marker injection: the delimiter is escaped where the text has it, ``regexp_replace``
puts it behind every unit, its count is the number of units, ``substring_index`` takes the parts by rank, and the parts are
unescaped and assembled. The cuts are drawn from a hash of the id, so a rerun, or a task run anew, cuts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import free_name

#: Units as patterns that cover every character of an escaped text, matched left to right; none parts an escaped character.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+\s*|\s+", "character": r"\x02[de]|(?s:.)"}
#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
DELIMITER, ESCAPE = "\x01", "\x02"


def escape(text: Column) -> Column:
    """Without DELIMITER; ESCAPE stands only before ``e`` (itself) or ``d`` (the delimiter)."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers from the SHA-256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _without_delimiter(parts: Column) -> Column:
    return unescape(F.replace(parts, F.lit(DELIMITER), F.lit("")))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """Every row with all its columns, and n, form, prefix_chars, middle_chars and output.

    n is the number of units. Of the four draws of an id, the smaller of the first two modulo n + 1 is the units before the
    middle, the larger the units before the suffix; the third leaves 100 - ``percent`` in a hundred texts plain; the fourth
    makes ``spm_percent`` in a hundred of the others ``spm`` (suffix, prefix, middle), else ``psm`` (prefix, suffix, middle).
    Texts that are empty or hold a marker are ``plain``: the output is the text and the lengths are null.

    Null texts count as empty (the input column stays null). Parts may be empty: a text of one line has at most one part
    that isn't. Control characters, the delimiter among them, are text like any other. Repeated rows come out alike; rows that
    share an id but not the text are cut by the same draws. An empty table gives an empty one. Columns of the input that have the
    name of a result are an error, any other name will do. Row by row, nothing is shuffled, however long a text is.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    if clash := {c.lower() for c in docs.columns} & set(added):
        raise ValueError(f"columns of the input have names of the result: {sorted(clash)}")
    names = {x: free_name([*docs.columns, *added], x) for x in ("text_", "draw_", "cut_", "part_")}
    text, draw, cut, part = map(F.col, names.values())
    p, s, m = map(F.lit, markers)
    drawn = docs.withColumn(names["text_"], F.coalesce(docs[text_col], F.lit(""))).withColumn(names["draw_"], F.array(*draws(docs[id_col], seed)))
    marked = drawn.withColumn(names["cut_"], F.regexp_replace(escape(text), f"({UNITS[unit]})", f"$1{DELIMITER}"))
    counted = marked.withColumn("n", (F.char_length(cut) - F.char_length(F.replace(cut, F.lit(DELIMITER), F.lit("")))).cast("long"))
    first, second = (F.get(draw, F.lit(k)) % (F.col("n") + 1) for k in range(2))
    low, high = F.least(first, second).cast("int"), F.greatest(first, second).cast("int")
    upto = lambda c, k: F.call_function("substring_index", c, F.lit(DELIMITER), k)
    parts = F.struct(
        _without_delimiter(upto(cut, low)).alias("prefix"),
        _without_delimiter(F.when(high > low, upto(upto(cut, high), low - high)).otherwise("")).alias("middle"),
        _without_delimiter(upto(cut, high - F.col("n").cast("int") - 1)).alias("suffix"),
    )
    whole = (text == "") | text.contains(markers[0]) | text.contains(markers[1]) | text.contains(markers[2]) | (F.get(draw, F.lit(2)) % 100 >= percent)
    formed = counted.withColumn("form", F.when(whole, "plain").when(F.get(draw, F.lit(3)) % 100 < spm_percent, "spm").otherwise("psm")).withColumn(names["part_"], parts)
    prefix, middle, suffix = (part[x] for x in ("prefix", "middle", "suffix"))
    return formed.select(
        *[F.col(f"`{c}`") for c in docs.columns], "n", "form",
        F.when(F.col("form") != "plain", F.char_length(prefix).cast("long")).alias("prefix_chars"), F.when(F.col("form") != "plain", F.char_length(middle).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of, exactly: no part holds a marker (whose ends must differ, so that it can't overlap itself)."""
    p, s, m = markers
    between = lambda a, b: F.call_function("substring_index", F.call_function("substring_index", output, F.lit(b), F.lit(1)), F.lit(a), F.lit(-1))
    last = F.call_function("substring_index", output, F.lit(m), F.lit(-1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), last, between(s, m))).otherwise(F.concat(between(p, m), last, between(s, p)))
