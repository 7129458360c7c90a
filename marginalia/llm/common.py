"""Pieces the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. ``lower`` is the faster way where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name in any case."""
    taken = {c.lower() for c in taken}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names; other columns cannot clash."""
    return docs.select(*[docs[c].alias(k) for k, c in columns.items()])


def text_chunks(batches, budget: int = 2 << 20):
    """From Arrow batches of (id, text): lists of ids and of UTF-8 bytes (null: empty), about ``budget``
    bytes at a time; a longer text comes alone. Bounds what a worker holds beside one Arrow batch."""
    import pyarrow as pa

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        at, size = 0, 0
        for i in range(len(ids)):
            n = len(texts[i].as_buffer()) if texts[i].is_valid else 0
            if size and size + n > budget:
                yield ids[at:i], [t or b"" for t in texts.slice(at, i - at).to_pylist()]
                at, size = i, 0
            size += n
        if at < len(ids):
            yield ids[at:], [t or b"" for t in texts.slice(at).to_pylist()]
