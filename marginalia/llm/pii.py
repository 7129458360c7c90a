"""PII spans by weak supervision: labelers vote, EM weighs them, and a span classifier adds to the base patterns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import narrow, text_chunks
from marginalia.runtime import ship_package

#: The kinds of the base patterns, and all: secrets are found by the vote alone.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Wider forms that only the vote can admit.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+", re.IGNORECASE),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[./_][0-9]{4}){3}|[0-9]{13,19})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[1-9][0-9 -]{8,16}[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,40}[0-9])[A-Za-z0-9+/_-]{20,}"),
}
#: A wide form can't be there without one of these in lower case, which are much faster to look for. ASCII letters of
#: the wide forms match others only in case: none of a, t, d and o folds with a letter outside ASCII.
HINTS = {"email": ("at)", "at]", "at}"), "ip": ("[.]", "(.)", "dot]", "dot)"), "card": None, "phone": None, "secret": None}

#: Gazetteers and context words.
TOP_LEVELS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn br in ru ch at be se no dk fi pl pt".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
FOR = {
    "email": ("mail", "contact", "write", "reach", "courriel", "correo", "kontakt"), "ip": ("ip", "server", "host", "address", "adresse", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "carte", "tarjeta", "karte"), "phone": ("phone", "tel", "call", "mobile", "fax", "sms", "whatsapp", "telefon", "llama", "appelez"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "api", "key", "auth", "bearer", "credential"),
}
SECRET_PREFIXES = ("sk_", "pk_", "sk-", "ghp_", "gho_", "xoxb-", "xoxp-", "AKIA", "AIza", "eyJ")
AGAINST = ("version", "isbn", "issn", "order", "invoice", "ref", "section", "chapter", "doi", "page", "serial", "part no", "v.")
#: How much each labeler's vote weighs before anything is estimated: a check sum or an entropy tells more than a look.
START = np.array([0.5, 2.0, 0.5, 1.0, 0.5])
#: Bits of ``shape``.
SHAPES = 6
LABELERS = ("format", "validity", "gazetteer", "context", "boundary")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


HEX = frozenset("0123456789abcdefABCDEF")


def entropy(span: str) -> float:
    """Bits a character, by the span's own frequencies."""
    counts = np.array(list(Counter(span).values())) / len(span)
    return float(-(counts * np.log2(counts)).sum())


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> list[tuple[int, int]]:
    """What ``[local]+@`` and DOMAIN find from left to right, looking only around each ``@``."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's own patterns, leftmost and without overlap within a kind; failing matches are dropped."""
    out = {"email": emails(text)}
    out["ip"] = [m.span() for m in IP.finditer(text) if octets(m[0].split("."))]
    out["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return out


def wide_spans(text: str) -> list[tuple[str, int, int]]:
    out, lower = [], text.lower()
    for kind, pattern in WIDE.items():
        hints = HINTS[kind]
        if hints is None or any(h in lower for h in hints):
            out.extend((kind, *m.span()) for m in pattern.finditer(text))
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """1, -1 or 0 (no opinion) of each of LABELERS."""
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    before, near = text[start - 1 : start] if start else "", text[max(0, start - 40) : start].lower()
    after = text[end : end + 1]
    if kind == "email":
        plain = re.sub(r" ?[\[({]at[\])}] ?", "@", re.sub(r" ?[\[({]dot[\])}] ?", ".", span, flags=re.IGNORECASE), flags=re.IGNORECASE)
        local, _, domain = plain.partition("@")
        form = 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain) else -1
        valid = 1 if 1 <= len(local) <= 64 and ".." not in plain and not domain.startswith("-") else -1
        known = 1 if domain.rpartition(".")[2].lower() in TOP_LEVELS else -1
    elif kind == "ip":
        parts = NOT_DIGIT.sub(" ", span).split()
        form, valid = 1 if len(parts) == 4 and all(len(p) <= 3 for p in parts) else -1, 1 if octets(parts) else -1
        known = -1 if parts[0] in ("0", "127", "255") or span == "1.2.3.4" else 0
    elif kind == "card":
        form = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(?:[ ./_-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
        valid, known = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1, 1 if digits.startswith(CARD_PREFIXES) else -1
    elif kind == "secret":
        digital = set(span) <= HEX
        mixed = any(c.isdigit() for c in span) and any(c.isupper() for c in span) and any(c.islower() for c in span)
        form = 1 if (digital and len(span) >= 32) or mixed else -1
        valid = 1 if form == 1 and entropy(span) >= 3 else -1
        known = 1 if (digital and len(span) in (32, 40, 64)) or span.startswith(SECRET_PREFIXES) else -1
    else:
        form = 1 if span[0] == "+" or re.fullmatch(r"\([2-9][0-9]{2}\) ?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}", span) else -1
        valid = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        known = 1 if span[0] == "+" or digits.startswith("00") or (len(digits) == 10 and digits[0] > "1" and digits[3] > "1") else -1
    context = 1 if any(w in near for w in FOR[kind]) else -1 if any(w in near for w in AGAINST) else 0
    boundary = -1 if (before.isalnum() or after.isalnum() or before in ("#", "=", "/", "_", "-") and before) else 1
    return form, valid, known, context, boundary


def shape(text: str, start: int, end: int) -> int:
    """A span's coarse form, which no labeler looks at: whether it has a separator or a bracket, is long, has letters, is mostly
    digits, and stands at the start of its line."""
    span = text[start:end]
    bits = (" " in span or "-" in span, any(c in span for c in "([{+"), end - start > 20, any(c.isalpha() for c in span), 2 * sum(c.isdigit() for c in span) > end - start, start == 0 or text[start - 1] == "\n")
    return sum(b << i for i, b in enumerate(bits))


WIDTH = len(ALL_KINDS) + 2 * len(LABELERS) + SHAPES


@dataclass(frozen=True)
class SpanModel:
    """Reliabilities by labeler and kind, and the classifier's weights."""

    weights: np.ndarray
    bar: float

    def admits(self, kind: str, vote: tuple[int, ...], form: int) -> bool:
        return 1 / (1 + np.exp(-float(features(kind, vote, form) @ self.weights))) >= self.bar


def features(kind: str, vote: tuple[int, ...], form: int) -> np.ndarray:
    x = np.zeros(WIDTH)
    x[ALL_KINDS.index(kind)] = 1
    for i, v in enumerate(vote):
        x[len(ALL_KINDS) + 2 * i] = v == 1
        x[len(ALL_KINDS) + 2 * i + 1] = v == -1
    x[-SHAPES:] = [form >> i & 1 for i in range(SHAPES)]
    return x


def fit(patterns: list[tuple[str, tuple[int, ...], int, int]], *, rounds: int = 60, bar: float = 0.9) -> SpanModel:
    """From (kind, votes, shape, count) rows: EM for each labeler's reliability, then logistic regression.

    The hidden label of a span is personal data or not. EM alternates between its posterior, with labelers
    independent given it, and the share of each vote under either label, by kind, starting from a vote weighed by ``START``. The
    classifier then learns the posteriors, so that it also weighs shapes, which no labeler looks at.
    """
    if not patterns:
        return SpanModel(np.zeros(WIDTH) - 9, bar)
    vote = np.array([p[1] for p in patterns])
    count = np.array([p[3] for p in patterns], dtype=float)
    kind = np.array([ALL_KINDS.index(p[0]) for p in patterns])
    good = 1 / (1 + np.exp(-1.5 * vote @ START))
    for _ in range(rounds):
        logit = np.zeros(len(patterns))
        for k in np.unique(kind):
            at = kind == k
            mass = (count[at] @ good[at], count[at] @ (1 - good[at]))
            logit[at] = np.log((mass[0] + 1) / (mass[1] + 1))
            for j in range(vote.shape[1]):
                for v in (-1, 1):
                    same = at & (vote[:, j] == v)
                    # one span of each label agrees with a labeler that is right four times in five
                    yes = (count[same] @ good[same] + (0.8 if v == 1 else 0.2)) / (mass[0] + 1)
                    no = (count[same] @ (1 - good[same]) + (0.2 if v == 1 else 0.8)) / (mass[1] + 1)
                    logit[same] += np.log(yes / no)
        good = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    x = np.stack([features(p[0], p[1], p[2]) for p in patterns])
    weights, share = np.zeros(x.shape[1]), np.log1p(count) / np.log1p(count).sum()
    for _ in range(3000):
        weights -= 2.0 * (x.T @ (share * (1 / (1 + np.exp(-x @ weights)) - good)) + 1e-4 * weights)
    return SpanModel(weights, bar)


def _decoded(texts: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> SpanModel:
    """The model over all candidates of all texts. What reaches the driver is the number of candidates by
    kind, votes and shape: at most 5 * 3**5 * 64 rows, whatever the corpus."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for _, texts in text_chunks(batches):
            for t in _decoded(texts):
                found = [(k, s, e) for k, spans in base_spans(t).items() for s, e in spans]
                found += [w for w in wide_spans(t) if all(w[2] <= s or e <= w[1] for _, s, e in found)]
                for k, s, e in found:
                    key = (k, *votes(t, k, s, e), shape(t, s, e))
                    seen[key] = seen.get(key, 0) + 1
        cols = list(zip(*seen, strict=True)) if seen else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int32()) for c in cols[1:]), pa.array(seen.values(), pa.int64())], names=["kind", *LABELERS, "shape", "n"])

    rows = narrow(docs, id=id_col, text=text_col)
    counted = rows.mapInArrow(run, f"kind string, {', '.join(f'{c} int' for c in LABELERS)}, shape int, n long").groupBy("kind", *LABELERS, "shape").agg(F.sum("n").alias("n"))
    return fit([(r.kind, tuple(r[c] for c in LABELERS), r["shape"], r.n) for r in counted.orderBy("kind", *LABELERS, "shape").collect()], **options)


def find_spans(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, base and added, arrays of (kind, start, end), sorted by kind as listed
    and start, in code points with the end exclusive, and n_email, n_ip, n_card, n_phone of the base.

    Base spans always stay; a wide candidate is added if the classifier admits it and it touches neither a base
    span nor an added one. Null and empty texts have no spans. Repeated rows are read one by one, null ids
    are passed through, an empty table gives an empty result, and other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            base, added, counts = [], [], []
            for t in _decoded(texts):
                found = base_spans(t)
                base.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in found[k]])
                counts.append([len(found[k]) for k in KINDS])
                taken, more = [se for spans in found.values() for se in spans], []
                for k, s, e in wide_spans(t):
                    if all(e <= a or b <= s for a, b in taken) and model.admits(k, votes(t, k, s, e), shape(t, s, e)):
                        taken.append((s, e))
                        more.append({"kind": k, "start": s, "end": e})
                added.append(more)
            n = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(base, span), pa.array(added, span), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(4))], names=["id", "base", "added", *(f"n_{k}" for k in KINDS)])

    kind = rows.schema["id"].dataType.simpleString()
    array = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"id {kind}, base {array}, added {array}, {', '.join(f'n_{k} long' for k in KINDS)}").withColumnRenamed("id", id_col)


def spans_text(spans):
    """kind:start:end of every span, by kind as in ``ALL_KINDS`` and start, joined by commas."""
    order = F.array(*map(F.lit, ALL_KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets, from the last span to the first."""
    for kind, start, end in sorted(spans, key=lambda s: -s[1]):
        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
    return text
