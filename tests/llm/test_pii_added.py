import random

from marginalia.llm import pii


def planted(seed, n):
    """Texts with secrets and written-out addresses, each with its span, and decoys that look like them."""
    rng, rows, truth = random.Random(seed), [], {}
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(3, 9)))
    for d in range(n):
        a, b = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(12))
        kind = d % 6
        if kind == 0:
            lead, span, what = 'token = "', "".join(rng.choice("0123456789abcdef") for _ in range(40)), "secret"
        elif kind == 1:
            lead, span, what = "mail me at ", f"{word()}.{word()} (at) {word()} (dot) com", "email"
        elif kind == 2:
            lead, span, what = "from ", f"{word()}{rng.randrange(10)}@{word()}.example.org", None
        elif kind == 3:
            lead, span, what = "serial ", "".join(rng.choice("123456789") for _ in range(15)) + "0", None
            while pii.luhn(span):
                span = span[:-1] + str((int(span[-1]) + 1) % 10)
        elif kind == 4:
            lead, span, what = "see ", f"{word()}-{word()}-part-{rng.randrange(10)}-of-{word()}-{word()}", None
        else:
            lead, span, what = "card ", "4", None
            span = next(s for s in iter(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)), None) if pii.luhn(s))
        rows.append((d, f'{a} {lead}{span}" {b}'))
        if what:
            truth[d] = (what, len(a) + 1 + len(lead), len(a) + 1 + len(lead) + len(span))
    return rows, truth


def test_added_spans_on_held_out_texts(spark):
    """The model learns from one set of texts without labels and is held against the planted spans of another."""
    model = pii.train(spark.createDataFrame(planted(1, 300)[0], "doc_id long, text string"))
    rows, truth = planted(2, 300)
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    added = {(r.doc_id, s.kind, s.start, s.end) for r in found for s in r.added}
    right = {(d, *s) for d, s in truth.items()}
    assert len(added & right) >= 0.95 * len(right) and len(added & right) >= 0.95 * len(added)
