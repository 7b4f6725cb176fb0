"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """Copies, near copies, a passage many share, nulls in every column, blanks, a long text, repeated rows."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    rows = []

    def add(text, lang="en", source="a", doc_id=-1):
        rows.append((len(rows) if doc_id == -1 else doc_id, text, lang, source, len(text) if text is not None else None))

    for _ in range(12):
        add(base)                                                    # exact copies
    for k in range(14):                                              # near copies, a few words changed
        words = base.split()
        for _ in range(1 + k % 4):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        add(" ".join(words), source="b")
    for k in range(8):                                               # a chain: each differs a little from the last
        words = (rows[-1][1] if k else prose(rng, 90)).split()
        words[(7 * k) % len(words)] = f"chain{k}"
        add(" ".join(words))
    for _ in range(10):
        add(prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 70), source="c")
    for _ in range(15):
        add(prose(rng, rng.randrange(1, 160)), source=rng.choice("abc"))
    for text in ("", " \t\n ", "one", "one two", "One TWO", "one two three", "\x0bx\x0cy\x0dz", "é è ê é è ê", None, None):
        add(text, source="d")
    add(prose(rng, 30000), source="long")
    add("null source here", source=None)
    add("null language", lang=None)
    add("null id", doc_id=None)
    add("repeated row here, the same twice", doc_id=900)
    add("repeated row here, the same twice", doc_id=900)
    add(prose(rng, 50), doc_id=901)
    add(prose(rng, 50), doc_id=901)
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None, extra: bool = False):
    """The rows as a table; with ``extra`` columns whose names clash with operators' own."""
    df = spark.createDataFrame(documents() if rows is None else rows, DOCUMENTS).repartition(3)
    if extra:
        for name in ("score", "kept", "component", "size", "taken", "target", "held_out", "n_words", "lang_id", "words"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df
