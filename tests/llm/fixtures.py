"""Small tables with the cases every text operator must bear."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns with names that operators use themselves.
CLASHING = SCHEMA + ", score double, label int, rank int, fp string, key string, size int, number int, repeats int, pii int, cuts int, line_runs int"


def sentence(seed: int, words: int = 12) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words)).capitalize() + "."


def text(seed: int, lines: int = 4) -> str:
    return "\n".join(sentence(seed * 1000 + i) for i in range(lines))


def document(i, t, source="s"):
    return (i, t, None, source, None if t is None else len(t))


def odd_rows() -> list[tuple]:
    """Nulls, empty texts, blanks only, one very long text, exact copies, repeated rows, null ids."""
    rows = [document(i, text(i)) for i in range(1, 9)]
    rows += [document(20, None), document(21, ""), document(22, " \n\t "), document(23, text(1)), document(24, text(1)), document(None, text(2)), document(None, text(2))]
    rows += [document(2, text(2)), document(2, text(2)), document(2, text(90)), document(30, text(31, 4000), None), document(31, "one", None)]
    return rows


def frames(spark):
    """The odd rows, the same with clashing extra columns, and an empty table."""
    rows = odd_rows()
    return [
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame([(*r, *[None] * 11) for r in rows], CLASHING),
        spark.createDataFrame([], SCHEMA),
    ]
