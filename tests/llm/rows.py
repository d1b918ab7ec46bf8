"""A small table with every awkward case: nulls, blanks, repeats, ties, long and non-ASCII texts, clashing columns."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def awkward(seed: int = 5, n: int = 120) -> list[tuple]:
    """(doc_id, text) rows; ids are not in order."""
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["the", "of", "and", "Über", "é中", "😀x"]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    run = "\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(6))
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(6, 80))) for _ in range(5)]
    rows: list[tuple] = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a  b\tc\nd"), (8, "x" * 3000), (9, " ".join(["same"] * 400)), (None, "null id text here"), (None, None)]
    for i in range(n):
        k = r.random()
        if k < 0.3:
            t = r.choice(base).split()
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = r.choice(vocab)
            text = " ".join(t)
        elif k < 0.5:
            text = f"start {i}\n{run if r.random() < 0.6 else passage}\nend {i % 7}"
        else:
            text = "\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(0, 15))) for _ in range(r.randint(1, 8)))
        rows.append((100 + (i * 37) % 997, text))
    rows += [rows[20], rows[30], rows[30]]
    r.shuffle(rows)
    return rows


def frame(spark, rows, clash: bool = True):
    """The rows as documents, with columns named like the operators' own."""
    full = [(i, t, "en", None if k % 5 == 0 else f"src{k % 3}", len(t or ""), k, None, "x", "y") for k, (i, t) in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    if clash:
        return spark.createDataFrame(full, names + ", key long, digest string, kept string, row string")
    return spark.createDataFrame([f[:5] for f in full], names)
