"""Documents for tests, with extra columns whose names clash with the operators' own."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, chunk string, score string, item_id string, copies int, sig string, steps int, parts int, label string"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 7, "c", "x", "i", 3, "g", 4, 5, "l") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentences(n, seed=0, vocabulary=3000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(text, width=5):
    w = words(text)
    if 0 < len(w) < width:
        return {tuple(w)}
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
