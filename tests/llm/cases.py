"""Small inputs with every odd case, and plain re-statements of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, row string, key string, bucket int"
SF = "/root/testdata/sf0.001"


def odd_rows():
    """(doc_id, text): nulls, empty and odd texts, equal texts, a repeated row, a long text, near copies."""
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    base, other, long = say(120).split(), say(40), say(6000)
    rows = [(0, None), (1, ""), (2, "   \n"), (3, "one"), (4, "one"), (5, "One two three"), (6, "one two three"), (7, long), (8, long + " end"),
            (9, other), (9, other), (10, "12 34 !!"), (None, other), (11, "a b c d e f"), (12, "a b c d e f"), (13, "a b c d e g")]
    for i in range(20, 50):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(names)
        rows.append((i, " ".join(words) + ("" if i % 3 else " " + say(5))))
    rows += [(i, say(rng.randint(3, 30))) for i in range(60, 80)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if t else None, "s", 1, 2, "x", "y", 3) for i, t in rows], SCHEMA)


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        sets.setdefault(i, []).append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in ids}, sets
