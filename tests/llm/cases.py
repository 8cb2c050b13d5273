"""Rows that every operator must bear."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, spans int, kept double, label int, key string, d string, node int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def rows():
    long = words(1, 25_000)
    base = words(2, 120)
    texts = [base, base, base + " tail", None, "", " \n\t ", "one", "one two three", long, long[: len(long) // 2], words(3, 40) + " " + " ".join(base.split()[20:60]), "Ünï çödé 日本 — …", "x" * 5000, "a b " * 300, words(4, 30)]
    out = [(i, t, ["en", "de", None][i % 3], ["s", None, "t"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[0], (0, words(5, 25), "en", "s", 1), (None, base, None, None, 0), (None, None, None, None, None)]
    return [r + ("clash", 1, 0.5, 2, "k", "d", 3) for r in out]
