"""Rows of the small test table, and words and shingles by definition."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def word_list(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width):
    w = word_list(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [prose(60) for _ in range(12)]
    out = []
    for i in range(60):
        lines = [prose(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            words = base[i % 12].split()
            words[rng.randrange(60)] = "changed"
            lines.insert(0, " ".join(words))
        if i % 5 == 0:
            lines.append("Licensed under CC BY-NC 4.0.")
        out.append((i, "\n".join(lines), f"s{i % 4}"))
    out += [(60, out[3][1], "s0"), (61, out[3][1], None), (62, out[3][1].upper(), "s0"), (63, "", "s1"), (64, None, "s1"), (65, " \n\t\n ", "s2"),
            (66, prose(20000), "s3"), (67, "été naïve 東京 \U0001f600 ﬁn", "s2"), (68, "one", "s2"), (68, "one", "s2"), (None, "no id here at all", "s1")]
    return out
