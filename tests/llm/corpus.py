"""A small corpus with every hard case: copies, near copies, shared passages, nulls, long and empty texts."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, lang string, n long, node string, row string, bucket int, key int, size string, h string, part int"


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def rows(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(2, 7))) for _ in range(400)] + ["the", "of", "and"] * 40
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(60)
    out = []
    for i in range(n):
        t = text(r.randint(5, 120))
        if i % 6 == 0:
            t = t + " " + passage + " " + text(5)
        out.append([i, t, f"s{i % 4}", "en" if i % 2 else "de"])
    for i in range(12):  # near copies of one document, and copies of another
        w = out[3][1].split()
        w[r.randrange(len(w))] = "changed"
        out.append([n + i, " ".join(w), "s0", "en"])
        out.append([n + 20 + i, out[5][1], "s1", "en"])
    out += [[n + 40, None, None, None], [n + 41, "", "s9", "en"], [n + 42, "One two", "s2", "en"], [n + 43, "one TWO", "s2", "en"], [n + 44, " \t\n ", "s2", "en"]]
    out += [[n + 45, text(6000), "s3", "en"], [None, text(30), "s3", "en"], [n + 42, "One two", "s2", "en"], [n + 46, "x" * 300, "s2", "en"], [n + 47, "x" * 120, "s2", "en"]]
    r.shuffle(out)
    extra = [7, "a", "b", 1, 2, "c", "d", 3]
    return [tuple(x + extra) for x in out]


def frame(spark, seed=1, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
